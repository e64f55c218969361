"""Seeded shuffle and exact train / validation / test split.

The reference shuffles an in-memory list with a seeded Mersenne twister and
cuts it at ``int(n*0.8)`` and ``int(n*0.1)``.  Here the shuffle order is the
md5 of ``seed:key`` (repeatable on any engine and any partitioning) and the
cut is exact: :func:`tessera.operators.ranking.labelled_cut` finds the keys at
the cut points, then every row is labelled by comparing its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import global_rank, hash_key, labelled_cut

SPLIT_LABELS = ["train", "valid", "test"]


def split_sizes(n: int, train_ratio: float = 0.8, valid_ratio: float = 0.1):
    """Same arithmetic as the reference: truncated double products."""
    n_train = int(n * train_ratio)
    n_valid = int(n * valid_ratio)
    return n_train, n_valid, n - n_train - n_valid


def with_shuffle_key(df: DataFrame, key_cols, seed: int = 42,
                     out: str = "shuffle_key") -> DataFrame:
    return df.withColumn(out, hash_key(seed, *key_cols))


def shuffled(df: DataFrame, key_cols, seed: int = 42) -> DataFrame:
    """Every row with its 0-based position in the seeded shuffle."""
    keyed = with_shuffle_key(df, key_cols, seed)
    return global_rank(keyed, "shuffle_key", key_cols, rank_col="shuffle_rank")


def exact_split(df: DataFrame, key_cols, seed: int = 42, train_ratio: float = 0.8,
                valid_ratio: float = 0.1) -> DataFrame:
    """Add ``shuffle_key`` (if it is not there) and ``split`` in {train,
    valid, test} with exact sizes.

    ``df`` is read for a count and two histograms of the key besides the
    labelling pass, so pass a written table where it is costly to derive.
    """
    keyed = df if "shuffle_key" in df.columns else with_shuffle_key(df, key_cols, seed)

    def bounds(n):
        n_train, n_valid, _ = split_sizes(n, train_ratio, valid_ratio)
        return [n_train, n_train + n_valid]

    return labelled_cut(keyed, "shuffle_key", list(key_cols), bounds, SPLIT_LABELS)


def split_summary(split_df: DataFrame) -> DataFrame:
    """S3: rows per split."""
    return split_df.groupBy("split").agg(F.count(F.lit(1)).alias("n_lines"))
