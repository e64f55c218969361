"""Exact global ranks without a single-partition window.

A global ``row_number()`` over the whole data set runs in one task.  Here the
order key starts with a uniformly distributed hex hash, so rows are bucketed
by its first ``digits`` hex digits: one aggregate counts rows per bucket (at
most ``16**digits`` rows reach the driver, independent of the data size), a
prefix sum gives each bucket's first rank, and rows are numbered inside their
bucket only.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(seed, *cols) -> Column:
    """md5 hex of ``seed:col1:col2...`` -- repeatable, engine independent."""
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                  for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def _bucket(h: Column, digits: int) -> Column:
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("int")


def bucket_histogram(df: DataFrame, h_col: str, digits: int = 4):
    """Return ``(buckets, starts, total)``: sorted bucket ids, first rank of
    each, and the row count.  One aggregate; the result is bounded by
    ``16**digits`` rows."""
    rows = (df.groupBy(_bucket(F.col(h_col), digits).alias("b")).count()
            .collect())
    rows.sort(key=lambda r: r["b"])
    buckets = [r["b"] for r in rows]
    counts = [r["count"] for r in rows]
    starts = [0] + list(accumulate(counts))[:-1]
    return buckets, starts, sum(counts), counts


def global_rank(df: DataFrame, h_col: str, tie_cols, digits: int = 4,
                rank_col: str = "rank") -> DataFrame:
    """0-based exact rank by ``(h_col, *tie_cols)`` for every row.

    One shuffle by bucket (``16**digits`` uniformly filled groups).
    """
    buckets, starts, _, _ = bucket_histogram(df, h_col, digits)
    if not buckets:
        return df.withColumn(rank_col, F.lit(None).cast("bigint"))
    start_df = df.sparkSession.createDataFrame(
        list(zip(buckets, starts)), "b int, start bigint")
    w = Window.partitionBy("b").orderBy(F.col(h_col), *[F.col(c) for c in tie_cols])
    return (df.withColumn("b", _bucket(F.col(h_col), digits))
            .join(F.broadcast(start_df), "b")
            .withColumn(rank_col, F.col("start") + F.row_number().over(w) - 1)
            .drop("b", "start"))


def cut_keys(df: DataFrame, h_col: str, tie_cols, ranks, digits: int = 4, small: int = 1000):
    """The keys ``(h, *ties)`` of the rows at the given 0-based ranks; a rank
    outside the data is None.

    Histograms of the hash narrow a rank down to a prefix, ``digits`` hex
    digits at a time (``16 ** digits`` counts at most reach the driver), until
    ``small`` rows at most share it; their keys are then sorted on the driver.
    """
    found = {}
    for rank in ranks:
        prefix, below, held = "", 0, df
        total = None
        while True:
            size = len(prefix) + digits
            cells = sorted((r["c"], r["count"]) for r in held.groupBy(
                F.substring(h_col, 1, size).alias("c")).count().collect())
            total = sum(n for _, n in cells) if total is None else total
            if not 0 <= rank < total:
                found[rank] = None
                break
            for cell, n in cells:
                if rank < below + n:
                    break
                below += n
            prefix, held = cell, df.filter(F.col(h_col).startswith(cell))
            if n <= small or len(prefix) >= 32:
                keys = [F.col(h_col), *[F.col(c) for c in tie_cols]]
                rows = held.select(*keys).orderBy(*keys).limit(rank - below + 1).collect()
                found[rank] = tuple(rows[-1])
                break
    return found


def before_key(columns, key) -> Column:
    """Whether ``columns`` come before ``key`` in order."""
    out = F.lit(False)
    for c, v in reversed(list(zip(columns, key))):
        out = (F.col(c) < F.lit(v)) | ((F.col(c) == F.lit(v)) & out)
    return out


def labelled_cut(df: DataFrame, h_col: str, tie_cols, boundaries, labels, label_col: str = "split") -> DataFrame:
    """Label rows by rank ranges ``[0,b1) [b1,b2) ... [bk, n)`` exactly.

    The keys at the boundaries are found first; a row's label then follows from
    comparing its key with them, in one projection without an exchange.
    ``boundaries`` may be a callable ``n -> list`` evaluated on the count.
    """
    if callable(boundaries):
        boundaries = boundaries(df.count())
    keys = cut_keys(df, h_col, tie_cols, sorted({b for b in boundaries if b > 0}))
    expr = F.lit(labels[-1])
    for bound, label in reversed(list(zip(boundaries, labels[:-1]))):
        if bound <= 0:
            continue
        key = keys[bound]
        expr = F.lit(label) if key is None else F.when(before_key([h_col, *tie_cols], key), F.lit(label)).otherwise(expr)
    return df.withColumn(label_col, expr)
