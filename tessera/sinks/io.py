"""Sinks (K1-K5): split text files, metrics CSV, boundary CSVs, models, JSON.

All writers are DataFrame writers (one file per task, folders created by
the writer); nothing passes through the driver except the bounded model
tables of K4.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_splits(split_df: DataFrame, path: str, text_col: str = "text", mode: str = "overwrite",
                 key_cols=(), files: int = 64) -> None:
    """K1: ``<path>/split=<name>/part-*.txt``, one UTF-8 line per row.

    Rows with a ``shuffle_key`` (:func:`tessera.operators.split.exact_split`) are
    written in the order of the seeded shuffle, ties by ``key_cols``: the key is
    uniform, so ranges of its first digits are of like size without sampling; each
    range goes to one task, is sorted there and becomes one file of at most two
    splits.  The files of a split in the order of their names are its lines
    in shuffled order.  ``files`` is the number of ranges (up to 65,536); other
    rows are written as they lie, without an exchange.
    """
    rows = split_df
    if "shuffle_key" in split_df.columns:
        prefix = F.conv(F.substring("shuffle_key", 1, 4), 16, 10).cast("long")
        rows = (split_df.repartitionById(files, F.floor(prefix * files / 65536).cast("int"))
                .sortWithinPartitions("split", "shuffle_key", *key_cols))
    (rows.select(F.col(text_col).alias("value"), "split")
     .write.mode(mode).partitionBy("split").option("lineSep", "\n").text(path))


def write_metrics_csv(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2: tokenizer metrics with a header, in report order, one file."""
    report.coalesce(1).write.mode(mode).option("header", True).csv(path)


def write_boundary_csvs(words: DataFrame, summary: DataFrame, path: str, language: str,
                        mode: str = "overwrite") -> None:
    """K3: word-level and summary tables of one gold language.  The word-level
    table is written by as many tasks as it has partitions; the summary has a
    row per tokenizer."""
    words.write.mode(mode).option("header", True).csv(f"{path}/word_level/language={language}")
    summary.coalesce(1).write.mode(mode).option("header", True).csv(f"{path}/summary/language={language}")


def write_json_metrics(spark: SparkSession, metrics: dict, path: str, mode: str = "overwrite") -> None:
    """K5: one JSON record of run metrics."""
    df = spark.createDataFrame([(json.dumps(metrics, sort_keys=True),)], "value string")
    df.coalesce(1).write.mode(mode).text(path)


def read_json_metrics(spark: SparkSession, path: str) -> dict:
    row = spark.read.text(path).first()
    return json.loads(row["value"]) if row else {}
