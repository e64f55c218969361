"""Leaderboard (S4): overall rows ranked per metric, ascending.

The reference draws one bar chart per metric from the ``all`` rows sorted
ascending; the ranked data behind the charts is this table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The metrics the reference plots, in its order.
PLOTTED_METRICS = ["fertility", "char_per_token", "unk_rate", "vocab_coverage",
                   "mean_token_chars"]


def leaderboard(report: DataFrame, metrics=PLOTTED_METRICS) -> DataFrame:
    overall = report.filter(F.col("language") == "all")
    long = overall.unpivot(["tokenizer"], list(metrics), "metric", "value")
    w = Window.partitionBy("metric").orderBy(F.col("value"), F.col("tokenizer"))
    return long.select("metric", "tokenizer", F.col("value").cast("double").alias("value"),
                       F.row_number().over(w).cast("bigint").alias("position"))
