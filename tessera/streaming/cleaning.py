"""The stateless prepare path on a streaming DataFrame.

Cleaning, filtering and tagging (F1-F8) hold no state, so the same Column
functions run unchanged on ``readStream``: new text files dropped into a
language folder are cleaned and appended to a sink as they arrive.  The
split, vocabulary and metric operators need the whole corpus and stay
batch-only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.sources.corpus import language_of_path


def stream_language_files(spark: SparkSession, raw_dir: str, max_files_per_trigger: int = 100) -> DataFrame:
    """``<raw_dir>/<lang>/*.txt`` as a stream of ``lang, source, line``."""
    df = (spark.readStream.format("text")
          .option("pathGlobFilter", "*.txt")
          .option("maxFilesPerTrigger", max_files_per_trigger)
          .load(f"{raw_dir.rstrip('/')}/*/"))
    return df.select(
        language_of_path(F.col("_metadata.file_path")).alias("lang"),
        F.col("_metadata.file_path").alias("source"),
        F.make_valid_utf8("value").alias("line"))


def prepare_stream(lines: DataFrame, lowercase: bool = False) -> DataFrame:
    """Clean, keep good lines, render the tag -- per row, no state."""
    cleaned = lines.select("lang", "source", tx.clean_line(F.col("line"), lowercase).alias("clean"))
    return (cleaned.filter(tx.is_good_line(F.col("clean")))
            .select("lang", "source", tx.render_tag(F.col("lang"), F.col("clean")).alias("text")))


def start_prepare(spark: SparkSession, raw_dir: str, out_dir: str, checkpoint: str,
                  trigger_once: bool = True):
    """Run the prepare stream into a parquet sink (exactly-once file sink)."""
    q = (prepare_stream(stream_language_files(spark, raw_dir))
         .writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    q = q.trigger(availableNow=True) if trigger_once else q
    return q.start()
