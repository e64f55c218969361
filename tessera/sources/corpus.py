"""Corpus sources.

* :func:`document_lines`  -- one row per line of the driver ``documents``
  table, with its ``(doc_id, line_no)`` key (the reference's one-line-one-
  record model, applied to text held in a table).
* :func:`read_language_files` -- ``<raw_dir>/<lang>/*.txt`` scan; only the
  configured languages, non-recursive, a missing folder is skipped with a
  warning.
* :func:`read_nonempty_lines` -- stripped non-empty lines of text files.
* :func:`read_gold_tsv` -- gold segmentation with column checks.
* :func:`read_metrics_csv` -- tokenizer metrics CSV with a fixed schema.
"""

from __future__ import annotations

import warnings
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as tx
from tessera.session import materialize

# Universal newlines, as Python's text-mode iteration splits lines.
LINE_BREAK = r"\r\n|\r|\n"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def balance(df: DataFrame, key_cols, partitions: int | None = None) -> DataFrame:
    """Hash-partition ``df`` on ``key_cols`` for CPU-heavy per-row work.

    ``partitions`` is the caller's choice; without it rows stay as they were
    read (one task per file split), whatever the input's size.
    """
    return df.repartition(partitions, *key_cols) if partitions else df


def document_lines(documents: DataFrame, text_col: str = "text",
                   key_cols=("doc_id", "lang", "source"), partitions: int | None = None) -> DataFrame:
    """Explode each document into ``(…keys, line_no, line)``; 0-based lines.

    Map-only for a large input: a document's lines stay in the task that
    read it (a single text value is bounded by the 2 GB row limit, so no
    document can hold an unbounded share of the lines).
    """
    keys = [c for c in key_cols if c in documents.columns]
    if "doc_id" in keys:
        documents = balance(documents.select(*keys, text_col), ["doc_id"], partitions)
    return (documents
            .select(*keys, F.posexplode(F.split(F.col(text_col), LINE_BREAK, -1))
                    .alias("line_no", "line"))
            .withColumn("line_no", F.col("line_no").cast("bigint")))


def _fs_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


#: File blocks whose line offsets are broadcast (some 150 bytes each); more are joined.
MOST_BLOCKS = 1_000_000


def _marked_files(spark: SparkSession, files) -> list[str]:
    """Those of ``files`` that begin with a byte-order mark: the first three
    bytes of each are read (Hadoop's line reader drops the mark)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def marked(name):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        stream = path.getFileSystem(conf).open(path)
        try:
            return [stream.read() for _ in range(3)] == [0xEF, 0xBB, 0xBF]
        finally:
            stream.close()

    with ThreadPoolExecutor(16) as pool:
        return [name for name, hit in zip(files, pool.map(marked, files)) if hit]


def read_language_files(spark: SparkSession, raw_dir: str, languages) -> DataFrame:
    """Lines of ``<raw_dir>/<lang>/*.txt`` for the given languages.

    Returns ``lang, source, doc_id, line_no, line, valid_utf8, valid_line``:
    ``doc_id`` is a hash of language and file name and ``line_no`` counts the file's
    lines from 0, so a line's key does not depend on splits or partitions, nor on
    where the corpus lies.  Lines end as in Python's text mode.  Invalid UTF-8 is
    repaired with U+FFFD and shown by ``valid_line`` and, for the file as a whole, by
    ``valid_utf8``; a leading byte-order mark stays in the first line, as in Python.  A
    language without a folder is skipped with a warning.

    Files are read in splits.  One job counts the lines of each (file, block); their
    prefix sums, plus a line's place in its block, number the lines in the
    pass that reads them.  Should the two passes see different splits, the read fails.
    """
    paths = []
    for lang in languages:
        path = f"{raw_dir.rstrip('/')}/{lang}"
        if _fs_exists(spark, path):
            paths.append(path)
        else:
            warnings.warn(f"no folder for language {lang!r}: {path}")
    schema = ("lang string, source string, doc_id bigint, line_no bigint, line string, valid_utf8 boolean, "
              "valid_line boolean")
    if not paths:
        return spark.createDataFrame([], schema)
    read = (spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "false").text(paths)
            .select("value", F.col("_metadata.file_path").alias("source"),
                    F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")))
    counted = materialize(read.groupBy("source", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.bool_and(F.is_valid_utf8("value")).alias("valid")),
        "file-blocks")
    n_blocks = counted.count()
    marked = _marked_files(spark, [r["source"] for r in counted.select("source").distinct().collect()])
    marks = spark.createDataFrame([(m,) for m in marked], "source string").withColumns(
        {"block": F.lit(0).cast("long"), "mark": F.lit("\ufeff")})
    of_file = Window.partitionBy("source")
    blocks = (counted.join(marks, ["source", "block"], "left").withColumns({
        "before": F.sum("n").over(of_file.orderBy("block")) - F.col("n"), "valid_utf8": F.bool_and("valid").over(of_file)}))
    if n_blocks <= MOST_BLOCKS:
        blocks = F.broadcast(blocks)
    place = F.col("at") - F.col("first")
    known = F.col("n").isNotNull() & (place >= 0) & (place < F.col("n"))
    line_no = F.when(known, F.col("before") + place).otherwise(
        F.raise_error(F.concat(F.lit("splits changed between two reads of "), "source")).cast("bigint"))
    line = F.concat(F.when(place == 0, F.coalesce("mark", F.lit(""))).otherwise(F.lit("")), F.make_valid_utf8("value"))
    lang = language_of_path(F.col("source"))
    return read.join(blocks, ["source", "block"], "left").select(
        lang.alias("lang"), "source", F.xxhash64(lang, F.regexp_extract("source", r"([^/]+)$", 1)).alias("doc_id"),
        line_no.alias("line_no"), line.alias("line"), "valid_utf8", F.is_valid_utf8("value").alias("valid_line"))


def language_of_path(path):
    """Name of a file's folder; paths come URL-encoded from the file source."""
    folder = F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1)
    # '+' is a plain character in a path, but a blank in url_decode
    return F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))


def read_nonempty_lines(spark: SparkSession, path: str) -> DataFrame:
    """R2: ``line.strip()`` of every line whose stripped form is non-empty;
    invalid UTF-8 is repaired with U+FFFD."""
    df = spark.read.text(path).select(tx.ustrip(F.make_valid_utf8("value")).alias("line"))
    return df.filter(F.length("line") > 0)


GOLD_SCHEMA = T.StructType([T.StructField("word", T.StringType()),
                            T.StructField("segments", T.StringType())])


def read_gold_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Gold TSV with a header; must have ``word`` and ``segments``.

    Raises ``FileNotFoundError`` for a missing file and ``ValueError`` naming
    the missing columns.  Words ``NA``/``null`` are kept as text.
    """
    if not _fs_exists(spark, path):
        raise FileNotFoundError(f"no gold segmentation at {path}")
    df = (spark.read.option("header", True).option("sep", "\t")
          .option("nullValue", "\u0000never\u0000").csv(path))
    missing = {"word", "segments"} - set(df.columns)
    if missing:
        raise ValueError(f"{path} needs the columns word and segments; absent: {sorted(missing)}")
    return df.select(tx.ustrip(F.coalesce("word", F.lit(""))).alias("word"),
                     tx.split_segments(F.coalesce("segments", F.lit(""))).alias("segments"))


def gold_language(path: str) -> str:
    """Language of a gold file, from its name ``<lang>_gold.tsv``."""
    return path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".tsv").removesuffix("_gold")


METRICS_SCHEMA = T.StructType([
    T.StructField("language", T.StringType()),
    T.StructField("tokenizer", T.StringType()),
    T.StructField("num_examples", T.LongType()),
    T.StructField("fertility", T.DoubleType()),
    T.StructField("char_per_token", T.DoubleType()),
    T.StructField("unk_rate", T.DoubleType()),
    T.StructField("vocab_coverage", T.DoubleType()),
    T.StructField("mean_token_chars", T.DoubleType()),
    T.StructField("median_token_chars", T.DoubleType()),
    T.StructField("p95_token_chars", T.DoubleType()),
])


def read_metrics_csv(spark: SparkSession, path: str) -> DataFrame:
    """The tokenizer-metrics CSV written by the report sink."""
    return spark.read.schema(METRICS_SCHEMA).option("header", True).csv(path)


def read_split_text(spark: SparkSession, split_dir: str, split: str) -> DataFrame:
    """One named split written by :func:`tessera.sinks.io.write_splits`."""
    return (spark.read.text(f"{split_dir.rstrip('/')}/split={split}")
            .select(F.col("value").alias("text")))
