"""Plans over the driver tables (``documents`` is the corpus).

:class:`Corpus` builds, lazily and once per instance, the frames every query
shares: document lines, the prepared (cleaned, filtered, tagged) corpus, its
exact split, and two fixtures derived from the document lines by fixed rules
so the cleaning and tag functions have something to do (FIXTURES.md §3-4:
the raw driver text contains almost nothing the cleaner changes).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import split as sp
from tessera.operators import tokenizers as tk
from tessera.session import few_rows_a_batch, materialize
from tessera.sources.corpus import document_lines, read_table

LINE_KEY = ["doc_id", "line_no"]


def dirty_line(line: Column, k: Column) -> Column:
    """Dirt chosen by ``k = (doc_id + line_no) % 10`` (FIXTURES.md §4)."""
    cases = {
        0: line,
        1: F.concat(F.lit("12. "), line),
        2: F.concat(F.lit("3:16 "), line),
        3: F.concat(F.lit("\u00a0  "), line, F.lit("\t")),
        4: F.replace(line, F.lit(" "), F.lit("\u2003 ")),
        5: F.replace(line, F.lit("\u00e9"), F.lit("e\u0301")),
        6: F.lit("7."),
        7: F.lit("2024 - 10"),
        8: F.substring(line, 1, 2),
    }
    expr = F.concat(F.lit(" 5. "), line)
    for key in sorted(cases, reverse=True):
        expr = F.when(k == key, cases[key]).otherwise(expr)
    return expr


def tag_variant(lang: Column, c: Column, k: Column) -> Column:
    """Tag forms chosen by ``k = (3*doc_id + line_no) % 6``."""
    expr = tx.render_tag(lang, c)
    variants = {
        2: c,
        3: F.concat(F.lit("<"), lang, F.lit(" "), c),
        4: F.concat(F.lit("<> "), c),
        5: F.concat(F.lit("<"), lang, F.lit("><x> "), c),
    }
    for key in sorted(variants, reverse=True):
        expr = F.when(k == key, variants[key]).otherwise(expr)
    return expr


def prepare_lines(lines: DataFrame, lowercase: bool = False) -> DataFrame:
    """The reference's prepare stage: clean each line, keep good lines, render
    the ``<lang> text`` tag.  Map-only; ``lines`` is keyed by ``doc_id,
    line_no`` as both corpus sources give it."""
    # explode of a one-element array: the generated column is computed once
    # and the good-line filter stays above it (a filter on a projected column
    # would be pushed below the projection with the regex chain inlined,
    # evaluating it once per reference); filters on other columns go below
    cleaned = lines.select("doc_id", "lang", "line_no",
                           F.explode(F.array(tx.clean_line(F.col("line"), lowercase))).alias("clean"))
    return (cleaned.filter(tx.is_good_line(F.col("clean")))
            .select("doc_id", "lang", "line_no",
                    tx.render_tag(F.col("lang"), F.col("clean")).alias("text")))


def prepare_corpus(lines: DataFrame, seed: int = 42, lowercase: bool = False) -> DataFrame:
    """Lines to split lines, end to end: the prepared lines with their shuffle
    key are written once, the split is a label on that table."""
    keyed = sp.with_shuffle_key(prepare_lines(lines, lowercase), LINE_KEY, seed)
    return sp.exact_split(materialize(keyed, "prepared"), LINE_KEY, seed)


def spread(df: DataFrame, key_cols=()) -> DataFrame:
    """Hash-partition into at least twice the cores (or the shuffle
    partition count, if larger) for CPU-heavy per-row work."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism * 2,
            int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *[F.col(c) for c in key_cols])


class Corpus:
    _shared: dict = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Corpus":
        """One instance per (application, data folder): the prepared corpus
        is checkpointed once and every query of the session reads it, as a
        pipeline reads a written table instead of re-cleaning the text."""
        key = (spark.sparkContext.applicationId, sf_dir)
        c = cls._shared.get(key)
        if c is None:
            c = cls._shared[key] = cls(spark, sf_dir)
        return c

    def __init__(self, spark: SparkSession, sf_dir: str, seed: int = 42,
                 lowercase: bool = False, closed_vocab_size: int = 500, partitions: int | None = None):
        """``partitions``: parts the documents are dealt into before the lines
        are cut (the driver tables are one file each); by default twice the
        cores."""
        self.spark, self.sf_dir, self.seed = spark, sf_dir, seed
        self.partitions = partitions or 2 * spark.sparkContext.defaultParallelism
        self.lowercase, self.closed_vocab_size = lowercase, closed_vocab_size

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    # -- sources ---------------------------------------------------------
    @cached_property
    def doc_lines(self) -> DataFrame:
        return document_lines(self.table("documents"), partitions=self.partitions)

    @cached_property
    def dirty(self) -> DataFrame:
        k = (F.col("doc_id") + F.col("line_no")) % 10
        # explode of a one-element array, here and below: the column is computed once (see prepare_lines)
        return self.doc_lines.select("doc_id", "lang", "line_no",
                                     F.explode(F.array(dirty_line(F.col("line"), k))).alias("line"))

    # -- prepared corpus (the real pipeline) -------------------------------
    @cached_property
    def splits(self) -> DataFrame:
        """Cleaned, filtered, tagged lines with their split (the prepare stage's
        output table): the texts are cleaned and written once."""
        return prepare_corpus(self.doc_lines, self.seed, self.lowercase)

    @property
    def prepared(self) -> DataFrame:
        return self.splits.drop("split", "shuffle_key")

    def split(self, name: str) -> DataFrame:
        return self.splits.filter(F.col("split") == name)

    # -- tag fixture --------------------------------------------------------
    @cached_property
    def tagged_fixture(self) -> DataFrame:
        c = tx.clean_line(F.col("line"))
        k = (F.col("doc_id") * 3 + F.col("line_no")) % 6
        base = self.dirty.select("doc_id", "lang", "line_no", F.explode(F.array(c)).alias("c"))
        out = (base.filter(F.length("c") > 0)
               .select("doc_id", "line_no", "lang",
                        tag_variant(F.col("lang"), F.col("c"), k).alias("text")))
        return materialize(out, "tagged_fixture")

    # -- words and tokenizers ------------------------------------------------
    @cached_property
    def stretches(self) -> DataFrame:
        """``train, tagged, stripped, stretch, n``: what stands between blanks in the prepared lines, counted
        once for the tables of words: in training lines or others, with their tag, without it, or in both."""
        whole, rest = F.col("text"), F.col("rest")
        size = F.length(whole) - F.length(rest)
        lines = self.splits.select((F.col("split") == "train").cast("int").alias("train"), "text",
                                   F.explode(F.array(tx.strip_language_tag(whole))).alias("rest"))
        # the tag goes with a blank behind it; if not, the line is counted twice
        apart = whole.endswith(rest) & whole.substr(F.lit(1), size).endswith(" ")
        tagged, stripped, both = 1, 2, 3
        lines = lines.select("rest", (4 * F.col("train") + F.when(apart, both).otherwise(stripped)).alias("rest_part"),
                             F.when(apart, whole.substr(F.lit(1), size - 1)).otherwise(whole).alias("tag"),
                             (4 * F.col("train") + tagged).alias("tag_part"))
        with few_rows_a_batch(self.spark):
            counts = materialize(tk.stretch_counts(lines, {"rest": "rest_part", "tag": "tag_part"}), "stretches")
        part = F.col("part")
        return counts.select((part >= 4).alias("train"), (part % 2 == 1).alias("tagged"), (part % 4 >= 2).alias("stripped"), "stretch", "n")

    @cached_property
    def word_freq(self) -> DataFrame:
        """``word, freq`` over the training lines with their tags."""
        from tessera.operators.bpe import word_frequency
        lines = self.stretches.filter("train and tagged")
        return materialize(word_frequency(lines, "stretch", count_col="n"), "word_freq")

    @cached_property
    def train_pretokens(self) -> DataFrame:
        """``pretoken, n`` over the tag-stripped training lines."""
        lines = self.stretches.filter("train and stripped")
        return materialize(tk.pretoken_counts(lines, "stretch", count_col="n"), "train_pretokens")

    @cached_property
    def rule_tokenizers(self):
        return tk.rule_tokenizers(self.train_pretokens, self.closed_vocab_size)

    @cached_property
    def rule_vocabs(self) -> dict:
        return {t.name: t.vocab(self.spark, self.train_pretokens) for t in self.rule_tokenizers}

    @cached_property
    def gold(self) -> DataFrame:
        """Gold segmentations derived from the corpus words, written once and
        spread over all cores (scoring is CPU-heavy per row, the table is
        small in bytes, so size-based coalescing would pack it into a few
        tasks)."""
        from tessera.plans.catalog import gold_words
        return spread(materialize(gold_words(self), "gold"), ["word"])

    def tokenizer(self, name: str):
        return {t.name: t for t in self.rule_tokenizers}[name]
