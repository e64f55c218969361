"""Language identification: known words first, then shorter and shorter n-grams."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import chunks, discard, release, short_batches, stage

UNKNOWN = "und"
#: Bounds of the model: labelled documents read per language, words kept per
#: language (most frequent ones), n-grams kept per language and length.
MAX_DOCS, MAX_WORDS, MAX_GRAMS = 4000, 50_000, 50_000
#: Longest n-gram that an unseen word falls back to.
LONGEST = 4

#: Characters that are scored together; one longer text is scored alone.
BLOCK_CHARS = 1_000_000

_LETTERS = re.compile(r"[^\W\d_]+")
#: Runs of letters, for the word counts on Spark.
LETTERS = r"\p{L}+"


def held_out(doc_id: Column) -> Column:
    """Documents kept away from training: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def letter_words(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    found = _LETTERS.findall(text.lower())
    return found if text.isascii() else [w for w in found if any(map(str.isalpha, w))]


class Model:
    """Log frequencies per language of known words and of n-grams.

    A word that any language knows scores by its smoothed log frequency in
    each.  Any other word scores by the mean over its known n-grams (the word
    is bounded by spaces) of the longest length that has any; a word without
    known n-grams says nothing.
    """

    def __init__(self, langs, words, grams):
        self.langs = langs
        self.words = _log_table(words, len(langs))
        self.grams = {n: _log_table(t, len(langs)) for n, t in grams.items()}

    def score_word(self, word: str) -> np.ndarray:
        at, table = self.words
        known = at.get(word)
        if known is not None:
            return table[known]
        padded = f" {word} "
        for n in sorted(self.grams, reverse=True):
            at, table = self.grams[n]
            found = [k for i in range(len(padded) - n + 1) if (k := at.get(padded[i:i + n])) is not None]
            if found:
                return table[found].mean(axis=0)
        return np.zeros(len(self.langs))

    def predict(self, texts) -> pd.DataFrame:
        """``lang_pred, score`` per text; the score is the posterior of the best
        language under equal priors.  Ties go to the first language by code
        point; a null text and one without letters is ``und`` with score 0."""
        lang, score = [], []
        for i, j in chunks([len(t or "") for t in texts], BLOCK_CHARS):
            words = [[] if t is None else letter_words(t) for t in texts[i:j]]
            ids: dict[str, int] = defaultdict(lambda: len(ids))
            lengths = np.array([len(w) for w in words], np.int64)
            flat = np.fromiter((ids[w] for part in words for w in part), np.int64, int(lengths.sum()))
            table = np.array([self.score_word(w) for w in ids]).reshape(len(ids), len(self.langs))
            total = np.zeros((j - i, len(self.langs)))
            for k in range(len(self.langs)):
                total[:, k] = np.bincount(np.repeat(np.arange(j - i), lengths), table[flat, k], j - i)
            for n, row in zip(lengths, total):
                if not n or not self.langs:
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    continue
                best = int(np.argmax(row))
                lang.append(self.langs[best])
                score.append(float(1 / np.exp(row - row[best]).sum()))
        return pd.DataFrame({"lang_pred": lang, "score": score})


def _log_table(counts: dict[str, dict[int, int]], n_langs: int):
    """Add-half smoothed log frequencies of ``{item: {language: count}}``:
    where each item is in the table, and the table."""
    table = np.zeros((len(counts), n_langs))
    for row, by in zip(table, counts.values()):
        row[list(by)] = list(by.values())
    if counts:
        table = np.log(table + 0.5) - np.log(table.sum(axis=0) + 0.5 * len(counts))
    return {item: i for i, item in enumerate(counts)}, table


def train(docs: DataFrame, max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS,
          longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on labelled rows of ``docs`` (text and language not null).

    The fit reads at most ``max_docs`` documents per language, those with a
    small hash of id and text, and keeps the most frequent items, so the model
    that reaches the driver has a bounded size whatever the corpus has.
    """
    labelled = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
                           F.xxhash64(id_col, text_col).alias("h")).dropna(subset=["lang", "text"])
    cuts = _hash_cuts(labelled, max_docs)
    langs = sorted(cuts)
    at = {lang: i for i, lang in enumerate(langs)}
    below = F.lit(False)
    for lang, (bits, end) in cuts.items():
        below = below | ((F.col("lang") == lang) & (F.shiftrightunsigned("h", 64 - bits) < end))
    counted = (labelled.filter(below)
               .select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0))).alias("w"))
               .groupBy("lang", "w").agg(F.count("*").alias("n")))
    counted = stage(counted, "lang-words")
    try:
        words = _top(counted.withColumnRenamed("w", "g"), max_words, at)
        grams = {}
        for n in range(1, longest + 1):
            padded = F.concat(F.lit(" "), F.col("w"), F.lit(" "))
            cut = (counted.filter(F.length("w") + 2 >= n)
                   .select("lang", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") + 3 - n),
                                                              lambda i: F.substring(padded, i, F.lit(n)))).alias("g"))
                   .groupBy("lang", "g").agg(F.sum("n").alias("n")))
            grams[n] = _top(cut.filter("g != ' '"), max_grams, at)
    finally:
        discard(counted)
    return Model(langs, words, grams)


def _hash_cuts(labelled: DataFrame, most: int, step: int = 12) -> dict[str, tuple[int, int]]:
    """Per language ``(bits, end)``: the rows whose hash begins, in ``bits``
    bits, with a number below ``end`` are at most ``most``.

    Read off histograms of the hash (2 ** ``step`` counts a language at most);
    a language of which not even the first cell fits is looked at more finely.
    """
    cuts: dict[str, tuple[int, int]] = {}
    bits, rows = 0, labelled.select("lang", "h")
    while bits + step <= 60:
        bits += step
        cells: dict[str, dict[int, int]] = {}
        counted = rows.groupBy("lang", F.shiftrightunsigned("h", 64 - bits).alias("c")).count()
        for r in counted.collect():
            cells.setdefault(r["lang"], {})[r["c"]] = r["count"]
        coarse = []
        for lang, counts in cells.items():
            held, end = 0, 1 << bits if bits == step else 1 << step
            for c in sorted(counts):
                if held + counts[c] > most:
                    end = c
                    break
                held += counts[c]
            cuts[lang] = bits, end
            if not held:
                coarse.append(lang)
        if not coarse:
            break
        rows = rows.filter(F.col("lang").isin(coarse) & (F.shiftrightunsigned("h", 64 - bits) == 0))
    return cuts


def _top(counted: DataFrame, most: int, at: dict[str, int]) -> dict[str, dict[int, int]]:
    """``{item: {language: count}}`` of each language's frequent items: those
    whose frequency is so high that all as frequent as they are ``most`` at
    most.  Which frequency that is comes from a histogram, so no language's
    items are sorted in one task."""
    levels: dict[str, list] = {}
    for r in counted.groupBy("lang", "n").agg(F.count("*").alias("items")).collect():
        levels.setdefault(r["lang"], []).append((r["n"], r["items"]))
    enough = F.lit(False)
    for lang, found in levels.items():
        held, least = 0, None
        for n, items in sorted(found, reverse=True):
            held += items
            if held > most:
                break
            least = n
        if least is not None:
            enough = enough | ((F.col("lang") == lang) & (F.col("n") >= least))
    out: dict[str, dict[int, int]] = {}
    rows = counted.filter(enough).select("lang", "g", "n").toPandas().sort_values(["g", "lang"])
    for lang, item, n in rows.itertuples(index=False):
        out.setdefault(item, {})[at[lang]] = n
    return out


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1), from the text alone.

    Columns of those names are replaced; rows are neither dropped nor merged.
    Without any labelled row the model knows no language and says ``und``.
    """
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        release()
        return shared.value.predict(text.tolist())

    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return (docs.select(*others).withColumn("__p", F.explode(F.array(predict(text_col))))
            .select(*others, "__p.lang_pred", "__p.score"))


def keep_identified(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """``docs`` without rows whose language is unknown or uncertain; the
    columns are those of ``docs``.  The model learns from the labelled rows."""
    found = identify(docs.withColumns({f"__{c}": F.col(c) for c in ("lang_pred", "score") if c in docs.columns}), train(docs))
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return kept.select(*[F.col(f"__{c}").alias(c) if c in ("lang_pred", "score") else F.col(c) for c in docs.columns])
