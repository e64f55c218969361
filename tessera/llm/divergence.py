"""How far the sources of a language are from one another, term by term."""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tables import short_batches, stage
from tessera.session import Tables

#: A term's price is its smoothed share in these parts.
UNIT, SMOOTHING = 1_000_000_000, 5
#: Terms (of one language) whose counts a pair of sources compares at once.
BLOCK_TERMS = 1 << 16
#: Entries a task counts before it hands them on.
HELD = 500_000

# A-Z to a-z; what is neither a letter of ASCII nor a byte of another character becomes a blank.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32) for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters (A-Z as a-z) and characters beyond ASCII."""
    return text.translate(_FOLD).split()


def _counted(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, df)``, counted per task in bounded tables: times
    a term occurs and rows it occurs in.  A null term stands for its group."""
    short_batches(docs.sparkSession)

    def rows(n: dict, df: dict):
        for (lang, source), found in n.items():
            k = len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (k + 1)), pa.array([source] * (k + 1)),
                 pa.array([*found, None], pa.binary()).cast(pa.string()), pa.array([*found.values(), 0], pa.int64()),
                 pa.array([*map(df[lang, source].__getitem__, found), 0], pa.int64())], ["lang", "source", "term", "n", "df"])

    def run(batches):
        n, df = {}, {}
        for batch in batches:
            texts: dict = {}
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source")),
                                          batch.column("text").cast(pa.binary()).to_pylist()):
                texts.setdefault((lang, source), []).append(terms(text))
            for group, found in texts.items():
                n.setdefault(group, Counter()).update(chain.from_iterable(found))
                df.setdefault(group, Counter()).update(chain.from_iterable(map(set, found)))
            if sum(map(len, n.values())) > HELD:
                yield from rows(n, df)
                n, df = {}, {}
        yield from rows(n, df)

    return (docs.mapInArrow(run, "lang string, source string, term string, n long, df long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")))


def price(count: Column, total: Column) -> Column:
    """``1 + floor(UNIT * (count + SMOOTHING) / total)``, exactly."""
    up, down = ((x).cast("decimal(20,0)") for x in (count + SMOOTHING, total))
    return F.lit(1).cast("long") + F.call_function("div", up * F.lit(UNIT).cast("decimal(10,0)"), down)


def prices(count: np.ndarray, total: int) -> np.ndarray:
    """:func:`price` of an array; where 64 bits don't hold the products, in Python's integers."""
    count = count.astype(np.int64) + SMOOTHING
    step = 32_000                       # UNIT in two factors: a remainder times one of them must fit
    if total >= 2**63 // step:
        return np.array([1 + UNIT * c // total for c in count.tolist()], np.int64)
    whole, rest = np.divmod(count, total)
    high, rest = np.divmod(rest * step, total)
    return 1 + whole * UNIT + high * (UNIT // step) + rest * (UNIT // step) // total


def gallop(few: np.ndarray, many: np.ndarray, stride: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of two sorted arrays without repeats are equal: positions
    in ``few`` and in ``many``.  For each ``stride`` of the one, the other is
    probed at doubling distances from where the last search ended until it is
    passed; the search is inside what was stepped over."""
    here, there, at = [], [], 0
    for i in range(0, len(few), stride):
        part, reach = few[i:i + stride], stride
        while at + reach < len(many) and many[at + reach] <= part[-1]:
            reach *= 2
        window = many[at:at + reach + 1]
        place = np.searchsorted(window, part)
        hit = np.flatnonzero(window[np.minimum(place, len(window) - 1)] == part) if len(window) else place[:0]
        here.append(hit + i)
        there.append(place[hit] + at)
        at += int(place[-1])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(here), join(there)


def distance(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int], n_terms: int) -> int:
    """Sum of ``abs(p - q)`` over ``n_terms`` terms for two groups, each given as
    sorted term ids, their counts, and the total its prices refer to: terms of
    both, of one of them, and of neither."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not n_terms:
        return 0
    i, j = gallop(a[0], b[0])
    p, q = prices(a[1], a[2]), prices(b[1], b[2])
    p0, q0 = (int(prices(np.zeros(1, np.int64), x[2])[0]) for x in (a, b))
    both = int(np.abs(p[i] - q[j]).sum())
    only_a = int(np.abs(np.delete(p, i) - q0).sum())
    only_b = int(np.abs(np.delete(q, j) - p0).sum())
    absent = n_terms - len(p) - len(q) + len(i)
    return both + only_a + only_b + absent * abs(p0 - q0)


def _pair(left: pa.Table, right: pa.Table) -> pa.Table:
    """One pair of sources in one block of terms, both ways."""
    sides = []
    for t in (left, right):
        row = {c: t.column(c)[0] for c in t.column_names}
        sides.append((row["source"].as_py(), (np.asarray(row["ids"].values), np.asarray(row["counts"].values),
                                              row["total"].as_py())))
    (s, a), (o, b) = sides
    value = distance(a, b, left.column("n_terms")[0].as_py())
    return pa.table({"lang": [left.column("lang")[0].as_py()] * 2, "source": [s, o], "item": [o, s],
                     "value": pa.array([value] * 2, pa.int64())})


def audit(docs: DataFrame, least_docs: int = 30, most_terms: int = 50, lang_col: str = "lang", source_col: str = "source",
          text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``.

    Part ``pair``: the distance of each source of a language to each other one;
    part ``term``: the ``most_terms`` terms it has most in excess of its language.  Terms
    are those in ``least_docs`` or more rows of the language; see :func:`terms`,
    :func:`price` and :func:`distance`.

    Words are counted in the tasks that read them and added up per language,
    source and term.  Kept terms are dealt into blocks by hash and numbered inside
    them; a source's counts in a block are two arrays sorted by term number.  For
    every unordered pair of a language's sources and every block the two sources'
    arrays are co-grouped and merged, so a task holds two blocks at a time, whatever
    the vocabulary; pairs without a common term are priced like all others.

    Nulls are empty strings; rows without terms still make their group; repeated
    rows count; no rows give no rows; other columns are not read.
    """
    empty = F.lit("")
    rows = docs.select(*[F.coalesce(F.col(c), empty).alias(name) for c, name in (
        (lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    with Tables() as kept:
        same = Window.partitionBy("lang", "term")
        found = kept.keep(
            _counted(rows).withColumns({"in_lang": F.sum("n").over(same), "docs": F.sum("df").over(same)})
            .filter((F.col("docs") >= least_docs) | F.col("term").isNull()).select("lang", "source", "term", "n", "in_lang"),
            "divergence-counts")
        vocab = found.filter("term is not null").groupBy("lang", "term").agg(F.max("in_lang").alias("n"))
        langs = kept.keep(found.select("lang").distinct().join(
            vocab.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("n")), "lang", "left")
            .select("lang", F.coalesce("v", F.lit(0)).alias("v"),
                    (F.coalesce("n", F.lit(0)) + F.coalesce("v", F.lit(0)) * SMOOTHING).alias("lang_total")), "divergence-langs")
        most = langs.agg(F.max("v")).first()[0] or 0
        blocks = max(1, -(-most // block_terms))
        in_lang = Window.partitionBy("lang")
        groups = kept.keep(
            found.groupBy("lang", "source").agg(F.sum("n").alias("n")).join(langs, "lang")
            .select("lang", "source", (F.col("n") + F.col("v") * SMOOTHING).alias("total"), "lang_total",
                    (F.row_number().over(in_lang.orderBy("source")) - 1).alias("k"),
                    F.count("*").over(in_lang).cast("int").alias("sources")), "divergence-groups")

        block = Window.partitionBy("lang", "block")
        arrays = (found.filter("term is not null").withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
                  .withColumn("t", F.dense_rank().over(block.orderBy("term")))
                  .groupBy("lang", "block", "source").agg(F.array_sort(F.collect_list(F.struct("t", "n"))).alias("x")))
        sizes = vocab.groupBy("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block")).agg(
            F.count("*").alias("n_terms"))
        none = F.array().cast("array<struct<t:int,n:bigint>>")
        placed = (groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
                  .join(arrays, ["lang", "source", "block"], "left").join(sizes, ["lang", "block"], "left")
                  .withColumn("x", F.coalesce("x", none))
                  .select("lang", "source", "block", "k", "sources", "total", F.coalesce("n_terms", F.lit(0)).alias("n_terms"),
                          F.col("x.t").alias("ids"), F.col("x.n").alias("counts")))
        placed = kept.keep(placed, "divergence-arrays")
        what = ["lang", "block", "source", "total", "n_terms", "ids", "counts"]
        left = placed.filter("k < sources - 1").select(
            *what, F.col("k").alias("a"), F.explode(F.sequence(F.col("k") + 1, F.col("sources") - 1)).alias("b"))
        right = placed.filter("k > 0").select(
            *what, F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("a"), F.col("k").alias("b"))
        key = ["lang", "a", "b", "block"]
        pairs = (left.groupBy(*key).cogroup(right.groupBy(*key))
                 .applyInArrow(_pair, "lang string, source string, item string, value long")
                 .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))

        own, all_ = price(F.col("n"), F.col("total")), price(F.col("in_lang"), F.col("lang_total"))
        excess = (found.filter("n > 0").join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"])
                  .select("lang", "source", F.col("term").alias("item"), (own - all_).alias("value")).filter("value > 0"))
        ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        result = (pairs.withColumn("rank", ranked).withColumn("part", F.lit("pair"))
                  .unionByName(excess.withColumn("rank", ranked).filter(F.col("rank") <= most_terms)
                               .withColumn("part", F.lit("term"))))
        return stage(result.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")),
                     "divergence")
