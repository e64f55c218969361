"""Mix sources to target weights by Pareto order sampling, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tables import WORD, stage
from tessera.session import Tables

#: Bits of the sampling key; one histogram pass resolves STEP of them.
KEY_BITS, STEP = 48, 12
#: A key cell with more rows than this is split by another pass.
CELL_ROWS = 5_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int, *columns: str) -> Column:
    """A number in (0, 1) that depends on the seed and the columns alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 64 - KEY_BITS)
    return (bits + 0.5) / float(1 << KEY_BITS)


def targets(sizes: DataFrame, weights=(1, 2, 3), most: float = 3.0) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row
    a source.

    Sources in code point order (null last) weigh ``weights``, repeating, and
    share the whole size; a target stops at ``most`` times its source's size
    and the excess goes to the others by weight.  So there is a level with
    ``target = min(most * size, level * weight)`` that uses the whole size up:
    with sources in order of ``most * size / weight`` it is that of the first
    source from which on all are below their stops.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weighed = sizes.select("source", F.col("source_size").cast("double").alias("s"), "source_size",
                           F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
                           .cast("double").alias("w"))
    stop = F.col("s") * most
    up = Window.orderBy(stop / F.col("w"), F.col("source").isNull(), "source")
    rest = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("s").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum(stop).over(before), F.lit(0.0))) / F.sum("w").over(rest)
    leveled = weighed.withColumn("level", level)
    water = F.max(F.when(F.col("level") * F.col("w") <= stop, F.col("level"))).over(Window.partitionBy())
    return (leveled.withColumn("water", water)
            .select("source", "source_size",
                    F.least(stop, F.coalesce(F.col("water") * F.col("w"), stop)).alias("target")))


def _cell(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, KEY_BITS - bits)


def _cuts(frame: DataFrame, need: DataFrame, kept: Tables) -> DataFrame:
    """``(source, cut)``: a source takes its keys up to ``cut``.

    ``frame(source, key, size)`` is ordered by ``key``; ``need(source, need)``
    is how much size to take.  Histograms of the key, pre-aggregated before the
    shuffle, narrow each source's cut to one cell, pass by pass, until cells
    are small; the keys of that cell alone are then summed up in order, rows
    of one key together.  The key where the sum comes nearest to the need is
    the cut (ties: the smaller one); null if nothing is to be taken.
    """
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    state = need.select(F.col("source").alias("t"), F.col("need").cast("double").alias("need"),
                        F.lit(0).cast("long").alias("cell"), F.lit(0.0).alias("below"))
    bits = 0
    while True:
        held = frame.join(state, same("source", "t") & (_cell(F.col("key"), bits) == F.col("cell")))
        if bits and (bits + STEP > KEY_BITS
                     or (held.groupBy("t").count().agg(F.max("count")).first()[0] or 0) <= CELL_ROWS):
            break
        bits += STEP
        run = Window.partitionBy("t").orderBy("c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cells = (held.groupBy("t", "need", "below", _cell(F.col("key"), bits).alias("c"))
                 .agg(F.sum("size").alias("n"))
                 .withColumn("to", F.col("below") + F.sum("n").over(run)))
        last = F.max("c").over(Window.partitionBy("t"))
        state = kept.keep(cells.withColumn("last", last)
                      .filter((F.col("to") >= F.col("need")) | (F.col("c") == F.col("last")))
                      .groupBy("t", "need").agg(F.min(F.struct("c", (F.col("to") - F.col("n")).alias("below"))).alias("x"))
                      .select("t", "need", F.col("x.c").alias("cell"), F.col("x.below").cast("double").alias("below")),
                      "mix-cuts")
    run = Window.partitionBy("t").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keys = (held.groupBy("t", "need", "below", "key").agg(F.sum("size").alias("n"))
            .withColumn("to", F.col("below") + F.sum("n").over(run)))
    # before the cell's first key the sum is `below`: everything under the cell
    floor = (F.shiftleft(F.col("cell"), KEY_BITS - bits) - 1).alias("key")
    options = keys.select("t", "key", "need", "to").unionByName(
        state.select("t", floor, "need", F.col("below").alias("to")))
    return (options.groupBy("t").agg(F.min(F.struct(F.abs(F.col("to") - F.col("need")).alias("gap"), "key")).alias("x"))
            .select("t", F.col("x.key").alias("cut")))


def _chances(sizes: DataFrame, planned: DataFrame) -> DataFrame:
    """``(t, c, certain, need)`` of the sources that take a part of their documents
    once more: a document of ``size`` words is due ``c * size`` times, such that the
    words expected are the words due.  Those due once or more are certain
    (``size >= certain``): they are taken off the words due, and ``c`` is that of the
    others, of which ``need`` words are left to take.

    From the largest size on, a size is certain if it is due once when all
    larger ones are certain.  Works on the counts of each source's sizes.
    """
    n, s = F.col("n").cast("double"), F.col("size").cast("double")
    counted = (sizes.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
               .join(planned.filter("p > 0").select("t", (F.col("p") * F.col("source_size")).alias("due")),
                     F.col("source").eqNullSafe(F.col("t"))))
    down = Window.partitionBy("t").orderBy(F.desc("size"))
    larger = F.coalesce(F.sum(n * s).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(n * s * s).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    open_ = counted.withColumns({"need": F.col("due") - larger, "c": (F.col("due") - larger) / rest}).filter(F.col("c") * s < 1)
    return open_.groupBy("t").agg(F.max(F.struct("size", "c", "need")).alias("x")).select(
        "t", "x.c", (F.col("x.size") + 1).alias("certain"), "x.need")


def plan(sizes: DataFrame, weights=(1, 2, 3), most: int = 3, seed: int = 8) -> DataFrame:
    """What the mix takes, one row a source: ``(t, source_size, target, whole, p, c,
    certain, cut)`` from ``sizes(id, h, source, size)``; see :func:`copies`."""
    with Tables() as kept:
        planned = (targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
                   .withColumn("due", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                               .otherwise(F.lit(0.0)))
                   .withColumn("whole", F.floor("due").cast("int"))
                   .withColumn("p", F.col("due") - F.col("whole")).withColumnRenamed("source", "t").drop("due"))
        planned = kept.keep(planned, "mix-targets")
        chances = kept.keep(_chances(sizes, planned), "mix-chances")
        ranked = (sizes.filter("size > 0").join(chances, F.col("source").eqNullSafe(F.col("t"))).filter("size < certain")
                  .select("source", _rank(seed).alias("key"), "size"))
        cuts = _cuts(ranked, chances.select(F.col("t").alias("source"), "need"), kept).withColumnRenamed("t", "source")
        return stage(planned.join(chances.withColumnRenamed("t", "k"), F.col("t").eqNullSafe(F.col("k")), "left")
                     .join(cuts, F.col("t").eqNullSafe(F.col("source")), "left").drop("source", "k", "need"), "mix-plan")


def _rank(seed: int) -> Column:
    """Random odds over inclusion odds as a fixed-point key: ``odds / (1 +
    odds)`` keeps their order and lies in (0, 1)."""
    u, p = uniform(seed, "id", "h"), F.col("c") * F.col("size")
    odds = (u / (1 - u)) * F.try_divide(1 - p, p)
    return F.floor(odds / (1 + odds) * float((1 << KEY_BITS) - 1))


def _taken(seed: int) -> Column:
    more = (F.col("size") >= F.col("certain")) | ((F.col("size") > 0) & (_rank(seed) <= F.col("cut")))
    return (F.col("whole") + F.when(more, 1).otherwise(0)).cast("int")


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                       word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("h"))


def copies(docs: DataFrame, weights=(1, 2, 3), most: int = 3, seed: int = 8, id_col: str = "doc_id",
           text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each document, one row per input row:
    ``(id_col, size, source_size, target, copies)``.

    ``size`` is the number of words (null text: none), :func:`targets` gives a
    source its size in the mix.  A source is due ``target / source_size`` times:
    the whole part is certain for each of its documents.  The words still due
    are sampled, one more copy at most, with a document's probability ``p``
    proportional to its size: what is due once or more by that is certain too (see
    :func:`_chances`).  With ``u`` uniform by hash, the others are ranked by
    ``(u / (1 - u)) / (p / (1 - p))`` -- Pareto order sampling (Rosen 1997) --
    and taken from the smallest on until the words due are reached as nearly
    as whole documents allow: a sample of fixed size with unequal probabilities.

    Documents of size zero add no words and get whole copies only.  Rows
    alike in id and text share a rank and are taken together.  Null sources
    are one source, the last.  A source without words has target zero and is
    not taken.  An empty table gives no rows.  The same input gives the same
    mix, whatever its partitions.
    """
    slim = stage(_slim(docs, id_col, text_col, source_col), "mix-sizes")
    decided = slim.join(plan(slim, weights, most, seed), F.col("source").eqNullSafe(F.col("t")))
    return decided.select(F.col("id").alias(id_col), "size", "source_size", "target", _taken(seed).alias("copies"))


def mix(docs: DataFrame, weights=(1, 2, 3), most: int = 3, seed: int = 8, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as :func:`copies`
    says, with the columns of ``docs``.  A row's copies follow from its id, its
    text and its source's row of the plan, so the texts are not shuffled."""
    with Tables() as kept:
        slim = kept.keep(_slim(docs, id_col, text_col, source_col), "mix-sizes")
        planned = plan(slim, weights, most, seed)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"),
                       F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    return (rows.join(planned, F.col("source").eqNullSafe(F.col("t")))
            .withColumn("copies", _taken(seed)).filter("copies > 0")
            .select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
            .select(*[F.col("row")[c].alias(c) for c in docs.columns]))
