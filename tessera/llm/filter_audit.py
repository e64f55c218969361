"""What each of several filters removes, in every order of applying them."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tables import WORD

#: The filters; bit i of a mask says that a document fails the i-th of them.
FILTERS = "ABCDE"
#: The one that looks at the whole table: a copy of an earlier document.
COPY = "E"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def rules(text: Column, least_words: int = 200, least_distinct: int = 50, most_capitals: int = 3,
          symbols: str = "[#$%&*|]") -> dict[str, Column]:
    """The filters that look at one text (not null): whether it fails them.
    A: words; B: distinct words in 100; C: A-Z among 100 code points; D: symbols."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    return {"A": F.size(words) < least_words,
            "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * least_distinct,
            "C": capitals.cast("long") * 100 > F.length(text).cast("long") * most_capitals,
            "D": text.rlike(symbols)}


def cells(docs: DataFrame, labels: DataFrame, fails: dict[str, Column] | None = None, id_col: str = "doc_id",
          text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents by the filters they fail.

    The texts are read once and leave as a 32-byte digest.  Everything after
    that is counted before it is exchanged, so neither a text with many copies
    nor a repeated id gathers its rows: of a text only one row for each part and
    label meets the others.  A copy is a row whose text also has a smaller id; rows
    without an id are never copies, nor make others copies.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    fails = fails or rules(text)
    mask = sum((fails[f].cast("int") * (1 << i) for i, f in enumerate(FILTERS) if f in fails), F.lit(0))
    rows = (docs.select(F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.col(id_col).alias("id"),
                        mask.alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
            .groupBy("id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n")))
    # a document is good (toxic) if one of its labels says so
    known = (labels.filter(F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
                                                     F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
             .withColumn("spread", F.lit(0).cast("long")))
    # rows without an id match no label: a second key deals them out
    spread = F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0))
    labelled = rows.withColumn("spread", spread).join(known, ["id", "spread"], "left").select(
        "id", "digest", "part", "mask", "n", F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"))
    alike = labelled.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"))
    least = F.min("first.id").over(Window.partitionBy("digest"))
    original = F.col("no_id") + F.when(F.col("first.id") == least, F.col("first.n")).otherwise(F.lit(0))
    copy = 1 << FILTERS.index(COPY)
    split = alike.withColumn("original", original).select("part", "good", "toxic", F.explode(F.array(
        F.struct("mask", F.col("original").alias("n")),
        F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("original")).alias("n")))).alias("c"))
    n = F.col("c.n")
    return (split.filter("c.n > 0").groupBy("part", "c.mask")
            .agg(F.sum(n).alias("n"), F.coalesce(F.sum(F.when(F.col("good"), n)), F.lit(0)).alias("good"),
                 F.coalesce(F.sum(F.when(F.col("toxic"), n)), F.lit(0)).alias("toxic")))


def audit(docs: DataFrame, labels: DataFrame, fails: dict[str, Column] | None = None, id_col: str = "doc_id",
          text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per part, order of the filters and step: what that step removes.

    Returns ``(part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley)``, 600 rows a part (zeros included).  ``fails``
    are conditions over ``docs`` for A to D; see :func:`rules` and :func:`cells`.

    Each of a part's at most 32 cells folds over the array of orders (a literal, sent
    with the plan): 600 structs weighted with the cell's counts, which are then
    summed element by element.  ``shapley`` is what the step's filter removes over
    all orders.

    Null texts are empty, a null part is the empty string, null labels are neither
    good nor toxic; no rows give no rows; other columns are not read.
    """
    orders = ["".join(p) for p in permutations(FILTERS)]
    bits = F.lit([[1 << FILTERS.index(f) for f in o] for o in orders])
    n, good, toxic, mask = (F.col(c) for c in ("n", "good", "toxic", "mask"))
    none = F.lit(0).cast("long")

    def step(seen, bit):
        fails = mask.bitwiseAND(bit) != 0
        here = fails & ~seen["gone"]
        row = F.struct(bit.alias("bit"), F.when(seen["gone"] | fails, none).otherwise(n).alias("kept"),
                       *[F.when(cond, x).otherwise(none).alias(name) for name, cond, x in (
                           ("removed", here, n), ("redundant", fails & seen["gone"], n), ("unique_fails", mask == bit, n),
                           ("good_lost", here, good), ("toxic_lost", here, toxic))])
        return F.struct((seen["gone"] | fails).alias("gone"), F.concat(seen["rows"], F.array(row)).alias("rows"))

    schema = "array<struct<bit:int," + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"
    start = F.struct(F.lit(False).alias("gone"), F.from_json(F.lit("[]"), schema).alias("rows"))
    fold = F.flatten(F.transform(bits, lambda order: F.aggregate(order, start, step, lambda seen: seen["rows"])))
    zeros = F.transform(F.flatten(bits), lambda bit: F.struct(bit.alias("bit"), *[none.alias(c) for c in COUNTS]))

    def add(a, b):
        return F.zip_with(a, b, lambda x, y: F.struct(x["bit"].alias("bit"), *[(x[c] + y[c]).alias(c) for c in COUNTS]))

    merged = (cells(docs, labels, fails, id_col, text_col, part_col).select("part", fold.alias("rows"))
              .groupBy("part").agg(F.aggregate(F.collect_list("rows"), zeros, add).alias("rows")))
    total = F.transform(F.lit([1 << i for i in range(len(FILTERS))]), lambda bit: F.aggregate(
        "rows", none, lambda s, r: s + F.when(r["bit"] == bit, r["removed"]).otherwise(none)))
    shapley = F.element_at("total", (F.log2(F.col("r.bit").cast("double")) + 1).cast("int"))
    steps = len(FILTERS)
    return (merged.withColumn("total", total).select("part", "total", F.posexplode("rows").alias("at", "r"))
            .select("part", F.element_at(F.lit(orders), F.expr(f"at div {steps} + 1").cast("int")).alias("filter_order"),
                    (F.col("at") % steps + 1).cast("int").alias("step"), *[F.col(f"r.{c}").alias(c) for c in COUNTS],
                    shapley.alias("shapley")))
