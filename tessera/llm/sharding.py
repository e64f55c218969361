"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

from math import exp, lgamma

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tables import stage

#: Rows that a block (an input part, or a part of a shard) has on average.
BLOCK_ROWS = 200_000
#: Fewest blocks: small tables are spread, too.
LEAST_BLOCKS = 64


def communication_matrix(counts, shards: int, seed: int) -> np.ndarray:
    """How many rows go from each block to each shard.

    Rows sum to ``counts``, columns to shard sizes at most one apart; drawn, a
    block after the other, from the multivariate hypergeometric distribution,
    which is that of these numbers if all rows were shuffled as one.
    """
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    left = np.full(shards, total // shards, np.int64)
    left[:total % shards] += 1
    rng = np.random.default_rng(seed)
    out = np.zeros((len(counts), shards), np.int64)
    for i, n in enumerate(counts):
        # one shard after the other: numpy's own draw is limited to 1e9 rows
        rest, room = int(n), int(left.sum())
        for j in range(shards):
            room -= int(left[j])
            take = rest if room == 0 else _hypergeometric(rng, int(left[j]), room, rest)
            out[i, j] = take
            rest -= take
        left -= out[i]
    return out


def _hypergeometric(rng, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` without replacement.  numpy draws them up to
    1e9 rows; beyond, the distribution is walked from its mode outwards."""
    total = good + bad
    if not good or not draws:
        return 0
    if total < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    lg = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    low, high = max(0, draws - bad), min(draws, good)
    up = down = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    p_up = p_down = exp(lg(good, up) + lg(bad, draws - up) - lg(total, draws))
    left = rng.random() - p_up
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
        if p_up + p_down < 1e-18:  # what rounding has left over
            break
    return min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))


def shuffle_into_shards(docs: DataFrame, shards: int = 16, seed: int = 9, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0
    within its shard), a uniformly random order of all rows.

    1. Rows fall into blocks by a hash of all their columns; the blocks' counts
       (one row a block reaches the driver) are the matrix's row sums.
    2. A block is permuted (ordered by a seeded hash) and cut into runs as long
       as its matrix row says: run ``j`` goes to shard ``j``.
    3. A shard is permuted again: by another hash its rows fall into cells,
       whose counts give each cell its first slot, and are ordered inside.

    Blocks and cells are hash buckets of about ``block_rows`` rows, so no task
    holds a shard.  Rows alike in every column are counted first (map-side) and
    numbered, so that copies spread over the blocks and the result depends on
    the rows and the seed alone.  Shard sizes are at most one apart.  Columns
    named ``shard`` and ``slot`` are replaced, all others kept (they must be
    comparable, so no maps); nulls are values like others; an empty table stays
    empty.
    """
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = stage(docs.groupBy(*names).agg(F.count("*").alias("__n"))
                 .withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
                 .select(*names, "__copy", F.xxhash64(F.lit(seed), *names).alias("__h")), "shard-rows")
    spark = docs.sparkSession
    n = rows.count()
    blocks = max(LEAST_BLOCKS, -(-n // block_rows))
    bucket = lambda k, of: F.pmod(F.xxhash64(F.lit(seed + k), "__h", "__copy"), F.lit(of)).cast("int")
    order = lambda k: [F.xxhash64(F.lit(seed + k), "__h", "__copy"), F.col("__h"), F.col("__copy")]
    rows = rows.withColumn("__block", bucket(1, blocks))
    counts = {r["__block"]: r["count"] for r in rows.groupBy("__block").count().collect()}
    held = sorted(counts)
    matrix = communication_matrix([counts[b] for b in held], shards, seed)
    ends = spark.createDataFrame([(b, e.tolist()) for b, e in zip(held, np.cumsum(matrix, axis=1))],
                                 "__b int, __ends array<long>")
    placed = (rows.withColumn("__at", F.row_number().over(Window.partitionBy("__block").orderBy(*order(2))))
              .join(ends, F.col("__block") == F.col("__b"))
              .withColumn("shard", F.size(F.filter("__ends", lambda e: e < F.col("__at"))))
              .withColumn("__cell", bucket(3, max(1, blocks // shards)))
              .select(*names, "shard", "__cell", "__h", "__copy"))
    placed = stage(placed, "shard-placed")
    before = Window.partitionBy("s").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy(F.col("shard").alias("s"), F.col("__cell").alias("c")).agg(F.count("*").alias("k"))
               .select("s", "c", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("__from")))
    inside = Window.partitionBy("shard", "__cell").orderBy(*order(4))
    return (placed.withColumn("__at", F.row_number().over(inside))
            .join(offsets, (F.col("shard") == F.col("s")) & (F.col("__cell") == F.col("c")))
            .select(*names, "shard", (F.col("__from") + F.col("__at") - 1).cast("long").alias("slot")))
