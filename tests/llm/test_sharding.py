import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import sharding


def test_matrix_margins():
    rng = random.Random(1)
    for seed in range(60):
        counts = [rng.randrange(200) for _ in range(rng.randrange(1, 20))]
        m = sharding.communication_matrix(counts, 16, seed)
        assert m.sum(axis=1).tolist() == counts and (m >= 0).all()
        sizes = m.sum(axis=0)
        assert sizes.sum() == sum(counts) and sizes.max() - sizes.min() <= 1


def test_draws_beyond_numpys_limit():
    rng = np.random.default_rng(1)
    draws = [sharding._hypergeometric(rng, 2 * 10**9, 14 * 10**9, 16_000) for _ in range(2000)]
    assert abs(np.mean(draws) - 2000) < 4 and abs(np.var(draws) / 1750 - 1) < 0.15
    assert sharding._hypergeometric(rng, 10**9, 10**9, 0) == 0


def check(out, n, shards):
    rows = out.select("shard", "slot").collect()
    assert len(rows) == n
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(shards))
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_shards_are_exact_and_repeatable(spark):
    df = spark.createDataFrame([(i, "x" if i % 3 else "same") for i in range(1003)], "doc_id long, text string")
    out = sharding.shuffle_into_shards(df, 16)
    check(out, 1003, 16)
    again = sharding.shuffle_into_shards(df.repartition(5), 16)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    other = sharding.shuffle_into_shards(df, 16, seed=10)
    assert sorted(map(tuple, out.collect())) != sorted(map(tuple, other.collect()))


def test_every_row_is_as_likely_anywhere(spark):
    df = spark.range(64).withColumnRenamed("id", "doc_id")
    seen = Counter()
    for seed in range(12):
        for r in sharding.shuffle_into_shards(df, 4, seed=100 * seed, block_rows=8).collect():
            seen[r["shard"], r["doc_id"] < 16] += 1
    assert all(abs(seen[s, True] - 48) < 26 for s in range(4))


def test_odd_rows(spark, odd, none):
    clash = odd.withColumnRenamed("n_chars", "slot")
    out = sharding.shuffle_into_shards(clash, 5)
    check(out, odd.count(), 5)
    assert out.columns == ["doc_id", "text", "lang", "source", "shard", "slot"]
    same = spark.range(300).select(F.lit(None).cast("string").alias("a"), F.lit(1).alias("b"))
    check(sharding.shuffle_into_shards(same, 7), 300, 7)
    assert sharding.shuffle_into_shards(none, 16).count() == 0


def test_rows_equal_a_plain_restatement(spark):
    """The same hashes, blocks, runs and cells, ordered in plain Python."""
    seed, shards, size = 9, 4, 8
    rows = [(i % 50, f"t{i % 50}") for i in range(300)]     # every row six times
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, sharding.shuffle_into_shards(df, shards, seed, block_rows=size).collect()))
    once = spark.createDataFrame([(i, f"t{i}", c) for i in range(50) for c in range(1, 7)], "doc_id long, text string, c long")
    once = once.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text"))
    items = once.select("doc_id", "text", "c", "h", *[F.xxhash64(F.lit(seed + k), "h", "c").alias(f"h{k}") for k in (1, 2, 3, 4)]).collect()
    blocks = max(sharding.LEAST_BLOCKS, -(-300 // size))
    of = {}
    for r in items:
        of.setdefault(r["h1"] % blocks, []).append(r)
    matrix = sharding.communication_matrix([len(of[b]) for b in sorted(of)], shards, seed)
    placed = {s: [] for s in range(shards)}
    for b, line in zip(sorted(of), matrix.tolist()):
        order = iter(sorted(of[b], key=lambda r: (r["h2"], r["h"], r["c"])))
        for s, n in enumerate(line):
            placed[s] += [next(order) for _ in range(n)]
    cells = max(1, blocks // shards)
    want = [(r["doc_id"], r["text"], s, slot) for s, mine in placed.items()
            for slot, r in enumerate(sorted(mine, key=lambda r: (r["h3"] % cells, r["h4"], r["h"], r["c"])))]
    assert got == sorted(want)
