import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing


def plain_targets(sizes, weights, most):
    """Share out by weight, stop at the limit, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=str) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            target.update({s: level * weight[s] for s in free})
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            free.remove(s)
    return target


def test_targets_equal_resharing(spark):
    rng = random.Random(1)
    for _ in range(12):
        names = rng.sample(["a", "b", "B", "é", "\U0001f642", "\ufffd", "z10", "z9", None, ""], rng.randrange(1, 10))
        sizes = {n: rng.choice([0, 1, 5, 100, 1000, 10**6]) for n in names}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
        want = plain_targets(sizes, (1, 2, 3), 3)
        assert got == pytest.approx(want)


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 20, 60])), rng.choice(["hot"] * 6 + ["a", "b", None, "c"]), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.copies(df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.copies(df.repartition(7)).collect()))
    joined = got.join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        F.sum("size").alias("all"), F.first("source_size").alias("s"), F.first("target").alias("t"),
        F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("copies").alias("most")).collect()
    for r in joined:
        assert r["all"] == r["s"] and abs(r["taken"] - r["t"]) <= 30 and r["most"] <= 3
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == got.agg(F.sum("copies")).first()[0]


def test_cells_are_split_until_they_are_small(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 9)), rng.choice(["a", "b", "c"])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(tuple, mixing.copies(df).collect()))
    monkeypatch.setattr(mixing, "CELL_ROWS", 0)
    assert sorted(map(tuple, mixing.copies(df).collect())) == want


def plain_selection(rows, u, weights, most):
    """Copies of ``rows`` (id, size, source) by the definition, in plain Python."""
    sizes = {}
    for _, n, s in rows:
        sizes[s] = sizes.get(s, 0) + n
    out = {}
    for s, target in plain_targets(sizes, weights, most).items():
        mine = [(i, n) for i, n, x in rows if x == s]
        due = target / sizes[s] if sizes[s] else 0.0
        out.update({i: int(due) for i, _ in mine})
        need, rest = (due - int(due)) * sizes[s], sorted((n, i) for i, n in mine if n)
        if need <= 0:
            continue
        while True:
            c = need / sum(n * n for n, _ in rest)
            if c * rest[-1][0] < 1:
                break
            top = rest[-1][0]
            for n, i in [x for x in rest if x[0] == top]:
                out[i] += 1
                need -= n
            rest = [x for x in rest if x[0] < top]
        order = sorted((u[i] / (1 - u[i]) * (1 - c * n) / (c * n), n, i) for n, i in rest)
        best, total, take = abs(need), 0, 0
        for k, (_, n, _) in enumerate(order):
            total += n
            if abs(total - need) < best:
                best, take = abs(total - need), k + 1
        for _, _, i in order[:take]:
            out[i] += 1
    return out


def test_equals_the_selection_in_plain_python(spark):
    rng = random.Random(5)
    for weights in ((1, 2, 3), (5, 1)):
        rows = [(i, rng.choice([0, 1, 2, 3, 8, 30, 31, 200]), rng.choice(["a", "b", "c", "d", None])) for i in range(300)]
        df = spark.createDataFrame([(i, "w " * n, s) for i, n, s in rows], "doc_id long, text string, source string").repartition(5)
        u = {r[0]: r[1] for r in df.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")).select(
            "id", mixing.uniform(8, "id", "h")).collect()}
        got = {r["doc_id"]: r["copies"] for r in mixing.copies(df, weights=weights).collect()}
        assert got == plain_selection(rows, u, weights, 3)


def test_inclusion_follows_size(spark):
    """A document's chance of the extra copy is proportional to its size; the largest are certain."""
    rows = [(i, (2, 4, 8)[i % 3], "a") for i in range(9000)] + [(9000 + i, 2000, "a") for i in range(3)] + [(10_000, 30_000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, n int, source string").select(
        "doc_id", F.repeat(F.lit("w "), F.col("n")).alias("text"), "source")
    got = mixing.copies(df, weights=(1, 2)).join(df.select("doc_id", "source"), "doc_id").filter("source = 'a'").collect()
    whole = min(r["copies"] for r in got)
    size, target = got[0]["source_size"], got[0]["target"]
    need = target - whole * size
    extra = {n: [r["copies"] - whole for r in got if r["size"] == n] for n in (2, 4, 8, 2000)}
    certain = need / sum(n * n for _, n, s in rows if s == "a") * 2000 >= 1
    assert certain and extra[2000] == [1, 1, 1]
    c = (need - 6000) / sum(n * n * 3000 for n in (2, 4, 8))
    assert 0.5 < c * 8 < 1
    for n in (2, 4, 8):
        share = sum(extra[n]) / 3000
        assert abs(share - c * n) < 0.04, (n, share, c * n)


def test_ranks_are_pareto(spark):
    """Of many equal documents, each seed takes a share close to its odds' and a fixed size."""
    df = spark.createDataFrame([(i, "w", "a" if i % 4 else "b") for i in range(400)], "doc_id long, text string, source string")
    counts = {}
    for seed in range(5):
        for r in mixing.copies(df, weights=(1, 1), most=3, seed=seed).collect():
            counts.setdefault((seed, r["doc_id"] % 4 == 0), []).append(r["copies"])
    assert {sum(v) for (_, b), v in counts.items()} == {200}
    assert len({tuple(v) for (s, b), v in counts.items() if not b}) > 1


def test_odd_rows(odd, none):
    got = mixing.copies(odd.withColumnRenamed("n_chars", "target"))
    assert got.count() == odd.count()
    assert got.filter("copies < 0 or copies > 3 or copies is null").count() == 0
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.copies(none).count() == mixing.mix(none).count() == 0
    blank = odd.filter("doc_id in (2, 3, 4)")
    assert mixing.copies(blank).agg(F.sum("copies")).first()[0] == 0
