import numpy as np
import pytest

from tessera.llm import multi_index as mi


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        v = x[ids.index(q)]
        near = sorted((-float(mi.cosine(v[None], w[None])[0]), i) for i, w in zip(ids, x) if i != q)
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


def rows_of(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_traversal_is_in_order_of_the_sum():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 9, rng.integers(1, 7)).astype(float), rng.integers(0, 9, rng.integers(1, 7)).astype(float)
        counts = {int(c): int(rng.integers(1, 5)) for c in rng.permutation(len(a) * len(b))[:rng.integers(0, 12)]}
        pairs = sorted((a[c // len(b)] + b[c % len(b)], n) for c, n in counts.items())
        for want in (1, 3, 10):
            got, reach = 0, float("inf")
            for d, n in pairs:
                got += n
                if got >= want:
                    reach = d
                    break
            assert mi.traverse(a, b, counts, want) == reach


@pytest.mark.parametrize("block", [7, 2000])
def test_exact_when_everything_is_visited(spark, monkeypatch, block):
    monkeypatch.setattr(mi, "BLOCK_VECTORS", block)
    monkeypatch.setattr(mi, "BLOCK_QUERIES", block)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6))
    x[50:130] = x[50]  # a very common vector
    x[200] = 3 * x[201]
    ids = list(range(300))
    df = spark.createDataFrame([(i, v.tolist(), "s") for i, v in zip(ids, x)], "vec_id long, embedding array<double>, score string")
    got = rows_of(mi.search(df.repartition(3), lambda i: i % 10 == 0, k=5, least=10**6))
    want = brute(ids, x, range(0, 300, 10), 5)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert [s for _, s in got[q]] == [s for _, s in want[q]]


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
            (6, [1.0, 1.0]), (7, [1e300, 1e300]), (None, [1.0, 2.0]), (8, [1.0, 2.0, 3.0]), (9, []), (0, [1.0, 0.0]),
            (10, [-1e-300, 0.0]), (11, [-0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(r["id"] for r in mi.valid(df, "vec_id", "embedding").distinct().collect()) == [0, 6, 7, 8, 10, 11]
    got = rows_of(mi.search(df, lambda i: i == 0, k=5))
    assert [i for i, _ in got[0]][:2] == [6, 7] and len(got[0]) == 4
    assert mi.search(df.limit(0), lambda i: i == 0).count() == 0
    assert mi.search(df.filter("vec_id = 0"), lambda i: i == 0).count() == 0


def test_every_length_has_neighbours_of_its_own(spark):
    """Two sizes in bulk, a third that is rare: each is searched like a table of its own."""
    rng = np.random.default_rng(4)
    sizes = [4] * 150 + [7] * 120 + [3] * 5
    rows = [(int(i), rng.normal(size=n).tolist()) for i, n in zip(rng.permutation(len(sizes)), sizes)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = rows_of(mi.search(df, lambda i: i % 3 == 0, k=5, least=10**6))
    want = {}
    for n in (3, 4, 7):
        mine = [(i, v) for i, v in rows if len(v) == n]
        want |= brute([i for i, _ in mine], np.array([v for _, v in mine]), [i for i, _ in mine if i % 3 == 0], 5)
    assert got.keys() == {q for q in want if want[q]}
    for q in got:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_recall_on_the_given_table(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    df = spark.read.parquet(path)
    rows = sorted((r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect())
    x = mi.unit_rows(mi.matrix([v for _, v in rows]))
    ids = np.array([i for i, _ in rows])
    got = rows_of(mi.search(df, lambda i: i % 50 == 0, k=5))
    hit = total = 0
    for q, found in got.items():
        s = x @ x[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -9
        best = set(ids[np.lexsort((ids, -s))[:5]].tolist())
        hit += len(best & {i for i, _ in found})
        total += 5
    assert hit / total >= 0.9
