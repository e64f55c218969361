"""Exact split sizes, disjointness, independence of partitioning."""
from pyspark.sql import functions as F

from tessera.operators import split as sp
from tessera.operators.ranking import global_rank, hash_key, labelled_cut


def test_sizes_disjoint_and_partition_independent(spark):
    base = spark.range(0, 1237).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("line_no"))
    results = []
    for parts in (1, 4, 64):
        df = base.repartition(parts)
        s = sp.exact_split(df, ["doc_id", "line_no"], seed=42)
        rows = {(r["doc_id"], r["line_no"]): r["split"] for r in s.collect()}
        results.append(rows)
        n_train, n_valid, n_test = sp.split_sizes(1237)
        counts = {k: sum(1 for v in rows.values() if v == k) for k in ("train", "valid", "test")}
        assert counts == {"train": n_train, "valid": n_valid, "test": n_test}
        assert len(rows) == 1237
    assert results[0] == results[1] == results[2]


def test_split_matches_global_order(spark):
    base = spark.range(0, 500).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("line_no"))
    s = {r["doc_id"]: r["split"] for r in sp.exact_split(base, ["doc_id", "line_no"]).collect()}
    keyed = base.withColumn("h", hash_key(42, "doc_id", "line_no")).collect()
    order = [r["doc_id"] for r in sorted(keyed, key=lambda r: (r["h"], r["doc_id"]))]
    n_train, n_valid, _ = sp.split_sizes(500)
    for i, d in enumerate(order):
        exp = "train" if i < n_train else "valid" if i < n_train + n_valid else "test"
        assert s[d] == exp


def test_global_rank_is_permutation(spark):
    base = spark.range(0, 300).withColumn("h", hash_key(7, "id"))
    ranks = sorted(r["rank"] for r in global_rank(base, "h", ["id"]).collect())
    assert ranks == list(range(300))


def test_labelling_has_no_exchange_and_odd_sizes(spark):
    base = spark.range(0, 5000).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("line_no"))
    plan = sp.exact_split(base, ["doc_id", "line_no"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    for n in (0, 1, 2, 9, 10):
        rows = sp.exact_split(base.limit(n), ["doc_id", "line_no"]).collect()
        assert [sum(r["split"] == s for r in rows) for s in ("train", "valid", "test")] == list(sp.split_sizes(n))


def test_equal_hashes_are_cut_by_the_key(spark):
    df = spark.range(0, 40).select(F.lit("a" * 32).alias("h"), "id")
    out = {r["id"]: r["split"] for r in labelled_cut(df, "h", ["id"], [10, 30], ["x", "y", "z"]).collect()}
    assert [out[i] for i in range(40)] == ["x"] * 10 + ["y"] * 20 + ["z"] * 10
