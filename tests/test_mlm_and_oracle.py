"""MLM data properties; registered queries against their DuckDB oracle."""
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import mlm


def test_examples_mask_batches(spark):
    rows = [(d, 0, list(range(10, 10 + d * 7))) for d in range(1, 40)]
    df = spark.createDataFrame(rows, "doc_id long, line_no long, ids array<int>")
    ex = mlm.examples(df, F.col("ids"), max_length=16)
    r = {x["doc_id"]: x for x in ex.collect()}
    assert list(r[1]["input_ids"]) == [2] + list(range(10, 17)) + [3]
    assert len(r[30]["input_ids"]) == 16 and r[30]["input_ids"][-1] == 3
    m = mlm.mask(ex, vocab_size=1000).collect()
    chosen = total = 0
    for x in m:
        for i, (a, b, lab) in enumerate(zip(x["input_ids"], x["masked_ids"], x["labels"])):
            if a in (2, 3):
                assert lab == -100 and b == a
                continue
            total += 1
            if lab != -100:
                chosen += 1
                assert lab == a
            else:
                assert b == a
    assert 0.08 < chosen / total < 0.22
    b = mlm.batches(ex, batch_size=8).collect()
    by = {}
    for x in b:
        by.setdefault(x["batch_id"], []).append(x)
    assert sorted(len(v) for v in by.values())[-1] == 8
    for v in by.values():
        L = max(len(x["input_ids"]) for x in v)
        assert all(len(x["padded_ids"]) == L and len(x["padded_mask"]) == L for x in v)
        assert sorted(x["position"] for x in v) == list(range(len(v)))


def test_hash01_matches_md5(spark):
    df = spark.createDataFrame([(1, 2)], "doc_id long, line_no long")
    v = df.select(mlm.hash01(42, "doc_id", "line_no")).first()[0]
    h = hashlib.md5(b"42:1:2").hexdigest()
    assert math.isclose(v, int(h[:8], 16) / 4294967296.0)


def test_ids_by_join_and_collated_batches(spark):
    rows = [(i, 0, ["the"] * (i % 5) + ["cat", "?"]) for i in range(20)] + [(20, 0, [])]
    df = spark.createDataFrame(rows, "doc_id long, line_no long, tokens array<string>")
    vocab = spark.createDataFrame([("the", 7), ("cat", 9)], "piece string, id int")
    ids = mlm.ids_by_join(df, "tokens", vocab, ["doc_id", "line_no"])
    got = {r["doc_id"]: r["ids"] for r in ids.collect()}
    assert got == {i: [{"the": 7, "cat": 9}.get(t, 1) for t in toks] for i, _, toks in rows}
    masked = mlm.mask(mlm.examples(ids, F.col("ids"), 10), 10, probability=0.5)
    for by_length in (False, True):
        out = mlm.batches(masked, 4, by_length=by_length).orderBy("batch_id", "position").collect()
        assert [(r["batch_id"], r["position"]) for r in out] == [(i // 4, i % 4) for i in range(21)]
        for r in out:
            n = len(r["masked_ids"])
            pad = r["batch_len"] - n
            assert list(r["padded_ids"]) == list(r["masked_ids"]) + [0] * pad
            assert list(r["padded_labels"]) == list(r["labels"]) + [-100] * pad
            assert list(r["padded_mask"]) == [1] * n + [0] * pad
    assert [len(r["masked_ids"]) for r in out] == sorted(len(r["masked_ids"]) for r in out)


def test_ids_of_rows_that_share_a_key(spark):
    rows = [(1, ["a", "b", "x"]), (1, ["b"]), (None, ["a", None]), (2, None), (3, []), (3, ["b"])]
    df = spark.createDataFrame(rows, "k long, tokens array<string>")
    vocab = spark.createDataFrame([("a", 7), ("b", 5)], "piece string, id int")
    for most in (10, 1):                    # sent to the tasks, joined
        got = {r["k"]: list(r["ids"]) for r in mlm.ids_by_join(df, "tokens", vocab, ["k"], max_broadcast=most).collect()}
        assert got == {1: [5, 7, 5, 1], None: [7, 1], 2: [], 3: [5]}


def test_ids_exchange_arrays_not_tokens(spark):
    df = spark.createDataFrame([(1, ["a"])], "k long, tokens array<string>")
    vocab = spark.createDataFrame([("a", 7)], "piece string, id int")
    plan = mlm.ids_by_join(df, "tokens", vocab, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_mask_draws_once_for_the_choice(spark):
    """The choice is drawn once a position, and by the digits as by the number."""
    ex = spark.range(60).selectExpr("id doc_id", "0L line_no", "array(2, 10, 11, 12, 13, 3) input_ids")
    m = mlm.mask(ex, 1000, probability=0.3)
    assert m.select("masked_ids")._jdf.queryExecution().analyzed().toString().count("md5(") <= 4
    draw = lambda d, i, salt: int(hashlib.md5(f"42:0:{d}:0:{i}:{salt}".encode()).hexdigest()[:8], 16) / 2 ** 32
    for r in m.collect():
        for i, x in enumerate(r["input_ids"]):
            v = draw(r["doc_id"], i, "v")
            new = 4 if v < 0.8 else int(draw(r["doc_id"], i, "r") * 1000) if v < 0.9 else x
            want = (new, x) if x > 3 and draw(r["doc_id"], i, "p") < 0.3 else (x, -100)
            assert (r["masked_ids"][i], r["labels"][i]) == want


def test_mask_hashes_outside_the_plan(spark):
    """No hash of a position is an expression of the plan, which is slow there; null keys, ids and
    rows are as they were (a null key is left out of what is hashed)."""
    rows = [(1, 0, [2, 10, None, 11, 3]), (None, 1, [12] * 40), (2, None, [13] * 40), (3, 0, None), (4, 0, [])]
    m = mlm.mask(spark.createDataFrame(rows, "doc_id long, line_no long, input_ids array<int>"), 1000, probability=0.5)
    assert "md5(" not in m._jdf.queryExecution().analyzed().toString()
    for r in m.collect():
        if r["input_ids"] is None:
            assert r["masked_ids"] is None and r["labels"] is None
            continue
        key = ":".join(str(k) for k in ("42", "0", r["doc_id"], r["line_no"]) if k is not None)
        draw = lambda i, salt: int(hashlib.md5(f"{key}:{i}:{salt}".encode()).hexdigest()[:8], 16) / 2 ** 32
        want = []
        for i, x in enumerate(r["input_ids"]):
            v = draw(i, "v")
            new = 4 if v < 0.8 else int(draw(i, "r") * 1000) if v < 0.9 else x
            want.append((new, x) if x is not None and x > 3 and draw(i, "p") < 0.5 else (x, -100))
        assert list(zip(r["masked_ids"], r["labels"])) == want


def test_cells_by_length_stay_few(spark):
    """The driver counts cells of tens of batches, not lengths times hash prefixes."""
    df = spark.range(30_000).selectExpr("id doc_id", "0L line_no", "array_repeat(7, int(pow(id % 100, 2) / 400)) input_ids")
    keyed = df.withColumns({"_h": mlm.hash_key(42, F.lit(0), "doc_id", "line_no"), "_n": F.size("input_ids")})
    for by_length, most in ((True, 25 + 30_000 // 64), (False, 30_000 // 64)):
        _, first = mlm._cells(keyed, 2, by_length)
        assert first.count() <= most and first.agg(F.sum("_count")).first()[0] == 30_000
    out = mlm.batches(df, 2, by_length=True).orderBy("batch_id", "position").collect()
    want = sorted((len(r["input_ids"]), hashlib.md5(f"42:0:{r['doc_id']}:0".encode()).hexdigest(), r["doc_id"]) for r in out)
    assert [r["doc_id"] for r in out] == [d for _, _, d in want]
    assert [(r["batch_id"], r["position"]) for r in out] == [(i // 2, i % 2) for i in range(30_000)]
    assert all(r["batch_len"] == max(want[i][0], want[i ^ 1][0]) for i, r in enumerate(out))


CHEAP = ["wordpiece_encode", "benchmark_coverage", "mlm_masked", "mlm_batches_by_length", "gold_segments", "corpus_lines", "clean_lines", "good_lines", "untag_lines", "line_words", "pretokens",
         "split_lines", "split_summary", "encoded_lines", "tokenizer_report", "boundary_summary",
         "word_frequency", "bpe_pair_counts", "mlm_batches", "unigram_seed"]


def test_registered_queries_match_oracle(spark, sf001):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf001}/{t}.parquet')")
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)

    def norm(v):
        if isinstance(v, float):
            return round(v, 9)
        return v

    for name in CHEAP:
        df = qs[name](spark, sf001)
        a = sorted(tuple(norm(x[c]) for c in sorted(df.columns)) for x in df.collect())
        res = con.sql(sql[name])
        cols = res.columns
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        b = sorted(tuple(norm(r[i]) for i in order) for r in res.fetchall())
        assert sorted(df.columns) == sorted(cols), name
        assert a == b, name


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    rows = df.collect()
    assert rows and df.columns[0] == "language" and rows[0]["language"] == "all"
