import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, least, most):
    """All pairs and terms in Python's integers."""
    docs = [[re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")),
             lang or "", source or ""] for t, lang, source in rows]
    out = set()
    for lang in {d[1] for d in docs}:
        mine = [d for d in docs if d[1] == lang]
        df = Counter(t for d in mine for t in set(d[0]))
        kept = {t for t in df if df[t] >= least}
        count = {s: Counter(t for d in mine if d[2] == s for t in d[0] if t in kept) for s in {d[2] for d in mine}}
        whole = Counter(t for d in mine for t in d[0] if t in kept)
        price = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        for s, c in count.items():
            pairs = [(-sum(abs(price(c, t) - price(o, t)) for t in kept), x) for x, o in count.items() if x != s]
            terms = [(price(whole, t) - price(c, t), t) for t in c if price(c, t) > price(whole, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:most])):
                out |= {(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(found)}
    return out


@pytest.mark.parametrize("block_terms,held", [(1 << 16, 500_000), (3, 4)])
def test_equals_plain_arithmetic(spark, monkeypatch, block_terms, held):
    monkeypatch.setattr(divergence, "HELD", held)
    rng = random.Random(4)
    words = [f"w{chr(97 + i)}" for i in range(20)] + ["Été", "UPPER", "x_y", "世界", "a1b", "ı"]
    rows = [(" ".join(rng.choices(words, weights=range(1, 27), k=rng.randrange(30))), rng.choice(["en", "fr", None]),
             rng.choice(["a", "b", "c", None, "B"])) for _ in range(120)]
    rows += [(None, "en", "empty"), ("", "xx", "only"), ("1 2 3", "xx", "two"), (None, None, None), ("one", "yy", "lone")]
    docs = spark.createDataFrame([(i % 7, *r) for i, r in enumerate(rows)], SCHEMA).repartition(6)
    got = divergence.audit(docs.withColumnsRenamed({"doc_id": "value"}), least_docs=6, most_terms=4, block_terms=block_terms)
    assert {tuple(r) for r in got.collect()} == brute(rows, 6, 4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_odd_rows(spark, odd, none):
    rows = [(r["text"], r["lang"], r["source"]) for r in odd.collect()]
    for least in (1, 2, 50):
        assert {tuple(r) for r in divergence.audit(odd, least).collect()} == brute(rows, least, 50)
    assert divergence.audit(none).count() == 0


def test_gallop_finds_what_is_in_both():
    rng = np.random.default_rng(3)
    for n, m in ((0, 0), (0, 5), (5, 0), (1, 4000), (300, 300), (70, 9000), (4000, 4100)):
        a, b = (np.sort(rng.choice(10_000, k, replace=False)) for k in (n, m))
        i, j = divergence.gallop(a, b)
        assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_prices_are_exact_at_any_size(spark):
    from pyspark.sql import functions as F
    rng = random.Random(5)
    for total in (7, 10**6 + 3, 10**12 + 39, 2**63 // 32_000 + 11, 4 * 10**17 + 7):
        counts = [0, 1, 2, total // 3, total - 5] + [rng.randrange(total) for _ in range(20)]
        want = [1 + 10**9 * (c + 5) // total for c in counts]
        assert divergence.prices(np.array(counts), total).tolist() == want
        df = spark.createDataFrame([(c, total) for c in counts], "c long, t long")
        assert [r[0] for r in df.select(divergence.price(F.col("c"), F.col("t"))).collect()] == want
