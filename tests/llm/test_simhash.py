import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessera.llm import components, simhash


def plain_print(text, k=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for a in range(len(prints)):
            for b in range(len(prints)):
                if (prints[a] ^ prints[b]).bit_count() <= distance and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_fold_in_blocks():
    h = np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64)
    assert simhash.fold(h, 7) == simhash.fold(h) and simhash.fold(h[:0]) == 0


def test_segments_find_every_close_pair():
    rng = random.Random(2)
    for segments in (1, 2, 3, 4, 5):
        plan = simhash.plan_segments(64, 4, segments)
        assert sum(w for _, w, _ in plan) == 64 and sum(r for _, _, r in plan) == 5 - segments
        for _ in range(500):
            x = sum(1 << b for b in rng.sample(range(64), 4))
            assert any((x >> s & (1 << w) - 1).bit_count() <= r for s, w, r in plan)


def test_close_pairs_equal_all_pairs(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(12)] + [0, 2**64 - 1]
    prints = sorted({b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(7))) for b in base for _ in range(12)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(prints)) for j in range(i)
            if (prints[i] ^ prints[j]).bit_count() <= 4}
    for segments in (2, 3):
        assert {tuple(r) for r in simhash.close_pairs(df, 4, segments).collect()} == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (7, 7), (300, 300)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["label"] for r in components.connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert components.connected_components(df.limit(0)).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(15):
        words = [f"W{rng.randrange(500)}" for _ in range(rng.choice([2, 40, 400]))]
        texts += [" ".join(words), "  ".join(words).lower()]
        for _ in range(4):
            changed = list(words)
            changed[rng.randrange(len(words))] = "x"
            texts.append("\t".join(changed))
    texts += [None, "", "\n", "\u00c9a b", "\u00e9a b"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = sorted(zip(ids, texts))
    prints = [plain_print(t) for _, t in rows]
    want = plain_components(prints, 4)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(3)
    got = sorted(simhash.near_duplicates(df).collect())
    assert [r["fingerprint"] for r in got] == [f"{p:016x}" for p in prints]
    assert [r["component_id"] for r in got] == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_odd_rows(odd, none):
    got = simhash.near_duplicates(odd)
    assert got.count() == odd.count()
    by = {r["doc_id"]: r["component_id"] for r in got.collect() if r["doc_id"] is not None}
    assert by[7] == by[1] == 1 and by[2] == by[3] == by[4] == 2
    kept = simhash.keep_one(odd).collect()
    assert sorted(r["doc_id"] or -1 for r in kept) == [-1, 1, 2, 5, 8, 9]  # 6 differs from 5 by a word
    assert odd.filter(F.col("doc_id").isNull() & F.col("text").isNotNull()).first() in kept
    assert simhash.near_duplicates(none).count() == simhash.keep_one(none).count() == 0
