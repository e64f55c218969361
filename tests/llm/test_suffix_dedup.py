import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import suffix_dedup

SCHEMA = "doc_id long, text string, n_spans string"


def brute(texts, length):
    datas = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in datas for i in range(len(d) - length + 1))
    out = []
    for d in datas:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((bytes(b for b, g in zip(d, gone) if not g), len(d), int(gone.sum()), int((edges == 1).sum())))
    return out


def run(spark, texts, length, ids=None, parts=3, **kw):
    rows = [(i if ids is None else ids[i], t, "x") for i, t in enumerate(texts)]
    df = suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(parts), length, **kw)
    return [(r["doc_id"], bytes(r["text"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in df.collect()]


def check(spark, texts, length, **kw):
    got = {r[0]: r[1:] for r in run(spark, texts, length, **kw)}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def corpus(rng, alphabet="abcdefgh ", n=24):
    """Texts that share passages at different places, with edits, and runs of one character."""
    word = lambda k: "".join(rng.choices(alphabet, k=k))
    shared = [word(rng.randrange(10, 60)) for _ in range(4)]
    texts = []
    for _ in range(n):
        t = word(rng.randrange(30))
        for _ in range(rng.randrange(4)):
            t += rng.choice([rng.choice(shared), rng.choice(shared)[rng.randrange(8):], "a" * rng.randrange(40),
                             "ab" * rng.randrange(20), "é" * rng.randrange(9)]) + word(rng.randrange(12))
        texts.append(t)
    return texts + [None, "", "short", texts[0], texts[1] + "!"]


@pytest.mark.parametrize("seed,length,anchor,most,held", [(1, 12, None, 2_000, 400_000), (2, 20, 5, 2, 400_000),
                                                          (3, 16, 16, 2_000, 30), (4, 9, 1, 3, 10)])
def test_equals_brute_force(spark, monkeypatch, seed, length, anchor, most, held):
    monkeypatch.setattr(suffix_dedup, "MOST_MEMBERS", most)
    monkeypatch.setattr(suffix_dedup, "HELD_RUNS", held)
    check(spark, corpus(random.Random(seed)), length, anchor=anchor)


def test_texts_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 64)
    monkeypatch.setattr(suffix_dedup, "_LOW", np.uint64(127))
    suffix_dedup._powers.cache_clear()
    rng = random.Random(6)
    long = "".join(rng.choices("abcdefgh", k=700))
    found = [np.concatenate(x) for x in zip(*suffix_dedup.runs((long[100:300] + long).encode(), 20, 5))]
    assert found[0][0] == 0 and found[1][-1] == 880 and (found[0][1:] == found[1][:-1] + 1).all()
    suffix_dedup._powers.cache_clear()
    monkeypatch.undo()
    check(spark, [long, long[100:400] + "x" + long[350:], "ab" * 5000, "q" * 3000], 20)


def test_two_hundred_bytes_to_the_byte(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    p, q = word(200), word(199)
    texts = [word(300) + "<" + p + ">" + word(50), "(" + p + ")" + word(400), word(20) + "[" + q + "]", "{" + q + "}" + word(300)]
    got = {r[0]: r[1:] for r in run(spark, texts, 200)}
    assert [got[i] for i in range(4)] == brute(texts, 200)
    assert [got[i][2:] for i in range(4)] == [(200, 1), (200, 1), (0, 0), (0, 0)]


def test_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = suffix_dedup.remove_repeats(odd, 25)
    want = sorted((str(i), *b) for (i, _), b in zip(rows, brute([t for _, t in rows], 25)))
    assert sorted((str(r["doc_id"]), bytes(r["text"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got.collect()) == want
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "text", "n_bytes", "n_removed", "n_spans"]
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_repeated_rows_and_null_ids_are_repeats(spark):
    text = "".join(random.Random(8).choices("abcdefgh", k=90))
    got = run(spark, [text] * 4 + [text + "z", "y" + text[:40]], 30, ids=[1, 1, None, None, 2, None])
    assert sorted((r[2], r[3], len(r[1])) for r in got) == sorted([(90, 90, 0)] * 4 + [(91, 90, 1), (41, 40, 1)])


def test_suffixes_are_sorted_and_collisions_found():
    rng = random.Random(9)
    parts = ["".join(rng.choices("ab", k=rng.randrange(1, 12))).encode() for _ in range(60)]
    s = suffix_dedup.Suffixes(parts, 12)
    assert [parts[i] for i in s.order] == sorted(parts)
    s.hashes = [[0] * 13 for _ in parts]        # all prefixes collide: the bytes decide
    assert [parts[i] for i in sorted(range(60), key=suffix_dedup.cmp_to_key(s.compare))] == sorted(parts)
    # strings over 0 and 1 with equal polynomial hashes modulo 2**64
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    a, b = bytes(bits), bytes(1 - x for x in bits)
    h = suffix_dedup.prefix_hashes(np.array([list(a), list(b)], np.uint8))
    assert h[0, -1] == h[1, -1]
    assert suffix_dedup.Suffixes([a, b], 2048).common == [0]


def test_texts_are_exchanged_once(spark, odd, monkeypatch):
    plans = []
    real = suffix_dedup.stage
    monkeypatch.setattr(suffix_dedup, "stage", lambda df, name: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    suffix_dedup.remove_repeats(odd, 25)
    assert "CartesianProduct" not in plans[0]
