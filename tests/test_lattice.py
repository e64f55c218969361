"""Piece lattices against all segmentations spelled out; the seed against all substrings."""
import math
import random
import time
from collections import Counter

import numpy as np

from tessera.operators import lattice as lattice_module
from tessera.operators import unigram as ug
from tessera.operators.lattice import Lattice


def segmentations(word, pieces, most):
    if not word:
        yield []
    for n in range(1, min(most, len(word)) + 1):
        if word[:n] in pieces:
            yield from ([word[:n], *rest] for rest in segmentations(word[n:], pieces, most))


def test_equals_all_segmentations():
    rng = random.Random(1)
    for k in range(200):
        letters = "ab一\U0001f642\x00"[:2 + k % 4]
        logp = {"".join(rng.choices(letters, k=rng.randrange(1, 5))): -5 * rng.random() for _ in range(rng.randrange(1, 12))}
        pieces = sorted(logp)
        words = ["".join(rng.choices(letters, k=rng.randrange(8))) for _ in range(10)]
        freq = [rng.randrange(1, 5) for _ in words]
        lattice = Lattice(pieces, [logp[p] for p in pieces], 4)
        expected, best, ll, score = Counter(), Counter(), 0.0, 0.0
        for w, f in zip(words, freq):
            paths = [(sum(logp[p] for p in s), s) for s in segmentations(w, logp, 4) if s]
            if not paths:
                continue
            z = math.log(sum(math.exp(x) for x, _ in paths))
            ll += f * z
            for x, s in paths:
                for p in s:
                    expected[p] += f * math.exp(x - z)
            x, s = max(paths)
            score += f * x
            best.update({p: f * n for p, n in Counter(s).items()})
        got, got_ll = lattice.expected(words, freq)
        paths, got_score = lattice.path_counts(words, freq)
        assert np.allclose(got, [expected[p] for p in pieces]) and np.isclose(got_ll, ll)
        assert np.allclose(paths, [best[p] for p in pieces]) and np.isclose(got_score, score)


def test_expected_counts_need_no_logarithms(monkeypatch):
    """Words of ordinary length are summed without logarithms, with the same counts; long and
    unlikely ones, whose chances a double cannot hold, as before."""
    rng = random.Random(3)
    logp = {"".join(rng.choices("abc", k=rng.randrange(1, 5))): -9 * rng.random() for _ in range(40)} | dict.fromkeys("abc", -9.0)
    pieces = sorted(logp)
    lattice = Lattice(pieces, [logp[p] for p in pieces], 4)
    words = ["".join(rng.choices("abcd"[:3 + k % 2], k=rng.randrange(1, 30))) for k in range(300)]
    long = ["abc" * 700, "a" * 400]
    freq = [rng.randrange(1, 9) for _ in words + long]
    plain = lattice.expected(words + long, freq)
    monkeypatch.setattr(lattice_module, "PLAIN", 0)
    logs = lattice.expected(words + long, freq)
    assert np.allclose(plain[0], logs[0], rtol=1e-12) and np.isclose(plain[1], logs[1], rtol=1e-12)
    monkeypatch.undo()
    monkeypatch.setattr(np, "logaddexp", None)
    lattice.expected(words, freq[:len(words)])


def test_digammas_equal_the_scalar_ones():
    x = [0.5, 0.75, 1.0, 5.9999, 6.0, 42.0, 1e7]
    assert np.allclose(ug.digammas(np.array(x)), [ug.digamma(v) for v in x], rtol=1e-14)


def test_best_paths_equal_the_scalar_ones():
    """Also where scores tie, and without the piece that is the word."""
    rng = random.Random(2)
    for _ in range(100):
        logp = {"".join(rng.choices("ab", k=rng.randrange(1, 6))): -float(rng.randrange(1, 4)) for _ in range(9)}
        pieces = sorted(logp)
        lattice = Lattice(pieces, [logp[p] for p in pieces], 5)
        words = ["".join(rng.choices("ab", k=rng.randrange(1, 9))) for _ in range(12)]
        for alone in (False, True):
            for some, score, steps in lattice.best(words, without_itself=alone):
                for k, i in enumerate(some):
                    want, z = ug.viterbi(words[i], logp, 5, unk=None, without_itself=alone)
                    found = [pieces[p] for live, piece in reversed(steps) for p in piece[live == k]]
                    assert (found, score[k]) == ((want, z) if z > -math.inf else ([], z))


def test_seed_equals_all_substrings(spark, monkeypatch):
    rng = random.Random(3)
    words = {"".join(rng.choices("abé\U0001f642", k=rng.randrange(1, 12))): rng.randrange(1, 9) for _ in range(60)}
    df = spark.createDataFrame(list(words.items()), "word string, freq long").repartition(5)
    want = Counter()
    for w, f in words.items():
        for i in range(len(w)):
            for n in range(1, min(6, len(w) - i) + 1):
                want[w[i:i + n]] += f * n
    for held in (500_000, 3):
        monkeypatch.setattr(ug, "HELD_SUFFIXES", held)
        rows = ug.seed_pieces(df, 6, 40).collect()
        assert {r["piece"]: r["score"] for r in rows if r["is_char"]} == {p: n for p, n in want.items() if len(p) == 1}
        top = sorted(((-n, p.encode()) for p, n in want.items() if len(p) > 1))[:40]
        assert sorted((-r["score"], r["piece"].encode()) for r in rows if not r["is_char"]) == top
    assert ug.seed_pieces(df.limit(0), 6, 40).count() == 0


def test_long_words_in_linear_time(spark):
    """A megabyte without a break is a word like others."""
    long = "".join(random.Random(4).choices("abcd", k=1_000_000))
    df = spark.createDataFrame([(long, 1), ("abc", 5)], "word string, freq long")
    t = time.time()
    rows = {r["piece"]: r["score"] for r in ug.seed_pieces(df, 16, 1000).collect()}
    assert rows["a"] == long.count("a") + 5 and len(rows) == 1004 and time.time() - t < 120
    pieces = sorted(p for p in rows if len(p) <= 2)
    total, ll = Lattice(pieces, [-3.0 * len(p) for p in pieces], 2).expected([long[:200_000], "abc"], [1, 5])
    assert np.isclose(sum(n * len(p) for p, n in zip(pieces, total)), 200_015) and ll < 0
