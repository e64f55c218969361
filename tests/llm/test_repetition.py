import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import repetition


def brute_cover(words, n):
    grams = Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    return len({p for i in range(len(words) - n + 1) if grams[tuple(words[i:i + n])] > 1 for p in range(i, i + n)})


def brute_longest(words):
    n = 0
    while any(c > 1 for c in Counter(tuple(words[i:i + n + 1]) for i in range(len(words) - n)).values()):
        n += 1
    return n


def test_suffix_array_equals_sorting():
    rng = random.Random(1)
    for _ in range(150):
        seqs = [[rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.randrange(30))] for _ in range(rng.randrange(1, 5))]
        symbols = np.array([x for s in seqs for x in s], np.int64)
        owner = np.repeat(np.arange(len(seqs)), [len(s) for s in seqs])
        order, lcp = repetition.suffix_array(symbols, owner)
        base = np.cumsum([0] + [len(s) for s in seqs])
        want = sorted((k, s[i:], int(base[k]) + i) for k, s in enumerate(seqs) for i in range(len(s)))
        assert [w[2] for w in want] == order.tolist()
        for x, (a, b) in zip(lcp[1:], zip(want, want[1:])):
            n = 0
            while a[0] == b[0] and n < min(len(a[1]), len(b[1])) and a[1][n] == b[1][n]:
                n += 1
            assert n == x


def test_counts_equal_brute_force():
    rng = random.Random(2)
    texts = [None, "", " \n\x0b", "a", "a\u00a0a a", "x y\n\nx y\n x y", "# a *b* & <c>|"]
    texts += ["".join(rng.choice(["a ", "b ", "cd ", "e\n", "\t", "\u00e9#"]) for _ in range(rng.randrange(120))) for _ in range(120)]
    got = repetition.measure(texts, 4)
    for t, r in zip(texts, got.itertuples()):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>")
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == brute_cover(words, 3) and r.n_covered_words == brute_cover(words, 4)
        assert r.longest_repeat == brute_longest(words)


@pytest.mark.parametrize("block", [10, 10_000])
def test_blocks_do_not_change_results(monkeypatch, block):
    texts = ["a b a b a b c", "a b", None, "z " * 300, "q"]
    whole = repetition.measure(texts, 2)
    monkeypatch.setattr(repetition, "BLOCK_WORDS", block)
    assert repetition.measure(texts, 2).equals(whole)


def test_verdicts(spark, odd, none):
    fresh = " ".join(f"u{i}" for i in range(400))
    passage = " ".join(f"p{i}" for i in range(120))
    rows = [(1, fresh), (2, f"{fresh} {passage} {fresh[:200]}x {passage}"), (3, "short"), (4, "a b c " * 200), (5, None),
            (6, " ".join(f"{fresh[i:i + 60]}" for i in range(0, 600, 30)))]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r["doc_id"]: r for r in repetition.score(df).collect()}
    assert got[1]["kept"] and not got[1]["base_failed"]
    assert not got[2]["base_failed"] and not got[2]["kept"] and got[2]["longest_repeat"] >= 120  # one long repeat
    assert got[3]["base_failed"] and got[4]["base_failed"] and got[5]["base_failed"] and got[5]["n_words"] == 0
    clash = odd.withColumnRenamed("n_chars", "n_words").withColumnRenamed("lang", "kept")
    out = repetition.score(clash)
    assert out.count() == odd.count() and len(set(out.columns)) == len(out.columns)
    assert repetition.score(none).count() == 0
