"""BPE training's and encoding's steps: the sample, the ranking, the words held and encoded."""
import random
import string

import numpy as np
import pyarrow as pa

from tessera.operators import bpe
from tessera.operators.tokenizers import _line_pieces


def frequencies(spark, n, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choices(string.ascii_lowercase[:9], k=rng.randrange(1, 12))): rng.randrange(1, 40) for _ in range(n)}
    return spark.createDataFrame(list(words.items()), "word string, freq long").cache()


def test_words_that_fit_are_held_at_once(spark):
    """No merge is foreseen where all word types fit; foreseen ones are the same."""
    wf = frequencies(spark, 400, 1)
    want = bpe.train_bpe(wf, vocab_size=60)
    assert want.rounds == 1 and len(want.vocab) == 60
    for types, ahead, every in ((100, (4, 50), 2), (5000, (7, 7), 3)):
        got = bpe.train_bpe(wf, vocab_size=60, sample_types=types, ahead=ahead, checkpoint_every=every, max_pairs=400, held_symbols=0)
        assert (got.merges, got.vocab) == (want.merges, want.vocab)
    wf.unpersist()


def test_a_sample_takes_merges_back():
    words = [[1, 2, 1, 2, 3], [1, 2, 3], [3, 1, 2], [4]]
    symbols = lambda: bpe._Symbols(np.array([5, 4, 3, 2]), np.concatenate(words).astype(np.int32), np.array([len(w) for w in words]))
    sample, other = bpe._Sample(symbols()), bpe._Sample(symbols())
    for made in (sample, other):
        assert made.merge((1, 2), 9)[1, 2] == -17
    sample.merge((9, 3), 10)
    sample.merge((3, 9), 11)
    for made in (sample, other):
        made.keep(1)
    assert sample.merge((9, 9), 12) == other.merge((9, 9), 12) == {(9, 9): -5, (9, 3): -5, (12, 3): 5}
    assert [list(map(int, x)) for x in sample.symbols.batch()] == [list(map(int, x)) for x in other.symbols.batch()]


def test_falling_counts_are_not_pushed():
    rng = random.Random(3)
    counts = {(a, b): rng.randrange(2, 90) for a in range(12) for b in range(12)}
    ranking = bpe._Ranking(dict(counts), 2)
    for _ in range(3000):
        pair, by = rng.choice(list(counts)), rng.choice((-9, -5, -1, -1, 4))
        counts[pair] = n if (n := counts[pair] + by) >= 2 else 0
        ranking.change(pair, by)
        if rng.random() < .2:
            first = min(((-n, *p) for p, n in counts.items() if n), default=None)
            assert ranking.first() == first
    ranking = bpe._Ranking({(1, 2): 5000}, 2)
    for _ in range(1000):
        ranking.change((1, 2), -1)
    assert len(ranking.heap) == 1 and ranking.first() == (-4000, 1, 2)


def test_short_and_long_words_are_encoded_alike(monkeypatch):
    rng = random.Random(4)
    for _ in range(300):
        symbols, ranks = list("abc"), {}
        for _ in range(8):
            pair = rng.choice(symbols), rng.choice(symbols)
            ranks.setdefault(pair, rng.randrange(50) * 10 + len(ranks))
            symbols.append(pair[0] + pair[1])
        word = "".join(rng.choices("abcd", k=rng.randrange(30)))
        got = bpe.bpe_encode_word(word, ranks, set(symbols))
        with monkeypatch.context() as m:
            m.setattr(bpe, "SHORT_WORD", 0)
            assert bpe.bpe_encode_word(word, ranks, set(symbols)) == got


def test_line_pieces():
    lines = pa.array([["ab", "c"], None, [], ["ab", "", "d", "ab"]], pa.list_(pa.string()))
    asked = []
    spell = lambda w: asked.append(w) or list(w)
    want = [["a", "b", "c"], None, [], ["a", "b", "d", "a", "b"]]
    assert _line_pieces(lines, spell, pa.string()).to_pylist() == want and sorted(asked) == ["", "ab", "c", "d"]
    assert _line_pieces(lines.slice(1, 3), spell, pa.string()).to_pylist() == want[1:]
    assert _line_pieces(lines.slice(1, 1), spell, pa.string()).to_pylist() == [None]
    assert _line_pieces(lines.slice(0, 0), spell, pa.string()).to_pylist() == []
