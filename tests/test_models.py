"""Learned models: BPE against the library (exact), WordPiece and Unigram
encoding against the library for the same vocabulary, Unigram properties."""
import json
import math
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import bpe, metrics
from tessera.operators import unigram as ug
from tessera.operators.metrics import token_counts, tokenizer_report
from tessera.operators.mlm import ids_by_join
from tessera.operators.wordpiece import WordPieceTokenizer, wordpiece_word
from tessera.plans.corpus import Corpus
from tessera.sources.models import load_tokenizers

SPECIALS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]


@pytest.fixture(scope="module")
def train_lines(spark, sf001):
    return Corpus(spark, sf001).split("train")


def library_bpe(texts, vocab_size, min_frequency=2):
    tokenizers = pytest.importorskip("tokenizers")
    from tokenizers import models, normalizers, pre_tokenizers, trainers
    tok = tokenizers.Tokenizer(models.BPE(unk_token="[UNK]"))
    tok.normalizer = normalizers.Sequence([normalizers.NFC()])
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tok.train_from_iterator(texts, trainers.BpeTrainer(vocab_size=vocab_size, min_frequency=min_frequency,
                                                       special_tokens=SPECIALS, show_progress=False))
    js = json.loads(tok.to_str())["model"]
    merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in js["merges"]]
    return tok, merges, [t for t, _ in sorted(js["vocab"].items(), key=lambda kv: kv[1])]


def encoded(spark, tok, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return [r["tokens"] for r in tok.encode_lines(df, "t").orderBy("k").collect()]


TRICKY = ["unseen \u2603 symbol", "a [MASK] b", "x[SEP]y ([UNK])", "Cafe\u0301 de\u0301ja\u0300 vu", "", "[MASK[MASK]]", "\u212b \ufb01"]


def test_bpe_equals_library(spark, train_lines):
    texts = [r["text"] for r in train_lines.select("text").collect()]
    m = bpe.train_bpe(bpe.word_frequency(train_lines, "text"), vocab_size=2100, max_pairs=3000)
    tok, merges, vocab = library_bpe(texts, 2100)
    assert m.merges == merges and m.vocab == vocab and len(merges) > 1900
    enc = bpe.BpeTokenizer(m, spark)
    sample = texts[:100] + TRICKY
    got = encoded(spark, enc, sample)
    assert [g[1:-1] for g in got] == [tok.encode(t).tokens for t in sample]
    assert all(g[0] == "[CLS]" and g[-1] == "[SEP]" for g in got)
    d = tempfile.mkdtemp(prefix="tessera-bpe-")
    m.save(spark, d)
    back = bpe.BpeModel.load(spark, d)
    assert (back.vocab, back.merges, back.special_tokens, back.unk_token) == (m.vocab, m.merges, SPECIALS, "[UNK]")


def test_bpe_ties_equal_library(spark):
    """Small alphabets, equal counts, self-pairs, strings made twice, few pairs held."""
    rng = random.Random(8)
    for k in range(5):
        texts = [" ".join("".join(rng.choice("abcd"[: 2 + k % 3]) for _ in range(rng.randrange(1, 9)))
                          for _ in range(rng.randrange(1, 14))) for _ in range(8)]
        df = spark.createDataFrame([(t,) for t in texts], "text string")
        m = bpe.train_bpe(bpe.word_frequency(df, "text"), vocab_size=26, min_frequency=1 + k % 2, max_pairs=[1, 2, 5, 50, 5000][k])
        assert m.merges == library_bpe(texts, 26, 1 + k % 2)[1], texts


def test_bpe_long_word_equals_plain_merging():
    rng = random.Random(9)
    merges = [("a", "b"), ("b", "a"), ("a", "a"), ("ab", "ab"), ("aa", "b"), ("ba", "aa"), ("abab", "a")]
    ranks = {p: i for i, p in enumerate(merges)}
    vocab = {"a", "b"} | {x + y for x, y in merges}
    for _ in range(300):
        syms = [rng.choice("abz") for _ in range(rng.randrange(40))]
        want = [c if c in vocab else "[UNK]" for c in syms]
        while True:
            found = [(ranks[p], i) for i, p in enumerate(zip(want, want[1:])) if p in ranks]
            if not found:
                break
            _, i = min(found)
            want[i:i + 2] = [want[i] + want[i + 1]]
        assert bpe.bpe_encode_word("".join(syms), ranks, vocab) == want
    assert "".join(bpe.bpe_encode_word("ab" * 100_000, ranks, vocab)) == "ab" * 100_000


def test_reports_encode_as_texts_are_encoded(spark):
    """Per-pre-token encoding sees the same NFC text and special tokens as encode_text."""
    m = bpe.BpeModel(SPECIALS + ["ca", "c", "a", "f", "\u00e9", "caf", "caf\u00e9"], [("c", "a"), ("ca", "f"), ("caf", "\u00e9")])
    tok = bpe.BpeTokenizer(m, spark, add_special_tokens=False)
    lines = spark.createDataFrame([("cafe\u0301 [MASK] cafe",)], "text string")
    assert encoded(spark, tok, ["cafe\u0301 [MASK] cafe"]) == [["caf\u00e9", "[MASK]", "caf", "[UNK]"]]
    r = tokenizer_report(lines, [tok], {"bpe": m.vocab_df(spark)}).filter("language = 'all'").first()
    assert (r["fertility"], r["unk_rate"]) == (round(4 / 3, 9), 0.25)
    counts = {x["token"]: x["n"] for x in token_counts(lines, [tok]).collect()}
    assert counts == {"caf\u00e9": 1, "[MASK]": 1, "caf": 1, "[UNK]": 1}


def test_report_encodes_once_per_tokenizer(spark, monkeypatch):
    m = bpe.BpeModel(SPECIALS + ["a", "b"], [])
    toks = [bpe.BpeTokenizer(m, spark, "one"), bpe.BpeTokenizer(m, spark, "two")]
    plans = []
    real = metrics.materialize

    def spy(df, name, *a):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return real(df, name, *a)

    monkeypatch.setattr(metrics, "materialize", spy)
    lines = spark.createDataFrame([("ab ba",)], "text string")
    tokenizer_report(lines, toks, {t.name: m.vocab_df(spark) for t in toks}).collect()
    assert dict(plans)["report_encodings"].count("ArrowEvalPython") == 2


def test_bpe_self_pairs(spark):
    wf = spark.createDataFrame([("aaa", 5), ("aa", 3), ("ab", 4), ("ba", 4)], "word string, freq long")
    m = bpe.train_bpe(wf, vocab_size=5 + 2 + 3, min_frequency=1)
    # (a,a) counts 5*2+3 = 13 and is merged alone first
    assert m.merges[0] == ("a", "a")
    assert bpe.bpe_encode_word("aaaa", {p: i for i, p in enumerate(m.merges)}, set(m.vocab))[0] == "aa"


def test_wordpiece_matches_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    vocab = ["[UNK]", "un", "##aff", "##able", "aff", "a", "##b", "b"]
    lib = tokenizers.Tokenizer(tokenizers.models.WordPiece({v: i for i, v in enumerate(vocab)},
                                                           unk_token="[UNK]"))
    lib.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    for w in ["unaffable", "ab", "abc", "b", "affable"]:
        assert wordpiece_word(w, set(vocab)) == lib.encode(w).tokens, w
    tok = WordPieceTokenizer(spark.createDataFrame([(v,) for v in vocab], "piece string"), spark)
    r = spark.createDataFrame([("unaffable ab abc",)], "t string").select(tok.encode_text(F.col("t"))).first()[0]
    assert list(r) == ["un", "##aff", "##able", "a", "##b", "[UNK]"]


def test_wordpiece_joined_keeps_rows_apart(spark):
    """Repeated, null and empty rows and map columns, with any vocabulary size."""
    rng = random.Random(12)
    vocab = sorted({"".join(rng.choices("abc", k=rng.randrange(1, 4))) for _ in range(12)})
    vocab = spark.createDataFrame([(v,) for v in vocab + ["##" + v for v in vocab] + ["[UNK]"]], "piece string")
    texts = [" ".join("".join(rng.choices("abcd", k=rng.randrange(1, 7))) for _ in range(rng.randrange(4))) for _ in range(20)]
    rows = [(1, t, {"k": 1}) for t in texts + texts[:6] + [None, None, "", "", " ", "ab c", "ab c"]]
    df = spark.createDataFrame(rows, "k int, t string, m map<string,int>")
    for special in (False, True):
        small, large = (WordPieceTokenizer(vocab, spark, add_special_tokens=special, max_broadcast=n) for n in (100, 1))
        want, got = (sorted(((r["t"], r["tokens"]) for r in x.encode_lines(df, "t").collect()), key=repr) for x in (small, large))
        assert got == want and len(got) == len(rows)
        assert large.encode_lines(df, "t").columns == ["k", "t", "m", "tokens"]


def test_ids_from_the_encoder_equal_ids_by_join(spark):
    m = bpe.BpeModel(SPECIALS + ["a", "b", "ab", "c"], [("a", "b")])
    tok = bpe.BpeTokenizer(m, spark, add_special_tokens=False)
    rows = [(i, t) for i, t in enumerate(["ab c abc", "", None, "x[MASK]ab", "ab ab"])]
    df = spark.createDataFrame(rows, "k int, t string")
    out = df.select("k", tok.encode_ids(F.col("t"), m.token_to_id(), 1).alias("ids"))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["k"]: r["ids"] for r in out.collect()}
    want = {r["k"]: r["ids"] for r in ids_by_join(tok.encode_lines(df.filter("t is not null"), "t"), "tokens", m.vocab_df(spark), ["k"]).collect()}
    assert {k: v for k, v in got.items() if k != 2} == want and not got[2]


def test_merges_are_foreseen_from_any_sample(spark, train_lines):
    """A sample that is too small or misleading costs rounds, not results."""
    wf = bpe.word_frequency(train_lines, "text").orderBy(F.desc("freq")).limit(3000).cache()
    want = bpe.train_bpe(wf, vocab_size=220)
    assert want.rounds <= 4
    for types, ahead, every in ((1, (50, 50), 2), (40, (1, 500), 5), (5000, (7, 7), 3)):
        got = bpe.train_bpe(wf, vocab_size=220, sample_types=types, ahead=ahead, checkpoint_every=every, max_pairs=400)
        assert (got.merges, got.vocab) == (want.merges, want.vocab)
    wf.unpersist()


def test_held_word_types_give_the_same_merges(spark, train_lines):
    """Merges on the driver's share of the word types, large or small, are those foreseen."""
    wf = bpe.word_frequency(train_lines, "text").orderBy(F.desc("freq")).limit(3000).cache()
    want = bpe.train_bpe(wf, vocab_size=700, held_symbols=0)
    for held, ahead in ((1_000_000, (1000, 1000)), (4000, (300, 300))):
        got = bpe.train_bpe(wf, vocab_size=700, ahead=ahead, held_symbols=held)
        assert (got.merges, got.vocab) == (want.merges, want.vocab)
    wf.unpersist()


def test_symbols_merge_as_words_do():
    rng = random.Random(21)
    for _ in range(150):
        words = [[rng.randrange(3) for _ in range(rng.randrange(1, 20))] for _ in range(6)]
        freq = [rng.randrange(1, 9) for _ in words]
        symbols = bpe._Symbols(np.array(freq), np.array(sum(words, []), np.int32), np.array([len(w) for w in words]))
        for step in range(5):
            pairs = sorted({p for w in words for p in zip(w, w[1:])})
            if not pairs:
                break
            pair = rng.choice(pairs)
            want = bpe.defaultdict(int)
            words = [bpe.merge_word(w, {pair: (0, 10 + step)}, want, f) for w, f in zip(words, freq)]
            found = symbols.merge(*pair, 10 + step)
            assert {(int(c) >> 32, int(c) & 0xFFFFFFFF): int(n) for c, n in zip(*found)} == {
                k[1:]: v for k, v in want.items() if v}
        left, flat, offsets = symbols.batch()
        assert [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [w for w in words if len(w) > 1]
        assert left.tolist() == [f for f, w in zip(freq, words) if len(w) > 1]


def test_changes_of_a_sequence_are_those_of_its_steps():
    rng = random.Random(13)
    for _ in range(200):
        ids = [rng.randrange(3) for _ in range(rng.randrange(2, 25))]
        sequence, now, want = [], list(ids), {}
        for step in range(4):
            pairs = sorted(set(zip(now, now[1:])))
            if not pairs:
                break
            pair = rng.choice(pairs)
            sequence.append((*pair, 10 + step))
            nxt = bpe.merge_word(now, {pair: (0, 10 + step)})
            for words, sign in ((now, -1), (nxt, 1)):
                for p in zip(words, words[1:]):
                    want[step, *p] = want.get((step, *p), 0) + 3 * sign
            now = nxt
        found = bpe.defaultdict(int)
        assert bpe.merge_word(ids, bpe._table(sequence), found, 3) == now
        assert {k: v for k, v in found.items() if v} == {k: v for k, v in want.items() if v}


def test_wordpiece_too_large_to_broadcast(spark):
    vocab = spark.createDataFrame([(v,) for v in ["un", "##aff", "##able", "aff", "a", "##b", "b", "[UNK]"]], "piece string")
    texts = ["unaffable ab abc", "", "a a [MASK] b", "b" * 101]
    small = WordPieceTokenizer(vocab, spark, add_special_tokens=True)
    large = WordPieceTokenizer(vocab, spark, add_special_tokens=True, max_broadcast=2)
    assert large.joined and not small.joined
    assert encoded(spark, large, texts) == encoded(spark, small, texts)
    words = spark.createDataFrame([("unaffable",), ("abc",), ("x",)], "pretoken string")
    assert sorted(map(tuple, large.encode_distinct(words).collect())) == sorted(map(tuple, small.encode_distinct(words).collect()))
    with pytest.raises(ValueError):
        large.encode_text(F.col("t"))


def test_unigram_ends_with_more_characters_than_it_may_have(spark):
    alphabet = [chr(0x4e00 + i) for i in range(62)]
    wf = spark.createDataFrame([(a + b, 3) for a, b in zip(alphabet, alphabet[1:])], "word string, freq long")
    model = ug.train_unigram(wf, vocab_size=40, seed_size=100)
    assert sorted(p for p, _ in model.pieces[5:]) == alphabet


def test_unigram_prune_leaves_out_the_piece_itself(spark):
    wf = spark.createDataFrame([("abab", 4), ("ab", 9), ("ba", 1)], "word string, freq long")
    logp = {"a": -3.0, "b": -3.0, "ab": -1.0, "abab": -2.5, "ba": -9.0}
    # abab falls apart into two ab at little loss; ab is what the words are made of
    assert sorted(ug.prune(wf, logp, 3, 16, ["a", "b"])) == ["a", "ab", "b"]


def test_unigram_save_and_load(spark):
    model = ug.UnigramModel([(s, 0.0) for s in SPECIALS] + [("a", -1.0), ("abcdefghijklmnopqrst", -1.5), ("b", -2.0)],
                            unk_token="[UNK]", max_piece_len=20)
    d = tempfile.mkdtemp(prefix="tessera-unigram-")
    model.save(spark, d)
    back = ug.UnigramModel.load(spark, d)
    texts = ["abcdefghijklmnopqrst a zz", "[MASK] ab"]
    want = encoded(spark, ug.UnigramTokenizer(model, spark), texts)
    assert want[0] == ["[CLS]", "abcdefghijklmnopqrst", "a", "zz", "[SEP]"]
    assert encoded(spark, load_tokenizers(spark, {"u": d})["u"], texts) == want
    assert back == ug.UnigramModel(model.pieces, "[UNK]", 20)


def test_unigram_viterbi_matches_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    pieces = [("[UNK]", 0.0), ("a", -2.0), ("b", -2.5), ("ab", -3.0), ("abc", -6.0), ("c", -3.0), ("bc", -4.5)]
    lib = tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, unk_id=0))
    logp = {p: s for p, s in pieces if p != "[UNK]"}
    unk_score = min(logp.values()) - ug.UNK_PENALTY
    for w in ["abc", "abcab", "cab", "zzab", "abzz", "azzb"]:
        assert ug.viterbi(w, logp, 16, "[UNK]", unk_score, unk_text=True)[0] == \
            [t.value for t in lib.model.tokenize(w)], w


def test_unigram_training_properties(spark, train_lines):
    wf = bpe.word_frequency(train_lines, "text")
    words = {r["word"]: r["freq"] for r in wf.collect()}
    seed = ug.seed_pieces(wf, 8, 400).collect()
    total = sum(r["score"] for r in seed)
    logp = {r["piece"]: math.log(r["score"] / total) for r in seed}
    chars = [r["piece"] for r in seed if r["is_char"]]
    new, ll1, expected = ug.em_step(wf, logp, 8, chars)
    covered = sum(v * len(p) for p, v in expected.items())
    assert abs(covered - sum(len(w) * f for w, f in words.items())) < 1e-6 * covered
    _, ll2, _ = ug.em_step(wf, new, 8, chars)
    assert ll2 >= ll1 - 1e-6 * abs(ll1)
    model = ug.train_unigram(wf, vocab_size=200, seed_size=400, max_piece_len=8)
    assert len(model.pieces) <= 200 and [p for p, _ in model.pieces[:5]] == SPECIALS
    tok = ug.UnigramTokenizer(model, spark, add_special_tokens=False)
    sample = sorted(words, key=lambda w: -words[w])[:200]
    enc = spark.createDataFrame([(w,) for w in sample], "w string").select("w", tok.pieces(F.col("w")).alias("p"))
    n_pieces = n_chars = 0
    for r in enc.collect():
        assert "".join(r["p"]) == r["w"]
        n_pieces += len(r["p"]) * words[r["w"]]
        n_chars += len(r["w"]) * words[r["w"]]
    # a useful model keeps frequent multi-character pieces
    assert n_pieces < 0.6 * n_chars
    assert ug.viterbi("zzab", {"a": -1.0, "b": -1.0, "ab": -1.5}, 16, "[UNK]", -20.0)[0] == ["[UNK]", "ab"]
