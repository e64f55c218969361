"""Word tables from stretches between blanks; Unigram training and encoding on arrays."""
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import bpe, tokenizers as tk
from tessera.operators import unigram as ug
from tessera.operators.lattice import Edges, Lattice
from tessera.plans import catalog, corpus
from tessera.plans.corpus import Corpus

LINES = [("train", "<en> plain words, words twice"), ("train", "<a>b> odd tag, é ́alone"), ("train", "<en>no blank behind"),
         ("train", "<en us> a  double space ##x ▁y"), ("valid", "<fr> <x>word mots d'un"), ("train", "<fr> <x>word <y> mots"),
         ("train", "<én> tag not composed"), ("test", "no tag here"), ("train", None), ("train", "<en> "), ("train", "a>!b <en> c")]


def corpus_of(spark, lines=LINES):
    c = Corpus(spark, "nowhere")
    c.__dict__["splits"] = spark.createDataFrame([(i, 0, s, t) for i, (s, t) in enumerate(lines)],
                                                 "doc_id long, line_no int, split string, text string")
    return c


def counted(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def test_words_of_stretches_are_those_of_lines(spark, monkeypatch):
    for held in (tk.HELD_STRETCHES, 3):
        monkeypatch.setattr(tk, "HELD_STRETCHES", held)
        c = corpus_of(spark)
        train = c.split("train")
        assert counted(c.word_freq.select("word", "freq")) == counted(bpe.word_frequency(train))
        lines = train.select(tx.strip_language_tag(F.col("text")).alias("t"))
        assert counted(c.train_pretokens.select("pretoken", "n")) == counted(tk.pretoken_counts(lines, "t"))
        words = c.prepared.select(F.explode(tx.simple_words(F.col("text")))).distinct()
        assert sorted(r[0] for r in catalog.gold_words(c).collect()) == sorted(r[0] for r in words.collect())


def test_lines_are_split_into_words_once(spark, monkeypatch):
    """One pass over the lines serves both learned models, the rule vocabularies and the gold words."""
    written = []
    monkeypatch.setattr(corpus, "materialize", lambda df, name, f=corpus.materialize: written.append(name) or f(df, name))
    c = corpus_of(spark, LINES * 3)
    monkeypatch.setitem(Corpus._shared, (spark.sparkContext.applicationId, "nowhere"), c)
    monkeypatch.setattr(catalog, "_MODELS", {})
    catalog.bpe_model(spark, "nowhere", 40)
    catalog.unigram_model(spark, "nowhere", 60)
    c.rule_vocabs, c.gold
    assert sorted(written) == ["gold", "stretches", "train_pretokens", "word_freq"]


def test_pieces_are_searched_for_once(spark, monkeypatch):
    """A training builds one trie, however many passes it takes; with the passes one by one it ends the same."""
    rng = random.Random(1)
    words = Counter("".join(rng.choices(["an", "ti", "on", "re", "e", "s"], k=rng.randrange(1, 6))) for _ in range(900))
    df = spark.createDataFrame(list(words.items()), "word string, freq long")
    built = []
    monkeypatch.setattr(ug, "Lattice", lambda *a, f=Lattice: built.append(1) or f(*a))
    model = ug.train_unigram(df, vocab_size=25, seed_size=500, max_piece_len=6)
    assert len(built) == 1 and model.rounds > 3
    seed = {r["piece"]: r for r in ug.seed_pieces(df, 6, 500).collect()}
    chars, total = [p for p, r in seed.items() if r["is_char"]], sum(r["score"] for r in seed.values())
    logp, target = {p: round(float(np.log(r["score"] / total)), 9) for p, r in seed.items()}, 20
    while True:
        for _ in range(2):
            logp, _, _ = ug.em_step(df, logp, 6, chars)
        if len(logp) <= target:
            break
        logp = ug.prune(df, logp, max(target, int(len(logp) * 0.75)), 6, chars)
    logp, _, _ = ug.em_step(df, logp, 6, chars)
    got = dict(model.pieces[5:])
    assert set(got) == set(logp) and np.allclose([got[p] for p in got], [logp[p] for p in got], atol=1e-8)


def test_edges_are_read_back_and_thinned_out():
    rng = random.Random(2)
    pieces = sorted({"".join(rng.choices("abc", k=rng.randrange(1, 5))) for _ in range(60)} | set("abc"))
    words = ["".join(rng.choices("abcd", k=rng.randrange(12))) for _ in range(200)]
    freq, scores = [rng.randrange(1, 9) for _ in words], np.array([-9 * rng.random() for _ in pieces])
    lattice = Lattice(pieces, scores, 4)
    left = np.array([len(p) == 1 or rng.random() < 0.5 for p in pieces])
    want = Lattice([p for p, x in zip(pieces, left) if x], scores[left], 4).expected(words, freq)
    for kind in ("<u2", "<i8"):
        rows = [pa.concat_arrays([r.slice(0, 0), r.slice(0, 150), r.slice(150)]) for r in lattice.edges(words).rows(kind)]
        edges = Edges.of(*rows, kind)
        thin = edges.kept(np.where(left, np.cumsum(left) - 1, -1))
        for got in (thin.expected(scores[left], freq), [x[left] if np.ndim(x) else x for x in edges.expected(np.where(left, scores, -np.inf), freq)]):
            assert np.allclose(got[0], want[0]) and np.isclose(got[1], want[1])
        half = Edges.of(*[r.slice(50, 70) for r in rows], kind)
        assert np.allclose(half.expected(scores, freq[50:120])[0], lattice.expected(words[50:120], freq[50:120])[0])


def test_words_are_encoded_at_once_as_one_by_one(spark):
    rng = random.Random(5)
    for k in range(300):
        letters = "abxy一\U0001f642"[:2 + k % 5]
        logp = {"".join(rng.choices(letters[:3], k=rng.randrange(1, 5))): -float(rng.choice([rng.randrange(1, 4), 3 * rng.random()]))
                for _ in range(rng.randrange(12))}
        pieces = sorted(logp)
        words = ["".join(rng.choices(letters, k=rng.randrange(9))) for _ in range(10)]
        unk = (min(logp.values()) if logp else 0.0) - rng.choice([10.0, 0.5, 0.0])
        payload = logp, 4, "[UNK]", unk, Lattice(pieces, [logp[p] for p in pieces], 4)
        assert ug._uni_words(payload, words).to_pylist() == [ug._uni_word(payload, w) for w in words]
    model = ug.UnigramModel([("[UNK]", 0.0), ("ab", -1.0), ("a", -2.0)], special_tokens=["[UNK]"])
    df = spark.createDataFrame([("abaxx [UNK] ab",), ("",), (None,)], "t string").coalesce(1)
    rows = [r["o"] for r in ug.UnigramTokenizer(model, spark, add_special_tokens=False).encode_lines(df, "t", "o").collect()]
    assert rows == [["ab", "a", "xx", "[UNK]", "ab"], [], None]


def test_substrings_go_on_from_batch_to_batch(spark):
    rng = random.Random(3)
    words = {"".join(rng.choices("abé\U0001f642", k=rng.choice([3, 9, 70]))): rng.randrange(1, 9) for _ in range(60)}
    want = Counter()
    for w, f in words.items():
        for i in range(len(w)):
            for n in range(2, min(6, len(w) - i) + 1):
                want[w[i:i + n]] += f * n
    suffixes = Counter()
    for w, f in words.items():
        for i in range(len(w) - 1):
            suffixes[w[i:i + 6]] += f
    rows = sorted(suffixes.items(), key=lambda x: x[0].encode())
    for size in (1, 2, 7, 10_000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k:k + size])], ["suffix", "freq"]) for k in range(0, len(rows), size)]
        found = [r for b in ug._intervals(batches) for r in zip(b.column("piece").to_pylist(), b.column("score").to_pylist())]
        assert len(found) == len(want) and dict(found) == want


def test_markers_are_removed_as_by_one_pattern(spark):
    texts = ["".join(random.Random(k).choices("#▁Ġa ", k=7)) for k in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = tx.ustrip(F.regexp_replace("t", "##|▁|Ġ", ""))
    assert df.filter(tx.clean_subword_marker("t") != plain).count() == 0
