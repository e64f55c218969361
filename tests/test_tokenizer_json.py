"""Tokenizer documents of the public library, read and written."""
import json
import tempfile

import pytest

from tessera.operators import bpe
from tessera.operators import unigram as ug
from tessera.sources.models import load_tokenizers
from tessera.sources.tokenizer_json import parse_tokenizer_json, tokenizer_json, write_tokenizer_json

tokenizers = pytest.importorskip("tokenizers")
SPECIALS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]
TEXTS = ["the cat sat on the mat", "unseen ☃ symbol", "a [MASK] b", "x[SEP]y ([UNK])", "Café déjà vu", "", "Å ﬁ"]
CORPUS = ["the cat sat on the mat while the bat ate", "café déjà vu a b x y", "the theatre thing"] * 4


def library(kind, wrap=True):
    from tokenizers import models, normalizers, pre_tokenizers, processors, trainers
    model, trainer = {
        "bpe": (models.BPE(unk_token="[UNK]"), trainers.BpeTrainer(vocab_size=90, min_frequency=1, special_tokens=SPECIALS, show_progress=False)),
        "unigram": (models.Unigram(), trainers.UnigramTrainer(vocab_size=60, special_tokens=SPECIALS, unk_token="[UNK]", show_progress=False)),
        "wordpiece": (models.WordPiece(unk_token="[UNK]"), trainers.WordPieceTrainer(vocab_size=90, special_tokens=SPECIALS, show_progress=False)),
    }[kind]
    tok = tokenizers.Tokenizer(model)
    tok.normalizer = normalizers.Sequence([normalizers.NFC()])
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tok.train_from_iterator(CORPUS, trainer)
    if wrap:
        tok.post_processor = processors.TemplateProcessing(
            single="[CLS] $A [SEP]", pair="[CLS] $A [SEP] $B:1 [SEP]:1",
            special_tokens=[("[CLS]", tok.token_to_id("[CLS]")), ("[SEP]", tok.token_to_id("[SEP]"))])
    return tok


def encoded(spark, tok):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string")
    return [list(r["tokens"]) for r in tok.encode_lines(df, "t").orderBy("k").collect()]


@pytest.mark.parametrize("kind", ["bpe", "unigram", "wordpiece"])
@pytest.mark.parametrize("wrap", [True, False])
def test_library_document_encodes_alike(spark, kind, wrap):
    lib = library(kind, wrap)
    path = tempfile.mkdtemp(prefix="tessera-json-") + "/tokenizer.json"
    lib.save(path)
    tok = load_tokenizers(spark, {"lib": path})["lib"]
    assert encoded(spark, tok) == [lib.encode(t).tokens for t in TEXTS]
    pieces = {r["piece"] for r in tok.vocab(spark).collect()}
    assert pieces == set(lib.get_vocab())


def test_merges_in_both_spellings(spark):
    doc = json.loads(library("bpe").to_str())
    pairs = [m if isinstance(m, list) else m.split(" ") for m in doc["model"]["merges"]]
    for merges in (pairs, [" ".join(m) for m in pairs]):
        doc["model"]["merges"] = merges
        tok = parse_tokenizer_json(spark, json.dumps(doc))
        assert [list(m) for m in tok.model.merges] == pairs


@pytest.mark.parametrize("wrap", [True, False])
def test_own_models_load_into_the_library(spark, wrap):
    wf = spark.createDataFrame([("the", 9), ("cat", 4), ("that", 3), ("café", 2), ("a", 1), ("b", 1)], "word string, freq long")
    folder = tempfile.mkdtemp(prefix="tessera-json-")
    models = {"bpe": bpe.train_bpe(wf, vocab_size=24, min_frequency=1), "unigram": ug.train_unigram(wf, vocab_size=22, seed_size=60)}
    for name, model in models.items():
        lib = tokenizers.Tokenizer.from_str(tokenizer_json(model, wrap))
        write_tokenizer_json(spark, model, f"{folder}/{name}.json", wrap)
        back = load_tokenizers(spark, {name: f"{folder}/{name}.json"})[name]
        assert encoded(spark, back) == [lib.encode(t).tokens for t in TEXTS]
        assert tokenizer_json(back.model, wrap) == tokenizer_json(model, wrap) or name == "unigram"
        ids = lib.get_vocab()
        assert [p for p, _ in sorted(ids.items(), key=lambda kv: kv[1])] == (
            model.vocab if name == "bpe" else [p for p, _ in model.pieces])


def test_what_is_not_supported_is_refused(spark):
    for path, value in [("normalizer", {"type": "Lowercase"}), ("normalizer", None), ("pre_tokenizer", {"type": "ByteLevel"}),
                        ("truncation", {"max_length": 5}), ("model.dropout", 0.1), ("model.unk_token", None),
                        ("model.byte_fallback", True), ("model.type", "WordLevel"), ("model.vocab", {"a": 0, "b": 2}),
                        ("post_processor", {"type": "ByteLevel"})]:
        doc = json.loads(library("bpe").to_str())
        at = doc
        *parents, last = path.split(".")
        for p in parents:
            at = at[p]
        at[last] = value
        with pytest.raises(ValueError, match="tokenizer.json"):
            parse_tokenizer_json(spark, json.dumps(doc))
    with pytest.warns(UserWarning, match="none.json"):
        assert load_tokenizers(spark, {"x": "/tmp/none.json"}) == {}
