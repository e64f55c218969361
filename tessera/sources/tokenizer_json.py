"""The nested ``tokenizer.json`` document of public tokenizer libraries.

:func:`read_tokenizer_json` turns such a file into one of this package's
tokenizers, :func:`tokenizer_json` renders a learned model as one.  A document is
a model (bounded by its vocabulary): it is read and written as a whole.

Supported are BPE, scored Unigram and WordPiece models over NFC text and
the whitespace pre-tokenizer, special added tokens and the ``[CLS] ... [SEP]``
template.  Anything else that would change an encoding is refused by a
``ValueError`` that names the field.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from tessera.operators.bpe import BpeModel, BpeTokenizer
from tessera.operators.tokenizers import CLS, SEP, Tokenizer
from tessera.operators.unigram import UnigramModel, UnigramTokenizer
from tessera.operators.wordpiece import PREFIX, WordPieceTokenizer

# Names of the document's components.
_NFC, _WHITESPACE, _TEMPLATE = {"type": "NFC"}, {"type": "Whitespace"}, "TemplateProcessing"


def _require(ok: bool, field: str, value) -> None:
    if not ok:
        raise ValueError(f"tokenizer.json: {field} = {json.dumps(value, ensure_ascii=False)[:200]} is not supported")


def _by_id(vocab: dict, field: str) -> list:
    pieces = sorted(vocab, key=vocab.get)
    _require([vocab[p] for p in pieces] == list(range(len(pieces))), field, "ids with gaps")
    return pieces


def _specials(doc: dict) -> list:
    out = []
    for token in sorted(doc.get("added_tokens") or [], key=lambda t: t["id"]):
        for flag in ("single_word", "lstrip", "rstrip"):
            _require(not token.get(flag), f"added_tokens.{flag}", token)
        _require(token.get("special", False) or not token.get("normalized", True), "added_tokens.normalized", token)
        out.append(token["content"])
    return out


def _wraps(post: dict | None) -> bool:
    """Whether texts are wrapped in the template."""
    if post is None:
        return False
    _require(post.get("type") == _TEMPLATE, "post_processor", post)
    parts = [next(iter(p.values()))["id"] for p in post["single"]]
    if parts == ["A"]:
        return False
    _require(parts == [CLS, "A", SEP], "post_processor.single", parts)
    return True


def parse_tokenizer_json(spark: SparkSession, text: str, name: str = "tokenizer") -> Tokenizer:
    """The tokenizer that a document describes."""
    doc = json.loads(text)
    normalizer = doc.get("normalizer")
    steps = (normalizer.get("normalizers") if (normalizer or {}).get("type") == "Sequence" else [normalizer])
    _require(steps == [_NFC], "normalizer", normalizer)
    _require(doc.get("pre_tokenizer") == _WHITESPACE, "pre_tokenizer", doc.get("pre_tokenizer"))
    for field in ("truncation", "padding"):
        _require(doc.get(field) is None, field, doc.get(field))
    specials, wrap, model = _specials(doc), _wraps(doc.get("post_processor")), doc["model"]
    kind = model.get("type") or ("BPE" if "merges" in model else None)
    if kind == "BPE":
        for field in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"):
            _require(not model.get(field), f"model.{field}", model.get(field))
        _require(model.get("unk_token") is not None, "model.unk_token", None)
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        bpe = BpeModel(_by_id(model["vocab"], "model.vocab"), merges, specials, model["unk_token"])
        return BpeTokenizer(bpe, spark, name, wrap)
    if kind == "Unigram":
        _require(not model.get("byte_fallback"), "model.byte_fallback", True)
        _require(model.get("unk_id") is not None, "model.unk_id", None)
        pieces = [(p, float(score)) for p, score in model["vocab"]]
        unk = pieces[model["unk_id"]][0]
        known = specials if unk in specials else [*specials, unk]
        longest = max((len(p) for p, _ in pieces if p not in known), default=1)
        return UnigramTokenizer(UnigramModel(pieces, unk, longest, special_tokens=known), spark, name, wrap)
    _require(kind == "WordPiece", "model.type", kind)
    _require(model["continuing_subword_prefix"] == PREFIX, "model.continuing_subword_prefix", model["continuing_subword_prefix"])
    vocab = spark.createDataFrame([(p, i) for i, p in enumerate(_by_id(model["vocab"], "model.vocab"))], "piece string, id int")
    return WordPieceTokenizer(vocab, spark, name, wrap, model["unk_token"], model["max_input_chars_per_word"], specials=specials)


def read_tokenizer_json(spark: SparkSession, path: str, name: str = "tokenizer") -> Tokenizer:
    """The tokenizer in a ``tokenizer.json`` file, or in a folder that
    :func:`write_tokenizer_json` wrote."""
    return parse_tokenizer_json(spark, spark.read.text(path, wholetext=True).first()["value"], name)


def tokenizer_json(model: BpeModel | UnigramModel, wrap: bool = True) -> str:
    """The document of a learned model; ``wrap`` adds the template."""
    ids = ({p: i for i, p in enumerate(model.vocab)} if isinstance(model, BpeModel)
           else {p: i for i, (p, _) in enumerate(model.pieces)})
    special = lambda t: {"id": t, "ids": [ids[t]], "tokens": [t]}
    mark = lambda t, k=0: {"SpecialToken": {"id": t, "type_id": k}}
    text = lambda t, k=0: {"Sequence": {"id": t, "type_id": k}}
    if isinstance(model, BpeModel):
        body = {"type": "BPE", "dropout": None, "unk_token": model.unk_token, "continuing_subword_prefix": None,
                "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
                "vocab": ids, "merges": [list(m) for m in model.merges]}
    else:
        body = {"type": "Unigram", "unk_id": ids[model.unk_token], "vocab": [[p, s] for p, s in model.pieces],
                "byte_fallback": False}
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None,
        "added_tokens": [{"id": ids[t], "content": t, "single_word": False, "lstrip": False, "rstrip": False,
                          "normalized": False, "special": True} for t in model.special_tokens if t in ids],
        "normalizer": {"type": "Sequence", "normalizers": [_NFC]}, "pre_tokenizer": _WHITESPACE,
        "post_processor": {"type": _TEMPLATE, "single": [mark(CLS), text("A"), mark(SEP)],
                           "pair": [mark(CLS), text("A"), mark(SEP), text("B", 1), mark(SEP, 1)],
                           "special_tokens": {t: special(t) for t in (CLS, SEP)}} if wrap else None,
        "decoder": None, "model": body}, ensure_ascii=False)


def write_tokenizer_json(spark: SparkSession, model: BpeModel | UnigramModel, path: str, wrap: bool = True,
                         mode: str = "overwrite") -> None:
    """Write the document as the one text file of the folder ``path``."""
    (spark.createDataFrame([(tokenizer_json(model, wrap),)], "value string")
     .coalesce(1).write.mode(mode).text(path))
