"""The plans of the steps that read every line, word or pre-token do so once."""

import sys

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import boundaries as bd
from tessera.operators import metrics as mt
from tessera.operators import tokenizers as tk
from tessera.plans.corpus import Corpus

TOKENIZERS = [tk.PretokTokenizer(), tk.Chunk3Tokenizer(), tk.CharsTokenizer(), tk.ClosedVocabTokenizer(["a", "the"]),
              tk.PretokTokenizer("pretok_special", add_special_tokens=True)]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def lines(spark):
    texts = ["<en> the cat, the hat", "<en> 12 !", "<fr><x> l'arbre", "no tag", "<de> ", "", None, "<en> the cat, the hat"]
    return spark.createDataFrame([(t,) for t in texts], "text string")


def test_strip_without_regex(spark):
    spaces = [chr(c) for c in range(sys.maxunicode) if chr(c).isspace()]
    rows = [f"{c} a{c}b {c}" for c in spaces] + ["", "  ", "a", "\u200b a"]
    df = spark.createDataFrame([(r,) for r in rows], "t string").select("t", tx.ustrip("t").alias("s"))
    assert all(s == t.strip() for t, s in df.collect())
    assert "regexp" not in plan(df)


def test_tag_fixture_cleans_once(spark, tmp_path):
    docs = [(1, "  Caf\u00e9 au lait\n3:16 x\n<en> y", "fr", "s"), (2, "one\n\n<de> two", None, "s"), (3, None, "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    import tessera.plans.corpus as module
    kept, module.materialize = module.materialize, lambda df, name: seen.append(plan(df)) or df
    try:
        Corpus(spark, str(tmp_path)).tagged_fixture
    finally:
        module.materialize = kept
    assert seen[0].count(tx.VERSE_PATTERN) == 1


def test_count_lines_without_struct_per_token(lines):
    df = mt.count_lines(mt.line_features(lines), TOKENIZERS)
    assert "lambda" not in plan(df)
    got = {(r["splitter"], r["language"], r["has_words"], r["pretoken"]): r["n"] for r in df.collect()}
    assert got[0, "en", True, "the"] == 4 and got[mt.WORDS, "en", True, "the"] == 4
    assert got[0, "en", False, "!"] == 1 and (mt.WORDS, "en", False, "12") not in got
    assert got[mt.LINES, "en", True, None] == 2 and got[mt.LINES, "unknown", False, None] == 1
    assert got[mt.LINE_WORDS, "en", True, None] == 8 and got[mt.LINE_CHARS, "en", True, None] == 2 * len("the cat, the hat")
    assert sum(n for key, n in got.items() if key[0] == mt.LINES) == 7          # a line without text is none


def test_token_counts_without_join(lines):
    df = mt.token_counts(lines, TOKENIZERS)
    assert "Join" not in plan(df) and "regexp_extract_all(text" not in plan(df)
    got = {(r["tokenizer"], r["token"]): r["n"] for r in df.collect()}
    assert got["pretok", "the"] == 4 and got["closed_vocab", "the"] == 4 and got["chars", "\u2581t"] == 5
    assert got["pretok_special", "[CLS]"] == 8


def test_report_joins_pieces_once(lines, monkeypatch):
    plans, keep = {}, mt.materialize
    monkeypatch.setattr(mt, "materialize", lambda df, name: plans.update({name: plan(df)}) or keep(df, name))
    vocabs = {t.name: t.vocab(lines.sparkSession, lines.select(F.explode(tx.pretokens("text")).alias("pretoken"))) for t in TOKENIZERS}
    mt.tokenizer_report(lines, TOKENIZERS, vocabs).collect()
    assert "lens" not in plans["report"]


def test_gold_words_are_read_once(spark):
    gold = spark.createDataFrame([("reopened", ["re", "open", "ed"]), ("at", ["at"]), ("up", None), (None, ["u"])],
                                 "word string, segments array<string>")
    df = bd.score_words(gold, TOKENIZERS, drop_specials=False)
    text = plan(df)
    assert "Union" not in text and text.count("array_intersect") == 1 and "array_except" not in text
    got = {(r["tokenizer"], r["word"]): r for r in df.collect()}
    assert len(got) == 20
    chunk = got["chunk3", "reopened"]
    assert (chunk["gold_boundaries"], chunk["predicted_boundaries"], chunk["true_positive"], chunk["f1"]) == ("2,6", "3,6", 1, 0.5)
    assert got["chunk3", "up"]["f1"] is None and got["pretok", "at"]["f1"] == 1
