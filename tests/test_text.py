"""Text functions: inputs and results written out by hand."""
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx


def run(spark, fn, values):
    df = spark.createDataFrame(list(enumerate(values)), "k int, t string")
    return [r[1] for r in df.select("k", fn(F.col("t"))).orderBy("k").collect()]


@pytest.mark.parametrize("raw, clean", [
    ("7. Seven pots", "Seven pots"), ("2:10 first", "10 first"), ("3.14 round", "14 round"), (" 9:  nine", "nine"),
    ("\u3000two\u2003\u2003wide\u00a0", "two wide"), ("e\u0301te\u0301", "\u00e9t\u00e9"), ("tab\tand\x0bfeed", "tab and feed"),
    ("\x1cunit\x1f", "unit"), ("12", "12"), ("12.", ""), ("", ""), (" \n ", ""), ("\u0663. third", "third")])
def test_clean_line(spark, raw, clean):
    assert run(spark, tx.clean_line, [raw]) == [clean]


def test_clean_line_in_lower_case(spark):
    assert run(spark, lambda c: tx.clean_line(c, True), ["4. RIVER \u00c9tang"]) == ["river \u00e9tang"]


def test_good_lines(spark):
    assert run(spark, tx.is_good_line, ["cat", "ca", " ca ", "123", "1 a", "\u6c34\u6c34\u6c34", "..!"]) == [
        True, False, False, False, True, True, False]


def test_tags(spark):
    lines = ["<xa> sun", "<xa><xb> moon", "<> star", "<open sky", "bare", "<xa>", "< xa > gap", "a <xa> later"]
    assert run(spark, tx.language_tag, lines) == ["xa", "xa", "", "unknown", "unknown", "xa", " xa ", "unknown"]
    assert run(spark, tx.strip_language_tag, lines) == [
        "sun", "<xb> moon", "<> star", "<open sky", "bare", "", "gap", "a <xa> later"]
    assert run(spark, lambda c: tx.render_tag(F.lit("xa"), c), ["sun"]) == ["<xa> sun"]


def test_words_and_pretokens(spark):
    assert run(spark, tx.simple_words, ["<xa> rock-pool's edge, 2nd isn\u2019t -x-"]) == [
        ["rock-pool's", "edge", "nd", "isn\u2019t", "x"]]
    assert run(spark, tx.pretokens, ["Well, now!! it's 3.5 a_b"]) == [
        ["Well", ",", "now", "!!", "it", "'", "s", "3", ".", "5", "a_b"]]
    with_specials = lambda c: tx.pretokens_with_specials(c, ["[MASK]", "[SEP]"])
    assert run(spark, with_specials, ["a[MASK]b ([SEP]) [x]"]) == [
        ["a", "[MASK]", "b", "(", "[SEP]", ")", "[", "x", "]"]]
    assert run(spark, lambda c: tx.pretokens_with_specials(c, []), ["a[MASK]"]) == [["a", "[", "MASK", "]"]]
    assert run(spark, tx.characters, ["a\U0001f642\u00e9"]) == [["a", "\U0001f642", "\u00e9"]]


def test_pieces(spark):
    pieces = ["##ing", "\u2581sea", "\u0120land", "##", "[SEP]", "<s>", "in##side", " x "]
    assert run(spark, tx.clean_subword_marker, pieces) == ["ing", "sea", "land", "", "[SEP]", "<s>", "inside", "x"]
    assert run(spark, tx.clean_token, pieces) == ["ing", "sea", "land", "", "", "", "inside", "x"]
    df = spark.createDataFrame([(pieces,)], "p array<string>")
    assert df.select(tx.clean_pieces(F.col("p"), True)).first()[0] == ["ing", "sea", "land", "inside", "x"]


def test_templates_and_segments(spark):
    df = spark.createDataFrame([(["q"], ["r", "s"])], "a array<string>, b array<string>")
    single = df.select(tx.template_single(F.col("a"))).first()[0]
    pair = df.select(*tx.template_pair(F.col("a"), F.col("b"))).first()
    assert single == ["[CLS]", "q", "[SEP]"]
    assert list(pair) == [["[CLS]", "q", "[SEP]", "r", "s", "[SEP]"], [0, 0, 0, 1, 1, 1]]
    assert run(spark, tx.split_segments, [" un|do|ing ", "whole"]) == [["un", "do", "ing"], ["whole"]]


def test_a_filter_on_the_language_reaches_the_scan(spark, sf001):
    from tessera.plans.corpus import prepare_lines
    from tessera.sources.corpus import document_lines
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    plan = prepare_lines(document_lines(docs)).filter("lang = 'fr'")._jdf.queryExecution().toString()
    assert "EqualTo(lang,fr)" in plan and plan.count("ArrowEvalPython") <= 2  # once in each of two printed plans


def test_nfc_of_every_character_and_of_marks(spark):
    """Only texts that may change reach Python; the result is unicodedata's."""
    rng = random.Random(5)
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))]
    bases = [chr(c) for c in (0x41, 0x65, 0xE9, 0x3B1, 0x1100, 0x1161, 0x11A8, 0xAC00, 0x915, 0x9C7, 0x1B05, 0x11099)]
    texts = ["".join(chr(c) for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) for a in range(0, 0x110000, 64)]
    texts += [chr(c) for c in range(0x300) if c] + ["x" + chr(c) for c in range(0xA0, 0x3000)]
    texts += ["".join(rng.choice(bases) + "".join(rng.choices(marks, k=rng.randrange(4))) for _ in range(3)) for _ in range(5000)]
    texts += ["".join(rng.choices(bases, k=4)) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(4)
    got = {r["k"]: r["n"] for r in df.select("k", tx.nfc("t").alias("n")).collect()}
    assert [k for k, t in enumerate(texts) if got[k] != unicodedata.normalize("NFC", t)] == []
    sure = ["déjà vu für Größe", "ĀāČč łódź", "русский текст", "中文字符", "한국어", "plain"]
    unsure = ["de\u0301ja", "\u212b", "ம்", "x\u0327"]
    df = spark.createDataFrame([(t,) for t in sure + unsure], "t string")
    found = [r["t"] for r in df.filter(F.col("t").rlike(tx.nfc_unsure_pattern())).collect()]
    assert found == unsure


def test_nfc_passes_latin_rows_without_the_long_class(spark):
    """No character below U+0300 changes under NFC or combines, so one range tells such rows."""
    import re
    import unicodedata
    assert all(unicodedata.normalize("NFC", a + chr(c)) == a + chr(c) for c in range(0x300) for a in ("", "e", "A"))
    df = spark.createDataFrame([("caf\u00e9",), ("cafe\u0301",), ("x\u2014y",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.nfc("t")).collect()] == ["caf\u00e9", "caf\u00e9", "x\u2014y", "", None]
    plan = df.select(tx.nfc("t"))._jdf.queryExecution().analyzed().toString()
    assert re.search(r"RLIKE\(?t#\d+, \[\^\\x\{0\}-\\x\{2ff\}\]", plan) or r"[^\x{0}-\x{2ff}]" in plan


def test_specials_are_not_looked_for_inside_words(spark):
    df = spark.createDataFrame([("a[MASK]b [SEP]! <x>y",)], "t string")
    for specials, want in ((["[MASK]", "[SEP]"], ["a", "[MASK]", "b", "[SEP]", "!", "<", "x", ">", "y"]),
                           (["ab", "<x>"], ["a", "[", "MASK", "]", "b", "[", "SEP", "]!", "<x>", "y"])):
        got = df.select(tx.pretokens_with_specials(F.col("t"), specials).alias("p"))
        assert got.first()["p"] == want
        looks = got._jdf.queryExecution().analyzed().toString().count("(?!")
        assert looks == (1 if specials[0] == "[MASK]" else 2)
