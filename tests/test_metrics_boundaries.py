"""Metrics and boundary scores: expected numbers worked out by hand."""
import pytest
from pyspark.sql import functions as F

from tessera.operators import boundaries as bd
from tessera.operators import metrics as mt
from tessera.operators import tokenizers as tk
from tessera.operators.leaderboard import leaderboard

LINES = ["<xa> Red fox ran, red!", "<xb> 12 !!", "plain words"]


@pytest.fixture(scope="module")
def report(spark):
    lines = spark.createDataFrame([(t,) for t in LINES], "text string")
    toks = [tk.PretokTokenizer(), tk.ClosedVocabTokenizer(["Red", "fox"]),
            tk.PretokTokenizer("templated", add_special_tokens=True), tk.Chunk3Tokenizer(), tk.CharsTokenizer()]
    vocab = spark.createDataFrame([("Red",), ("fox",), ("plain",)], "piece string")
    return mt.tokenizer_report(lines, toks, {t.name: vocab for t in toks}).collect()


def row(report, language, tokenizer):
    return next(tuple(r)[2:] for r in report if (r["language"], r["tokenizer"]) == (language, tokenizer))


@pytest.mark.parametrize("language, tokenizer, numbers", [
    # lines, tokens per word, characters per token, unknown, coverage, mean, median and 95 % length
    ("all", "pretok", (3, 8 / 6, 3.3, 0, 0.5, 2.8, 3, 5)),
    ("xa", "pretok", (1, 6 / 4, 17 / 6, 0, 0.5, 14 / 6, 3, 3)),
    ("xb", "pretok", (1, 0, 2.5, 0, 0, 2, 2, 2)),
    ("unknown", "pretok", (1, 1, 5.5, 0, 0.5, 5, 5, 5)),
    ("all", "closed_vocab", (3, 8 / 6, 3.3, 0.8, 0.5, 4.6, 5, 5)),
    ("all", "templated", (3, 2, 33 / 16, 0, 0.5, 3.625, 4, 5)),
    ("xb", "templated", (1, 0, 1.25, 0, 0, 3.5, 3.5, 5)),
    ("xa", "chunk3", (1, 6 / 4, 17 / 6, 0, 0.5, 14 / 6, 3, 3)),
    ("unknown", "chunk3", (1, 2, 11 / 4, 0, 0.5, 2.5, 2.5, 3)),
    ("unknown", "chars", (1, 5, 1.1, 0, 0.5, 1, 1, 1))])
def test_report(report, language, tokenizer, numbers):
    assert row(report, language, tokenizer) == pytest.approx(numbers, abs=1e-8)


def test_report_order(report):
    assert [r["language"] for r in report] == ["all"] * 5 + ["unknown"] * 5 + ["xa"] * 5 + ["xb"] * 5
    assert [r["tokenizer"] for r in report][:5] == ["pretok", "closed_vocab", "templated", "chunk3", "chars"]


def test_leaderboard(spark, report):
    board = leaderboard(spark.createDataFrame(report)).filter("metric = 'fertility'").orderBy("position").collect()
    assert [(r["tokenizer"], r["position"]) for r in board] == [
        ("closed_vocab", 1), ("pretok", 2), ("chunk3", 3), ("templated", 4), ("chars", 5)]


def test_unknown_tokens_and_functions_are_parameters(spark):
    lines = spark.createDataFrame([("<xa> ab cd",)], "text string")
    tok = tk.FunctionTokenizer(spark, lambda text: [text[:3], "<?>", text[3:]], "thirds")
    vocab = spark.createDataFrame([("ab",)], "piece string")
    got = mt.tokenizer_report(lines, [tok, tk.PretokTokenizer()], {"thirds": vocab, "pretok": vocab}, unk_tokens=["<?>"]).collect()
    assert row(got, "all", "thirds") == pytest.approx((1, 1.5, 5 / 3, 1 / 3, 0.5, 7 / 3, 2, 2.9))
    assert row(got, "all", "pretok")[3] == 0


class Fixed(tk.Tokenizer):
    name, add_special_tokens = "fixed", True
    cuts = {"sunflower": ["su", "##nflow", "er"], "at": ["at"], "up": ["u", "p"], "reopened": ["re", "open", "ed"]}

    def pieces(self, pt):
        expr = F.array(pt)
        for word, parts in self.cuts.items():
            expr = F.when(pt == word, F.array(*map(F.lit, parts))).otherwise(expr)
        return expr


def test_boundary_scores(spark):
    gold = spark.createDataFrame([("sunflower", ["sun", "flower"]), ("sky", ["sky"]), ("at", ["a", "t"]), ("up", ["up"]),
                                  ("reopened", ["re", "open", "ed"])], "word string, segments array<string>")
    got = {r["word"]: tuple(r)[2:] for r in bd.score_words(gold, [Fixed()]).collect()}
    assert got["sunflower"] == ("sun|flower", "[CLS]|su|##nflow|er|[SEP]", "3", "2,7", 0, 0, 0, 0, 2, 1)
    assert got["sky"] == ("sky", "[CLS]|sky|[SEP]", "", "", 1, 1, 1, 0, 0, 0)
    assert got["at"] == ("a|t", "[CLS]|at|[SEP]", "1", "", 0, 0, 0, 0, 0, 1)
    assert got["up"] == ("up", "[CLS]|u|p|[SEP]", "", "1", 0, 0, 0, 0, 1, 0)
    assert got["reopened"] == ("re|open|ed", "[CLS]|re|open|ed|[SEP]", "2,6", "2,6", 1, 1, 1, 2, 0, 0)
    raw = {r["word"]: r["predicted_boundaries"] for r in bd.score_words(gold, [Fixed()], drop_specials=False).collect()}
    assert raw["sky"] == "5,8"
    s = bd.macro_summary(bd.score_words(gold, [Fixed()], round_to=None)).first()
    assert tuple(s) == ("fixed", 5, 0.4, 0.4, 0.4, 2, 3, 2)


def test_offsets(spark):
    rows = [(["ab", "", "cde", "f"], [2, 5]), (["", "x"], [0]), (["whole"], []), ([], []), (["\U0001f642\u00e9", "b", "c"], [2, 3])]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "k int, s array<string>")
    assert [r[1] for r in df.select("k", bd.boundary_offsets("s")).orderBy("k").collect()] == [b for _, b in rows]
    long = spark.createDataFrame([(["y"] * 100_000,)], "s array<string>")
    assert long.select(F.size(bd.boundary_offsets("s"))).first()[0] == 99_999
