import math
import random
from collections import Counter

import numpy as np
import regex
from pyspark.sql import functions as F

from tessera.llm import language_id as li
from tessera.llm.queries import op4_language_id


def test_word_first_then_shorter_grams():
    m = li.Model(["a", "b"], {"hund": {0: 3}, "dog": {1: 3}}, {1: {"x": {0: 1}}, 2: {" d": {1: 9}, "qq": {0: 9}}})
    assert np.argmax(m.score_word("hund")) == 0 and np.argmax(m.score_word("dog")) == 1
    assert np.allclose(m.score_word("dax"), m.grams[2][1][m.grams[2][0][" d"]])  # only 2-grams count if any is known
    assert np.allclose(m.score_word("x"), m.grams[1][1][m.grams[1][0]["x"]])
    assert not m.score_word("zzz").any()
    got = m.predict(["the Hund hund", "dog!", None, "", "12 ?", "dog hund", "zzz"])
    assert got.lang_pred.tolist() == ["a", "b", "und", "und", "und", "a", "a"]
    assert got.score.tolist()[2:5] == [0, 0, 0] and got.score[6] == 0.5


def test_odd_rows(odd, none):
    clash = odd.withColumnRenamed("n_chars", "score")
    model = li.train(odd)
    out = li.identify(clash, model)
    assert out.count() == odd.count() and out.columns.count("score") == 1
    got = {r["doc_id"]: r["lang_pred"] for r in out.collect()}
    assert got[2] == got[3] == got[4] == got[9] == "und" and got[8] in model.langs
    kept = li.keep_identified(clash)
    assert kept.columns == clash.columns and kept.schema["score"].dataType == clash.schema["score"].dataType
    assert li.keep_identified(none).count() == 0
    assert li.identify(odd, li.train(none)).select("lang_pred").distinct().collect()[0][0] == "und"


def test_held_out_accuracy_and_no_peeking(spark, sf001):
    got = op4_language_id(spark, sf001)
    docs = spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").filter("held_out and lang is not null").collect()
    assert len(rows) > 40
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert got.filter(~F.col("score").between(0, 1)).count() == 0


def test_the_fit_is_bounded(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4800, "a").otherwise("b").alias("lang"), F.xxhash64("id").alias("h"))
    for most, step in ((100, 12), (100, 3), (5000, 12), (1, 4)):
        cuts = li._hash_cuts(df, most, step)
        for lang, (bits, end) in cuts.items():
            n = df.filter((F.col("lang") == lang) & (F.shiftrightunsigned("h", 64 - bits) < end)).count()
            assert n <= most and (n > 0 or most == 1) and (most < 5000 or n == df.filter(F.col("lang") == lang).count())
    items = spark.createDataFrame([("a", f"w{i}", i // 3) for i in range(30)] + [("b", "x", 1)], "lang string, g string, n long")
    got = li._top(items, 7, {"a": 0, "b": 1})
    assert sorted(got) == ["w24", "w25", "w26", "w27", "w28", "w29", "x"] and got["x"] == {1: 1}


def test_training_and_prediction_equal_a_recount(spark):
    """Every count of the model, and every prediction, worked out again in plain Python."""
    rng = random.Random(6)
    pools = {"a": ["haus", "baum", "über", "x"], "b": ["house", "tree", "x", "the"], "c": ["дом", "the", "baum"]}
    rows = [(i, " ".join(rng.choices(pools[lang], k=rng.randrange(1, 9))).title() + " 12!", lang)
            for i, lang in enumerate(rng.choices("abc", k=60))]
    df = spark.createDataFrame(rows + [(90, None, "a"), (91, "nobody", None)], "doc_id long, text string, lang string")
    model = li.train(df, longest=3)
    langs = ["a", "b", "c"]
    words, grams = {}, {n: {} for n in (1, 2, 3)}
    for _, text, lang in rows:
        for w in regex.findall(r"\p{L}+", text.lower()):
            words.setdefault(w, Counter())[lang] += 1
            padded = f" {w} "
            for n in grams:
                for k in range(len(padded) - n + 1):
                    if padded[k:k + n] != " ":
                        grams[n].setdefault(padded[k:k + n], Counter())[lang] += 1

    def logs(counts):
        total = {x: sum(c[x] for c in counts.values()) for x in langs}
        return {i: [math.log((c[x] + 0.5) / (total[x] + 0.5 * len(counts))) for x in langs] for i, c in counts.items()}

    want = {0: logs(words)} | {n: logs(g) for n, g in grams.items()}
    for n, (at, table) in {0: model.words, **model.grams}.items():
        assert at.keys() == want[n].keys()
        assert all(np.allclose(table[k], want[n][item]) for item, k in at.items())

    def predict(text):
        total = [0.0] * 3
        found = regex.findall(r"\p{L}+", (text or "").lower())
        for w in found:
            row = want[0].get(w)
            for n in (3, 2, 1):
                known = [want[n][f" {w} "[k:k + n]] for k in range(len(w) + 3 - n) if f" {w} "[k:k + n] in want[n]]
                if row is None and known:
                    row = [sum(x) / len(known) for x in zip(*known)]
            total = [t + r for t, r in zip(total, row or [0.0] * 3)]
        if not found:
            return "und", 0.0
        best = max(range(3), key=lambda k: (total[k], -k))
        return langs[best], 1 / sum(math.exp(t - total[best]) for t in total)

    texts = [t for _, t, _ in rows] + ["häuser bäume", "trees", "домик the", "qqq", "", None, "haus the the"]
    got = li.identify(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), model).orderBy("k").collect()
    for r, t in zip(got, texts):
        lang, score = predict(t)
        assert r["lang_pred"] == lang and math.isclose(r["score"], score, rel_tol=1e-9, abs_tol=1e-12)
