"""Morpheme-boundary scoring (B1-B6), built-in array functions only.

A gold word is a ``word`` with ``segments`` (array).  Boundaries are the
running sums of segment lengths, last one left out, as a set.  Predicted
boundaries come from the tokenizer's pieces of the word after cleaning
(markers removed; special tokens removed too in the main variant).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx


def boundary_offsets(segments) -> Column:
    """B1: ``{len(s1), len(s1)+len(s2), ...}`` without the last, distinct."""
    seg = F.col(segments) if isinstance(segments, str) else segments
    # linear in the word: segments as runs of one mark, joined by commas; the
    # k-th comma stands after as many marks as its index less k
    marks = F.array_join(F.transform(seg, lambda x: F.repeat(F.lit("x"), F.length(x))), ",")
    commas = F.filter(F.transform(F.split(marks, ""), lambda c, i: F.when(c == ",", i)), lambda i: i.isNotNull())
    return F.array_distinct(F.transform(commas, lambda at, k: at - k))


def predicted_offsets(pieces, drop_specials: bool = True) -> Column:
    """B2: clean the pieces, drop empties, then B1."""
    p = F.col(pieces) if isinstance(pieces, str) else pieces
    return boundary_offsets(tx.clean_pieces(p, drop_specials=drop_specials))


def _join_offsets(c: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(c), lambda x: x.cast("string")), ",")


def shared(gold: Column, pred: Column) -> Column:
    """How many offsets two sets have in common."""
    return F.size(F.array_intersect(gold, pred))


def score(gold: Column, pred: Column, tp: Column | None = None) -> dict:
    """TP / FP / FN, precision, recall, F1 of two offset sets; ``tp`` is a column
    that holds :func:`shared` of them already (each score refers to it many times)."""
    tp = shared(gold, pred) if tp is None else tp
    fp = F.size(pred) - tp
    fn = F.size(gold) - tp
    both_empty = (F.size(gold) == 0) & (F.size(pred) == 0)
    precision = tp / F.greatest(tp + fp, F.lit(1))
    recall = tp / F.greatest(tp + fn, F.lit(1))
    f1 = F.when(precision + recall == 0, F.lit(0.0)).otherwise(
        2 * precision * recall / (precision + recall))
    one = F.lit(1.0)
    return {
        "precision": F.when(both_empty, one).otherwise(precision),
        "recall": F.when(both_empty, one).otherwise(recall),
        "f1": F.when(both_empty, one).otherwise(f1),
        "true_positive": F.when(both_empty, 0).otherwise(tp).cast("bigint"),
        "false_positive": F.when(both_empty, 0).otherwise(fp).cast("bigint"),
        "false_negative": F.when(both_empty, 0).otherwise(fn).cast("bigint"),
    }


def score_words(gold: DataFrame, tokenizers, drop_specials: bool = True,
                round_to: int | None = 9) -> DataFrame:
    """One row per (tokenizer, gold word).

    ``gold`` has ``word string, segments array<string>``.  Each tokenizer is
    applied to the word as a text (pre-tokenized, templated) -- the same call
    the reference makes per word.  No cross join: every word is read once, gets the
    pieces of each tokenizer as a column and becomes a row for each (J2).
    """
    tokenizers = list(tokenizers)
    # here and below, explode of a one-element array: offsets and hits are worked out once
    words = gold.select("word", "segments", F.explode(F.array(boundary_offsets(F.col("segments")))).alias("_g"))
    for i, tok in enumerate(tokenizers):
        words = tok.encode_lines(words, "word", out=f"_pieces{i}")
    enc = words.select("word", "segments", "_g", F.explode(F.array(*[
        F.struct(F.lit(tok.name).alias("tokenizer"), F.col(f"_pieces{i}").alias("pieces"))
        for i, tok in enumerate(tokenizers)])).alias("_t"))
    enc = enc.select("word", "segments", "_g", "_t.tokenizer", "_t.pieces", F.explode(F.array(
        predicted_offsets(F.col("_t.pieces"), drop_specials))).alias("_p"))
    enc = enc.select("*", F.explode(F.array(shared(F.col("_g"), F.col("_p")))).alias("_tp"))
    s = score(F.col("_g"), F.col("_p"), F.col("_tp"))
    sel = ["tokenizer", "word",
           F.array_join("segments", "|").alias("gold_segments"),
           F.array_join("pieces", "|").alias("predicted_tokens"),
           _join_offsets(F.col("_g")).alias("gold_boundaries"),
           _join_offsets(F.col("_p")).alias("predicted_boundaries")]
    for k in ("precision", "recall", "f1"):
        v = s[k].cast("double")
        sel.append((F.round(v, round_to) if round_to is not None else v).alias(k))
    for k in ("true_positive", "false_positive", "false_negative"):
        sel.append(s[k].alias(k))
    return enc.select(*sel)


def macro_summary(words: DataFrame, round_to: int | None = 9) -> DataFrame:
    """Per tokenizer word count, mean P/R/F1, summed TP/FP/FN."""
    def r(c):
        return F.round(c, round_to) if round_to is not None else c
    return (words.groupBy("tokenizer").agg(
        F.count("word").alias("num_words"),
        r(F.avg("precision")).alias("boundary_precision"),
        r(F.avg("recall")).alias("boundary_recall"),
        r(F.avg("f1")).alias("boundary_f1"),
        F.sum("true_positive").cast("bigint").alias("total_true_positive"),
        F.sum("false_positive").cast("bigint").alias("total_false_positive"),
        F.sum("false_negative").cast("bigint").alias("total_false_negative"))
        .orderBy("tokenizer"))
