"""Repetition inside a text, measured on suffix arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import chunks, short_batches, utf8, word_ids

SYMBOLS = "#*$%&|<>"
#: Words whose suffixes are sorted together; one longer text is sorted alone.
BLOCK_WORDS = 400_000
_DROP_SYMBOLS = {ord(c): None for c in SYMBOLS}


def suffix_array(symbols: np.ndarray, owner: np.ndarray):
    """Suffix array and longest-common-prefix lengths of several sequences.

    ``owner`` (ascending) says which sequence a position belongs to; a suffix
    ends with its sequence, and suffixes of different sequences share no
    prefix.  Prefix doubling: each round sorts only suffixes whose prefix of
    the current length still ties with another.  Returns ``(order, lcp)``,
    ``lcp[i]`` being that of ``order[i - 1]`` and ``order[i]``.
    """
    n = len(symbols)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    last = np.searchsorted(owner, owner, side="right")  # end of the own sequence
    key = owner.astype(np.int64) * (int(symbols.max()) + 1) + symbols
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = head
    tied = _ties(new)
    length, levels = 1, [rank.astype(np.int32)]
    while len(tied):
        at = order[tied]
        nxt = at + length
        second = np.where(nxt < last[at], rank[np.minimum(nxt, n - 1)], -1)
        first = rank[at]
        resorted = np.lexsort((second, first))
        at, first, second = at[resorted], first[resorted], second[resorted]
        order[tied] = at
        split = np.ones(len(tied), bool)
        split[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        new[tied] |= split
        rank[at] = tied[np.maximum.accumulate(np.where(split, np.arange(len(tied)), 0))]
        tied = tied[_ties(new[tied])]
        length *= 2
        levels.append(rank.astype(np.int32))
    return order, _common(levels, last, order)


def _ties(new: np.ndarray) -> np.ndarray:
    """Positions of runs of two or more that start where ``new`` is set."""
    n = len(new)
    if not n:
        return np.empty(0, np.int64)
    alone = new.copy()
    alone[:-1] &= new[1:]
    return np.flatnonzero(~alone)


def _common(levels, last, order):
    """Common prefix lengths of neighbours in ``order``.  ``levels[k]`` ranks
    the suffixes by their first ``2 ** k`` symbols, so the lengths are read off
    bit by bit from the highest level down."""
    lcp = np.zeros(len(order), np.int64)
    live = 1 + np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    a, b = order[live - 1].copy(), order[live].copy()
    end_a, end_b = last[a], last[b]
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero((a < end_a) & (b < end_b))
        same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
        lcp[live[same]] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return lcp


def repeats(order: np.ndarray, lcp: np.ndarray, least: int):
    """Longest repeat that starts at each position and is at least ``least``
    long (else 0): the longest interval of the LCP array that holds it."""
    reach = np.zeros(len(order), np.int64)
    if len(order):
        up = lcp.copy()
        up[:-1] = np.maximum(up[:-1], lcp[1:])
        reach[order] = np.where(up >= least, up, 0)
    return reach


def covered(reach: np.ndarray) -> np.ndarray:
    """Positions inside the union of the spans ``[i, i + reach[i])``."""
    n = len(reach)
    step = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(reach)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + reach[starts], -1)
    return np.cumsum(step[:-1]) > 0


def measure(texts, least_words: int) -> pd.DataFrame:
    """Word, symbol, line and repetition counts of each text; texts are taken
    in blocks of about :data:`BLOCK_WORDS` words."""
    out = []
    data = [utf8(t) if t is not None else b"" for t in texts]
    for i, j in chunks([len(d) // 6 for d in data], BLOCK_WORDS):
        words = [d.split() for d in data[i:j]]
        symbols, n = word_ids(words)
        owner = np.repeat(np.arange(j - i), n)
        order, lcp = suffix_array(symbols, owner)
        tally = lambda mask: np.bincount(owner[mask], minlength=j - i)
        reach = repeats(order, lcp, least_words)
        longest = np.zeros(j - i, np.int64)
        np.maximum.at(longest, owner, repeats(order, lcp, 1))
        three = np.minimum(repeats(order, lcp, 3), 3)
        frame = pd.DataFrame({"n_words": n, "n_covered_words": tally(covered(reach)), "longest_repeat": longest,
                              "n_repeat_words": tally(covered(three))})
        part = [t or "" for t in texts[i:j]]
        frame["word_chars"] = [len(t) - sum(map(t.count, " \t\n\v\f\r")) for t in part]
        frame["n_symbols"] = [len(t) - len(t.translate(_DROP_SYMBOLS)) for t in part]
        frame["n_dup_lines"] = [_repeated_lines(t) for t in data[i:j]]
        out.append(frame)
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(
        columns=["n_words", "n_covered_words", "longest_repeat", "n_repeat_words", "word_chars", "n_symbols", "n_dup_lines"])


def _repeated_lines(data: bytes) -> int:
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered_words long, longest_repeat long"


def score(docs: DataFrame, least_words: int = 10, max_covered: float = 0.5, max_repeat: int = 100,
          min_words: int = 50, max_repeat_words: int = 50, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with the counts above and two verdicts.

    A text's words are its symbols.  Repeats of ``least_words`` or more words
    are the maximal repeated substrings read off the LCP intervals of the
    text's suffix array; the union of their spans (first occurrences too) may
    cover ``max_covered`` of the words, the longest may have ``max_repeat``
    words.  ``base_failed``: fewer than ``min_words`` words, or more than
    ``max_repeat_words`` per cent of them in repeated 3-word windows.  ``kept``:
    passes both.  Null and empty texts have no words and fail.  Rows are never
    dropped; columns that share a new column's name are replaced.
    """
    short_batches(docs.sparkSession)
    names = [c.split()[0] for c in COUNTS.split(", ")]
    others = [c for c in docs.columns if c not in {*names, text_col, "base_failed", "kept", "covered_fraction"}]

    @F.pandas_udf(COUNTS)
    def count(text: pd.Series) -> pd.DataFrame:
        return measure(text.tolist(), least_words)[names]

    n, rep = F.col("n_words"), F.col("n_repeat_words")
    failed = (n < min_words) | (rep * 100 > n * max_repeat_words)
    return (docs.select(*[docs[c] for c in others], F.explode(F.array(count(text_col))).alias("__c"))
            .select(*others, "__c.*")
            .withColumn("covered_fraction", F.when(n > 0, F.col("n_covered_words") / n).otherwise(F.lit(0.0)))
            .withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("covered_fraction") <= max_covered)
                        & (F.col("longest_repeat") <= max_repeat)))
