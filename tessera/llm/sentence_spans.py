"""Substring deduplication on sliding runs of sentences."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tables import release, short_batches, utf8

#: A sentence ends with its marks or line and the blanks behind them, so a text
#: is its sentences joined.
SENTENCE = r"[^.!?\n]*[.!?\n]+[ \t\r\n]*|[^.!?\n]+"
_SENTENCE = re.compile(SENTENCE)

#: Sentence marks of other scripts, and scripts without blanks between words
#: (Thai, Lao, Myanmar, Khmer, kana, Han), where a character counts as a word.
MARKS = ".!?\u2026\u3002\uff01\uff1f\uff61\u061f\u06d4\u0964\u0965\u0589"
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_WORD = re.compile(rf"[^\s{MARKS}{UNSPACED}]+[{MARKS}]*\s*|[{MARKS}]+\s*|[{UNSPACED}][{MARKS}]*\s*")
_ASCII_WORD = re.compile(r"[^\s.!?]+[.!?]*\s*|[.!?]+\s*")
_END = re.compile(rf"[{MARKS}]+\s*|\n\s*")

#: Words of which one at least starts a piece; see :func:`pieces`.
WINDOW = 10

#: Characters of the texts whose runs are compared before they are shuffled.
GATHER_CHARS = 16_000_000
#: Runs that are compared at once at most, whatever the texts are like.
GATHER_RUNS = 250_000


def sentences(text: str) -> list[str]:
    return _SENTENCE.findall(text)


def _words(text: str):
    """``(words, at)``: a text's words (UTF-8, A-Z in lower case) and the
    offset at which each begins, the blanks behind a word being its own."""
    chunks = (_ASCII_WORD if text.isascii() else _WORD).findall(text)
    words = utf8(" ".join(" ".join(chunks).split())).lower().split(b" ") if chunks else []
    blank = len(text) - len(text.lstrip())
    return words, np.cumsum([blank, *map(len, chunks)])[:-1]


def _starts(text: str, words: list[bytes], at: np.ndarray, window: int) -> np.ndarray:
    """Numbers of the words that start a piece: those that start a sentence, and
    of every ``window`` words in a row without such a one the word with the
    smallest hash (of equal ones the last)."""
    n = len(words)
    ends = np.zeros(len(text) + 1, bool)
    ends[[m.end() for m in _END.finditer(text)]] = True
    first = ends[at]
    first[:1] = True
    order = np.fromiter(map(zlib.crc32, words), np.uint64, n) * np.uint64(2654435761) % np.uint64(2**32) + np.uint64(1)
    order[first] = 0
    # the smallest of each window: the spans looked at double up to it
    least = (order << np.uint64(31)) | (np.uint64(2**31 - 1) - np.arange(n, dtype=np.uint64))
    span = 1
    while span < window and len(least) > 1:
        step = min(span, window - span)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        span += step
    if n >= window:
        first[2**31 - 1 - (least & np.uint64(2**31 - 1)).astype(np.int64)] = True
    return np.flatnonzero(first)


def pieces(text: str, window: int = WINDOW) -> list[str]:
    """Sentences, cut further where they are longer than ``window`` words, so
    that no piece is.  Whether a word starts a piece depends on the ``window``
    words on either side only: a passage is cut alike in every text but for so
    many words at its ends.  Where a passage is whole sentences it is cut alike
    up to its ends.  A text is its pieces joined."""
    words, at = _words(text)
    if not words:
        return [text] if text else []
    cuts = [0, *at[_starts(text, words, at, window)[1:]].tolist(), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def _bounds(counts: np.ndarray, least_sentences: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the runs to hash, in order; see :func:`runs`."""
    n = len(counts)
    total = np.concatenate([[0], np.cumsum(counts)])
    first, last = np.arange(n), np.arange(1, n + 1)
    to = np.maximum(np.searchsorted(total, total[:-1] + least_words), first + least_sentences)
    start = np.minimum(np.searchsorted(total, total[1:] - least_words, side="right") - 1, last - least_sentences)
    both = np.unique(np.concatenate([first[to <= n] * (n + 1) + to[to <= n], start[start >= 0] * (n + 1) + last[start >= 0]]))
    return both // (n + 1), both % (n + 1)


def runs(counts: np.ndarray, least_sentences: int, least_words: int) -> list[tuple[int, int]]:
    """The runs ``[i, j)`` of consecutive sentences to hash: the shortest one
    from each sentence on and the shortest one up to each sentence that has at
    least ``least_sentences`` sentences and ``least_words`` words."""
    i, j = _bounds(counts, least_sentences, least_words)
    return list(zip(i.tolist(), j.tolist()))


def _hashed_runs(text: str, least_sentences: int, least_words: int, window: int | None = None):
    """``(i, j, digests)``: the runs of a text as two arrays and their hashes in a row."""
    if window:
        words, offset = _words(text)
        starts = np.append(_starts(text, words, offset, window), len(words)) if words else np.zeros(1, np.int64)
        ends = np.cumsum([0, *[len(w) + 1 for w in words]])
        i, j = _bounds(np.diff(starts), 1, least_words)
        joined, at = b" ".join([*words, b""]), ends[starts]
    else:
        parts = [utf8(s).lower().split() for s in sentences(text)]
        i, j = _bounds(np.fromiter(map(len, parts), np.int64, len(parts)), least_sentences, least_words)
        # every word is followed by a blank, so a run is one slice
        plain = [b"".join([w + b" " for w in p]) for p in parts]
        joined, at = b"".join(plain), np.cumsum([0, *map(len, plain)])
    digest = xxhash.xxh3_128_digest
    return i, j, b"".join([digest(joined[a:b]) for a, b in zip(at[i].tolist(), at[j].tolist())])


def run_hashes(text: str, least_sentences: int, least_words: int, window: int | None = None):
    """The runs of a text and the 128-bit hash of each; what counts of a
    sentence are its words (runs of characters but the six ASCII blanks), A-Z in
    lower case.  With a ``window`` the runs are of :func:`pieces`."""
    i, j, digests = _hashed_runs(text, least_sentences, least_words, window)
    return list(zip(i.tolist(), j.tolist())), [digests[k:k + 16] for k in range(0, len(digests), 16)]


# Rows are packed while they are shuffled: h2 and key in ``p``; sure, no, i and
# j - i (30 bits each, a text has fewer sentences) in ``q``.
_SPAN = "h long, id long, p long, q long"
_PLACE = ["no", "id", "key", "i", "j"]


def _packed(docs: list[tuple[bool, int, int]], found: list) -> pa.RecordBatch:
    """Rows of the runs ``(i, j, digests)`` found in each document ``(no, id, key)``."""
    n = np.fromiter((len(f[0]) for f in found), np.int64, len(found))
    i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    h = np.frombuffer(b"".join([f[2] for f in found]), "<i8").reshape(-1, 2)
    h, h2 = h[:, 0], h[:, 1].astype(np.int32)
    no, ids, key = (np.array(c, t) for c, t in zip(zip(*docs), (np.int64, np.int64, np.int64)))
    order = np.lexsort((key, ids, no))
    other = np.any([c[order[1:]] != c[order[:-1]] for c in (no, ids, key)], axis=0) if len(docs) > 1 else np.zeros(0, bool)
    rank = np.zeros(len(docs), np.int64)
    rank[order[1:]] = np.cumsum(other)
    doc = np.repeat(np.arange(len(docs)), n)
    # of equal runs in these texts, only those at the first place go on to meet others
    place = rank[doc]
    order = np.lexsort((j, i, place, h2, h))
    head = np.ones(len(order), bool)
    head[1:] = (h[order[1:]] != h[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    sure = np.zeros(len(order), np.int64)
    sure[order] = (place[order] != place[first]) | (i[order] != i[first]) | (j[order] != j[first])
    return pa.RecordBatch.from_arrays(
        [pa.array(h), pa.array(ids[doc]), pa.array(h2.astype(np.int64) << 32 | key[doc] & 0xFFFFFFFF),
         pa.array(sure << 61 | no[doc] << 60 | i << 30 | j - i)], [c.split()[0] for c in _SPAN.split(", ")])


def _unpacked(found: DataFrame) -> DataFrame:
    bits = lambda c, at, n: F.shiftright(c, at).bitwiseAND(F.lit((1 << n) - 1))
    i = bits("q", 30, 30)
    return found.select("h", F.shiftright("p", 32).cast("int").alias("h2"), (bits("q", 60, 1) == 1).alias("no"), "id",
                        F.shiftright(F.shiftleft("p", 32), 32).cast("int").alias("key"), i.cast("int").alias("i"),
                        (i + bits("q", 0, 30)).cast("int").alias("j"), (bits("q", 61, 1) == 1).alias("sure"))


def spans(docs: DataFrame, least_sentences: int, least_words: int, id_col: str, text_col: str,
          window: int | None = None) -> DataFrame:
    """One row per run of each text: its hash, its place (``no``: the id is
    null) and whether an earlier one is known already (``sure``), because both
    are in texts that one task has gathered.  So of a run that is everywhere a
    task sends few rows that have to meet in one place."""
    short_batches(docs.sparkSession)

    def run(batches):
        release()
        keys, found, chars, count = [], [], 0, 0
        for batch in batches:
            for key, text in zip(zip(*(batch.column(c).to_pylist() for c in ("no", "id", "key"))), batch.column("text")):
                text = text.as_py()
                keys.append(key)
                found.append(_hashed_runs(text, least_sentences, least_words, window))
                chars += len(text)
                count += len(found[-1][0])
                if chars >= GATHER_CHARS or count >= GATHER_RUNS:
                    yield _packed(keys, found)
                    keys, found, chars, count = [], [], 0, 0
        if keys:
            yield _packed(keys, found)

    return _keyed(docs.select(F.col(id_col).alias("__i"), F.col(text_col).alias("text")), "__i", "text").filter(
        "text is not null").select("no", "id", "key", "text").mapInArrow(run, _SPAN)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with what a document is known by: ``no, id, key``; without an id
    a hash of the text takes its place, so 96 bits tell such texts apart."""
    number = F.col(id_col).cast("long")
    return docs.select("*", number.isNull().alias("no"), F.coalesce(number, F.xxhash64(text_col)).alias("id"),
                       F.hash(text_col).alias("key"))


def later_spans(docs: DataFrame, least_sentences: int = 2, least_words: int = 20, id_col: str = "doc_id",
                text_col: str = "text", window: int | None = None) -> DataFrame:
    """``(no, id, key, spans)``: per document the runs ``[i, j)`` of sentences
    (with a ``window``: of pieces) that also occur earlier in the table (by id, nulls last, then hash of the
    text, then position), be it in the same document."""
    found = spans(docs, least_sentences, least_words, id_col, text_col, window)
    # what is decided already need not meet others of its hash
    place = F.when(F.col("q") >= 1 << 61, F.xxhash64("id", "p", "q")).otherwise(F.col("h"))
    found = _unpacked(found.withColumn("h", place).repartition("h"))
    same = Window.partitionBy("h", "h2", "sure").orderBy(*_PLACE)
    return (found.withColumn("r", F.rank().over(same)).filter("sure or r > 1")
            .groupBy("no", "id", "key").agg(F.collect_set(F.struct("i", "j")).alias("spans")))


def remove_repeats(docs: DataFrame, least_sentences: int = 2, least_words: int = 20, id_col: str = "doc_id",
                   text_col: str = "text", window: int | None = None) -> DataFrame:
    """``docs`` with sentences removed that any non-first repeated run covers.

    Runs are hashed (128 bits, of which 96 are compared) and joined over the
    whole table.  ``text_col`` holds the sentences that stay, joined;
    ``n_sentences`` and ``n_removed`` are added (replaced, if there).  The first
    occurrence of a run stays: that with the smallest id, of equal ids that
    with the smaller hash of the text, then position.  Rows equal in id and text are
    one occurrence and are treated alike.  A null text stays null with no
    sentences; texts too short for a run are left alone; rows are never
    dropped (a text may become empty).  Occurrences that overlap inside one text
    count.  An empty table stays empty.

    Without a ``window`` a repeat is seen only if it holds whole sentences.  With
    one the runs are of :func:`pieces` instead (any number of them, the two
    columns count them): every repeat of ``least_words + 3 * window`` words or
    more goes, wherever it begins and ends, but for up to ``window`` words at
    either end; of whole sentences, every one of ``least_words`` words.
    """
    others = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    later = later_spans(docs, least_sentences, least_words, id_col, text_col, window)
    rows = docs.select(F.struct(*[c for c in others if c != text_col]).alias("row"), F.col(id_col).alias("__i"),
                       F.col(text_col).alias("text"))
    short_batches(docs.sparkSession)

    @F.pandas_udf("text string, n_sentences long, n_removed long")
    def cut(text: pd.Series, repeated: pd.Series) -> pd.DataFrame:
        out = []
        for t, found in zip(text, repeated):
            parts = [] if t is None else pieces(t, window) if window else sentences(t)
            covered = np.zeros(len(parts) + 1, np.int64)
            for s in found if found is not None else ():
                covered[s["i"]] += 1
                covered[s["j"]] -= 1
            gone = np.cumsum(covered)[:-1] > 0
            n = int(gone.sum())
            out.append((t if not n else "".join(p for p, g in zip(parts, gone) if not g), len(parts), n))
        return pd.DataFrame(out, columns=["text", "n_sentences", "n_removed"])

    joined = _keyed(rows, "__i", "text").join(later, ["no", "id", "key"], "left")
    return (joined.select("row", F.explode(F.array(cut("text", "spans"))).alias("cut"))
            .select(*[F.col("cut.text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in others],
                    "cut.n_sentences", "cut.n_removed"))


def dedup(docs: DataFrame, least_sentences: int = 2, least_words: int = 20, id_col: str = "doc_id",
          text_col: str = "text", window: int | None = WINDOW) -> DataFrame:
    """:func:`remove_repeats` of pieces with the columns of ``docs``, without the rows of
    which nothing but blanks is left (rows that had no text before stay)."""
    kept = {f"__{c}": F.col(c) for c in ("n_sentences", "n_removed") if c in docs.columns}
    out = remove_repeats(docs.withColumns(kept) if kept else docs, least_sentences, least_words, id_col, text_col,
                         window)
    out = out.filter((F.col("n_removed") == 0) | F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.col(f"__{c}").alias(c) if f"__{c}" in kept else F.col(c) for c in docs.columns])
