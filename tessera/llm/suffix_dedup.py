"""Every byte of a long repeat goes: suffixes sorted by hash comparisons.

A window is a string of ``length`` bytes.  The suffixes that are compared are
those at *anchors*: of the hashes of all ``anchor`` bytes inside a window the
smallest (of equal ones the first) is at the window's anchor.  It depends on the
window's bytes only, so equal windows have equal anchors at equal distances, and
a window is repeated if and only if another suffix at an equal anchor agrees
with its own for the bytes of the window behind the anchor, and the text before
it, read backwards, for those in front.

The windows with one anchor are consecutive; the bytes they cover are a *run*.
"""

from __future__ import annotations

from functools import cache, cmp_to_key

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tables import short_batches, stage
from tessera.session import Tables

LENGTH = 200
#: Window starts that are looked at in one go; a longer text is cut between windows.
BLOCK = 1 << 18
#: Runs of a task that are compared with each other before they are shuffled.
HELD_RUNS = 400_000
#: Runs at equal anchors that one task sorts; the windows of more of them are compared by digest.
MOST_MEMBERS = 2_000

_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64(BLOCK * 2 - 1)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's first ``n`` powers and their inverses, modulo 2**64."""
    def upto(base):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, out=out)
    return upto(_BASE), upto(pow(_BASE, -1, 2**64))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes (modulo 2**64) of the prefixes of each row of bytes, the
    empty one first."""
    power, _ = _powers(2 * BLOCK)
    values = (data.astype(np.uint64) + np.uint64(1)) * power[:data.shape[-1]]
    return np.concatenate([np.zeros((*data.shape[:-1], 1), np.uint64), np.cumsum(values, axis=-1)], axis=-1)


def runs(data: bytes, length: int, anchor: int):
    """Yield ``(first, last, at, hash)``, arrays over the runs of a text: first
    and last window start, the anchor's place and the hash of its bytes."""
    _, inverse = _powers(2 * BLOCK)
    span = length - anchor + 1
    for begin in range(0, len(data) - length + 1, BLOCK):
        part = np.frombuffer(data, np.uint8, min(BLOCK + length - 1, len(data) - begin), begin)
        total = prefix_hashes(part)
        h = (total[anchor:] - total[:-anchor]) * inverse[:len(part) - anchor + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        # the smallest of each window: the spans looked at double up to it
        least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        seen = 1
        while seen < span:
            step = min(seen, span - seen)
            least = np.minimum(least[:-step], least[step:])
            seen += step
        at = (least & _LOW).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        at = at[first]
        yield first + begin, np.append(first[1:], len(least)) - 1 + begin, at + begin, h[at].view(np.int64)


def _met_before(*keys: np.ndarray) -> np.ndarray:
    """0 for a row whose keys no other row has; of equal rows 1 for one, 2 for the others."""
    order = np.lexsort(keys)
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        same &= k[order[1:]] == k[order[:-1]]
    out = np.zeros(len(order), np.int32)
    out[order[1:]] = 2 * same
    out[order[:-1]] |= np.where(same & (out[order[:-1]] == 0), 1, 0).astype(np.int32)
    return out


# A document is known by three columns: whether its id is null, the id (or else a
# hash of the text), and another hash of the text.
_DOC = ["no", "id", "key"]
_RUN = "no boolean, id long, key int, h long, x long, first int, last int, at int, met int"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    others = [c for c in docs.columns if c != text_col]
    number, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.struct(*others).alias("row"), text.alias("text"), number.isNull().alias("no"),
                       F.coalesce(number, F.xxhash64(text)).alias("id"), F.hash(text).alias("key"))


def _all_runs(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    short_batches(docs.sparkSession)
    names = [c.split()[0] for c in _RUN.split(", ")]

    def rows(held):
        doc, found = [x[0] for x in held], [x[1] for x in held]
        n = np.fromiter((len(f[0]) for f in found), np.int64, len(found))
        first, last, at, h, x = (np.concatenate(c) for c in zip(*found))
        columns = [pa.array([d[0] for d in doc]).take(pa.array(np.repeat(np.arange(len(doc)), n))),
                   *[pa.array(np.repeat(np.array([d[k] for d in doc], t), n)) for k, t in ((1, np.int64), (2, np.int32))],
                   pa.array(h), pa.array(x), *[pa.array(v.astype(np.int32)) for v in (first, last, at)],
                   pa.array(_met_before(h, x))]
        table = pa.Table.from_arrays(columns, names)
        return table.to_batches(max_chunksize=1 << 16)

    def run(batches):
        held, count = [], 0
        for batch in batches:
            for doc, data in zip(zip(*(batch.column(c).to_pylist() for c in _DOC)),
                                 batch.column("text").cast(pa.binary())):
                data = data.as_py()
                for first, last, at, h in runs(data, length, anchor):
                    x = np.array([xxhash.xxh3_64_intdigest(data[i:j + length])
                                  for i, j in zip(first.tolist(), last.tolist())], np.uint64).view(np.int64)
                    held.append((doc, (first, last, at, h, x)))
                    count += len(first)
                    if count >= HELD_RUNS:
                        yield from rows(held)
                        held, count = [], 0
        if held:
            yield from rows(held)

    return docs.select(*_DOC, "text").mapInArrow(run, _RUN)


def _judged(found: DataFrame) -> DataFrame:
    """Runs that are wholly ``repeated``, and runs of which parts may be: those at
    anchors where other runs are.  Of each such run the first stands for all;
    ``members`` counts them."""
    # what its own task has settled need not meet others of its hash
    decided = F.col("met") == 2
    found = (found.withColumn("decided", decided)
             .withColumn("place", F.when(decided, F.xxhash64("id", "key", "first")).otherwise(F.col("h"))).repartition("place"))
    same = Window.partitionBy("place", "decided", "h", "x")
    bucket = Window.partitionBy("place", "decided", "h")
    first = F.row_number().over(same.orderBy(*_DOC, "first")) == 1
    repeated = F.col("decided") | (F.col("met") == 1) | (F.count("*").over(same) > 1)
    return (found.withColumns({"stands": first, "repeated": repeated})
            .withColumns({"members": F.sum(F.col("stands").cast("long")).over(bucket),
                          "open": F.max(~F.col("repeated")).over(bucket)})
            .withColumn("compare", ~F.col("decided") & F.col("stands") & F.col("open") & (F.col("members") > 1))
            .filter("repeated or compare")
            .select(*_DOC, "h", "first", "last", "at", "repeated", "compare", "members"))


_MEMBER = "g long, g2 long, no boolean, id long, key int, first int, at int, open boolean, met int, body binary"


def _cut_out(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the runs to compare, or, where too many runs have an
    anchor, the digest of each of their windows."""
    short_batches(docs.sparkSession)
    lists = wanted.groupBy(*_DOC).agg(F.collect_list(F.struct(
        "h", "first", "last", "at", (~F.col("repeated")).alias("open"), (F.col("members") > MOST_MEMBERS).alias("many"))).alias("runs"))
    names = [c.split()[0] for c in _MEMBER.split(", ")]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.binary()]

    def out(rows, many):
        if many:
            met = _met_before(*[np.array([r[k] for r in many], np.int64) for k in (0, 1)])
            # a window that others of this task have is repeated without meeting more of them
            rows = rows + [(*(r[:2] if m < 2 else (r[3], r[5] + 1)), *r[2:8], m, None)
                           for r, m in zip(many, met.tolist()) if m < 2 or r[7]]
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def run(batches):
        rows, many, size, last_doc = [], [], 0, None
        for batch in batches:
            for doc, data, found in zip(zip(*(batch.column(c).to_pylist() for c in _DOC)),
                                        batch.column("text").cast(pa.binary()), batch.column("runs").to_pylist()):
                if doc == last_doc:         # a repeated row: its runs are not open and one of each is enough
                    continue
                last_doc, data = doc, data.as_py()
                for r in found:
                    if r["many"]:
                        for i in range(r["first"], r["last"] + 1):
                            d = np.frombuffer(xxhash.xxh3_128_digest(data[i:i + length]), np.int64).tolist()
                            many.append((d[0], d[1] or 1, *doc, i, 0, r["open"]))
                        size += 100 * (r["last"] + 1 - r["first"])
                    else:
                        rows.append((r["h"], 0, *doc, r["first"], r["at"], r["open"], 0, data[r["first"]:r["last"] + length]))
                        size += r["last"] - r["first"] + length
                    if size > 1 << 24:
                        yield out(rows, many)
                        rows, many, size = [], [], 0
        if rows or many:
            yield out(rows, many)

    # "row" is read so that this exchange of the texts is the one that the result uses too
    return (docs.join(lists, _DOC).select(*_DOC, "text", "runs", F.xxhash64("row").alias("row"))
            .mapInArrow(run, _MEMBER))


class Suffixes:
    """Suffixes of up to ``width`` bytes in sorted order, and the common length
    of neighbours.

    The common extension of two is found by binary search over their prefix
    hashes, so a comparison takes logarithmic time, and is verified on the bytes: unequal
    hashes are of unequal prefixes, equal ones may be a collision.  Python's sort is a merge sort.
    """

    def __init__(self, parts: list[bytes], width: int):
        self.parts = [p[:width] for p in parts]
        padded = np.zeros((len(parts), max(map(len, self.parts))), np.uint8)
        for row, p in zip(padded, self.parts):
            row[:len(p)] = np.frombuffer(p, np.uint8)
        self.hashes = prefix_hashes(padded).tolist()
        self.order = sorted(range(len(parts)), key=cmp_to_key(self.compare))
        self.common = [self.extension(i, j) for i, j in zip(self.order, self.order[1:])]

    def extension(self, i: int, j: int) -> int:
        a, b, p, q = self.hashes[i], self.hashes[j], self.parts[i], self.parts[j]
        low, high = 0, min(len(p), len(q))
        while low < high:
            middle = (low + high + 1) // 2
            if a[middle] == b[middle]:
                low = middle
            else:
                high = middle - 1
        if p[:low] != q[:low]:
            low = next(k for k in range(low) if p[k] != q[k])
        return low

    def compare(self, i: int, j: int) -> int:
        n, p, q = self.extension(i, j), self.parts[i], self.parts[j]
        return (p[n:n + 1] > q[n:n + 1]) - (p[n:n + 1] < q[n:n + 1])

    def classes(self, least: np.ndarray) -> np.ndarray:
        """For each suffix (row) and each number of bytes in ``least`` (column):
        the class of suffixes that agree for so many."""
        new = np.array(self.common, np.int64).reshape(-1, 1) < least
        out = np.zeros((len(self.parts), len(least)), np.int64)
        out[self.order[1:]] = np.cumsum(new, axis=0)
        return out


def repeated_windows(members: list[tuple[bytes, int]], length: int, anchor: int) -> np.ndarray:
    """For runs ``(bytes, place of the anchor)`` with equal anchors: whether the
    window that has ``u`` bytes (column) in front of the anchor is in another one too."""
    before = np.arange(length - anchor + 1)
    behind = Suffixes([body[at:] for body, at in members], length).classes(length - before)
    front = Suffixes([body[:at][::-1] for body, at in members], length).classes(before)
    # suffixes too short for a window share it with none: they agree with none for so many bytes
    both = behind * len(members) + front
    order = np.argsort(both, axis=0, kind="stable")
    ranked = np.take_along_axis(both, order, axis=0)
    same = np.zeros(both.shape, bool)
    equal = ranked[1:] == ranked[:-1]
    same[1:] = equal
    same[:-1] |= equal
    out = np.empty(both.shape, bool)
    np.put_along_axis(out, order, same, axis=0)
    return out


_SPAN = "no boolean, id long, key int, span long"


def _compared(members: DataFrame, length: int, anchor: int) -> DataFrame:
    """Spans of the open runs' repeated windows; each task goes through its
    anchors one by one."""
    names = [c.split()[0] for c in _SPAN.split(", ")]

    def bucket(rows):
        seen, kept = set(), []
        for r in rows:
            if r["open"] or r["body"] not in seen:
                seen.add(r["body"])
                kept.append(r)
        if len(kept) < 2:
            return
        same = repeated_windows([(r["body"], r["at"] - r["first"]) for r in kept], length, anchor)
        for r, row in zip(kept, same):
            if r["open"]:
                edge = np.diff(np.concatenate([[0], row.astype(np.int8), [0]]))
                for u, v in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                    yield r["no"], r["id"], r["key"], (r["at"] - v + 1) << 32 | (r["at"] - u + length)

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*out), (pa.bool_(), pa.int64(), pa.int32(), pa.int64()))], names)

    def run(batches):
        held, key, out = [], None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["body"] is None:       # one window, of which its digest tells how many there are
                    if r["open"] and (r["met"] or r["n"] > 1):
                        out.append((r["no"], r["id"], r["key"], r["first"] << 32 | (r["first"] + length)))
                    continue
                if r["g"] != key:
                    out += bucket(held)
                    held, key = [], r["g"]
                held.append(r)
            if len(out) > 1 << 16:
                yield batch_of(out)
                out = []
        out += bucket(held)
        if out:
            yield batch_of(out)

    return (members.repartition("g", "g2").withColumn("n", F.count("*").over(Window.partitionBy("g", "g2")))
            .mapInArrow(run, _SPAN))


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int | None = None, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` replaced by what stays of its bytes (binary), and
    ``n_bytes``, ``n_removed``, ``n_spans`` (added; replaced, if there).

    Every byte goes that a string of ``length`` bytes covers which also starts
    anywhere else in the table, be it in the same document or overlapping; none
    stays as the first.  Strings do not cross documents and are judged on the
    input.  What is left may start or end inside a character.

    Each task finds the runs of its texts (see the module); runs are matched by a
    128-bit digest, 64 bits of it the anchor's.  Runs with a like one are repeated
    throughout.  The others that share an anchor only are cut out of their
    texts and compared byte by byte, as sorted suffixes.  At an anchor with more than
    :data:`MOST_MEMBERS` different runs (a phrase in many contexts) the 128-bit
    digests of their windows are counted instead, with the same result.

    Null texts are empty; shorter ones stay as they are; rows are never dropped.
    Repeated rows are repeats of each other.  Rows are known by id and a 32-bit
    hash of the text, those without an id by 96 bits of hashes.  No rows give no rows.
    """
    anchor = anchor or max(1, length // 4)
    if not 1 <= anchor <= length <= BLOCK:
        raise ValueError(f"an anchor has 1 to length bytes, a window at most {BLOCK}")
    others = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_removed", "n_spans")]
    keyed = _keyed(docs.select(*others, text_col), id_col, text_col)
    with Tables() as kept:
        judged = kept.keep(_judged(_all_runs(keyed, length, anchor)), "suffix-runs")
        dealt = keyed.repartition(*_DOC)
        some = _compared(_cut_out(dealt, judged.filter("compare"), length), length, anchor)
        whole = judged.filter("repeated").select(*_DOC, (F.shiftleft(F.col("first").cast("long"), 32).bitwiseOR(
            F.col("last").cast("long") + length)).alias("span"))
        spans = whole.unionByName(some).groupBy(*_DOC).agg(F.collect_set("span").alias("spans"))

        @F.pandas_udf("kept binary, n_bytes long, n_removed long, n_spans long")
        def cut(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([_cut(t, s) for t, s in zip(text, spans)], columns=["kept", "n_bytes", "n_removed", "n_spans"])

        result = (dealt.join(spans, _DOC, "left")
                  .select("row", F.explode(F.array(cut(F.col("text").cast("binary"), "spans"))).alias("cut"))
                  .select(*[F.col("row")[c].alias(c) for c in others], F.col("cut.kept").alias(text_col),
                          "cut.n_bytes", "cut.n_removed", "cut.n_spans"))
        return stage(result, "suffix-dedup")


def _cut(data: bytes, spans) -> tuple[bytes, int, int, int]:
    """What is left of a text without the spans (``start << 32 | end``)."""
    if spans is None or not len(spans):
        return data, len(data), 0, 0
    packed = np.sort(np.asarray(spans, np.int64))
    start, end = packed >> 32, np.maximum.accumulate(packed & 0xFFFFFFFF)
    new = np.append(True, start[1:] > end[:-1])
    begin, stop = start[new].tolist(), end[np.append(new[1:], True)].tolist()
    left = b"".join(data[i:j] for i, j in zip([0, *stop], [*begin, len(data)]))
    return left, len(data), len(data) - len(left), len(begin)
