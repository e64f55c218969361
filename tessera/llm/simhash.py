"""SimHash near-duplicates found by multi-index hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.tables import release, short_batches, stage, utf8

BITS = 64


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``shingle`` words joined by one space;
    fewer words: of the whole sequence; none: no hash."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = end - length
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[i:j], 42) for i, j in
                     zip(start[:len(words) - k + 1].tolist(), end[k - 1:].tolist())], np.uint64)


def fold(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """Bits set in over half of the hashes (zero for none), in blocks so that
    a long text needs no more memory than a short one."""
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), block):
        part = np.ascontiguousarray(hashes[i:i + block]).view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``(id, key, fp)`` per row; ``key`` is a hash of the text, ``fp`` holds the
    unsigned fingerprint's bits as a long.  A-Z are lower-cased.  Null and
    wordless texts have fingerprint zero."""
    short_batches(docs.sparkSession)

    def run(batches):
        release()
        for batch in batches:
            fp = [fold(shingle_hashes([] if t is None else utf8(t).lower().split(), shingle))
                  for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"),
                                              pa.array(np.array(fp, np.uint64).view(np.int64))], ["id", "key", "fp"])

    return (docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"),
                        F.col(text_col).alias("text"))
            .mapInArrow(run, "id long, key long, fp long"))


def plan_segments(bits: int, distance: int, segments: int):
    """Cut ``bits`` into segments ``(shift, width, radius)`` such that two
    words within ``distance`` agree up to ``radius`` in at least one.

    General pigeonhole: radii that sum to ``distance - segments + 1`` do.
    """
    if segments > distance + 1:
        raise ValueError("at most distance + 1 segments")
    spare, out, shift = distance - segments + 1, [], 0
    for i in range(segments):
        width = bits // segments + (i >= segments - bits % segments)
        radius = spare // segments + (i < spare % segments)
        out.append((shift, width, radius))
        shift += width
    return out


def ball(width: int, radius: int) -> list[int]:
    """Masks of up to ``radius`` set bits out of ``width``."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def close_pairs(prints: DataFrame, distance: int = 4, segments: int = 3) -> DataFrame:
    """Pairs ``(u, v)``, u < v, of distinct fingerprints within ``distance`` bits.

    ``prints(fp)`` must be distinct.  Each fingerprint is entered once per
    segment under that segment's value; every fingerprint looks up its Hamming
    ball in each segment (45 keys for 64 bits, 3 segments, distance 4); table
    matches are verified over all bits inside the join.
    """
    def key(i, shift, width, mask):
        part = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        return part.bitwiseXOR(mask).bitwiseOR(F.lit(i << 32))

    plan = plan_segments(BITS, distance, segments)
    entries = prints.select(F.col("fp").alias("v"), F.explode(F.array(
        *[key(i, s, w, F.lit(0).cast("long")) for i, (s, w, _) in enumerate(plan)])).alias("k"))
    probes = prints.select(F.col("fp").alias("u"), F.explode(F.array(
        *[key(i, s, w, F.lit(m).cast("long")) for i, (s, w, r) in enumerate(plan) for m in ball(w, r)])).alias("k"))
    return (probes.join(entries.hint("merge"), "k")
            .filter((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance))
            .select("u", "v"))


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, segments: int = 3,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``(id_col, fingerprint, component_id)``.

    ``fingerprint`` is 16 hex digits; ``component_id`` is the smallest id that
    can be reached over links of at most ``distance`` differing bits.

    Exact copies share a fingerprint and are folded into it before any pair is
    looked for (map-side minimum), so a group of copies costs one node.  Rows
    with a null id take part and get the component of their text; a component
    without any id has a null ``component_id``.  Repeated rows are kept.  An
    empty table gives no rows.  Other columns are not read.
    """
    rows = stage(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    least = _labels(rows, distance, segments)
    classes = least.join(least.groupBy("label").agg(F.min("least").alias("component_id")), "label")
    return (rows.join(classes.select("fp", "component_id"), "fp")
            .select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    "component_id"))


def _labels(rows: DataFrame, distance: int, segments: int) -> DataFrame:
    """``(fp, least id, label)``: the component of each distinct fingerprint."""
    prints = rows.groupBy("fp").agg(F.min("id").alias("least"))
    links = connected_components(close_pairs(prints.select("fp"), distance, segments))
    return (prints.join(links.withColumnRenamed("node", "fp"), "fp", "left")
            .select("fp", "least", F.coalesce("label", "fp").alias("label")))


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4, segments: int = 3,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per component: that with the smallest id (rows
    without an id come last, ties go to the smaller text hash), one of
    repeated rows.  The columns are those of ``docs``.
    """
    rows = stage(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    first = (rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "key")).alias("first"))
             .join(_labels(rows, distance, segments).select("fp", "label"), "fp")
             .groupBy("label").agg(F.min("first").alias("first"))
             .select(F.col("first.no").alias("__no"), F.coalesce("first.id", F.lit(0)).alias("__id"),
                     F.col("first.key").alias("__key")))
    number = F.col(id_col).cast("long")
    keys = {"__no": number.isNull(), "__id": F.coalesce(number, F.lit(0)), "__key": F.xxhash64(text_col)}
    # both steps are on the same keys: the texts are exchanged once
    return docs.withColumns(keys).join(first, list(keys), "left_semi").dropDuplicates(list(keys)).drop(*keys)
