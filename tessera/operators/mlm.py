"""Masked-LM training data (M1-M3) as DataFrame plans.

* M1 ``examples``: token ids of each line, truncated to ``max_length``
  *including* ``[CLS]``/``[SEP]``, no padding (the tag is not stripped).
* M2 ``mask``: each non-special position is chosen with probability 0.15;
  a chosen position becomes ``[MASK]`` (80 %), a random id (10 %) or stays
  (10 %); labels are the original id where chosen, else -100.  The random
  draws are md5 hashes of ``(seed, epoch, doc_id, line_no, position, salt)``
  -- repeatable on any engine and partitioning, no driver state.
* M3 ``batches``: rows ranked by a seeded hash (a shuffled sampler), cut
  into batches of ``batch_size``, padded to the longest row of the batch.
  The rank is exact and bucketed (no single-task window): the id arrays are
  exchanged once, which gives rank and padding length; batches that
  straddle two buckets are stitched from a pass over the lengths.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.ranking import hash_key

PAD_ID, UNK_ID, CLS_ID, SEP_ID, MASK_ID = 0, 1, 2, 3, 4
IGNORE = -100


def ids_by_join(df: DataFrame, tokens: str, vocab: DataFrame, keys, unk_id: int = UNK_ID,
                max_broadcast: int = 1_000_000) -> DataFrame:
    """``keys, ids``: the ids of the token strings, joined from ``vocab(piece,
    id)``; a piece that is not in it gets ``unk_id``.  ``keys`` names a row; the ids of
    rows that share it are put together by their places.

    A vocabulary of up to ``max_broadcast`` pieces is sent to the tasks, and the only
    exchange is that of the id arrays by ``keys``; a larger one is joined token by token.
    """
    known = vocab.select("piece", F.col("id").cast("int").alias("id")).dropDuplicates(["piece"])
    table = known.limit(max_broadcast + 1).toArrow()
    if table.num_rows > max_broadcast:
        rows = df.select(*keys, F.posexplode_outer(tokens).alias("_at", "piece"))
        return (rows.join(known, "piece", "left")
                .select(*keys, F.when(F.col("_at").isNotNull(), F.struct(
                    "_at", F.coalesce("id", F.lit(unk_id)).alias("id"))).alias("_t"))
                .groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("_t")), lambda t: t["id"]).alias("ids")))
    shared = df.sparkSession.sparkContext.broadcast((table.column("piece").to_pylist(), table.column("id").to_pylist()))
    rows = df.select(*keys, _looked_up(shared, unk_id)(tokens).alias("_ids")).groupBy(*keys).agg(F.collect_list("_ids").alias("_all"))
    placed = F.flatten(F.transform("_all", lambda ids: F.transform(ids, lambda x, i: F.struct(i.alias("at"), x.alias("id")))))
    return rows.select(*keys, F.when(F.size("_all") == 1, F.col("_all")[0]).otherwise(
        F.transform(F.array_sort(placed), lambda t: t["id"])).alias("ids"))


def _looked_up(shared, unk_id: int):
    """Arrays of pieces as arrays of ids (null: none), whole batches at once."""
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(tokens: pa.Array) -> pa.Array:
        pieces, numbers = shared.value
        offsets = np.cumsum([0, *pc.fill_null(pc.list_value_length(tokens), 0).to_pylist()], dtype=np.int32)
        flat = tokens.flatten()
        at = pc.index_in(flat, pa.array(pieces, flat.type), skip_nulls=True)
        found = pc.fill_null(pc.take(pa.array(numbers, pa.int32()), at), unk_id)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found)

    return ids


def examples(df: DataFrame, ids: Column, max_length: int = 128) -> DataFrame:
    """M1: ``[CLS] ids[:max_length-2] [SEP]`` and its attention mask."""
    body = F.slice(ids, 1, max_length - 2)
    input_ids = F.concat(F.array(F.lit(CLS_ID)), body, F.array(F.lit(SEP_ID)))
    return (df.withColumn("input_ids", input_ids)
            .withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids"))))


def hash01(seed, *parts) -> Column:
    """Uniform [0, 1) from the first 32 bits of md5(seed:parts...)."""
    h = hash_key(seed, *parts)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def mask(df: DataFrame, vocab_size: int, seed: int = 42, epoch: int = 0,
         probability: float = 0.15, key_cols=("doc_id", "line_no")) -> DataFrame:
    """M2: add ``masked_ids`` and ``labels`` from ``input_ids``."""
    # what the hashes of a row begin with; the position and the salt follow
    row = F.concat_ws(":", *[F.lit(str(x)) for x in (seed, epoch)], *[F.col(c).cast("string") for c in key_cols])
    number = df.schema["input_ids"].dataType.elementType
    number = number if isinstance(number, T.LongType) else T.IntegerType()
    return (df.withColumn("_mp", _masked(vocab_size, probability, number)("input_ids", row.cast("binary")))
            .withColumn("masked_ids", F.col("_mp.m"))
            .withColumn("labels", F.col("_mp.l"))
            .drop("_mp"))


def _masked(vocab_size: int, probability: float, number: T.DataType):
    """Arrays of ids and what their rows' hashes begin with as ``(m, l)`` arrays: a
    position's first 32 bits of md5, compared as bytes, are one hash of some 40 bytes each."""
    def bound(share):
        """Digests of :func:`hash01` below ``share`` come before these bytes."""
        least = max(math.ceil(share * 4294967296.0), 0)
        return least.to_bytes(4, "big") if least <= 0xFFFFFFFF else b"\xff" * 17

    below, masked, drawn = bound(probability), bound(0.8), bound(0.9)
    kind = pa.int64() if isinstance(number, T.LongType) else pa.int32()

    @F.arrow_udf(T.StructType([T.StructField(c, T.ArrayType(number)) for c in "ml"]))
    def mask_ids(ids: pa.Array, rows: pa.Array) -> pa.Array:
        md5 = hashlib.md5
        sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
        flat = ids.flatten().cast(kind)
        here = flat.is_valid().to_numpy(zero_copy_only=False)
        old = flat.fill_null(0).to_numpy(zero_copy_only=False)
        open_ = here & ~np.isin(old, (PAD_ID, CLS_ID, SEP_ID))
        salted = [b":%d:" % i for i in range(sizes.max(initial=0))]
        first = [x + b"p" for x in salted]
        new, labels, at = old.copy(), np.full(len(old), IGNORE, old.dtype), 0
        for row, size in zip(rows.to_pylist(), sizes.tolist()):
            for i in np.flatnonzero(open_[at:at + size]).tolist():
                if md5(row + first[i]).digest() < below:
                    labels[at + i] = old[at + i]
                    value = md5(row + salted[i] + b"v").digest()
                    if value < masked:
                        new[at + i] = MASK_ID
                    elif value < drawn:
                        part = int.from_bytes(md5(row + salted[i] + b"r").digest()[:4], "big") / 4294967296.0
                        new[at + i] = math.floor(part * vocab_size)
            at += size
        none = ids.is_null() if ids.null_count else None
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=none)
             for values in (pa.array(new, kind, mask=~here), pa.array(labels, kind))], ["m", "l"])

    return mask_ids


def batches(df: DataFrame, batch_size: int = 64, seed: int = 42, epoch: int = 0,
            key_cols=("doc_id", "line_no"), by_length: bool = False) -> DataFrame:
    """M3: ``batch_id``, ``position`` and the padded arrays of each row.

    ``df`` has ``input_ids``, or ``masked_ids`` and ``labels`` from
    :func:`mask`; ids are padded with ``[PAD]``, labels with -100.  Rows are
    batched in the order of a seeded hash, ``by_length`` in that of their
    length first, so that little is padded.
    """
    ids = "masked_ids" if "masked_ids" in df.columns else "input_ids"
    h = hash_key(seed, F.lit(epoch), *[F.col(c) for c in key_cols])
    keyed = df.withColumns({"_h": h, "_n": F.size(ids)})
    keyed, first = _cells(keyed, batch_size, by_length)
    ranked = _ranked(keyed, first, key_cols, batch_size)
    # a batch that lies inside a cell has its longest row there; the few that go
    # on in the next cell (one a cell) have it from the rows' lengths alone
    lengths = _ranked(keyed.select("_cell", "_h", "_n", *key_cols), first, key_cols, batch_size)
    edges = lengths.filter((F.col("batch_id") * batch_size < F.col("_start"))
                           | ((F.col("batch_id") + 1) * batch_size > F.col("_start") + F.col("_count"))).groupBy("batch_id").agg(
        F.max("_n").alias("_edge"))
    inside = F.max("_n").over(Window.partitionBy("_cell", "batch_id"))
    out = (ranked.withColumn("_inside", inside).join(F.broadcast(edges), "batch_id", "left")
           .withColumn("position", (F.col("_rank") % batch_size).cast("int"))
           .withColumn("batch_len", F.coalesce("_edge", "_inside")))
    n_pad = F.col("batch_len") - F.size(ids)
    out = (out.withColumn("padded_ids", F.concat(ids, F.array_repeat(F.lit(PAD_ID), n_pad)))
           .withColumn("padded_mask", F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), n_pad))))
    if "labels" in df.columns:
        out = out.withColumn("padded_labels", F.concat("labels", F.array_repeat(F.lit(IGNORE), n_pad)))
    return out.drop("_h", "_rank", "_n", "_cell", "_start", "_count", "_edge", "_inside")


#: Cells that the driver counts at most (besides one for each length).
MAX_CELLS = 1 << 16


def _cells(keyed: DataFrame, batch_size: int, by_length: bool):
    """``keyed`` with its ``_cell`` and the table ``(_cell, _start, _count)``: rows in
    order are cut into cells by the first digits of the uniform hash (``by_length``:
    by length, then digits).  The digits, four at most, are so many for each length that
    a cell has tens of batches and there are ``MAX_CELLS`` cells at most; the
    lengths and the cells are counted in one light pass each, and only these counts
    reach the driver."""
    sizes = {r["n"]: r["count"] for r in keyed.groupBy((F.col("_n") if by_length else F.lit(0)).alias("n")).count().collect()}
    least = max(batch_size * 32, -(-sum(sizes.values()) // MAX_CELLS))

    def digits_of(count):
        return max((d for d in range(1, 5) if 16 ** d * least <= count), default=0)

    digits = F.lit(0)
    for d in range(1, 5):
        some = [n for n, count in sizes.items() if digits_of(count) == d]
        if some:
            digits = F.when(F.col("_n").isin(some) if by_length else F.lit(True), F.lit(d)).otherwise(digits)
    cell = F.substring("_h", F.lit(1), digits)
    if by_length:
        cell = F.concat(F.lpad(F.col("_n").cast("string"), 10, "0"), F.lit(":"), cell)
    keyed = keyed.withColumn("_cell", cell)
    starts, at = [], 0
    for cell, count in sorted(tuple(r) for r in keyed.groupBy("_cell").count().collect()):
        starts.append((cell, at, count))
        at += count
    return keyed, keyed.sparkSession.createDataFrame(starts, "_cell string, _start bigint, _count bigint")


def _ranked(keyed: DataFrame, first: DataFrame, key_cols, batch_size: int) -> DataFrame:
    """Global rank and batch of each row: numbered inside its cell."""
    w = Window.partitionBy("_cell").orderBy("_h", *key_cols)
    return (keyed.join(F.broadcast(first), "_cell").withColumn("_rank", F.col("_start") + F.row_number().over(w) - 1)
            .withColumn("batch_id", F.expr(f"_rank div {batch_size}")))
