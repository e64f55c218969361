"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
from bisect import bisect_right
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tables import short_batches, stage

#: Vectors that fit the codebooks, centroids of a half at most, rounds of k-means.
SAMPLE, MAX_CENTROIDS, ROUNDS = 10_000, 128, 12
#: Vectors and queries that meet in one task's group.
BLOCK_VECTORS, BLOCK_QUERIES = 2_000, 4_000


class Codebooks(NamedTuple):
    first: np.ndarray
    second: np.ndarray

    def distances(self, unit: np.ndarray):
        """Squared distances of the halves to the centroids of each half."""
        half = self.first.shape[1]
        return _squares(unit[:, :half], self.first), _squares(unit[:, half:], self.second)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.distances(unit)
        return a.argmin(axis=1) * len(self.second) + b.argmin(axis=1)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :], 0)


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from distinct points of a bounded sample."""
    rng = np.random.default_rng(seed)
    points = np.unique(x, axis=0)
    c = points[np.sort(rng.choice(len(points), min(k, len(points)), replace=False))]
    for _ in range(rounds):
        near = _squares(x, c).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def unit_rows(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # no overflow of the squares
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision: equal rows give equal numbers."""
    dot = (a * b).sum(axis=1)
    return dot / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def traverse(first: np.ndarray, second: np.ndarray, counts: dict[int, int], want: int) -> float:
    """Multi-sequence traversal: pairs of centroids in the order of summed
    distance, from a heap, until their cells hold ``want`` vectors.  Returns the
    sum reached (infinite if there are not so many); the pairs visited are
    those up to it.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    da, db = first[a].tolist(), second[b].tolist()
    width, got = len(db), 0
    a, b = a.tolist(), b.tolist()
    heap = [(da[0] + db[0], 0, 0)]
    while heap:
        d, i, j = heapq.heappop(heap)
        got += counts.get(a[i] * width + b[j], 0)
        if got >= want:
            return d
        if j + 1 < width:
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
        if not j and i + 1 < len(da):  # the next row's first pair is no nearer than this one's
            heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
    return float("inf")


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, v)`` of the rows that take part: an id and a vector that is not null,
    not zero, without null or non-finite components, of any length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"),
                          F.col(vec_col).cast("array<double>").alias("v")).dropna()
    # -0.0 is 0.0 for the distinct vectors below
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (rows.filter(finite & F.exists("v", lambda x: x != 0))
            .withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))))


def fit(sample: list[list[float]], seed: int) -> Codebooks:
    """Codebooks of both halves of vectors of one length, 16 vectors a centroid."""
    unit = unit_rows(matrix(sample))
    half, centroids = unit.shape[1] // 2, max(1, min(MAX_CENTROIDS, len(sample) // 16))
    first = k_means(unit[:, :half], centroids, ROUNDS, seed) if half else np.zeros((1, 0))
    return Codebooks(first, k_means(unit[:, half:], centroids, ROUNDS, seed + 1))


def search(vectors: DataFrame, is_query, k: int = 5, fraction: float = 0.4, least: int = 2000,
           id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 7) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: of each query row the ``k`` nearest
    other rows found, by cosine, nearest first, ties to the smaller id.

    ``is_query`` is a condition on ``id``.  Codebooks of both halves of the unit
    vectors are fitted on the ``SAMPLE`` vectors with the smallest hash; every
    vector is indexed under its pair of nearest centroids.  A query visits
    pairs by summed distance until their cells hold ``fraction`` of the distinct
    vectors (``least`` at least), and what it finds is ranked by exact cosine.
    Vectors of unequal length have no cosine: each length has codebooks, cells and
    neighbours of its own; one that is too rare for the sample has one cell.
    Embeddings without structure need a large fraction for a recall of 0.9;
    README has the figures.

    Equal vectors are equally near, so only the ``k + 1`` smallest ids of each
    are candidates: exact, and a vector that is very common neither fills a cell
    nor a query's visits.  Cells are packed into blocks of bounded size (a
    larger cell takes several), queries into bounded groups, and a task holds
    one block and one group.  Rows that :func:`valid` leaves out take no part;
    repeated rows of one id are one row if their vectors agree, else the id
    counts with each.  Fewer candidates give fewer rows; an empty table none.
    """
    spark = vectors.sparkSession
    short_batches(spark, 4096)
    rows = stage(valid(vectors, id_col, vec_col).distinct(), "ann-rows")
    by_vector = Window.partitionBy("v").orderBy("id")
    kept = stage(rows.withColumn("r", F.row_number().over(by_vector)).filter(F.col("r") <= k + 1), "ann-distinct")
    lengths = sorted(r["n"] for r in kept.select(F.size("v").alias("n")).distinct().collect())
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    samples: dict[int, list] = {}
    for r in kept.filter("r = 1").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE).select("v").collect():
        samples.setdefault(len(r["v"]), []).append(r["v"])
    # the cells of all lengths are numbered in one row
    books, base, cells = {}, {}, 0
    for n in lengths:
        books[n], base[n] = fit(samples.get(n) or [[1.0] * n], seed), cells
        cells += len(books[n].first) * len(books[n].second)
    shared = spark.sparkContext.broadcast((books, base))

    def assign(batches):
        books, base = shared.value
        for pdf in batches:
            for n, some in pdf.groupby(pdf["v"].map(len)):
                yield some.assign(cell=(base[n] + books[n].cells(unit_rows(matrix(some["v"])))).astype(np.int32))

    index = stage(kept.select("id", "v").mapInPandas(assign, "id long, v array<double>, cell int"), "ann-index")
    counts = {r["cell"]: r["count"] for r in index.groupBy("cell").count().collect()}
    starts = sorted(base.values())
    length_of = {cell: bisect_right(starts, cell) for cell in counts}
    # blocks: cells of one length in order of their number, packed; a large one takes several
    first, parts, block, room, before = {}, {}, -1, 0, None
    for cell in sorted(counts):
        if length_of[cell] != before:
            before, room = length_of[cell], 0
        if counts[cell] > room:
            block, room = block + 1, BLOCK_VECTORS
            parts[cell] = -(-counts[cell] // BLOCK_VECTORS)
            first[cell] = block
            block += parts[cell] - 1
            room = room - counts[cell] if parts[cell] == 1 else 0
        else:
            first[cell], parts[cell], room = block, 1, room - counts[cell]
    where = spark.sparkContext.broadcast((counts, first, parts))
    queries = rows.filter(is_query(F.col("id")))
    groups = max(1, -(-queries.count() // BLOCK_QUERIES))
    def visit(batches):
        (counts, first, parts), (all_books, base) = where.value, shared.value
        for pdf in batches:
            for n, some in pdf.groupby(pdf["v"].map(len)):
                books = all_books[n]
                last = base[n] + len(books.first) * len(books.second)
                mine = {c - base[n]: m for c, m in counts.items() if base[n] <= c < last}
                want = max(least, int(fraction * sum(mine.values())))
                numbers = np.array(sorted(mine))
                rows_of, columns_of = np.divmod(numbers, len(books.second))
                a, b = books.distances(unit_rows(matrix(some["v"])))
                out = []
                for at, (i, v) in enumerate(zip(some["id"], some["v"])):
                    reach = traverse(a[at], b[at], mine, want)
                    visited = numbers[a[at][rows_of] + b[at][columns_of] <= reach] + base[n]
                    blocks: dict[int, list[int]] = {}
                    for cell in visited.tolist():
                        for part in range(parts[cell]):
                            blocks.setdefault(first[cell] + part, []).append(cell)
                    out += [(i, v, block, cells) for block, cells in blocks.items()]
                yield pd.DataFrame(out, columns=["id", "v", "block", "cells"])

    def place(batches):
        _, first, parts = where.value
        for pdf in batches:
            yield pdf.assign(block=[first[c] + i % parts[c] for c, i in zip(pdf["cell"], pdf["id"])])

    group = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(groups)).cast("int")
    # a number of partitions, so that few bytes are not packed into one task
    tasks = max(groups, 2 * spark.sparkContext.defaultParallelism)
    asked = (queries.repartition(tasks, "id").mapInPandas(visit, "id long, v array<double>, block int, cells array<int>")
             .withColumn("g", group))
    held = (index.mapInPandas(place, "id long, v array<double>, cell int, block int")
            .withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=columns).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        left = left.sort_values(["cell", "id"], ignore_index=True)
        x, ids, cells = matrix(left["v"]), left["id"].to_numpy(), left["cell"].to_numpy()
        unit, out = unit_rows(x), []
        for q, v, visited in zip(right["id"], right["v"], right["cells"]):
            at = np.flatnonzero(np.isin(cells, np.asarray(visited)) & (ids != q))
            if not len(at):
                continue
            v = np.asarray(v, np.float64)
            near = unit[at] @ unit_rows(v[None, :])[0]
            if len(at) > k:  # those that rounding might put among the first k
                at = at[near >= np.partition(near, len(at) - k)[len(at) - k] - 1e-9]
            score = cosine(np.broadcast_to(v, (len(at), len(v))), x[at])
            best = np.lexsort((ids[at], -score))[:k]
            out += [(q, i, s) for i, s in zip(ids[at][best], score[best])]
        return pd.DataFrame(out, columns=columns).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = held.groupBy("block", "g").cogroup(asked.groupBy("block", "g")).applyInPandas(
        rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
