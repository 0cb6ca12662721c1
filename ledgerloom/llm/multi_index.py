"""Approximate nearest neighbours by largest inner product, with an inverted multi-index (Babenko and Lempitsky, 2012).

Vectors are cut into two halves. K-means centroids are fitted for each half on a sample of at most FIT_ROWS vectors;
every vector is indexed under its pair of nearest centroids. As inner products rather than distances are sought, each
half gets one more coordinate, the root of what its squared length lacks to the largest of the fitting sample (0 if it
exceeds that); for a query that coordinate is 0, so near halves have large products.

A query visits pairs of centroids in the order of their summed distances, taken from a heap that holds one frontier
(the multi-sequence rule), until the visited cells hold SHARE of all vectors, and at least LEAST. All vectors in those
cells are ranked again by the exact inner product in double precision.

Skew: only the top + 1 least ids of equal vectors can be among the nearest, since ties go to the smaller id, so all
others leave before indexing, first within salted parts; this loses no result. Neighbouring cells are packed to blocks of at
most BLOCK vectors, and a larger cell is cut into such blocks. The queries that visit cells of a block stream past its
vectors in sorted order, so no task holds more than one block and a batch of queries, whatever visits it. Queries are dealt to
streams of some STREAM, and vectors are copied once a stream, not once a query or once a small block of queries.

Defined results: vectors that are null, empty, zero, of another length than most of the sample, or hold null or non-finite values take no part,
as rows or as queries; neither do rows with a null id; repeated ids are vectors of their own, but a query never finds its own id; each of
several query rows with one id has results of its own; a product beyond the range of doubles counts as infinite; fewer than
`top` candidates are all returned; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.llm.scratch import materialize

TOP = 20
FIT_ROWS = 8192
CENTROIDS = 128
SHARE, LEAST = 0.35, 3000
BLOCK, STREAM = 2048, 1 << 16
LARGE = 2.0**400  # products of components below it don't overflow
ROUNDS = 12
SALTS = 64


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and x (doubles) of the vectors that take part."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).filter("id is not null and x is not null and size(x) > 0")
    return rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("x", lambda v: v != 0))


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rule from distinct rows spread over the sample; reruns agree."""
    distinct = np.unique(x, axis=0)
    centers = distinct[np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int)]
    for _ in range(rounds):
        near = distances(x, centers).argmin(1)
        counts = np.bincount(near, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return centers


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)[None]


class Codebook:
    """The centroids of both halves. Its size is fixed by CENTROIDS and the vectors' length."""

    def __init__(self, sample: np.ndarray, k: int):
        self.width = sample.shape[1]
        self.half = self.width // 2
        # A power of two that brings the sample near 1, so that squares don't overflow.
        self.scale = 2.0 ** -int(np.frexp(np.abs(sample).max())[1])
        sample = sample * self.scale
        self.most = [self._long((h * h).sum(1)) for h in (sample[:, : self.half], sample[:, self.half :])]
        self.centers = [kmeans(h, k) for h in self.halves(sample)]

    @staticmethod
    def _long(squares: np.ndarray) -> float:
        """What squared length counts as full: the most, but for a few very long vectors, which would make all others alike."""
        most, bound = float(squares.max(initial=0)), 4 * float(np.quantile(squares, 0.99))
        return min(most, bound) if bound > 0 else most

    def halves(self, x: np.ndarray, query: bool = False) -> list[np.ndarray]:
        """The halves of vectors with what each lacks to the full length; longer ones are drawn in, and only to choose their cells."""
        out = []
        for part, most in zip((x[:, : self.half], x[:, self.half :]), self.most, strict=True):
            squares = (part * part).sum(1)
            if not query:
                part = part * np.sqrt(np.minimum(1, most / np.maximum(squares, 1e-300)))[:, None]
            lacks = np.zeros(len(part)) if query else np.sqrt(np.maximum(0, most - squares))
            out.append(np.concatenate([part, lacks[:, None]], 1))
        return out

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x * self.scale, -1e100, 1e100)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (distances(h, c).argmin(1) for h, c in zip(self.halves(self.scaled(x)), self.centers, strict=True))
        return a * len(self.centers[1]) + b

    def visits(self, x: np.ndarray, held: np.ndarray, enough: int) -> Iterator[list[int]]:
        """For each query, the non-empty cells in the order of summed distances, until they hold enough vectors."""
        first, second = (distances(h, c) for h, c in zip(self.halves(self.scaled(x), query=True), self.centers, strict=True))
        n = second.shape[1]
        for u, v in zip(first, second, strict=True):
            i_order, j_order = np.argsort(u, kind="stable"), np.argsort(v, kind="stable")
            us, vs = u[i_order], v[j_order]
            heap, got, out = [(us[0] + vs[0], 0, 0)], 0, []
            while heap and got < enough:
                _, i, j = heapq.heappop(heap)
                cell = int(i_order[i] * n + j_order[j])
                if held[cell]:
                    out.append(cell)
                    got += int(held[cell])
                if j + 1 < n:
                    heapq.heappush(heap, (us[i] + vs[j + 1], i, j + 1))
                if j == 0 and i + 1 < len(us):
                    heapq.heappush(heap, (us[i + 1] + vs[0], i + 1, 0))
            yield out


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The inner product of each row of q with the same row of x, always added up in one way; beyond doubles: infinite, never NaN."""
    if max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) < LARGE:
        return (q * x).sum(1)
    exponents = [np.frexp(np.abs(v).max(1))[1] for v in (q, x)]
    scaled = [np.ldexp(v, -e[:, None]) for v, e in zip((q, x), exponents, strict=True)]
    with np.errstate(over="ignore"):
        return np.ldexp((scaled[0] * scaled[1]).sum(1), exponents[0] + exponents[1])


def nearest(q: np.ndarray, x: np.ndarray, may: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) places of pairs among which are each query's top nearest of those it may meet; ties all stay."""
    # Powers of two bring queries one by one, and vectors together, near 1: the order stays, and this product may round as it likes.
    q = np.ldexp(q, -np.frexp(np.abs(q).max(1))[1][:, None])
    x = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))
    scores = np.where(may, q @ x.T, -np.inf)
    k = min(top, len(x))
    bound = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k]
    slack = 1e-12 * len(q[0])  # all products lie within len(q[0]), and are this exact
    return np.nonzero((scores >= (bound - slack)[:, None]) & may)


class Nearest:
    """The top nearest so far of each query, cut back whenever LIMIT pairs have come together."""

    LIMIT = 1 << 20

    def __init__(self, top: int):
        self.top, self.parts, self.size, self.kept = top, [], 0, 0

    def add(self, *columns: np.ndarray) -> None:
        """asked, query_id, vec_id, score."""
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size > 2 * self.kept + self.LIMIT:
            self.cut()

    def cut(self) -> None:
        asked, query, vector, score = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((vector, -score, asked))
        asked = asked[order]
        place = np.arange(len(asked))
        first = np.maximum.accumulate(np.where(np.append(True, asked[1:] != asked[:-1]), place, 0))
        order = order[place - first < self.top]
        self.parts = [tuple(c[order] for c in (np.concatenate(c) for c in zip(*self.parts, strict=True)))]
        self.size = self.kept = len(order)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            self.cut()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in self.parts[0]], ["asked", "query_id", "vec_id", "score"])
        self.parts, self.size, self.kept = [], 0, 0


def packed(held: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first block and its number of blocks. Neighbouring cells share a block as long as it holds at most `size`."""
    parts = np.maximum(1, -(-held // size))
    first, block, filled = np.zeros(len(held), np.int64), 0, 0
    for c, n in enumerate(held):
        if filled and filled + n > size:
            block, filled = block + 1, 0
        first[c] = block
        filled += n
        if parts[c] > 1:
            block, filled = block + int(parts[c]), 0
    return first, parts


def search(
    vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, centroids: int = CENTROIDS,
    share: float = SHARE, least: int = LEAST, fit_rows: int = FIT_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's nearest, by inner product, ties to the smaller id."""
    rows = usable(vectors, id_col, vector_col)
    asked = usable(queries, id_col, vector_col)
    sample = rows.orderBy(F.xxhash64("id"), "id", "x").limit(fit_rows).select("x").collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return vectors.sparkSession.createDataFrame([], schema)
    width = max(set(sizes := [len(r["x"]) for r in sample]), key=sizes.count)
    book = Codebook(np.array([r["x"] for r in sample if len(r["x"]) == width]), centroids)
    rows, asked = rows.filter(F.size("x") == width), asked.filter(F.size("x") == width)

    # Of equal vectors the least ids, and of one id's repeats no more than a query can return. Three passes, each limited before
    # its shuffle, so that no hot vector and no hot id meets in one task.
    by_vector = lambda *more: Window.partitionBy("h", *more).orderBy("id")
    hashed = rows.withColumn("h", F.struct(F.xxhash64("x"), F.hash("x"))).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    few = hashed.withColumn("n", F.row_number().over(by_vector("salt", "id"))).filter(F.col("n") <= top + 1).drop("n")
    few = few.withColumn("n", F.dense_rank().over(by_vector("salt"))).filter(F.col("n") <= top + 1).drop("n")
    few = few.withColumn("n", F.dense_rank().over(by_vector())).filter(F.col("n") <= top + 1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(book.cells(_matrix(batch.column(1), width))), batch.column(0), batch.column(1)], ["cell", "id", "x"])

    indexed = materialize(few.select("id", "x").mapInArrow(assign, "cell long, id long, x array<double>"), "index")
    n_cells = len(book.centers[0]) * len(book.centers[1])
    held = np.zeros(n_cells, np.int64)  # at most centroids**2 numbers
    for r in indexed.groupBy("cell").count().collect():
        held[r["cell"]] = r["count"]
    enough = max(least, int(share * held.sum()))
    first_block, parts = packed(held)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("block", pa.int64()), ("cells", pa.list_(pa.int32()))]))
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                some, out = batch.slice(low, 64), []
                for cells in book.visits(_matrix(some.column(2), width), held, enough):
                    by_block: dict[int, list[int]] = {}
                    for c in cells:
                        for p in range(parts[c]):
                            by_block.setdefault(int(first_block[c]) + p, []).append(c)
                    out.append([{"block": b, "cells": found} for b, found in by_block.items()])
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), pa.array(out, kind)], ["asked", "id", "x", "visits"])

    # Each query row has a number of its own, which stays as it is once it is written.
    numbered = materialize(asked.select(F.monotonically_increasing_id().alias("asked"), "id", "x"), "queries")
    streams = max(1, -(-numbered.count() // STREAM))
    visits = materialize(numbered.mapInArrow(visit, "asked long, id long, x array<double>, visits array<struct<block: long, cells: array<int>>>"), "visits")
    of_cell = lambda numbers: F.get(F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>"), F.col("cell").cast("int")).cast("long")
    in_part = F.pmod(F.xxhash64(F.lit(3), "id"), of_cell(parts))
    vectors = indexed.select(
        (of_cell(first_block) + in_part).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(streams - 1)).cast("array<long>")).alias("stream"),
        F.lit(0).cast("long").alias("kind"), F.lit(0).cast("long").alias("asked"), "id", "x", F.array(F.col("cell").cast("int")).alias("cells")
    )
    asking = visits.select(
        F.pmod(F.xxhash64("asked"), F.lit(streams)).alias("stream"), F.lit(1).cast("long").alias("kind"), "asked", "id", "x", F.inline("visits")
    ).select("block", "stream", "kind", "asked", "id", "x", "cells")
    # A stream's blocks are dealt to groups, each worked through by one task, which keeps the nearest so far of the stream's queries.
    blocks = int((first_block + parts).max())
    groups = max(min(blocks, 16), blocks // 16)
    task = (F.col("stream") * groups + F.pmod(F.col("block"), F.lit(groups))).cast("int")
    dealt = vectors.unionByName(asking).withColumn("task", task).repartitionById(streams * groups, "task").drop("task").sortWithinPartitions("stream", "block", "kind")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunks, ready, best = None, [], None, Nearest(top)
        for batch in batches:
            block, stream, kind = (batch.column(i).to_numpy() for i in range(3))
            if not len(block):
                continue
            edges = np.flatnonzero((block[1:] != block[:-1]) | (stream[1:] != stream[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *edges], [*edges, len(block)], strict=True):
                if now is None or (block[lo], stream[lo]) != now:
                    if now is not None and stream[lo] != now[1]:
                        yield from best.batches()
                    now, chunks, ready = (block[lo], stream[lo]), [], None
                some = batch.slice(lo, hi - lo)
                x, ids, cells = _matrix(some.column(5), width), some.column(4).to_numpy(), some.column(6)
                if kind[lo] == 0:
                    chunks.append((x, ids, cells.flatten().to_numpy()))
                    continue
                if not chunks:
                    continue
                ready = ready or [np.concatenate(v) for v in zip(*chunks, strict=True)]
                asked, lists = some.column(3).to_numpy(), cells.to_pylist()
                for low in range(0, len(x), 256):
                    q, q_ids = x[low : low + 256], ids[low : low + 256]
                    open_cells = np.zeros((len(q), n_cells), bool)
                    for i, one in enumerate(lists[low : low + 256]):
                        open_cells[i, one] = True
                    i, j = nearest(q, ready[0], open_cells[:, ready[2]] & (q_ids[:, None] != ready[1][None]), top)
                    best.add(asked[low + i], q_ids[i], ready[1][j], products(q[i], ready[0][j]))
        yield from best.batches()

    near = dealt.mapInArrow(rank, "asked long, query_id long, vec_id long, score double")
    by_score = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
