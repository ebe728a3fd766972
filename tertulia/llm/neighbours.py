"""Nearest neighbours through stable projections, kd-trees and a chi-square stopping test.

Vectors are projected to a few dimensions by one Gaussian matrix. For a pair at distance d,
the squared distance of the projections over d^2 follows a chi-square law, whatever the data.
Rows lie in blocks of about BLOCK vectors by a hash of the id; each block has a kd-tree over
its projections. A query takes a block's points in order of projected distance, verifies them
on the original vectors, and stops once a point as near as its k-th neighbour so far would
have come earlier with probability CONFIDENCE. The k best of all blocks are merged.

Queries meet every block, a batch of BATCH queries at a time, so nothing is limited by memory
of one task. A first pass over a bounded sample of SAMPLE vectors gives each query a k-th
distance that is never too small, so that the test can hold early in every block.

Vectors that are null, of another length than most, zero, or that hold a null or a non-finite
component take no part. Ties go to the smaller id. Rows that repeat an id are candidates each,
but never those with the query's own id; of equal query ids one is asked. Fewer candidates
than k give all of them; an empty table an empty result. Only the two columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tertulia.llm.store import written

DIMENSIONS = 16
CONFIDENCE = 0.995
ROUNDING = 1e-24  # of squared projected distances, relative to the squared norms
BLOCK, BATCH, SAMPLE, LEAF, STEP = 8192, 2048, 4096, 32, 256


def chi_square_quantile(p: float, even: int) -> float:
    """The value that a chi-square variable of an even number of degrees stays below."""
    half = even // 2

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, half):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 10.0 * even + 100
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def projection(length: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(11)).normal(size=(length, dimensions))


class Tree:
    """A kd-tree over points: leaves hold up to LEAF points, split at the median."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.order = np.arange(len(points))
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        self.spans: list[tuple[int, int]] = []
        self.children: list[int] = []
        self._add(0, len(points))

    def _add(self, a: int, b: int) -> int:
        me = len(self.spans)
        inside = self.points[self.order[a:b]]
        self.boxes.append((inside.min(axis=0), inside.max(axis=0)))
        self.spans.append((a, b))
        self.children.append(-1)
        if b - a > LEAF:
            widest = int(np.argmax(self.boxes[me][1] - self.boxes[me][0]))
            middle = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(inside[:, widest], middle)]
            self._add(a, a + middle)
            self.children[me] = self._add(a + middle, b)
        return me

    def finish(self) -> None:
        self.low = np.array([x for x, _ in self.boxes])
        self.high = np.array([x for _, x in self.boxes])

    def increasing(self, query: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, squared distances) in groups, each no nearer than the one before."""
        gap = np.maximum(np.maximum(self.low - query, query - self.high), 0)
        bound = (gap * gap).sum(axis=1).tolist()
        heap = [(bound[0], 0)]
        held_at, held = [], []
        waiting = 0
        while heap:
            _, node = heapq.heappop(heap)
            if self.children[node] >= 0:
                for child in (node + 1, self.children[node]):
                    heapq.heappush(heap, (bound[child], child))
            else:
                a, b = self.spans[node]
                at = self.order[a:b]
                away = self.points[at] - query
                held_at.append(at)
                held.append((away * away).sum(axis=1))
                waiting += b - a
            if waiting >= STEP or not heap:
                limit = heap[0][0] if heap else math.inf
                at, distance = np.concatenate(held_at), np.concatenate(held)
                ready = distance <= limit
                if ready.any():
                    order = np.argsort(distance[ready], kind="stable")
                    yield at[ready][order], distance[ready][order]
                held_at, held = [at[~ready]], [distance[~ready]]
                waiting = 0


def usable(vector: Column, length: int | None = None) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    good = fine & some if length is None else fine & some & (F.size(vector) == length)
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def matrix(column: pa.Array, length: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, length)


def best(ids: np.ndarray, distances: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, distances))[:k]


def nearest(
    vectors: DataFrame,
    wanted: Column,
    k: int = 10,
    id_column: str = "vec_id",
    vector: str = "embedding",
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """query_id, rank, vec_id and score (distance) of the k nearest found for each query.

    ``wanted`` says which rows are queries, as an expression over the id column.
    """
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    every = vectors.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(vector).cast("array<double>").alias("v"),
        wanted.alias("wanted"),
    ).where(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = every.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    length, rows = int(sizes["n"]), sizes["count"]
    every = every.where(F.size("v") == length)
    blocks = max(1, -(-rows // BLOCK))
    # a few of the blocks' sizes more than SAMPLE at most; the hash picks the same rows always
    rate = min(1 << 30, int(SAMPLE / rows * (1 << 30)) + 1)
    sample = every.where(F.pmod(F.xxhash64(F.col("id"), F.lit("sample")), F.lit(1 << 30)) < rate)
    sample = sample.select("id", "v").toArrow().combine_chunks()
    sample_ids = sample.column("id").to_numpy()
    sample_vectors = matrix(sample.column("v").combine_chunks(), length)
    shared = spark.sparkContext.broadcast((sample_ids, sample_vectors))

    def bounded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known = shared.value
        for batch in batches:
            own = batch.column(0).to_numpy()
            mine = matrix(batch.column(1), length)
            bound = np.full(len(own), np.inf)
            for i in range(len(own)):
                other = ids != own[i]
                if other.sum() >= k:
                    away = known[other] - mine[i]
                    bound[i] = np.partition((away * away).sum(axis=1), k - 1)[k - 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(bound)], names=["id", "v", "bound"]
            )

    queries = every.where("wanted").dropDuplicates(["id"]).select("id", "v")
    queries = written(queries.mapInArrow(bounded, "id long, v array<double>, bound double"), "queries")
    batches_of = max(1, -(-queries.count() // BATCH))
    asked = queries.select(
        F.lit(True).alias("ask"),
        "id",
        "v",
        "bound",
        F.pmod(F.xxhash64("id"), F.lit(batches_of)).cast("long").alias("batch"),
        F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"),
    )
    held = every.select(
        F.lit(False).alias("ask"),
        "id",
        "v",
        F.lit(0.0).alias("bound"),
        F.explode(F.expr(f"sequence(0L, {batches_of - 1}L)")).alias("batch"),
        F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("long").alias("block"),
    )
    basis = projection(length)
    quantile = chi_square_quantile(confidence, basis.shape[1])

    def search(group: pa.Table) -> pa.Table:
        ask = group.column("ask").to_numpy()
        ids = group.column("id").to_numpy()
        v = matrix(group.column("v").combine_chunks(), length)
        bounds = group.column("bound").to_numpy()[ask]
        mine, theirs, query_ids, known_ids = v[ask], v[~ask], ids[ask], ids[~ask]
        out = ([], [], [])
        if len(mine) and len(theirs):
            tree = Tree(theirs @ basis)
            tree.finish()
            projected = mine @ basis
            # two projections of one vector may differ in their last bits
            norms = (projected**2).sum(axis=1), float((tree.points**2).sum(axis=1).max())
            for q in range(len(mine)):
                found_ids, found = np.zeros(0, np.int64), np.zeros(0)
                limit, slack = bounds[q], ROUNDING * (norms[0][q] + norms[1])
                for at, near in tree.increasing(projected[q]):
                    at = at[near <= quantile * limit + slack] if np.isfinite(limit) else at
                    away = theirs[at] - mine[q]
                    other = known_ids[at] != query_ids[q]
                    found_ids = np.append(found_ids, known_ids[at][other])
                    found = np.append(found, (away * away).sum(axis=1)[other])
                    keep = best(found_ids, found, k)
                    found_ids, found = found_ids[keep], found[keep]
                    if len(found) == k:
                        limit = min(limit, found[-1])
                    if near[-1] > quantile * limit + slack:
                        break
                out[0].extend([query_ids[q]] * len(found))
                out[1].extend(found_ids.tolist())
                out[2].extend(np.sqrt(found).tolist())
        return pa.table(
            {
                "query_id": pa.array(out[0], pa.int64()),
                "vec_id": pa.array(out[1], pa.int64()),
                "score": pa.array(out[2], pa.float64()),
            }
        )

    found = asked.union(held).groupBy("batch", "block").applyInArrow(search, schema)
    # k rows of each block; the limit on the rank is applied in each task before the shuffle
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
