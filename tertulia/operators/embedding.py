"""Neighbourhood embedding: a map in two dimensions that keeps near rows near.

Rows attract each other along the edges of their exact nearest-neighbour graph and repel all
others. The repulsion is estimated from a sample of SAMPLE positions, drawn anew for each epoch,
which is all of it while there are no more rows than that. An epoch is therefore linear in the
edges and the rows, and what is sent to every task does not grow.

Rows are dealt to cells of space, borders of a tree of medians. For the graph a task holds the
rows of one cell and lets the tiles of all others stream past; a tile is compared only with the
rows whose neighbours so far reach into the ball around it. In an epoch a task holds the
positions of its cell and of the rows its edges lead to, pulls both ends of each edge, and sends
what it found to the cells of the other ends; the edges stay where they are.
"""

from __future__ import annotations

import gc
import math

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from tertulia.operators.classify import project_2d
from tertulia.session import remove_path, shared_folder
from tertulia.sources.corpus import materialise

SAMPLE = 2048
BLOCK_ROWS, TILE = 65_536, 128  # most rows of a cell, rows of a tile
GROUPS, LEAST_ROWS = 12, 8192  # cells of nearest_rows while they are small, and rows of one then
SPLIT_ROWS = 16_384  # rows that the borders of cells are taken from
STREAM_ROWS, AROUND = 8192, 1024  # rows seen at once, rows on both sides of a tile that bound its search first
PUSHED = 32  # rows that are pushed at a time: what is found for them stays in the cache
EDGE_ROWS, PAIRS = 4096, 1 << 16  # rows of a record of edges, pairs of rows held at once
KEPT_EPOCHS = 5  # epochs after which the positions are stored, and what made them is let go
EXAGGERATION, EXAGGERATED = 12.0, 0.25  # factor on the attraction, share of the epochs with it
START = 1e-2  # deviation of the first positions


def nearest_rows(rows: DataFrame, k: int, count: int) -> DataFrame:
    """id, others, distances: the ``k`` nearest other rows (ties to the smaller id), ascending.

    ``rows`` has id (long) and vector; ``count`` is their number. An id that rows share has the
    nearest of what all of them found.
    """
    tiles, sizes = in_cells(rows, k, count)

    def lists(own, others):
        for batch in _found(own, others, k).rows():
            sizes = batch.column(2).value_lengths()
            yield tuple(bytearray(x.to_numpy().tobytes()) for x in (batch.column(0), sizes, batch.column(1).flatten(), batch.column(2).flatten()))

    def unpacked(batches):
        for batch in batches:
            for r in batch.to_pylist():
                cuts = pa.array(np.concatenate([[0], np.cumsum(np.frombuffer(r["sizes"], np.int32))]), pa.int32())
                values = pa.array(np.frombuffer(r["others"], np.int64)), pa.array(np.frombuffer(r["distances"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(r["id"], np.int64)), *(pa.ListArray.from_arrays(cuts, v) for v in values)],
                    names=["id", "others", "distances"],
                )

    found = rows.sparkSession.createDataFrame(
        _past_cells(tiles, sizes, lists), "id binary, sizes binary, others binary, distances binary"
    ).mapInArrow(unpacked, "id long, others array<long>, distances array<double>")
    listed = F.flatten(F.collect_list(F.arrays_zip(F.col("distances"), F.col("others"))))
    near = found.groupBy("id").agg(F.slice(F.sort_array(listed), 1, k).alias("_near"))
    return near.select("id", F.col("_near.others").alias("others"), F.col("_near.distances").alias("distances"))


def in_cells(rows: DataFrame, k: int, count: int) -> tuple[DataFrame, list[int]]:
    """The rows in stored tiles (cell, at, seen, ids, vectors), and the rows of each cell.

    ``at`` is the place of a tile's first row in its cell. Of equal vectors none but the k + 1
    smallest ids can be among the nearest of any row: only those are ``seen``; the others
    are dealt to all cells alike, so copies of one vector do not meet in one.
    """
    cells = max(1, -(-count // BLOCK_ROWS), min(GROUPS, -(-count // min(BLOCK_ROWS, LEAST_ROWS))))
    vector = F.col("vector").cast("array<double>")
    order = F.xxhash64("id")
    sample = rows.select("id", vector.alias("vector")).orderBy(order, "id").limit(SPLIT_ROWS).select("vector").toArrow()
    tree = _borders(_matrix(sample.column(0).combine_chunks()), cells)
    copies = F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))
    flagged = rows.select("id", vector.alias("vector")).withColumn("seen", copies <= k + 1)

    def placed(batches):
        for batch in batches:
            if batch.num_rows:
                vectors, ids = _matrix(batch.column(1)), _ids(batch.column(0))
                seen = batch.column(2).to_numpy(zero_copy_only=False).astype(bool) & np.isfinite(vectors).all(axis=1)
                spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                cell = np.where(seen, _cell_of(tree, vectors), (spread % np.uint64(cells)).astype(np.int64))
                flags = [pa.array(seen), pa.array(cell.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column(1), *flags], names=["id", "vector", "seen", "cell"])

    def tiled(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        ids = np.concatenate([b.column(0).to_numpy() for b in batches])
        vectors = np.concatenate([_matrix(b.column(1)) for b in batches])
        seen = np.concatenate([b.column(2).to_numpy(zero_copy_only=False).astype(bool) for b in batches])
        cell = np.concatenate([b.column(3).to_numpy() for b in batches])
        for number in np.unique(cell).tolist():
            at = 0
            for flag in (True, False):
                mine = np.flatnonzero((cell == number) & (seen == flag))
                mine = mine[np.lexsort((ids[mine],))]
                for part in _leaves(vectors[mine]) if flag else np.split(np.arange(len(mine)), range(TILE, len(mine), TILE)):
                    part = mine[part]
                    if len(part):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([number], pa.int32()), pa.array([at]), pa.array([flag])]
                            + [pa.array([x[part].tobytes()], pa.binary()) for x in (ids, vectors)],
                            names=["cell", "at", "seen", "ids", "vectors"],
                        )
                    at += len(part)

    dealt = flagged.mapInArrow(placed, "id long, vector array<double>, seen boolean, cell int")
    dealt = dealt.repartitionById(cells, F.col("cell"))
    tiles = materialise(dealt.mapInArrow(tiled, "cell int, at long, seen boolean, ids binary, vectors binary"), "map-cells")
    sizes = dict(tiles.groupBy("cell").agg(F.sum(F.octet_length("ids") / 8).cast("long")).collect())
    return tiles, [sizes.get(cell, 0) for cell in range(cells)]


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def _ids(column: pa.Array) -> np.ndarray:
    """A null is the least number."""
    return column.fill_null(np.iinfo(np.int64).min).to_numpy()


def _borders(vectors: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """Nodes (dimension, border, left, right) of a tree; ~c in place of a node is cell c."""
    vectors = np.unique(vectors[np.isfinite(vectors).all(axis=1)], axis=0) if len(vectors) else vectors
    nodes: list = []

    def grow(some: np.ndarray, first: int, number: int) -> int:
        if number == 1 or len(some) < 2:
            return ~first
        widest = int(some.var(axis=0).argmax())
        values = np.sort(some[:, widest])
        cut = values[len(some) * (number // 2) // number]  # rows with one value stay together
        ends = [e for e in (np.searchsorted(values, cut), np.searchsorted(values, cut, side="right")) if 0 < e < len(some)]
        if not ends:
            return ~first
        end = int(min(ends, key=lambda e: abs(e / len(some) - (number // 2) / number)))
        left = min(number - 1, max(1, round(number * end / len(some))))
        nodes.append(None)
        here, border = len(nodes) - 1, float(values[end])
        low = some[:, widest] < border
        nodes[here] = (widest, border, grow(some[low], first, left), grow(some[~low], first + left, number - left))
        return here

    return nodes if grow(vectors, 0, cells) >= 0 else []


def _cell_of(tree: list[tuple[int, float, int, int]], vectors: np.ndarray) -> np.ndarray:
    out, waiting = np.zeros(len(vectors), dtype=np.int64), [(0 if tree else ~0, np.arange(len(vectors)))]
    while waiting:
        node, some = waiting.pop()
        if node < 0:
            out[some] = ~node
        elif len(some):
            widest, border, left, right = tree[node]
            low = vectors[some, widest] < border
            waiting += [(left, some[low]), (right, some[~low])]
    return out


def _leaves(vectors: np.ndarray) -> list[np.ndarray]:
    """Rows that lie together, TILE at most, neighbouring leaves one after the other."""
    out, waiting = [], [np.arange(len(vectors))]
    while waiting:
        some = waiting.pop()
        if len(some) <= TILE:
            out.append(some)
            continue
        here = vectors[some]
        half = -(-len(some) // TILE) // 2 * TILE
        order = np.argpartition(here[:, here.var(axis=0).argmax()], half)
        waiting += [some[order[half:]], some[order[:half]]]
    return out


def _past_cells(tiles: DataFrame, sizes: list[int], work) -> RDD:
    """``work(own, others)`` in a task for each cell, with its own tiles and an iterator over the
    seen ones of all others. Nothing is shuffled."""

    def part(cell: int) -> RDD:
        size = sizes[cell]

        def run(records):
            own, early, known = [], [], 0
            records = iter(records)
            for tile in records:
                if tile["cell"] != cell:
                    early.append(tile)  # none, unless the files come in another order
                    continue
                own.append(tile)
                known += len(tile["ids"]) // 8
                if known == size:
                    break

            def others():
                yield from early
                yield from records

            return work(own, others())

        mine = tiles.where(F.col("cell") == cell)
        rest = tiles.where((F.col("cell") != cell) & F.col("seen"))
        return mine.union(rest).coalesce(1).rdd.mapPartitions(run)

    context = tiles.sparkSession.sparkContext
    parts = [part(cell) for cell, size in enumerate(sizes) if size]
    return context.union(parts) if parts else context.parallelize([], 1)


def _unpacked(tiles: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, vectors, places and seen of the rows of tiles."""
    ids = np.frombuffer(b"".join(t["ids"] for t in tiles), dtype=np.int64)
    vectors = np.frombuffer(b"".join(t["vectors"] for t in tiles)).reshape(len(ids), -1)
    sizes = [len(t["ids"]) // 8 for t in tiles]
    places = np.concatenate([_place(t["cell"], t["at"]) + np.arange(n) for t, n in zip(tiles, sizes, strict=True)])
    return ids, vectors, places, np.repeat([t["seen"] for t in tiles], sizes)


def _place(cell: int, at: int) -> np.int64:
    return np.int64(cell << 32 | at)


def _found(own: list[dict], others, k: int) -> _Nearest:
    ids, vectors, places, seen = _unpacked(sorted(own, key=lambda t: t["at"]))
    found = _Nearest([(ids, vectors, seen)], k, places)
    waiting, rows = [], 0
    for tile in others:
        waiting.append(tile)
        rows += len(tile["ids"]) // 8
        if rows >= STREAM_ROWS:
            found.see(*_unpacked(waiting)[:3])
            waiting, rows = [], 0
    if waiting:
        found.see(*_unpacked(waiting)[:3])
    return found


class _Nearest:
    """The ``k`` nearest rows seen so far of each row of a group; ``own`` are seen first.

    A row that is not seen has more than k copies, or no finite vector."""

    def __init__(self, own: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, places: np.ndarray | None = None):
        self.k = k
        nothing = [(np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0, bool))]
        self.ids, self.vectors, seen = map(np.concatenate, zip(*(own or nothing), strict=True))
        n = len(self.ids)
        finite = np.isfinite(self.vectors).all(axis=1)
        self.middle = self.vectors[finite].mean(axis=0) if finite.any() else 0.0
        self.centred = self.vectors - self.middle
        self.squares = np.einsum("ij,ij->i", self.centred, self.centred)
        self.top = float(self.squares[finite].max(initial=0.0))
        # squared distances, ids and places, by the first two ascending; infinite where fewer are known
        self.far = np.full((n, k), np.inf)
        self.others = np.full((n, k), np.iinfo(np.int64).max)
        self.places = np.full((n, k), -1)
        self.bound = np.where(seen, np.inf, 0.0)  # no neighbour is farther, squared
        first = np.flatnonzero(seen)
        for at in range(0, len(first), TILE):
            self._bounded(first[at : at + TILE], first[max(0, at - AROUND) : at + TILE + AROUND])
        self.see(self.ids[seen], self.vectors[seen], None if places is None else places[seen])

    def _bounded(self, rows: np.ndarray, near: np.ndarray) -> None:
        """The bound of ``rows`` that ``near`` gives: the k-th of its rows with another id."""
        kth = self.k + int(np.unique(self.ids[near], return_counts=True)[1].max()) - 1
        if kth < len(near):
            a, b = self.squares[rows], self.squares[near]
            d = a[:, None] + b - 2 * self.centred[rows] @ self.centred[near].T
            slack = 8 * (self.vectors.shape[1] + 3) * np.finfo(np.float64).eps * (a + b.max())
            self.bound[rows] = np.minimum(self.bound[rows], np.maximum(np.partition(d, kth, axis=1)[:, kth], 0) + slack)

    def see(self, ids: np.ndarray, vectors: np.ndarray, places: np.ndarray | None = None) -> None:
        places = np.full(len(ids), -1) if places is None else places
        for at in range(0, len(ids), STREAM_ROWS):
            there = slice(at, at + STREAM_ROWS)
            self._see(ids[there], vectors[there], places[there])

    def _see(self, ids: np.ndarray, vectors: np.ndarray, places: np.ndarray) -> None:
        """Tile by tile. In single precision |a|^2 + |b|^2 - 2ab, less what rounding can add, says
        which pairs may be near enough; those are measured directly."""
        if not len(self.ids) or not len(ids):
            return
        there = vectors - self.middle
        squares = np.einsum("ij,ij->i", there, there)
        top = max(self.top, float(squares.max()))
        kind = np.float32 if 1e-20 < top < 1e30 else np.float64
        error = 4 * (vectors.shape[1] + 5) * np.finfo(kind).eps
        open_ = np.isinf(self.bound)
        bound = np.where(open_, 0.0, self.bound)
        reach = np.sqrt(bound)
        starts = np.arange(0, len(ids), TILE)
        sizes = np.diff(np.append(starts, len(ids)))
        centres = np.add.reduceat(there, starts) / sizes[:, None]
        gap = there - np.repeat(centres, sizes, axis=0)
        radius = np.sqrt(np.maximum.reduceat(np.einsum("ij,ij->i", gap, gap), starts)) * (1 + 1e-9)
        # the row reaches into the tile's ball: |a - c| <= reach + radius, both sides squared
        ones = np.ones((len(self.ids), 1))
        left = np.concatenate([-2 * self.centred, (self.squares - bound)[:, None], reach[:, None], ones], axis=1).astype(kind)
        ball = np.concatenate(
            [centres, np.ones((len(starts), 1)), -2 * radius[:, None],
             (np.einsum("ij,ij->i", centres, centres) - radius * radius)[:, None]], axis=1
        ).astype(kind)
        slack = error * (4 * top + float(bound[np.isfinite(self.squares)].max(initial=0.0)) + float(radius.max()) ** 2)
        with np.errstate(invalid="ignore"):
            reached = ball @ left.T <= kind(slack)
        reached[:, open_] = True
        right = np.concatenate([there, np.ones((len(ids), 1)), squares[:, None]], axis=1).T.astype(kind)
        mine = np.concatenate([-2 * self.centred, self.squares[:, None], ones], axis=1).astype(kind)
        limit = np.where(open_, np.inf, bound + error * (4 * top + bound)).astype(kind)
        found, held = [], 0
        for number, start in enumerate(starts.tolist()):
            near = np.flatnonzero(reached[number])
            tile = np.ascontiguousarray(right[:, start : start + TILE])
            step = max(1, 4 * PAIRS // tile.shape[1])
            for at in range(0, len(near), step):
                some = near[at : at + step]
                with np.errstate(invalid="ignore"):
                    hits = np.flatnonzero((mine[some] @ tile <= limit[some, None]).ravel())
                if len(hits):
                    found.append((some[hits // tile.shape[1]], start + hits % tile.shape[1]))
                    held += len(hits)
                if held > 16 * PAIRS:
                    self._add(found, ids, vectors, places)
                    found, held = [], 0
        if found:
            self._add(found, ids, vectors, places)

    def _add(self, found: list, ids: np.ndarray, vectors: np.ndarray, places: np.ndarray) -> None:
        row, col = (np.concatenate(x) for x in zip(*found, strict=True))
        other = self.ids[row] != ids[col]
        row, col = row[other], col[other]
        exact = np.empty(len(row))
        for at in range(0, len(row), PAIRS):
            gap = self.vectors[row[at : at + PAIRS]] - vectors[col[at : at + PAIRS]]
            exact[at : at + PAIRS] = np.einsum("ij,ij->i", gap, gap)
        limit = np.minimum(self.bound, self.far[:, -1])
        keep = np.flatnonzero((exact <= limit[row]) & np.isfinite(exact))
        keep = keep[np.argsort(row[keep], kind="stable")]
        row, col, exact = row[keep], col[keep], exact[keep]
        changed, starts, counts = np.unique(row, return_index=True, return_counts=True)
        at = 0
        while at < len(changed):
            wide = self.k + np.maximum.accumulate(counts[at : at + 4096])
            here = slice(at, at + max(1, int((wide * np.arange(1, len(wide) + 1) <= 8 * PAIRS).sum())))
            at = here.stop
            pairs = slice(starts[here][0], starts[here][-1] + counts[here][-1])
            self._merged(changed[here], counts[here], exact[pairs], ids[col[pairs]], places[col[pairs]])

    def _merged(self, changed: np.ndarray, counts: np.ndarray, exact: np.ndarray, ids: np.ndarray, places: np.ndarray) -> None:
        k, n = self.k, len(changed)
        slot = k + np.arange(len(exact)) - np.repeat(np.cumsum(counts) - counts, counts)
        line = np.repeat(np.arange(n), counts)
        far = np.full((n, k + counts.max()), np.inf)
        others, where = np.full(far.shape, np.iinfo(np.int64).max), np.full(far.shape, -1)
        far[:, :k], others[:, :k], where[:, :k] = self.far[changed], self.others[changed], self.places[changed]
        far[line, slot], others[line, slot], where[line, slot] = exact, ids, places
        order = np.argsort(far, axis=1, kind="stable")[:, : k + 1]
        ahead = np.take_along_axis(far, order, axis=1)
        # ties go to the smaller id
        tied = np.flatnonzero(((ahead[:, 1:] == ahead[:, :-1]) & np.isfinite(ahead[:, 1:])).any(axis=1))
        if len(tied):
            by = np.argsort(others[tied], axis=1, kind="stable")
            by = np.take_along_axis(by, np.argsort(np.take_along_axis(far[tied], by, axis=1), axis=1, kind="stable"), axis=1)
            order[tied] = by[:, : k + 1]
        order = order[:, :k]
        self.far[changed] = np.take_along_axis(far, order, axis=1)
        self.others[changed] = np.take_along_axis(others, order, axis=1)
        self.places[changed] = np.take_along_axis(where, order, axis=1)
        self.bound[changed] = np.minimum(self.bound[changed], self.far[changed, -1])

    def rows(self):
        for first in range(0, len(self.ids), STREAM_ROWS):
            here = slice(first, first + STREAM_ROWS)
            there_is = np.isfinite(self.far[here])
            sizes = there_is.sum(axis=1)
            some = sizes > 0
            cuts = pa.array(np.concatenate([[0], np.cumsum(sizes[some])]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(self.ids[here][some]),
                    pa.ListArray.from_arrays(cuts, pa.array(self.others[here][there_is])),
                    pa.ListArray.from_arrays(cuts, pa.array(np.sqrt(self.far[here][there_is]))),
                ],
                names=["id", "others", "distances"],
            )


def bandwidths(distances: np.ndarray, perplexity: float, steps: int = 64) -> np.ndarray:
    """Rows of probabilities over neighbours, at the bandwidth whose entropy is log(perplexity).

    ``distances`` is padded with infinity. The bandwidth of each row is found by halving; a
    row whose neighbours cannot reach the perplexity gets equal shares.
    """
    squared = distances**2
    there = np.isfinite(squared)
    shifted = np.where(there, squared - squared[:, :1], 0.0)
    low, high = np.zeros(len(squared)), np.full(len(squared), np.inf)
    beta = 1 / np.maximum(shifted.sum(axis=1) / np.maximum(there.sum(axis=1), 1), 1e-300)
    beta = np.minimum(beta, 1e300)
    wanted = math.log(perplexity)
    for _ in range(steps):
        with np.errstate(over="ignore", invalid="ignore"):
            e = np.where(there, np.exp(-beta[:, None] * shifted), 0.0)
            total = e.sum(axis=1)
            entropy = np.log(total) + beta * (e * shifted).sum(axis=1) / total
        flat = entropy > wanted  # too even: the bandwidth has to shrink
        low, high = np.where(flat, beta, low), np.where(flat, high, beta)
        beta = np.where(np.isinf(high), np.minimum(beta * 2, 1e300), (low + high) / 2)
    e = np.where(there, np.exp(-np.minimum(beta[:, None] * shifted, 700.0)), 0.0)
    return e / e.sum(axis=1, keepdims=True)


def affinities(neighbours: DataFrame, perplexity: float, count: int) -> DataFrame:
    """i, j, p in both directions: the symmetric shares of the pairs, which sum to one."""

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, STREAM_ROWS):
                part = batch.slice(at, STREAM_ROWS)
                others, distances = part.column(1), part.column(2)
                sizes = distances.value_lengths().to_numpy(zero_copy_only=False)
                there = np.arange(sizes.max(initial=0)) < sizes[:, None]
                padded = np.full(there.shape, np.inf)
                padded[there] = distances.flatten().to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(part.column(0).to_numpy(), sizes)),
                        others.flatten(),
                        pa.array(bandwidths(padded, perplexity)[there]),
                    ],
                    names=["i", "j", "p"],
                )

    directed = neighbours.select("id", "others", "distances").mapInArrow(work, "i long, j long, p double")
    share = (F.col("p") / F.lit(2.0 * count)).alias("p")
    both = directed.select("i", "j", share).unionByName(
        directed.select(F.col("j").alias("i"), F.col("i").alias("j"), share)
    )
    # dealt by i alone, so that an epoch's sums by i are all but done where the edges are read
    return both.repartition("i").groupBy("i", "j").agg(F.sum("p").alias("p"))


def attraction(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """id, ax, ay: the sum over a row's edges of p / (1 + d^2) times the way to the other end."""
    here = positions.select(F.col("id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"))
    there = positions.select(F.col("id").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"))
    dx, dy = F.col("xi") - F.col("xj"), F.col("yi") - F.col("yj")
    pull = F.col("p") / (1 + dx * dx + dy * dy)
    met = edges.join(here, "i").join(there, "j")
    return met.groupBy(F.col("i").alias("id")).agg(
        F.sum(pull * dx).alias("ax"), F.sum(pull * dy).alias("ay")
    )


def normaliser(sample: np.ndarray, count: int) -> float:
    """The sum of 1 / (1 + d^2) over all ordered pairs of ``count`` rows, estimated from a sample."""
    n, total = len(sample), 0.0
    for at in range(0, n, PUSHED):
        part = sample[at : at + PUSHED]
        d = (part[:, None, 0] - sample[None, :, 0]) ** 2 + (part[:, None, 1] - sample[None, :, 1]) ** 2
        total += float((1 / (1 + d)).sum())
    return (total - n) * count * (count - 1) / max(1, n * (n - 1))


def repulsion(
    x: np.ndarray, y: np.ndarray, ids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, count: int, total: float | None = None
):
    """Estimated sums over all other rows of 1 / (1 + d^2)^2 times the way, over the sum of
    1 / (1 + d^2) of all pairs, ``total``, which is estimated from the sample too."""
    n = len(sample)
    total = normaliser(sample, count) if total is None else total
    fx, fy = np.zeros(len(x)), np.zeros(len(x))
    by = np.argsort(sample_ids, kind="stable")
    first, last = (np.searchsorted(sample_ids[by], ids, side=side) for side in ("left", "right"))
    middle = sample.mean(axis=0) if n else np.zeros(2)
    places = sample - middle
    ends = np.concatenate([-2 * places.T, np.ones((1, n)), 1 + (places**2).sum(axis=1)[None]])
    sums = np.concatenate([np.ones((n, 1)), places], axis=1)
    for at in range(0, len(x), PUSHED):
        part = slice(at, at + PUSHED)
        here = np.stack([x[part], y[part]], axis=1) - middle
        # 1 + |a|^2 + |b|^2 - 2ab
        near = np.concatenate([here, (here**2).sum(axis=1)[:, None], np.ones((len(here), 1))], axis=1) @ ends
        np.maximum(near, 1, out=near)
        near *= near
        np.divide(1, near, out=near)
        for row in np.flatnonzero(last[part] > first[part]).tolist():
            near[row, by[first[at + row] : last[at + row]]] = 0
        found = near @ sums
        scale = (count - 1) / np.maximum(1, n - (last[part] - first[part])) / max(total, 1e-300)
        fx[part] = scale * (here[:, 0] * found[:, 0] - found[:, 1])
        fy[part] = scale * (here[:, 1] * found[:, 0] - found[:, 2])
    return fx, fy


def moved(state: dict[str, np.ndarray], pull: np.ndarray, push: np.ndarray, rate: float, momentum: float, factor: float):
    """One step of gradient descent with momentum and a gain for each coordinate."""
    out = {}
    for k, axis in enumerate("xy"):
        gradient = 4 * (factor * pull[k] - push[k])
        speed, gain = state["v" + axis], state["g" + axis]
        gain = np.maximum(np.where(gradient * speed < 0, gain + 0.2, gain * 0.8), 0.01)
        speed = momentum * speed - rate * gain * gradient
        out[axis], out["v" + axis], out["g" + axis] = state[axis] + speed, speed, gain
    return out


STATE = ("x", "y", "vx", "vy", "gx", "gy")


def schedule(epoch: int, epochs: int, count: int) -> tuple[float, float, float]:
    """Rate, momentum and exaggeration of an epoch."""
    early = epoch < EXAGGERATED * epochs
    return max(count / EXAGGERATION, 50.0), 0.5 if early else 0.8, EXAGGERATION if early else 1.0


def neighbourhood_map(
    df: DataFrame, id: str, vector: str, perplexity: float = 30.0, epochs: int = 100
) -> DataFrame:
    """id, x, y of every row with a vector. The id is a unique long; null vectors have no place.

    The first positions are the two principal components, so the map does not depend on a seed,
    only the draws of the repulsion on the ids. A single row lies at the origin.
    """
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"))
    rows = materialise(rows.where(F.col("vector").isNotNull()), "map-rows")
    count = rows.count()
    if count < 3:  # nothing to lay out: a line
        place = F.row_number().over(Window.orderBy("id")) - 1  # two rows at most
        return rows.select("id", place.cast("double").alias("x"), F.lit(0.0).alias("y"))
    perplexity = max(1.0, min(perplexity, (count - 1) / 3))
    k = min(count - 1, int(3 * perplexity))
    known = rows.agg(F.count("id"), F.count_distinct("id")).first()
    if tuple(known) == (count, count):
        return _map_in_cells(rows, k, perplexity, epochs, count)
    # rows that share an id share its edges: they are found by the id
    edges = materialise(affinities(nearest_rows(rows, k, count), perplexity, count), "map-edges")
    first = _first_positions(project_2d(rows, "vector").select("id", "x", "y"))
    state = first.select("*", *(F.lit(v).alias(c) for c, v in zip(STATE[2:], (0.0, 0.0, 1.0, 1.0), strict=True)))
    state = materialise(state, "map-start")
    for epoch in range(epochs):
        state = materialise(_epoch(state, edges, epoch, count, *schedule(epoch, epochs, count)), "map-epoch")
    return state.select("id", "x", "y")


def _first_positions(first: DataFrame) -> DataFrame:
    spread = first.agg(F.avg("x"), F.avg("y"), F.stddev_pop("x")).first()
    scale = START / (spread[2] or 1.0)
    return first.withColumns({"x": (F.col("x") - spread[0]) * scale, "y": (F.col("y") - spread[1]) * scale})


def _map_in_cells(rows: DataFrame, k: int, perplexity: float, epochs: int, count: int) -> DataFrame:
    """The map of rows whose ids are unique. Records of a cell meet in one task; of an epoch only
    positions and pulls at the ends of edges that leave a cell are shuffled."""
    spark, context = rows.sparkSession, rows.sparkSession.sparkContext
    tiles, sizes = in_cells(rows, k, count)
    cells = len(sizes)
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(spark))
    edges = _edges_of_cells(tiles, sizes, k, perplexity, count).partitionBy(cells, _owner)
    routes = edges.mapPartitions(_routes).partitionBy(cells, _owner)
    start = materialise(_first_in_cells(tiles), "map-start")
    state = start.rdd.map(lambda r: (r[0], ("start", *map(bytes, r[1:])))).partitionBy(cells, _owner)
    state = state.mapPartitions(_started, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
    sample, stored = _drawn(state, 0, count), None
    for epoch in range(epochs):
        sent = context.union([state, routes]).mapPartitions(_sent).partitionBy(cells, _owner)
        pulled = context.union([state, sent, edges]).mapPartitions(_pulled).partitionBy(cells, _owner)
        move = _mover(*sample, count, *schedule(epoch, epochs, count))
        new = context.union([state, routes, pulled]).mapPartitions(move, preservesPartitioning=True)
        new.persist(StorageLevel.MEMORY_AND_DISK)
        keep = epoch % KEPT_EPOCHS == KEPT_EPOCHS - 1 or epoch == epochs - 1
        if keep:
            new.checkpoint()
        sample = _drawn(new, epoch + 1, count)
        state.unpersist()
        state = new
        if keep:
            old, stored = stored, new.getCheckpointFile()
            state = RDD(new._jrdd, context, new._jrdd_deserializer)  # without the way to it
            del sent, pulled, new
            gc.collect()
            spark._jvm.System.gc()  # what is shuffled goes with what refers to it
            if old:
                remove_path(spark, old)
    found = spark.createDataFrame(
        state.map(lambda r: tuple(bytearray(r[1][1][c].tobytes()) for c in ("id", "x", "y"))), "ids binary, xs binary, ys binary"
    )

    def unpacked(batches):
        for batch in batches:
            for record in batch.to_pylist():
                columns = [np.frombuffer(record["ids"], np.int64), *(np.frombuffer(record[c]) for c in ("xs", "ys"))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "x", "y"])

    places = materialise(found.mapInArrow(unpacked, "id long, x double, y double"), "map-places")
    state.unpersist()
    if stored:
        remove_path(spark, stored)
    return places


def _owner(cell: int) -> int:
    return cell


def _edges_of_cells(tiles: DataFrame, sizes: list[int], k: int, perplexity: float, count: int) -> RDD:
    """By cell: first, links, shares. First of a cell come, at -1, the places outside it that its edges
    lead to, ascending; then for each stretch of rows the numbers of their ``k`` neighbours, first
    those of the cell, then those places, and the shares p / 2n of the directed pairs."""

    def work(own, others):
        cell, found = own[0]["cell"], _found(own, others, k)
        n = len(found.ids)
        there = np.isfinite(found.far)
        inside = found.places >> 32 == cell
        outside = np.unique(found.places[there & ~inside])
        links = np.where(inside, found.places & 0xFFFFFFFF, n + np.searchsorted(outside, found.places))
        links = np.where(there, links, 0).astype(np.int32)
        yield cell, ("edges", -1, outside.tobytes(), b"")
        for first in range(0, n, EDGE_ROWS):
            shares = np.zeros((min(EDGE_ROWS, n - first), k))
            for at in range(0, len(shares), 256):
                some = np.flatnonzero(there[first + at : min(first + at + 256, first + len(shares)), 0])
                if len(some):
                    shares[at + some] = bandwidths(np.sqrt(found.far[first + at + some]), perplexity) / (2.0 * count)
            yield cell, ("edges", first, links[first : first + EDGE_ROWS].tobytes(), shares.tobytes())

    return _past_cells(tiles, sizes, work)


def _first_in_cells(tiles: DataFrame) -> DataFrame:
    """cell, at, id, x, y: the first positions, packed."""

    def rows(batches):
        for batch in batches:
            for t in batch.to_pylist():
                ids, vectors, places, _ = _unpacked([t])
                flat = pa.array(vectors.ravel())
                cuts = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * vectors.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.ListArray.from_arrays(cuts, flat), pa.array(places)], names=["id", "vector", "place"]
                )

    def packed(batches):
        for batch in batches:
            place, ids, x, y = (batch.column(i).to_numpy() for i in range(4))
            for cell in np.unique(place >> 32).tolist():
                mine = place >> 32 == cell
                columns = [pa.array([c[mine].tobytes()], pa.binary()) for c in (place & 0xFFFFFFFF, ids, x, y)]
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), *columns], names=["cell", "at", "id", "x", "y"])

    flat = tiles.mapInArrow(rows, "id long, vector array<double>, place long")
    first = _first_positions(project_2d(flat, "vector").select("place", "id", "x", "y"))
    return first.mapInArrow(packed, "cell int, at binary, id binary, x binary, y binary")


def _started(records):
    parts = [(cell, record) for cell, record in records]
    if parts:
        at, ids = (np.concatenate([np.frombuffer(r[i], np.int64) for _, r in parts]) for i in (1, 2))
        x, y = (np.concatenate([np.frombuffer(r[i]) for _, r in parts]) for i in (3, 4))
        order = np.argsort(at)
        n = len(at)
        state = dict(zip(STATE, (x[order], y[order], np.zeros(n), np.zeros(n), np.ones(n), np.ones(n)), strict=True))
        yield parts[0][0], ("state", state | {"id": ids[order]})


def _routes(records):
    """To each cell, which of its rows the edges of another lead to."""
    for cell, record in records:
        if record[0] == "edges" and record[1] < 0:
            places = np.frombuffer(record[2], np.int64)
            for other in np.unique(places >> 32).tolist():
                yield other, ("route", cell, (places[places >> 32 == other] & 0xFFFFFFFF).astype(np.int32))


def _sent(records):
    """The positions that the edges of other cells lead to."""
    state = None
    for cell, record in records:
        if record[0] == "state":
            state = record[1]
        else:
            yield record[1], ("ends", cell, state["x"][record[2]], state["y"][record[2]])


def _pulled(records):
    """What the edges of a cell pull at both of their ends, by the cells that these are in."""
    state, ends, all_, pull = None, [], None, None
    for cell, record in records:
        if record[0] == "state":
            state = record[1]
        elif record[0] == "ends":
            ends.append(record[1:])
        elif record[1] >= 0:
            if all_ is None:
                ends.sort(key=lambda e: e[0])
                all_ = [np.concatenate([state[c], *(e[i] for e in ends)]) for i, c in ((1, "x"), (2, "y"))]
                pull = [np.zeros(len(all_[0])) for _ in all_]
            shares = np.frombuffer(record[3])
            k = _width(record, state)
            links, shares = np.frombuffer(record[2], np.int32).reshape(-1, k), shares.reshape(-1, k)
            ways = [np.empty(shares.shape) for _ in all_]
            for at in range(0, len(links), 256):
                part = slice(at, at + 256)
                rows = slice(record[1] + at, record[1] + at + len(links[part]))
                dx, dy = (c[rows, None] - c[links[part]] for c in all_)
                weight = dx * dx
                weight += dy * dy
                weight += 1
                np.divide(shares[part], weight, out=weight)
                for i, way in enumerate((dx, dy)):
                    np.multiply(way, weight, out=ways[i][part])
                    pull[i][rows] += ways[i][part].sum(axis=1)
            for i in (0, 1):
                pull[i] -= np.bincount(links.ravel(), ways[i].ravel(), minlength=len(pull[i]))
    if pull is not None:
        at = len(state["x"])
        yield cell, ("pull", cell, *(p[:at] for p in pull))
        for other, x, _ in ends:
            yield other, ("pull", cell, *(p[at : at + len(x)] for p in pull))
            at += len(x)


def _width(record: tuple, state: dict) -> int:
    """Neighbours of a row, in a record of edges."""
    return len(record[3]) // 8 // min(EDGE_ROWS, len(state["x"]) - record[1])


def _mover(sample_ids: np.ndarray, sample: np.ndarray, count: int, rate: float, momentum: float, factor: float):
    total = normaliser(sample, count)

    def move(records):
        state, routes, pulls = None, {}, []
        for cell, record in records:
            if record[0] == "state":
                state, here = record[1], cell
            elif record[0] == "route":
                routes[record[1]] = record[2]
            else:
                pulls.append(record[1:])
        if state is None:
            return
        pull = [np.zeros(len(state["x"])) for _ in "xy"]
        for other, *found in sorted(pulls, key=lambda p: p[0]):
            at = slice(None) if other == here else routes[other]
            for i in (0, 1):
                pull[i][at] += found[i]
        push = repulsion(state["x"], state["y"], state["id"], sample, sample_ids, count, total)
        yield here, ("state", moved(state, pull, push, rate, momentum, factor) | {"id": state["id"]})

    return move


def _drawn(state: RDD, epoch: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and positions of the sample of an epoch, as ``_epoch`` draws it."""

    def some(share: float):
        def work(records):
            for _, (_, s) in records:
                draw = draws(s["id"], epoch) if count > SAMPLE else s["id"]
                mine = np.flatnonzero(draw <= np.iinfo(np.int64).min + int(share * 2.0**64)) if share < 1 else np.arange(len(draw))
                mine = mine[np.lexsort((s["id"][mine], draw[mine]))[:SAMPLE]]
                yield draw[mine], s["id"][mine], s["x"][mine], s["y"][mine]

        return state.mapPartitions(work).collect()

    wanted = min(SAMPLE, count)
    share = 2 * SAMPLE / count if count > 4 * SAMPLE else 1.0
    found = some(share)
    if sum(len(f[0]) for f in found) < wanted:
        found = some(1.0)
    draw, ids, x, y = map(np.concatenate, zip(*found, strict=True))
    first = np.lexsort((ids, draw))[:wanted]
    return ids[first], np.stack([x[first], y[first]], axis=1)


def draws(ids: np.ndarray, epoch: int) -> np.ndarray:
    """Spark's xxhash64 of a long and an int."""
    a, b, c, d, e = (np.uint64(p) for p in _PRIMES)

    def turned(h: np.ndarray, by: int) -> np.ndarray:
        return (h << np.uint64(by)) | (h >> np.uint64(64 - by))

    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(33))) * b
        h = (h ^ (h >> np.uint64(29))) * c
        return h ^ (h >> np.uint64(32))

    with np.errstate(over="ignore"):
        h = (np.uint64(42) + e + np.uint64(8)) ^ (turned(ids.astype(np.uint64) * b, 31) * a)
        h = mixed(turned(h, 27) * a + d)
        h = (h + e + np.uint64(4)) ^ (np.uint64(epoch) * a)
        return mixed(turned(h, 23) * b + c).astype(np.int64)


_PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


def _epoch(state: DataFrame, edges: DataFrame, epoch: int, count: int, rate: float, momentum: float, factor: float):
    draw = F.xxhash64("id", F.lit(epoch)) if count > SAMPLE else F.col("id")
    drawn = state.select("id", "x", "y").orderBy(draw, "id").limit(SAMPLE).toArrow()
    sample_ids = drawn["id"].to_numpy()
    sample = np.stack([drawn["x"].to_numpy(), drawn["y"].to_numpy()], axis=1)
    pulled = state.join(attraction(edges, state), "id", "left").na.fill(0.0, ["ax", "ay"])

    def work(batches):
        for batch in batches:
            c = {name: batch.column(i).to_numpy() for i, name in enumerate(batch.schema.names)}
            push = repulsion(c["x"], c["y"], c["id"], sample, sample_ids, count)
            new = moved(c, (c["ax"], c["ay"]), push, rate, momentum, factor)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(new[s]) for s in STATE)], names=["id", *STATE]
            )

    schema = "id long, " + ", ".join(f"{s} double" for s in STATE)
    return pulled.select("id", *STATE, "ax", "ay").mapInArrow(work, schema)


def map_loss(edges: DataFrame, positions: DataFrame, normaliser: Column) -> DataFrame:
    """Kullback-Leibler divergence of the map's pair shares from the edges' shares.

    ``normaliser`` is the sum of 1 / (1 + d^2) over all ordered pairs, a literal.
    """
    here = positions.select(F.col("id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"))
    there = positions.select(F.col("id").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"))
    d = (F.col("xi") - F.col("xj")) ** 2 + (F.col("yi") - F.col("yj")) ** 2
    q = 1 / (1 + d) / normaliser
    met = edges.where("p > 0").join(here, "i").join(there, "j")
    return met.agg(F.sum(F.col("p") * (F.log(F.col("p")) - F.log(q))).alias("loss"))
