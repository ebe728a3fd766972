"""Short test items inside long documents: size-partitioned containment MinHash.

Items and documents are sets of 5-word shingles. A document holds an item when it has at
least ``percent`` in 100 of the item's shingles. Banding by Jaccard similarity fails here,
as that is tiny between an item and a document a thousand times as long. Instead the items
are partitioned by size (powers of two), and every item of a partition is represented by
the shingles with its k smallest hashes. A document may lack at most (100 - percent) in 100
of an item's shingles; k is one more than that for the partition's largest size, so one of
the k is always in a document that holds the item: the search misses nothing. What it
proposes is verified by exact containment of the whole set.

The sets of the items are written once. At most BLOCK_SHINGLES shingles of them go to every
task, and documents are looked at where they are. Of a larger benchmark the tasks get a Bloom
filter of bounded size only. What passes it is joined with the sketches, and the pairs found
are verified by a join with the whole sets; no items reach the driver. Both ways give the
same hits.

A null or empty text, of either side, holds nothing and is held by nothing. An item of n < 5
words is one run of n words, held by every document in which they follow each other. Repeated
items and documents are reported each. Empty tables give no hits. The order of a document's
hits is that of the ids of the items, null first. Extra columns stay; one that has the name
of the output is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tertulia.llm.phrases import filter_of, known
from tertulia.llm.store import free, others, replaced, with_computed, written
from tertulia.llm.words import SHINGLE, Words, buffers, runs, shingle_sets, word_hashes

BLOCK_SHINGLES = 1 << 20
FILTER_BITS = 22

HITS = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.LongType()),
            T.StructField("item_shingles", T.LongType()),
            T.StructField("shared", T.LongType()),
        ]
    ),
    False,
)
_ARROW_HITS = pa.list_(
    pa.field(
        "element",
        pa.struct([("item_id", pa.int64()), ("item_shingles", pa.int64()), ("shared", pa.int64())]),
        nullable=False,
    )
)


def sketch_size(n: int, percent: int) -> int:
    """How many smallest hashes stand for an item of n shingles: those of its partition."""
    largest = (1 << int(n).bit_length()) - 1
    return min(n, largest * (100 - percent) // 100 + 1)


def item_sets(items: DataFrame, id_column: str, text: str) -> DataFrame:
    """Items with a word at least: item_id, members (hashes, in unsigned order), words (at most 5)."""

    def make():
        split = Words()

        def compute(column: pa.Array):
            data, offsets = buffers(column)
            counts = [word_hashes(split, data, offsets, a, b)[1] for a, b in runs(offsets)]
            words = np.minimum(np.concatenate([*counts, np.zeros(0, np.int64)]), SHINGLE)
            found = [s.view(np.int64) for s in shingle_sets(column, split)]
            yield [pa.array(found, pa.list_(pa.int64())), pa.array(words.astype(np.int32))]

        return compute

    plain = items.select(F.col(id_column).cast("long").alias("item_id"), F.col(text).alias("_text"))
    fields = [T.StructField("members", T.ArrayType(T.LongType())), T.StructField("words", T.IntegerType())]
    return with_computed(plain, "_text", fields, make, drop=("_text",)).where(F.size("members") > 0)


class Index:
    """Sketches of a block of items, and their full sets."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], percent: int):
        self.items, self.percent = items, percent
        sketches = [s[: sketch_size(len(s), percent)] for _, s in items]  # sets are sorted
        hashes = np.concatenate([*sketches, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(items)), [len(s) for s in sketches])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner = hashes[order], owner[order]
        self.maybe = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.maybe[self.hashes >> np.uint64(64 - FILTER_BITS)] = True

    def hits(self, found: np.ndarray) -> list[dict]:
        likely = found[self.maybe[found >> np.uint64(64 - FILTER_BITS)]]
        if not len(likely):
            return []
        first = np.searchsorted(self.hashes, likely, side="left")
        last = np.searchsorted(self.hashes, likely, side="right")
        owners = {int(x) for a, b in zip(first, last, strict=True) for x in self.owner[a:b]}
        out = []
        for k in sorted(owners):
            item, members = self.items[k]
            at = np.minimum(np.searchsorted(found, members), len(found) - 1)
            shared = int((found[at] == members).sum())
            if 100 * shared >= self.percent * len(members):
                out.append({"item_id": item, "item_shingles": len(members), "shared": shared})
        return out


def with_hits(
    docs: DataFrame,
    items: DataFrame,
    percent: int = 80,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    hits: str = "hits",
) -> DataFrame:
    """Adds the items that each document holds, ordered by their ids."""
    sets = written(item_sets(items, item_id, item_text), "item-sets")
    total = sets.agg(F.sum(F.size("members")), F.collect_set("words")).first()
    shorter = tuple(sorted(set(total[1]) - {SHINGLE}))
    if (total[0] or 0) <= BLOCK_SHINGLES:
        return _held_in_place(docs, sets, percent, shorter, text, hits)
    return _held_by_join(docs, sets, percent, shorter, text, hits)


def _held_in_place(docs, sets, percent, shorter, text, hits) -> DataFrame:
    """Hits of few items, whose sets go to every task."""
    rows = sets.select("item_id", "members").orderBy("item_id").toArrow().combine_chunks()
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def make():
        ids, members = (shared.value.column(i).to_pylist() for i in (0, 1))
        index = Index([(i, np.array(m, np.int64).view(np.uint64)) for i, m in zip(ids, members, strict=True)], percent)
        split = Words()

        def compute(column: pa.Array):
            yield [pa.array([index.hits(s) for s in shingle_sets(column, split, shorter)], _ARROW_HITS)]

        return compute

    return with_computed(docs, text, [T.StructField(hits, HITS)], make)


def _held_by_join(docs, sets, percent, shorter, text, hits) -> DataFrame:
    """Hits of any number of items, by joins of hashes that a bounded filter lets through."""
    numbered = written(sets.withColumn("_item", F.monotonically_increasing_id()), "items")
    members = numbered.select("_item", F.explode("members").alias("_hash"))
    shared = docs.sparkSession.sparkContext.broadcast(filter_of(members.select(F.col("_hash").alias("key"))))

    def make():
        split, bloom = Words(), shared.value

        def compute(column: pa.Array):
            found = shingle_sets(column, split, shorter)
            yield [pa.array([s[known(bloom, s)].view(np.int64) for s in found], pa.list_(pa.int64()))]

        return compute

    near, row = free(docs, "__near"), free(docs, "__row")
    fields = [T.StructField(near, T.ArrayType(T.LongType()))]
    rows = written(with_computed(docs, text, fields, make).withColumn(row, F.monotonically_increasing_id()), "near")
    present = rows.select(F.col(row).alias("_row"), F.explode(near).alias("_hash"))
    n = F.size("members")
    largest = F.expr("shiftleft(1L, length(bin(size(members)))) - 1")  # of the item's partition
    sketch = F.least(n.cast("long"), F.floor(largest * (100 - percent) / 100) + 1).cast("int")
    sketches = numbered.select("_item", F.explode(F.slice("members", 1, sketch)).alias("_hash"))
    pairs = written(present.join(sketches, "_hash").select("_row", "_item").distinct(), "pairs")
    shared_of = (
        pairs.join(members, "_item")
        .join(present, ["_row", "_hash"], "left_semi")
        .groupBy("_row", "_item")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    sizes = numbered.select("_item", "item_id", n.cast("long").alias("item_shingles"))
    hit = F.struct("item_id", "item_shingles", "shared")
    held = (
        shared_of.join(sizes, "_item")
        .where(100 * F.col("shared") >= percent * F.col("item_shingles"))
        .groupBy(F.col("_row").alias(row))
        .agg(F.sort_array(F.collect_list(hit)).alias(free(docs, "__held")))  # a document's own result
    )
    out = rows.join(held, row, "left")
    empty = F.array().cast(HITS)
    return replaced(out, {hits: F.coalesce(free(docs, "__held"), empty)}).drop(
        *(c for c in (near, row, free(docs, "__held")) if c != hits)
    )


def without_contaminated(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    kept = others(docs, ())
    found = free(docs, "__found")
    marked = with_hits(docs, items, percent, hits=found)
    return marked.where(F.size(found) == 0).select(*(F.col(f"`{c}`") for c in kept))
