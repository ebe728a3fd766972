"""Near-duplicate documents: MinHash bands, verification, and components by star steps.

A document's set holds the hashes of its distinct 5-word shingles. Two documents are
linked when 100 * |intersection| >= percent * |union|. Documents of equal sets form a
class, found by a digest of the set, and only one of each class goes on. It has BANDS
keys of ROWS minima each, from universal hashes h(x) = (a x + b) mod 2^64; two documents
at 0.85 fail to share a key with a chance of 3e-7.

Documents that share a key are not paired with each other all. Each is first compared
with the smallest id it shares a key with, and the links found are closed to components,
so a group of copies costs one comparison a document. Only keys whose documents then still
lie in several components go on: of a small group all pairs from different components are
compared. Large groups that share documents are taken together, ordered by component and
cut into blocks; a task compares two blocks by products of 0/1 matrices, skips what lies in
one component, and returns links that join components only, so never more than it has rows.
That part is quadratic in the documents of a large group that are alike but not linked.
So no link that the keys show is lost, and no group meets in one task.

A comparison looks at the signatures first (equal in at least AGREE of the minima) and
then at the full sets.

Nulls and texts without words have an empty set, are linked with nothing and are their own
component. Rows of one doc_id count as one document. Rows without a doc_id take the
component of their class; if no row of that class has an id it is null, and they are kept.
Repeated rows are returned each. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tertulia.llm.stars import components
from tertulia.llm.store import free, with_computed, written
from tertulia.llm.words import Words, shingle_sets

BANDS, ROWS = 26, 5
HASHES = BANDS * ROWS
AGREE = 0.65
WORD = r"[^\x20\x09-\x0D]"
SMALL, ROWS_OF_BLOCK, COLUMNS = 16, 512, 4096
BLOCK = 1024

_DRAW = np.random.Generator(np.random.PCG64(77))
FACTORS = _DRAW.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _DRAW.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def minima(values: np.ndarray) -> bytes:
    """High halves of the smallest value of each hash function over the set."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), BLOCK):
        hashed = np.multiply.outer(FACTORS, values[at : at + BLOCK])
        hashed += OFFSETS[:, None]
        np.minimum(least, hashed.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4").tobytes()


def with_signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_shingles, a digest of the set, and the minima; both null for an empty set."""
    fields = [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("minima", T.BinaryType()),
    ]

    def make():
        split = Words()

        def compute(column: pa.Array):
            sizes, digests, signatures = [], [], []
            for found in shingle_sets(column, split):
                sizes.append(len(found))
                some = len(found) > 0
                raw = found.astype("<u8").tobytes()
                digests.append(hashlib.blake2b(raw, digest_size=16).digest() if some else None)
                signatures.append(minima(found) if some else None)
            yield [
                pa.array(sizes, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(signatures, pa.binary()),
            ]

        return compute

    return with_computed(docs, text, fields, make, drop=(text,))


def band_keys(minima_column: str) -> list:
    width = 4 * ROWS
    return [
        F.xxhash64(F.lit(i), F.substring(minima_column, 1 + width * i, width)) for i in range(BANDS)
    ]


def _agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree well enough for a link."""
    left = nodes.select(F.col("node").alias("a"), F.col("minima").alias("_left"))
    right = nodes.select(F.col("node").alias("b"), F.col("minima").alias("_right"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "_left", "_right")

    def work(batches):
        for batch in batches:
            sides = [
                np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(-1, HASHES)
                for i in (2, 3)
            ]
            good = (sides[0] == sides[1]).mean(axis=1) >= AGREE
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(
                pa.array(good)
            )

    return both.mapInArrow(work, "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("_left"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("_right"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "_left", "_right")

    def work(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, other = (np.frombuffer(s.as_buffer(), "<u8") for s in (x, y))
                at = np.minimum(np.searchsorted(one, other), len(one) - 1)
                common = int((one[at] == other).sum())
                good.append(100 * common >= percent * (len(one) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(
                pa.array(good, pa.bool_())
            )

    return both.mapInArrow(work, "a long, b long")


def _sets(docs: DataFrame, nodes: DataFrame, id_column: str, text: str) -> DataFrame:
    """Sorted full sets, as bytes, of the nodes."""
    mine = docs.select(F.col(id_column).alias("node"), F.col(text).alias("_text"))
    field = T.StructField("members", T.BinaryType())

    def make():
        split = Words()

        def compute(column: pa.Array):
            found = [s.astype("<u8").tobytes() for s in shingle_sets(column, split)]
            yield [pa.array(found, pa.binary())]

        return compute

    wanted = mine.join(nodes, "node", "left_semi").where(F.col("_text").isNotNull())
    return with_computed(wanted, "_text", [field], make, drop=("_text",)).where(
        F.octet_length("members") > 0
    )


def _within(small: DataFrame) -> DataFrame:
    """Pairs from different components of groups (key, node, comp) of at most SMALL nodes."""
    other = small.select("key", F.col("node").alias("b"), F.col("comp").alias("_comp"))
    every = small.select("key", F.col("node").alias("a"), "comp").join(other, "key")
    every = every.where((F.col("comp") != F.col("_comp")) & (F.col("a") > F.col("b")))
    return every.select("a", "b").distinct()


def common(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of ``rows`` with each of ``columns``."""
    sides = []
    for sets in (rows, columns):
        sides.append((np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
    shared = np.intersect1d(np.unique(sides[0][0]), np.unique(sides[1][0]), assume_unique=True)
    out = np.zeros((len(rows), len(columns)), dtype=np.float32)
    if not len(shared):
        return out
    places = []
    for values, owner in sides:
        at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        good = shared[at] == values
        order = np.argsort(at[good], kind="stable")
        places.append((at[good][order], owner[good][order]))
    for first in range(0, len(shared), COLUMNS):
        width = min(COLUMNS, len(shared) - first)
        dense = []
        for (at, owner), n in zip(places, (len(rows), len(columns)), strict=True):
            a, b = np.searchsorted(at, [first, first + width])
            x = np.zeros((n, width), dtype=np.float32)
            x[owner[a:b], at[a:b] - first] = 1
            dense.append(x)
        out += dense[0] @ dense[1].T
    return out


def joining(nodes, comps, minima_, sets, half: np.ndarray, same: bool, percent: int) -> list[tuple]:
    """Links between the two halves (within, if ``same``) that join different components."""
    left, right = np.flatnonzero(~half), np.flatnonzero(half)
    if same:
        right = left
    signed = np.frombuffer(b"".join(minima_), "<u4").reshape(-1, HASHES)
    agree = np.zeros((len(left), len(right)), dtype=np.uint8)
    for k in range(HASHES):
        agree += signed[left, k][:, None] == signed[right, k][None, :]
    likely = (agree >= AGREE * HASHES) & (comps[left][:, None] != comps[right][None, :])
    if same:
        likely &= np.tri(len(left), k=-1, dtype=bool)
    rows, columns = np.flatnonzero(likely.any(axis=1)), np.flatnonzero(likely.any(axis=0))
    if not len(rows):
        return []
    mine, theirs = left[rows], right[columns]
    full = [np.frombuffer(x, "<u8") for x in sets]
    both = common([full[i] for i in mine], [full[i] for i in theirs])
    size = np.array([len(x) for x in full])
    whole = size[mine][:, None] + size[theirs][None, :] - both
    good = likely[np.ix_(rows, columns)] & (100 * both >= percent * whole)
    home, out = {}, []

    def root(x: int) -> int:
        while home.get(x, x) != x:
            x = home[x]
        return x

    for i, j in zip(*np.nonzero(good), strict=True):
        a, b = mine[i], theirs[j]
        x, y = root(int(comps[a])), root(int(comps[b]))
        if x != y:
            home[max(x, y)] = min(x, y)
            out.append((int(nodes[a]), int(nodes[b])))
    return out


def _across(large: DataFrame, signed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join components, of groups (key, node, comp, low) of more than SMALL nodes."""
    # written, so that the rows of a hot key meet their one row here in as many parts as needed
    lows = written(large.groupBy("key").agg(F.min("node").alias("b")), "lows")
    together = components(large.select("key", F.col("node").alias("a")).join(lows, "key"))
    found = large.select("node", "comp").distinct()
    found = found.join(together.withColumnRenamed("a", "node"), "node", "left")
    found = written(found.select("node", "comp", F.coalesce("b", "node").alias("kind")), "alike")
    # blocks by position: components in order of their id, in ranges of equal numbers
    ordered = _numbered(found)
    blocks = ordered.withColumn("block", F.floor(F.col("at") / ROWS_OF_BLOCK))
    spans = written(
        blocks.groupBy("kind", "block").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")),
        "blocks",
    )
    other = spans.select("kind", F.col("block").alias("other"), F.col("_low").alias("_l"), F.col("_high").alias("_h"))
    pairs = spans.join(other, "kind").where(
        (F.col("block") <= F.col("other")) & ~((F.col("_low") == F.col("_h")) & (F.col("_l") == F.col("_high")))
    )  # both blocks in one component: nothing to join
    pairs = pairs.select("kind", "block", "other")
    roles = pairs.withColumn("half", F.lit(False)).select(
        "kind", F.col("block").alias("mine"), "block", "other", "half"
    ).union(
        pairs.where("block < other").select(
            "kind", F.col("other").alias("mine"), "block", "other", F.lit(True).alias("half")
        )
    )
    full = blocks.join(signed, "node").join(sets, "node")
    dealt = full.withColumnRenamed("block", "mine").join(roles, ["kind", "mine"]).select(
        "kind", "block", "other", "half", "node", "comp", "minima", "members"
    )

    def work(group: pa.Table) -> pa.Table:
        same = group.column("block")[0] == group.column("other")[0]
        half = group.column("half").to_numpy()
        columns = [group.column(c).to_pylist() for c in ("minima", "members")]
        links = joining(
            group.column("node").to_numpy(), group.column("comp").to_numpy(), *columns, half, same, percent
        )
        return pa.table(
            {"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())}
        )

    return dealt.groupBy("kind", "block", "other").applyInArrow(work, "a long, b long")


def _numbered(found: DataFrame) -> DataFrame:
    """Positions ``at`` within each kind, by component and node, counted in ranges of the order."""
    parts = found.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = found.repartitionByRange(int(parts), "kind", "comp", "node").sortWithinPartitions(
        "kind", "comp", "node"
    )
    dealt = written(dealt.withColumn("part", F.spark_partition_id()), "in-order")
    sizes = dealt.groupBy("kind", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("kind", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("kind", "part").orderBy("comp", "node")
    return dealt.withColumn("k", F.row_number().over(inside) - 1).join(starts, ["kind", "part"]).select(
        "node", "comp", "kind", (F.col("start") + F.col("k")).alias("at")
    )


def links_closed(
    docs: DataFrame, nodes: DataFrame, percent: int, id_column: str, text: str
) -> DataFrame:
    """Components (a, b) over ``nodes`` (node, minima), as ``stars.components`` gives them."""
    bands = nodes.select("node", F.explode(F.array(*band_keys("minima"))).alias("key"))
    lows = bands.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    # written, so that its size is known and the bands of a hot key need not meet in one task
    shared = written(lows.where("low < high").select("key", "low"), "shared-keys")
    grouped = written(bands.join(shared, "key").select("key", "node", "low"), "groups")
    met = grouped.select("node").distinct()
    sets = written(_sets(docs, met, id_column, text), "sets")
    signed = written(nodes.join(met, "node", "left_semi"), "signed")
    pairs = grouped.groupBy(F.col("node").alias("a")).agg(F.min("low").alias("b")).where("a > b")
    stars = components(_linked(written(_agreeing(pairs, signed), "likely"), sets, percent))
    homes = stars.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    grouped = grouped.join(homes, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    spans = grouped.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min("comp").alias("_low"), F.max("comp").alias("_high")
    )
    # written, so that the rows of a hot key meet their one row here in as many parts as needed
    spans = written(spans.where("_low < _high").select("key", "size"), "spans")
    still = written(grouped.select("key", "node", "comp").join(spans, "key"), "open-groups")
    likely = written(_agreeing(_within(still.where(F.col("size") <= SMALL)), signed), "likely")
    links = _linked(likely, sets, percent)
    large = still.where(F.col("size") > SMALL)
    if not large.isEmpty():
        links = links.union(_across(large, signed, sets, percent))
    return components(links.union(stars))


def _row_key(id_column: Column, text: Column) -> Column:
    """A digest of an id and a text that are not null, or of the text alone."""
    return F.md5(F.concat_ws(" ", F.md5(text.cast("binary")), id_column.cast("string")).cast("binary"))


def near_duplicates(
    docs: DataFrame, percent: int = 85, id_column: str = "doc_id", text: str = "text", rows: bool = False
) -> DataFrame:
    """One row for each row: the id, n_shingles, component_id and kept.

    With ``rows`` also the digest of the set and ``_row``, a key of id and text.
    """
    pair = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text).alias("_text"))
    if rows:
        pair = pair.withColumn("_row", _row_key(F.col("_id"), F.col("_text")))
    signed = written(with_signatures(pair, "_text"), "signatures")
    classes = written(
        signed.where(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(F.min("_id").alias("node")),
        "classes",
    )
    first = classes.where(F.col("node").isNotNull()).select(F.col("node").alias("_id"), "digest")
    nodes = written(
        signed.join(first, ["_id", "digest"], "left_semi")
        .dropDuplicates(["_id", "digest"])  # repeated rows have the same minima
        .select(F.col("_id").alias("node"), "minima"),
        "nodes",
    )
    stars = links_closed(pair, nodes, percent, "_id", "_text")
    homes = classes.join(stars.select(F.col("a").alias("node"), F.col("b").alias("comp")), "node", "left")
    homes = homes.select("digest", F.coalesce("comp", "node").alias("comp"))
    found = signed.drop("minima").join(homes, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("_id")).otherwise(F.col("comp"))
    return found.select(
        F.col("_id").alias(id_column),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("_id") == component, component.isNull()).alias("kept"),
        *(["digest", "_row"] if rows else []),
    )


def without_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The documents that stay, with all their columns: one of each component.

    Rows are judged each, so a text stays if no other document has a copy, whatever other rows
    of its doc_id hold. Of rows with the same doc_id and set one stays, and so of copies that
    have no doc_id. Rows without words all stay.
    """
    has_words = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    found = near_duplicates(docs.where(has_words), percent, rows=True)
    stay = found.where("kept").groupBy("doc_id", "digest").agg(F.min("_row").alias("_row"))
    name = free(docs, "__row")
    once = docs.where(has_words).withColumn(name, _row_key(F.col("doc_id"), F.col("text"))).dropDuplicates([name])
    kept = once.join(stay.select(F.col("_row").alias(name)), name, "left_semi").drop(name)
    return kept.unionByName(docs.where(~has_words))
