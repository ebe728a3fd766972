"""The trie of rebuilt conversations: which share how many first turns.

A turn's id is the first WIDTH bytes of a digest of role and text, so a conversation is a
string of fixed-width big-endian ids. Equal strings are one row with their number, smallest
conv_id and a digest of all their conv_ids. These rows are cut into ranges of the strings,
which split any group however hot; a task builds an adaptive radix tree over its range and
emits a node at each byte depth that ends a turn. A node whose conversations go on in another
range is emitted in part by each: all figures of a node are sums (or minima) over ranges
once what a range counts as new is set against the last string of the range before.

conv_ids are hashed in ascending order, as the digest asks. Ranges of (string, conv_id) join
them to texts in parallel; only these texts are streamed through the digest, one after another.

A null role or text counts as empty; a null turn comes first; rows of one conversation with
equal turns go by digest, and count each. Rows without conv_id are in no conversation. A
conversation may have no turn; an empty table has no node, not even a root. A conversation's
ids (not its texts) are one value, so 2^31 bytes of them are the most. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tertulia.llm.radix import Tree, common
from tertulia.llm.store import written

WIDTH = 16
BASE, HEADS = 20, 4  # conversations that share a first part, and below how many turns it has
ROWS_A_TASK, IDS_A_TEXT = 100_000, 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()


def head_turns(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, path (ids of the turns), words (of each turn's text) of every conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            F.md5(F.concat(F.md5(role.cast("binary")), F.md5(text.cast("binary"))).cast("binary")).alias("id"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
        ).alias("turn"),
    )
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("_turns"))
    own = written(own, "trie-turns")
    base = F.col("conv_id") - F.col("conv_id") % BASE
    heads = own.where(F.col("conv_id") % BASE == 0).select(
        F.col("conv_id").alias("_base"), F.slice("_turns", 1, HEADS - 1).alias("_heads")
    )
    n = head_turns(F.col("conv_id"))
    nothing = F.filter("_turns", lambda _: F.lit(False))
    joined = own.withColumn("_base", base).join(heads, "_base", "left")
    whole = F.concat(
        F.coalesce(F.slice("_heads", F.lit(1), n), nothing),
        F.slice("_turns", n + 1, F.greatest(F.size("_turns"), F.lit(1))),
    )
    return joined.select("conv_id", whole.alias("_whole")).select(
        "conv_id",
        F.unhex(F.array_join(F.transform("_whole", lambda x: x["id"]), "")).alias("path"),
        F.transform("_whole", lambda x: x["words"]).alias("words"),
    )


def member_digests(members: DataFrame, tasks: int) -> DataFrame:
    """path_id, ends: SHA-256 of the ascending conv_ids of each path, joined by commas."""

    def joined(batches):
        for batch in batches:
            paths, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            cuts = np.flatnonzero(paths[1:] != paths[:-1]) + 1
            edges = np.unique(np.concatenate([[0], cuts, np.arange(0, len(ids), IDS_A_TEXT), [len(ids)]]))
            texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(edges, edges[1:], strict=False)]
            first = edges[:-1].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(first)), pa.array(ids[first]), pa.array(texts, pa.string())],
                names=["path_id", "first", "text"],
            )

    def digested(batches):
        current, state = None, None
        for batch in batches:
            done_paths, done = [], []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if path == current:
                    state.update(b"," + text.encode())
                    continue
                if current is not None:
                    done_paths.append(current)
                    done.append(state.hexdigest())
                current, state = path, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(done_paths, pa.binary()), pa.array(done, pa.string())], names=["path_id", "ends"]
            )
        if current is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([current], pa.binary()), pa.array([state.hexdigest()])], names=["path_id", "ends"]
            )

    dealt = members.repartitionByRange(tasks, "path_id", "conv_id").sortWithinPartitions("path_id", "conv_id")
    texts = dealt.mapInArrow(joined, "path_id binary, first long, text string")
    return (
        texts.repartition(tasks, "path_id")
        .sortWithinPartitions("path_id", "first")
        .mapInArrow(digested, "path_id binary, ends string")
    )


PART = (
    "pid int, depth long, key binary, parent_key binary, conv_id long, parent_conv_id long,"
    " n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
)


def _keys(path: bytes, turns: int) -> list[bytes]:
    """Digests of the first 0 to ``turns`` turns of a path."""
    state, out = hashlib.md5(), []
    for d in range(turns + 1):
        out.append(state.digest())
        state.update(path[d * WIDTH : (d + 1) * WIDTH])
    return out


def range_nodes(table: pa.Table) -> pa.Table:
    """The nodes of one range of paths, see PART; those shared with other ranges have a key.

    Rows of kind 1 and 2 are the last path of the range before and the first of the one after.
    """
    kind, paths = table["kind"].to_numpy(), table["path"].to_pylist()
    border = {int(kind[i]): paths[i] for i in np.flatnonzero(kind)}
    rows = np.flatnonzero(kind == 0).tolist()
    counts, smallest = table["n"].to_pylist(), table["conv_id"].to_pylist()
    words, ends = table["words"].to_pylist(), table["ends"].to_pylist()
    first, last = min(rows, key=paths.__getitem__), max(rows, key=paths.__getitem__)
    # how many turns the borders share with this range, and the keys of those shared nodes
    left = common(border[1], paths[first]) // WIDTH if 1 in border else -1
    right = common(border[2], paths[last]) // WIDTH if 2 in border else -1
    goes_on = 2 in border and right * WIDTH == len(paths[last])
    left_keys, right_keys = _keys(paths[first], left), _keys(paths[last], right)

    tree = Tree()
    for i in rows:
        tree.put(paths[i], i)
    out: dict[str, list] = {x.split()[0]: [] for x in PART.split(", ")}
    parent: list[int] = []
    done: list[tuple] = []  # of subtrees whose parent is still to come
    for node, begin, end in tree.upwards():
        n = kids = leaves = saved = 0
        least, some, is_first, is_last, waiting = None, None, False, False, []
        below = sum(1 for _ in node.kids.items())
        if below:
            for m, x, some, f, z, k, v, s, w in done[-below:]:
                n, kids, leaves, saved = n + x, kids + k, leaves + v, saved + s
                least = m if least is None else min(least, m)
                is_first, is_last = is_first or f, is_last or z
                waiting += w
            del done[-below:]
        if node.value is not None:
            some = node.value
            n += counts[some]
            least = smallest[some] if least is None else min(least, smallest[some])
            is_first, is_last = is_first or some == first, is_last or some == last
        for d in range(end // WIDTH, begin // WIDTH, -1):
            here = node.value is not None and d * WIDTH == end
            new = not (is_first and d <= left)
            if not waiting:
                leaves = 0 if is_last and goes_on else 1
            size = words[some][d - 1] if d else 0
            saved += n * size - new * size
            key = left_keys[d] if is_first and d <= left else right_keys[d] if is_last and d <= right else None
            at = len(parent)
            for child in waiting:
                parent[child] = at
            values = (0, d, key, None, least, None, n, kids, leaves, saved, ends[some] if here else None)
            for column, value in zip(out.values(), values, strict=True):
                column.append(value)
            parent.append(-1)
            kids, waiting = int(new), [at]
        done.append((least, n, some, is_first, is_last, kids, leaves, saved, waiting))
    out["pid"] = [int(table["pid"][0].as_py())] * len(parent)
    out["parent_key"] = [out["key"][p] if p >= 0 else None for p in parent]
    out["parent_conv_id"] = [
        out["conv_id"][p] if p >= 0 and out["key"][p] is None else None for p in parent
    ]
    types = {"pid": pa.int32(), "key": pa.binary(), "parent_key": pa.binary(), "ends": pa.string()}
    return pa.table({k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()})


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
    of every node."""
    spark = conversations.sparkSession
    whole = written(rebuilt(conversations).withColumn("path_id", F.md5("path").cast("binary")), "trie-paths")
    least_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least_tasks, -(-whole.count() // ROWS_A_TASK))
    digests = member_digests(whole.select("path_id", "conv_id"), tasks)
    distinct = whole.groupBy("path", "path_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.first("words").alias("words")
    )
    rows = distinct.join(digests, "path_id").drop("path_id").repartitionByRange(tasks, "path")
    rows = written(rows.withColumn("pid", F.spark_partition_id()), "trie-ranges")
    order = Window.orderBy("pid")  # a row per range
    edges = rows.groupBy("pid").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    edges = edges.select("pid", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))
    sides = edges.select(
        "pid",
        F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("path")) for k, c in ((1, "before"), (2, "after"))))).alias("_side"),
    ).select("pid", "_side.kind", "_side.path").where(F.col("path").isNotNull())
    inner = rows.withColumn("kind", F.lit(0)).unionByName(sides, allowMissingColumns=True)
    nodes = written(inner.groupBy("pid").applyInArrow(range_nodes, PART), "trie-nodes")

    shared = nodes.where(F.col("key").isNotNull())
    merged = written(
        shared.groupBy("key", "depth").agg(
            F.first("parent_key").alias("parent_key"),
            F.min("conv_id").alias("conv_id"),
            *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
            F.max("ends").alias("ends"),
        ),
        "trie-shared",
    )
    named = merged.select("key", F.col("conv_id").alias("_above"))
    top = merged.join(named.withColumnRenamed("key", "parent_key"), "parent_key", "left")
    # by range as well, so that the children of a node with many are dealt out
    in_range = shared.select("pid", "key").join(named, "key").withColumnRenamed("key", "parent_key")
    rest = nodes.where(F.col("key").isNull()).join(in_range, ["pid", "parent_key"], "left")
    rest = rest.withColumn("_above", F.coalesce("_above", "parent_conv_id"))
    result = ["conv_id", "depth", "_above", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    return top.select(*result).unionByName(rest.select(*result)).select(
        "conv_id",
        "depth",
        F.col("_above").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
    )
