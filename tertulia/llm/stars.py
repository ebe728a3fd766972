"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tertulia.llm.store import written

def _with_smallest(arcs: DataFrame) -> DataFrame:
    """Arcs (u, v) with the smallest of u and all its v as ``m``.

    A node may hold a third of all arcs. One with more than a shuffle partition's fair share
    meets its ``m`` in as many parts as it holds shares; there are fewer such nodes than
    partitions, hence the broadcast, and all their parts are at most twice the partitions.
    """
    least = written(
        arcs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")),
        "smallest",
    )
    total = least.agg(F.sum("n")).first()[0] or 0
    share = max(1, -(-total // int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    parts = F.ceil(F.col("n") / share).cast("int")
    hot = least.where(F.col("n") > share).select("u", parts.alias("parts"))
    dealt = arcs.join(F.broadcast(hot), "u", "left").select(
        "u", "v", F.coalesce(F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"), F.lit(0)).alias("salt")
    )
    every = least.select("u", "m", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    return dealt.join(every, ["u", "salt"])


def large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest one. Edges are (a, b), a > b."""
    arcs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    found = _with_smallest(arcs).where("v > u")
    return found.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a > b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links each smaller neighbour of a node, and the node, to the smallest one."""
    arcs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    found = _with_smallest(arcs)
    ends = found.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
    return ends.where("a > b").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) with b the smallest id that a is connected with, for every a that isn't it.

    ``edges`` has longs a and b; loops, nulls and repeated edges are allowed. The loop ends
    when a pair of steps changes nothing, after a number of steps that grows with the
    logarithm of the number of nodes; each step is written, so none is done again.
    """
    now = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a > b")
        .distinct(),
        "edges",
    )
    mark = _mark(now)
    while mark[0]:
        now = written(small_star(written(large_star(now), "large-star")), "small-star")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now
