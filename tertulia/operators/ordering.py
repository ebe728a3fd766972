"""Reproducible order, positions and samples.

Order comes from a hash of a row key and a seed, not from where a row is stored,
so results do not change with the partitioning or when a lost task is run again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tertulia.sources.corpus import materialise

PICKS_SENT = 200_000
DIGITS = 4  # hex digits a pass of ``digests_at`` adds


def shuffle_key(key: Column, seed: int = 42) -> Column:
    """Hex digest that orders rows pseudo-randomly; a null key counts as an empty one."""
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"|{seed}")))


def hash_number(key: Column, seed: int = 42, digits: int = 8) -> Column:
    """Non-negative integer from the first hex digits of the digest."""
    return F.conv(F.left(shuffle_key(key, seed), F.lit(digits)), 16, 10).cast("long")


def digests_at(
    df: DataFrame, key: Column, places: Sequence[int], seed: int = 42
) -> list[str | None]:
    """For each place, the least digest prefix whose rows start there in the shuffled order.

    A row stands before place p exactly if its digest is smaller than the p-th prefix, so rows
    can be cut there by comparison, without being moved. Rows are counted by their next DIGITS
    hex digits, at first all of them, then only those of a range that a place lies in, until
    each place is the start of a range: about one pass over the key column for each factor of
    65,536 in the number of rows. A pass returns one row for each place. Rows with equal keys
    stay together, behind a place that would part them. None: the place is behind the last row.
    """
    digests = df.select(shuffle_key(key, seed).alias("_key"))
    open_at = {p: ("", p) for p in places}  # the range a place lies in, and how far inside
    found: dict[int, str | None] = dict.fromkeys(places)
    for digits in range(DIGITS, 32 + DIGITS, DIGITS):
        if not open_at:
            break
        outer, inner = F.left("_key", F.lit(digits - DIGITS)), F.left("_key", F.lit(digits))
        asked = sorted({prefix for prefix, _ in open_at.values()})
        counts = digests.where(outer.isin(asked)).groupBy(outer.alias("_outer"), inner.alias("_inner")).count()
        running = F.sum("count").over(Window.partitionBy("_outer").orderBy("_inner"))
        bounds = counts.withColumn("_end", running).withColumn("_start", F.col("_end") - F.col("count"))
        holds = [
            (F.col("_outer") == prefix) & (F.col("_start") <= rest) & (F.col("_end") > rest)
            for prefix, rest in open_at.values()
        ]
        rows = bounds.where(reduce(Column.__or__, holds)).collect()  # one for each place at most
        still = {}
        for place, (prefix, rest) in open_at.items():
            for r in rows:
                if r["_outer"] == prefix and r["_start"] <= rest < r["_end"]:
                    found[place] = r["_inner"]
                    if rest > r["_start"]:
                        still[place] = (r["_inner"], rest - r["_start"])
        open_at = still
    return [found[p] for p in places]


def before(digest: Column, bound: str | None) -> Column:
    """Whether a digest stands before a bound of ``digests_at``."""
    return F.lit(True) if bound is None else digest < bound


def positions(df: DataFrame, key: Column, name: str = "position", seed: int = 42) -> DataFrame:
    """Add the 0-based position of every row in the shuffled order.

    ``key`` must identify a row. The first four hex digits split the rows into up
    to 65,536 ranges that are already in order: counting them gives each range its
    offset, and only rows of one range are numbered together. The offset table is
    broadcast because its size is fixed by the number of ranges.
    """
    keyed = df.withColumn("_key", shuffle_key(key, seed)).withColumn(
        "_range", F.left("_key", F.lit(4))
    )
    # counted from the key alone, so the scan behind it reads no other column
    counts = (
        df.select(F.left(shuffle_key(key, seed), F.lit(4)).alias("_range")).groupBy("_range").count()
    )
    offsets = counts.select(
        "_range",
        (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_offset"),
    )
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_key"))
    return (
        keyed.withColumn("_within", within)
        .join(F.broadcast(offsets), "_range")
        .withColumn(name, F.col("_offset") + F.col("_within") - 1)
        .drop("_key", "_range", "_offset", "_within")
    )


def cap_per_group(
    df: DataFrame, group: str, key: Column, n: int = 1000, seed: int = 42, spread: int = 64
) -> DataFrame:
    """First ``n`` rows of each group in the shuffled order (all rows of smaller groups).

    A first pass over the group and key columns counts digest ranges per group and
    finds the range that reaches ``n``; rows beyond it are dropped where they are
    read, so a group holding a third of the table sends only about ``n`` rows. What
    is left is ranked twice, first within ``spread`` parts of each group, so that even
    many copies of one key are never sorted by one task. The limits (one row per group)
    are written to the shared folder when this is called: their size is then known, and
    a small one is broadcast instead of shuffling the table by group.
    """
    keyed = df.withColumn("_key", shuffle_key(key, seed)).withColumn(
        "_range", F.left("_key", F.lit(4))
    )
    ranges = (
        df.select(group, F.left(shuffle_key(key, seed), F.lit(4)).alias("_range"))
        .groupBy(group, "_range")
        .count()
    )
    running = F.sum("count").over(Window.partitionBy(group).orderBy("_range"))
    # last range still needed: the first one at which the running count reaches n
    limits = materialise(
        ranges.withColumn("_running", running)
        .groupBy(F.col(group).alias("_group"))
        .agg(F.min(F.when(F.col("_running") >= n, F.col("_range"))).alias("_last")),
        "limits",
    )
    near = keyed.join(limits, F.col(group).eqNullSafe(F.col("_group")), "inner").where(
        F.col("_last").isNull() | (F.col("_range") <= F.col("_last"))
    )
    part = near.withColumn("_part", F.spark_partition_id() % spread)
    first = F.row_number().over(Window.partitionBy(group, "_part").orderBy("_key"))
    final = F.row_number().over(Window.partitionBy(group).orderBy("_key"))
    return (
        part.withColumn("_rank", first)
        .where(F.col("_rank") <= n)
        .withColumn("_rank", final)
        .where(F.col("_rank") <= n)
        .drop("_key", "_range", "_group", "_last", "_part", "_rank")
    )


def keys_at(df: DataFrame, key: Column, picks: DataFrame, rows: int, seed: int = 42) -> DataFrame:
    """``picks``, with the key (``_picked``) at position ``_pick`` of the shuffled order.

    Keys are counted by digest range first, at most 65,536 of them. A pick finds its range through
    cells of equal width, into which the ranges are cut (twice as many rows at most), and only keys
    of ranges with a pick are then shuffled and numbered. ``key`` must identify a row, ``rows`` is
    their number; picks behind the last row go.
    """
    keys = df.select(key.alias("_picked"), shuffle_key(key, seed).alias("_key")).withColumn(
        "_range", F.left("_key", F.lit(4))
    )
    width = max(1, -(-rows // 65_536))
    end = F.sum("count").over(Window.orderBy("_range"))
    ranges = keys.groupBy("_range").count().withColumn("_end", end)
    ranges = ranges.select("_range", (F.col("_end") - F.col("count")).alias("_start"), "_end")
    first, last = F.expr(f"_start div {width}"), F.expr(f"(_end - 1) div {width}")
    cells = ranges.withColumn("_cell", F.explode(F.sequence(first, last)))
    located = (
        picks.withColumn("_cell", F.expr(f"_pick div {width}"))
        .join(F.broadcast(cells), "_cell")
        .where((F.col("_start") <= F.col("_pick")) & (F.col("_pick") < F.col("_end")))
        .withColumn("_within", F.col("_pick") - F.col("_start"))
        .drop("_cell", "_start", "_end")
    )
    wanted = keys.join(F.broadcast(located.select("_range").distinct()), "_range", "left_semi")
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_key")).cast("long") - 1
    return located.join(wanted.withColumn("_within", place), ["_range", "_within"]).drop(
        "_range", "_within", "_key"
    )


def bootstrap(
    df: DataFrame, key: Column, draws: int, subsets: int, rows: int, seed: int = 42
) -> DataFrame:
    """Samples with replacement: ``subsets`` times ``draws`` rows out of ``rows``.

    Adds ``subset`` and ``draw``. Each draw picks a position by hash. Only keys of digest
    ranges with a draw are numbered, and only picked keys are joined to the rows, so other
    columns are never shuffled for it while the picks, at most ``subsets * draws`` rows, are
    few enough to be broadcast (PICKS_SENT); beyond that, rows are shuffled by key once.
    ``key`` must identify a row.
    """
    spark = df.sparkSession
    picks = spark.range(subsets * draws).select(
        F.floor(F.col("id") / draws).cast("int").alias("subset"),
        (F.col("id") % draws).alias("draw"),
    )
    label = F.concat_ws("/", F.col("subset").cast("string"), F.col("draw").cast("string"))
    picks = picks.withColumn("_pick", hash_number(label, seed, digits=12) % rows)
    chosen = keys_at(df, key, picks, rows, seed).select("subset", "draw", "_picked")
    if subsets * draws <= PICKS_SENT:
        chosen = F.broadcast(chosen)
    keyed = df.withColumn("_key", key)
    same = F.col("_key").eqNullSafe(F.col("_picked"))
    return keyed.join(chosen, same).drop("_key", "_picked")
