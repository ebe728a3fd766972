"""Value histograms, running counts, mid-ranks and quantiles.

A histogram (value, count) replaces the raw rows: copies of a value collapse on the
map side. Ranks and quantiles are then read off running counts. With few distinct
values one window per measure is enough; otherwise values are cut into ordered
buckets whose totals give offsets, so no task sees all values of a measure.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tertulia.sources.corpus import materialise

AUTO = -1


def bucket_count(df: DataFrame, buckets: int) -> int:
    """``AUTO`` means one bucket per shuffle partition, so that it grows with the cluster."""
    if buckets != AUTO:
        return max(buckets, 1)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 32)


def stored(df: DataFrame) -> DataFrame:
    """A small or expensive intermediate, written once."""
    return materialise(df, "distribution")


def value_histogram(
    df: DataFrame, by: Sequence[str], value: str = "value", count: str = "n"
) -> DataFrame:
    """Number of rows per ``by`` and value; null and NaN values are left out."""
    known = df.where(f"NOT coalesce(isnan(CAST(`{value}` AS DOUBLE)) OR `{value}` IS NULL, true)")
    return known.groupBy(*by, value).agg(F.count(F.lit(1)).alias(count))


def running_counts(
    hist: DataFrame,
    by: Sequence[str],
    value: str = "value",
    count: str = "n",
    buckets: int | None = AUTO,
    is_stored: bool = False,
) -> DataFrame:
    """Add ``ties`` (rows with this value), ``upto`` (rows with this value or less) and
    ``size`` (all rows), each per ``by``.

    Rows of ``hist`` that share ``by`` and value (such as one per language) tie.
    ``buckets=None`` states that each ``by`` has few distinct values; otherwise a task
    sees about a ``buckets``-th of the distinct values of one ``by``. The histogram and
    the two small tables joined to it are then written to the shared folder: the source
    is scanned once, and the joins are planned from known sizes, so the histogram is
    not shuffled by ``by`` alone, where one group may hold most of it. ``is_stored`` says
    that the histogram is such a written one already.
    """
    by = list(by)
    if buckets is None:
        upto = F.sum(count).over(Window.partitionBy(*by).orderBy(value))
        ties = F.sum(count).over(Window.partitionBy(*by, value))
        size = F.sum(count).over(Window.partitionBy(*by))
        return hist.withColumns({"upto": upto, "ties": ties, "size": size})

    hist = hist if is_stored else stored(hist)
    size = bucket_count(hist, buckets)
    stride = math.isqrt(size) + 1
    cuts = ", ".join(f"{i / size}D" for i in range(1, size)) or "0.5D"
    sketch = f"percentile_approx(CAST(`{value}` AS DOUBLE), array({cuts}), {max(10000, 20 * size)})"
    bounds = stored(
        hist.groupBy(*by)
        .agg(F.expr(f"{sketch} AS _bounds"))
        .withColumn("_coarse", F.expr(f"filter(_bounds, (b, i) -> (i + 1) % {stride} = 0)"))
    )
    # bounds below the value, counted in steps of ``stride`` first, then within one step
    steps = f"size(filter(_coarse, b -> b < CAST(`{value}` AS DOUBLE))) * {stride}"
    placed = (
        _join(hist, bounds, by)
        .withColumn("_step", F.expr(steps))
        .withColumn(
            "_bucket",
            F.expr(
                f"_step + size(filter(slice(_bounds, _step + 1, {stride}), "
                f"b -> b < CAST(`{value}` AS DOUBLE)))"
            ),
        )
        .drop("_bounds", "_coarse", "_step")
    )
    totals = placed.groupBy(*by, "_bucket").agg(F.sum(count).alias("_total"))
    offsets = totals.select(
        *by,
        "_bucket",
        (
            F.sum("_total").over(Window.partitionBy(*by).orderBy("_bucket")) - F.col("_total")
        ).alias("_offset"),
        F.sum("_total").over(Window.partitionBy(*by)).alias("size"),
    )
    offsets = stored(offsets)
    # both windows share the shuffle on (by, bucket)
    upto = F.sum(count).over(Window.partitionBy(*by, "_bucket").orderBy(value))
    ties = F.sum(count).over(Window.partitionBy(*by, "_bucket", value))
    ranked = placed.withColumns({"_within": upto, "ties": ties})
    return (
        _join(ranked, offsets, [*by, "_bucket"])
        .withColumn("upto", F.col("_offset") + F.col("_within"))
        .drop("_bucket", "_offset", "_within")
    )


def _join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Null-safe join on ``on``. A null group is a group, as in ``groupBy``."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    condition = None
    for c in on:
        equal = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        condition = equal if condition is None else condition & equal
    return left.join(renamed, condition).drop(*[f"_r_{c}" for c in on])


def mid_rank() -> Column:
    """Average rank of tied values, from the columns of ``running_counts``."""
    return F.col("upto") - F.col("ties") + (F.col("ties") + 1) / 2.0


def quantiles(
    hist: DataFrame,
    by: Sequence[str],
    probabilities: dict[str, float],
    value: str = "value",
    count: str = "n",
    method: str = "linear",
    buckets: int | None = AUTO,
    is_stored: bool = False,
) -> DataFrame:
    """Exact quantiles per group, one column per entry of ``probabilities``.

    ``linear`` interpolates between neighbours; ``nearest`` takes the row at
    round((n - 1) * q), halves away from zero.
    """
    by = list(by)
    ranked = running_counts(hist, by, value, count, buckets, is_stored)
    v = F.col(value).cast("double")

    def at(index: Column) -> Column:
        return F.min(F.when(F.col("upto") > index, v))

    columns = []
    for name, q in probabilities.items():
        place = (F.col("size") - 1) * F.lit(float(q))
        if method == "nearest":
            columns.append(at(F.floor(place + 0.5)).alias(name))
        else:
            low, high = at(F.floor(place)), at(F.ceil(place))
            fraction = F.max(place - F.floor(place))
            columns.append((low + (high - low) * fraction).alias(name))
    return ranked.groupBy(*by).agg(*columns)


def at_or_above_quantile(
    df: DataFrame, column: str, q: float, buckets: int | None = AUTO
) -> DataFrame:
    """Rows whose ``column`` reaches its nearest-rank quantile over the whole frame."""
    values = df.select(F.lit(1).alias("_all"), F.col(column).alias("_value"))
    hist = value_histogram(values, ["_all"], "_value")
    cut = quantiles(hist, ["_all"], {"_cut": q}, "_value", method="nearest", buckets=buckets)
    # one row by construction, hence the broadcast
    return df.join(
        F.broadcast(cut.select("_cut")), F.col(column).cast("double") >= F.col("_cut")
    ).drop("_cut")
