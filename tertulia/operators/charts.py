"""The tables behind the figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tertulia.operators.distribution import AUTO, quantiles, stored, value_histogram


def log_bars(counts: DataFrame, count: str) -> DataFrame:
    """Bar heights on a logarithmic axis."""
    return counts.withColumn(f"log10_{count}", F.log10(F.nullif(F.col(count), F.lit(0))))


def score_histogram(df: DataFrame, by: Sequence[str], value: str, width: float = 0.01) -> DataFrame:
    """Rows per bin of ``width``; the bin is named by its lower edge's index.

    Rounding to nine digits keeps a value that lies on an edge in the bin above it.
    """
    bins = df.withColumn("bin", F.floor(F.round(F.col(value) / width, 9)).cast("long"))
    return value_histogram(bins, by, "bin")


def violin(df: DataFrame, by: str, value: str, buckets: int | None = AUTO) -> DataFrame:
    """Rows, extremes, median and mean per group."""
    hist = value_histogram(df, [by], value)
    if buckets is not None:
        hist = stored(hist)
    middle = quantiles(hist, [by], {"median": 0.5}, value, buckets=buckets, is_stored=buckets is not None)
    n, v = F.col("n").cast("double"), F.col(value).cast("double")
    rest = hist.groupBy(F.col(by).alias("_by")).agg(
        F.sum("n").alias("rows"),
        F.min(v).alias("minimum"),
        F.max(v).alias("maximum"),
        (F.sum(n * v) / F.sum(n)).alias("mean"),
    )
    return middle.join(rest, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def density(df: DataFrame, by: str, value: str, points: int = 100) -> DataFrame:
    """Gaussian kernel density per group on an even grid from minimum to maximum.

    The bandwidth is the deviation times n**(-1/5). Distinct values with counts
    stand in for rows, and each contributes once per grid point, so the work is
    linear in distinct values; round a continuous score first. A group without spread
    has no density.
    """
    hist = stored(value_histogram(df, [by], value))
    n, v = F.col("n").cast("double"), F.col(value).cast("double")
    moments = hist.groupBy(F.col(by).alias("_by")).agg(
        F.sum(n).alias("_rows"),
        F.min(v).alias("_min"),
        F.max(v).alias("_max"),
        F.sum(n * v).alias("_sum"),
        F.sum(n * v * v).alias("_squares"),
    )
    rows = F.col("_rows")
    spread = F.try_divide(F.col("_squares") - F.col("_sum") * F.col("_sum") / rows, rows - 1)
    stats = stored(
        moments.where(F.col("_max") > F.col("_min"))
        .withColumn("_h", F.sqrt(spread) * F.pow(rows, F.lit(-0.2)))
        .drop("_sum", "_squares")
    )
    grid = (
        hist.join(stats, F.col(by).eqNullSafe(F.col("_by")))
        .select(
            by, "n", v.alias("_v"), "_rows", "_min", "_max", "_h",
            F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"),
        )
        .withColumn(
            "x",
            F.col("_min") + (F.col("_max") - F.col("_min")) * F.col("point") / float(points - 1),
        )
    )
    u = (F.col("x") - F.col("_v")) / F.col("_h")
    weight = n * F.exp(-0.5 * u * u) / (
        F.col("_rows") * F.col("_h") * F.sqrt(F.lit(2.0) * F.pi())
    )
    return grid.groupBy(by, "point").agg(F.min("x").alias("x"), F.sum(weight).alias("density"))


def density_binned(
    df: DataFrame, by: str, value: str, points: int = 100, steps: int = 32
) -> DataFrame:
    """``density`` of a continuous score, without a row per distinct value.

    Each row is shared between the two nearest points of a grid with ``steps`` points a
    bandwidth, in proportion to how near they are, and the sums per grid point are spread instead
    of the rows. These sums are formed before anything moves; a group has at most
    ``steps`` times its range in bandwidths of them. The result differs from the direct sum
    by at most ``error``, which is 1 / (8 steps^2) of the kernel's peak: linear
    interpolation of a function errs by an eighth of the squared grid width times its largest
    second derivative. The frame is read twice, once for the bandwidth. Null and NaN
    values are left out and a group without spread has no density.
    """
    v = F.col(value).cast("double")
    known = df.select(F.col(by).alias("_by"), v.alias("_v")).where("NOT coalesce(isnan(_v) OR _v IS NULL, true)")
    rows = F.col("_rows")
    stats = stored(
        known.groupBy("_by")
        .agg(
            F.count(F.lit(1)).cast("double").alias("_rows"),
            F.min("_v").alias("_min"),
            F.max("_v").alias("_max"),
            F.stddev_samp("_v").alias("_spread"),
        )
        .where("_max > _min")
        .select(F.col("_by").alias(by), "_rows", "_min", "_max", (F.col("_spread") * F.pow(rows, F.lit(-0.2))).alias("_h"))
    )
    place = (F.col("_v") - F.col("_min")) * steps / F.col("_h")
    share = F.col("_place") - F.floor("_place")
    ends = F.array(
        F.struct(F.floor("_place").alias("bin"), (1 - share).alias("weight")),
        F.struct((F.floor("_place") + 1).alias("bin"), share.alias("weight")),
    )
    bins = (
        known.join(stats, F.col(by).eqNullSafe(F.col("_by")))
        .withColumn("_place", place)
        .select(by, F.inline(ends))
        .where("weight > 0")
        .groupBy(F.col(by).alias("_by"), "bin")
        .agg(F.sum("weight").alias("weight"))
    )
    width = (F.col("_max") - F.col("_min")) / float(points - 1)
    spread = bins.join(stats, F.col(by).eqNullSafe(F.col("_by"))).select(
        by, "bin", "weight", "_rows", "_min", "_h", width.alias("_width"),
        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"),
    )
    u = F.col("point") * F.col("_width") / F.col("_h") - F.col("bin") / float(steps)
    peak = 1 / (F.col("_h") * F.sqrt(F.lit(2.0) * F.pi()))
    return spread.groupBy(by, "point").agg(
        F.min(F.col("_min") + F.col("point") * F.col("_width")).alias("x"),
        F.sum(F.col("weight") / F.col("_rows") * peak * F.exp(-0.5 * u * u)).alias("density"),
        F.min(peak / (8.0 * steps * steps)).alias("error"),
    )
