"""Kruskal-Wallis and Dunn tests for many measures in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tertulia.operators.columns import listed
from tertulia.functions.numeric import round_half_away
from tertulia.functions.tails import chi2_sf, normal_two_sided
from tertulia.operators.distribution import AUTO, mid_rank, running_counts, stored, value_histogram


def long_measures(
    df: DataFrame, group: str, measures: Sequence[str], digits: int | None = None
) -> DataFrame:
    """Wide measures to (measure, group, value), optionally rounded."""
    value = F.col("value") if digits is None else round_half_away(F.col("value"), digits)
    quoted = [f"`{m}`" for m in measures]
    long = df.select(group, *quoted).unpivot([group], quoted, "measure", "value")
    return long.withColumn("value", value)


def ranked_histogram(
    long: DataFrame, group: str, buckets: int | None = AUTO
) -> DataFrame:
    """(measure, group, value, n) with the mid-rank of the value within its measure."""
    hist = value_histogram(long, ["measure", group])
    return running_counts(hist, ["measure"], buckets=buckets).withColumn("mid_rank", mid_rank())


def rank_sums(ranked: DataFrame, group: str) -> DataFrame:
    """Rows and rank sum per measure and group.

    ``tie_share`` spreads each value's tie term over the groups it occurs in, so
    that its sum over groups is the tie term of the measure.
    """
    n, ties = F.col("n").cast("double"), F.col("ties").cast("double")
    return ranked.groupBy("measure", group).agg(
        F.sum("n").alias("n"),
        F.sum(n * F.col("mid_rank")).alias("rank_sum"),
        F.sum(n * (ties * ties - 1)).alias("tie_share"),
    )


def kruskal_wallis(sums: DataFrame, group: str) -> DataFrame:
    """H statistic with tie correction and its p-value, one row per measure.

    Null when all values of a measure tie or fewer than two groups have rows.
    """
    # squares about the mean rank: the textbook difference of two sums loses all digits
    # of H when there are very many rows
    n, whole = F.col("n").cast("double"), F.sum("n").over(Window.partitionBy("measure"))
    gap = F.col("rank_sum") / n - (F.col("total") + 1) / 2.0
    totals = (
        sums.withColumn("total", whole.cast("double"))
        .groupBy("measure")
        .agg(
            F.first("total").alias("total"),
            F.count(F.lit(1)).alias("groups"),
            F.sum(n * gap * gap).alias("squares"),
            F.sum("tie_share").alias("tie_term"),
        )
    )
    t = F.col("total")
    raw = 12.0 / (t * (t + 1)) * F.col("squares")
    correction = 1.0 - F.try_divide(F.col("tie_term"), t * t * t - t)
    h = F.when((F.col("groups") > 1) & (t > 1) & (correction > 0), F.try_divide(raw, correction))
    out = totals.select("measure", h.alias("h_statistic"), (F.col("groups") - 1).alias("df"))
    return out.withColumn("p_value", chi2_sf(F.col("h_statistic"), F.col("df")))


def dunn(sums: DataFrame, group: str, alpha: float = 0.05) -> DataFrame:
    """Dunn's z and Bonferroni-adjusted p for every two groups of each measure.

    The self-join runs over one row per measure and group, not over raw rows. These
    rows are written first: three branches read them, and the filters a join pushes
    into each would otherwise make every branch scan the source again.
    """
    sums = stored(sums)
    totals = sums.groupBy("measure").agg(
        F.sum("n").cast("double").alias("total"),
        F.count(F.lit(1)).alias("groups"),
        F.sum("tie_share").alias("tie_term"),
    )

    def side(name: str) -> DataFrame:
        return sums.select(
            F.col("measure").alias(f"measure_{name}"),
            F.col(group).alias(f"{group}_{name}"),
            F.col("n").cast("double").alias(f"n_{name}"),
            (F.col("rank_sum") / F.col("n")).alias(f"mean_rank_{name}"),
        )

    a, b = side("a"), side("b")
    pairs = a.join(
        b,
        (F.col("measure_a") == F.col("measure_b")) & (F.col(f"{group}_a") < F.col(f"{group}_b")),
    ).join(totals, F.col("measure_a") == F.col("measure"))
    t, k = F.col("total"), F.col("groups")
    variance = (t * (t + 1) / 12.0 - F.try_divide(F.col("tie_term"), 12.0 * (t - 1))) * (
        1.0 / F.col("n_a") + 1.0 / F.col("n_b")
    )
    z = F.when(
        variance > 0, F.abs(F.col("mean_rank_a") - F.col("mean_rank_b")) / F.sqrt(variance)
    )
    p = F.least(F.lit(1.0), normal_two_sided(F.col("z")) * k * (k - 1) / 2.0)
    return (
        pairs.withColumn("z", z)
        .withColumn("p_value", F.when(F.col("z").isNotNull(), p))
        .select(
            "measure",
            f"{group}_a",
            f"{group}_b",
            "z",
            "p_value",
            (F.col("p_value") < alpha).alias("significant"),
        )
    )


def square(pairs: DataFrame, group: str) -> DataFrame:
    """Both triangles of a pair table plus the diagonal, still in long form."""
    a, b = f"{group}_a", f"{group}_b"
    entries = pairs.select(
        "measure",
        F.explode(
            F.array(
                F.struct(F.col(a).alias("row"), F.col(b).alias("col"), F.col("p_value").alias("p")),
                F.struct(F.col(b).alias("row"), F.col(a).alias("col"), F.col("p_value").alias("p")),
            )
        ).alias("e"),
    ).select("measure", "e.*")
    diagonal = entries.select("measure", "row").distinct().select(
        "measure", "row", F.col("row").alias("col"), F.lit(1.0).alias("p")
    )
    return entries.unionByName(diagonal)


def matrix(
    long: DataFrame, columns: Sequence[str] | None = None, label: str = "lang"
) -> DataFrame:
    """Long square table of one measure to a labelled wide matrix, with a column per group
    of the data or per listed group; a group that is not listed stops the job."""
    if columns is not None:
        long = long.withColumn("col", listed(F.col("col"), columns, "group"))
    return (
        long.groupBy(F.col("row").alias(label))
        .pivot("col", None if columns is None else list(columns))
        .agg(F.first("p"))
    )
