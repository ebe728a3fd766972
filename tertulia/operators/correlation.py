"""Pearson and Spearman correlation with two-sided p-values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tertulia.functions.tails import student_t_two_sided
from tertulia.operators.distribution import AUTO, mid_rank, running_counts, stored


def _p_value(r: Column, n: Column) -> Column:
    df = (n - 2).cast("double")
    t = r * F.sqrt(F.try_divide(df, 1.0 - r * r))
    return (
        F.when(r.isNull() | (n < 2), F.lit(None).cast("double"))
        .when(n == 2, F.lit(1.0))
        .when(F.abs(r) >= 1.0, F.lit(0.0))
        .otherwise(student_t_two_sided(t, df))
    )


def _both_known(df: DataFrame, x: str, y: str) -> DataFrame:
    pair = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return pair.where(
        F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    )


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: correlation, p-value and number of rows."""
    out = _both_known(df, x, y).agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))
    return out.select(
        F.lit("pearson").alias("method"),
        "r",
        _p_value(F.col("r"), F.col("n")).alias("p_value"),
        "n",
    )


def distinct_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct (x, y) and the number of rows with them."""
    return _both_known(df, x, y).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


def pearson_of_pairs(pairs: DataFrame) -> DataFrame:
    """``pearson`` from written distinct pairs; sums are taken about the means, which are two
    numbers of a first pass over the pairs."""
    n = F.col("n").cast("double")
    means = pairs.agg(F.sum(n * F.col("x")) / F.sum(n), F.sum(n * F.col("y")) / F.sum(n)).first()
    u, v = (F.col(c) - F.lit(m).cast("double") for c, m in zip(("x", "y"), means, strict=True))
    sums = pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.sum(n * u * v).alias("uv"),
        F.sum(n * u * u).alias("uu"),
        F.sum(n * v * v).alias("vv"),
    )
    spread = F.nullif(F.sqrt(F.col("uu")) * F.sqrt(F.col("vv")), F.lit(0.0))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.col("uv"), spread)))
    out = sums.select(F.when(spread.isNotNull(), r).alias("r"), "n")
    return out.select(
        F.lit("pearson").alias("method"),
        "r",
        _p_value(F.col("r"), F.col("n")).alias("p_value"),
        "n",
    )


def spearman(df: DataFrame, x: str, y: str, buckets: int | None = AUTO) -> DataFrame:
    """One row: rank correlation with mid-ranks for ties, p-value and number of rows.

    Rows are first reduced to distinct (x, y) with a count, so a value shared by
    many rows is one row (per partner value) before it is joined to its rank.
    """
    pairs = distinct_pairs(df, x, y)
    return spearman_of_pairs(pairs if buckets is None else stored(pairs), buckets)


def spearman_of_pairs(pairs: DataFrame, buckets: int | None = AUTO) -> DataFrame:
    """``spearman`` from distinct pairs, which are read three times."""
    hist = (
        pairs.select(
            F.inline(
                F.array(
                    F.struct(F.lit("x").alias("side"), F.col("x").alias("value"), "n"),
                    F.struct(F.lit("y").alias("side"), F.col("y").alias("value"), "n"),
                )
            )
        )
        .groupBy("side", "value")
        .agg(F.sum("n").alias("n"))
    )
    ranks = running_counts(hist, ["side"], buckets=buckets).withColumn("rank", mid_rank())
    rank_x = ranks.where(F.col("side") == "x").select(
        F.col("value").alias("x"), F.col("rank").alias("rx")
    )
    rank_y = ranks.where(F.col("side") == "y").select(
        F.col("value").alias("y"), F.col("rank").alias("ry")
    )
    joined = pairs.join(rank_x, "x").join(rank_y, "y")
    n, rx, ry = F.col("n").cast("double"), F.col("rx"), F.col("ry")
    sums = joined.agg(
        F.sum("n").alias("n"),
        F.sum(n * rx).alias("sx"),
        F.sum(n * ry).alias("sy"),
        F.sum(n * rx * ry).alias("sxy"),
        F.sum(n * rx * rx).alias("sxx"),
        F.sum(n * ry * ry).alias("syy"),
    )
    size = F.col("n").cast("double")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / size
    var_x = F.col("sxx") - F.col("sx") * F.col("sx") / size
    var_y = F.col("syy") - F.col("sy") * F.col("sy") / size
    r = F.try_divide(cov, F.nullif(F.sqrt(var_x * var_y), F.lit(0.0)))
    # least() passes over a null, so a side without spread is kept out of it
    bounded = F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    out = sums.select(bounded.alias("r"), "n")
    return out.select(
        F.lit("spearman").alias("method"),
        "r",
        _p_value(F.col("r"), F.col("n")).alias("p_value"),
        "n",
    )


def correlations(df: DataFrame, x: str, y: str, buckets: int | None = AUTO) -> DataFrame:
    """Both, from one scan of ``df``: all but its distinct pairs is read once."""
    pairs = stored(distinct_pairs(df, x, y))
    return pearson_of_pairs(pairs).unionByName(spearman_of_pairs(pairs, buckets))
