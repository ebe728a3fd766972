"""Grouped means, deviations and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tertulia.operators.distribution import AUTO, quantiles, value_histogram


def mean_and_std(
    df: DataFrame,
    by: Sequence[str],
    columns: Sequence[str],
    mean: str = "avg_{}",
    std: str = "std_{}",
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Mean and sample deviation of every column per group, in one aggregation."""
    aggregates = []
    for c in columns:
        aggregates.append(F.expr(f"avg(`{c}`) AS `{mean.format(c)}`"))
        aggregates.append(F.expr(f"stddev_samp(`{c}`) AS `{std.format(c)}`"))
    aggregates.extend(extra)
    return df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)


def count_per_group(df: DataFrame, by: str, name: str) -> DataFrame:
    """Rows per group; the null group keeps its row, with a count of 0."""
    return df.groupBy(by).agg(F.count(by).alias(name))


def mean_and_std_with_total(
    df: DataFrame,
    by: str,
    role: str,
    columns: Sequence[str],
    total: str = "all",
    mean: str = "avg_{}",
    std: str = "std_{}",
) -> DataFrame:
    """Mean and sample deviation per (by, role) and for all roles together.

    Raw rows are aggregated once, to count, mean and squared deviations per column.
    The rows for ``total`` are merged from those few rows, so the input is not
    doubled.
    """
    parts = []
    for i, c in enumerate(columns):
        parts += [
            F.expr(f"count(`{c}`) AS n{i}"),
            F.expr(f"avg(`{c}`) AS m{i}"),
            F.expr(f"var_pop(`{c}`) * count(`{c}`) AS s{i}"),
        ]
    stacked = ", ".join(f"{i}, n{i}, m{i}, s{i}" for i in range(len(columns)))
    moments = df.groupBy(by, role).agg(*parts).selectExpr(
        by,
        f"explode(array({role}, '{total}')) AS {role}",
        f"stack({len(columns)}, {stacked}) AS (_column, n, m, s)",
    )
    # pooled mean first: squared deviations are then shifted to it without cancellation
    same = Window.partitionBy(by, role, "_column")
    pooled = F.try_divide(F.sum(F.col("n") * F.col("m")).over(same), F.sum("n").over(same))
    merged = moments.withColumn("mean", pooled).groupBy(by, role, "_column").agg(
        F.first("mean").alias("mean"),
        F.sum("n").alias("n"),
        F.expr("sum(s + n * (m - mean) * (m - mean))").alias("squares"),
    )
    std_expr = "CASE WHEN n > 1 THEN sqrt(squares / (n - 1)) END"
    out = []
    for i, c in enumerate(columns):
        out.append(F.expr(f"max(CASE WHEN _column = {i} THEN mean END) AS `{mean.format(c)}`"))
        out.append(
            F.expr(f"max(CASE WHEN _column = {i} THEN {std_expr} END) AS `{std.format(c)}`")
        )
    return merged.groupBy(by, role).agg(*out)


def mode(df: DataFrame, by: Sequence[str], label: str, name: str = "mode") -> DataFrame:
    """Most frequent label per group, the smallest one on ties."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.groupBy(*by).agg(
        F.min_by(label, F.struct((-F.col("n")).alias("n"), F.col(label).alias("l"))).alias(name)
    )


def category_codes(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """Distinct values with their index in sorted order divided by their number."""
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    # the window sees one row per distinct value of a small category column
    order = Window.orderBy(column)
    whole = Window.partitionBy()
    return distinct.select(
        column,
        (F.row_number().over(order) - 1).alias("index"),
        F.count(F.lit(1)).over(whole).alias("values"),
    ).select(column, "index", (F.col("index") / F.col("values")).alias(name))


def five_numbers(df: DataFrame, by: str, column: str, buckets: int | None = AUTO) -> DataFrame:
    """Minimum, quartiles and maximum per group (linear interpolation)."""
    hist = value_histogram(df.select(by, F.col(column).alias("_value")), [by], "_value")
    return quantiles(
        hist,
        [by],
        {"minimum": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "maximum": 1.0},
        "_value",
        buckets=buckets,
    )
