"""Label counts per group, chi-squared test of independence, effect size, residuals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tertulia.functions.numeric import ratio, row_sum
from tertulia.functions.tails import chi2_sf
from tertulia.operators.columns import listed
from tertulia.schema import SATISFACTION_LABELS


def label_counts(
    df: DataFrame, group: str, label: str, labels: list[str] = SATISFACTION_LABELS
) -> DataFrame:
    """Counts, total and shares of each label per group; rows without a label are ignored.

    The labels are listed, so one that never occurs is a column of zeros, and one that
    is not listed stops the job instead of being left out of the totals.
    """
    wide = (
        df.where(F.col(label).isNotNull())
        .select(F.col(group), listed(F.col(label), labels, "label").alias(label))
        .groupBy(group)
        .pivot(label, labels)
        .agg(F.count(label))
        .na.fill(0)
    )
    names = [name.lower() for name in labels]
    wide = wide.select(
        group, *[F.col(label_).alias(f"count_{name}") for label_, name in zip(labels, names)]
    )
    total = row_sum([F.col(f"count_{name}") for name in names])
    wide = wide.withColumn("total", total)
    return wide.withColumns(
        {f"percentage_{name}": ratio(F.col(f"count_{name}"), F.col("total")) for name in names}
    )


def _add(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def expected_counts(counts: DataFrame, names: list[str]) -> DataFrame:
    """Add ``expected_<name>``: row total times column total over grand total.

    ``counts`` has one row per group, so the unpartitioned window stays small.
    """
    whole = Window.partitionBy()
    total = _add([F.col(f"count_{n}") for n in names])
    grand = F.sum(total).over(whole).cast("double")
    return counts.withColumns(
        {
            f"expected_{n}": F.try_divide(
                total * F.sum(f"count_{n}").over(whole).cast("double"), grand
            )
            for n in names
        }
    )


def drop_small(counts: DataFrame, names: list[str], min_expected: float = 10) -> DataFrame:
    """Groups whose expected counts, before dropping, are all above ``min_expected``."""
    kept = expected_counts(counts, names)
    for n in names:
        kept = kept.where(F.col(f"expected_{n}") > min_expected)
    return kept.drop(*[f"expected_{n}" for n in names])


def chi2_independence(counts: DataFrame, names: list[str]) -> DataFrame:
    """One row: chi-squared statistic, degrees, p-value, rows, observations, Cramér's V.

    Yates' correction applies to one degree of freedom only. A single group gives
    statistic 0, 0 degrees and p 1.
    """
    table = expected_counts(counts, names)
    groups = F.count(F.lit(1)).over(Window.partitionBy())
    columns = len(names)
    yates = (groups - 1) * (columns - 1) == 1
    cells = []
    for n in names:
        gap = F.abs(F.col(f"count_{n}") - F.col(f"expected_{n}"))
        gap = F.when(F.col("_yates"), gap - F.least(F.lit(0.5), gap)).otherwise(gap)
        cells.append(F.try_divide(gap * gap, F.col(f"expected_{n}")))
    observed = _add([F.col(f"count_{n}") for n in names])
    out = (
        table.withColumn("_yates", yates)
        .agg(
            F.sum(_add(cells)).alias("statistic"),
            F.count(F.lit(1)).alias("groups"),
            F.sum(observed).alias("observations"),
        )
        .withColumn("dof", F.greatest((F.col("groups") - 1) * (columns - 1), F.lit(0)))
    )
    smaller = F.least(F.col("groups") - 1, F.lit(columns - 1))
    return out.withColumns(
        {
            "p_value": chi2_sf(F.col("statistic"), F.col("dof")),
            "cramers_v": F.when(
                smaller > 0, F.sqrt(F.col("statistic") / F.col("observations") / smaller)
            ),
        }
    ).select("statistic", "dof", "p_value", "cramers_v", "groups", "observations")


def residuals(counts: DataFrame, group: str, names: list[str]) -> DataFrame:
    """Pearson residuals in long form: (group, label, observed, expected, residual)."""
    cells = [
        F.struct(
            F.lit(n.upper()).alias("label"),
            F.col(f"count_{n}").alias("observed"),
            F.col(f"expected_{n}").alias("expected"),
            F.try_divide(
                F.col(f"count_{n}") - F.col(f"expected_{n}"), F.sqrt(f"expected_{n}")
            ).alias("residual"),
        )
        for n in names
    ]
    return expected_counts(counts, names).select(group, F.inline(F.array(*cells)))


def transposed(long: DataFrame, group: str, groups: list[str] | None = None) -> DataFrame:
    """Residuals with one row per label and one column per group of the data, or per
    listed group; a group that is not listed stops the job."""
    if groups is not None:
        long = long.withColumn(group, listed(F.col(group), groups, "group"))
    return long.groupBy("label").pivot(group, groups).agg(F.first("residual"))
