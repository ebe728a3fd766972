"""Satisfaction labels per language and their independence test."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tertulia.operators.contingency import (
    chi2_independence,
    drop_small,
    expected_counts,
    label_counts,
    residuals,
)

NAMES = ["yes", "no", "na"]


def table(df: DataFrame) -> DataFrame:
    """Counts and shares per language, last language first."""
    return label_counts(df, "lang", "satisfaction_label").orderBy(F.desc("lang"))


def bars(counts: DataFrame) -> DataFrame:
    """The same table, most satisfied language first."""
    return counts.orderBy(F.desc("percentage_yes"), "lang")


def expected(counts: DataFrame) -> DataFrame:
    return expected_counts(counts, NAMES)


def kept(counts: DataFrame, min_expected: float = 10) -> DataFrame:
    return drop_small(counts, NAMES, min_expected)


def independence(counts: DataFrame, min_expected: float = 10) -> DataFrame:
    """Languages with small expected counts are dropped, then expectations are
    recomputed from the rest."""
    return chi2_independence(kept(counts, min_expected), NAMES)


def residual_table(counts: DataFrame, min_expected: float = 10) -> DataFrame:
    return residuals(kept(counts, min_expected), "lang", NAMES)
