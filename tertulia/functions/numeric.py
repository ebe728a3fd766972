"""Row-wise numeric expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def round_half_away(x: Column, digits: int) -> Column:
    """Scale, round half away from zero, scale back.

    Spark's ``round`` works on the decimal text of the double, which moves values
    such as 0.145 to the next hundredth; ties decide ranks, so the arithmetic rule
    is kept.
    """
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def row_sum(columns: list[Column]) -> Column:
    """Sum that counts nulls as zero."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in columns])


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null when b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))
