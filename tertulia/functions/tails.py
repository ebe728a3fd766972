"""Tail probabilities as Column expressions.

They are applied to rows that are already aggregated (one per test or pair), and
stay on the JVM, so no Python worker is started for a p-value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

_SQRT_PI = math.sqrt(math.pi)


def erfc(z: Column) -> Column:
    """Complementary error function for z >= 0.

    Below 2 the all-positive power series of erf is summed; from 2 on the
    continued fraction is evaluated from the inside out, which keeps the relative
    accuracy of tiny tails.
    """
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(z.alias("term"), z.alias("total")),
        lambda acc, n: F.struct(
            (acc["term"] * 2.0 * z * z / (2 * n + 1)).alias("term"),
            (acc["total"] + acc["term"] * 2.0 * z * z / (2 * n + 1)).alias("total"),
        ),
        lambda acc: 1.0 - acc["total"] * F.exp(-z * z) * (2.0 / _SQRT_PI),
    )
    fraction = F.aggregate(
        F.sequence(F.lit(120), F.lit(1)),
        z,
        lambda acc, k: z + k / (2.0 * acc),
        lambda acc: F.exp(-z * z) / (_SQRT_PI * acc),
    )
    return F.when(z < 2.0, series).otherwise(fraction)


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) for a standard normal."""
    return erfc(F.abs(z) / math.sqrt(2.0))


def chi2_sf(x: Column, df: Column) -> Column:
    """P(X >= x) for a chi-squared variable with an integer number of degrees.

    For integer degrees the upper incomplete gamma is a finite sum of positive
    terms (plus an erfc when the number is odd). Terms are carried as logarithms
    so that neither large x nor many degrees overflow.
    """
    half = x / 2.0
    odd = (df % 2) == 1
    shift = F.when(odd, F.lit(0.5)).otherwise(F.lit(0.0))
    terms = F.floor((df - F.when(odd, F.lit(1)).otherwise(F.lit(0))) / 2).cast("int")
    log_half = F.ln(half)
    # log of half**(i+shift) * exp(-half) / gamma(i+shift+1), started one step early
    first = F.when(odd, -half - 0.5 * log_half - math.log(_SQRT_PI)).otherwise(-half - log_half)
    steps = F.when(terms >= 1, F.sequence(F.lit(1), F.greatest(terms, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )
    total = F.aggregate(
        steps,
        F.struct(first.alias("log_term"), F.lit(0.0).alias("total")),
        lambda acc, i: F.struct(
            (acc["log_term"] + log_half - _log_step(i, shift)).alias("log_term"),
            (acc["total"] + F.exp(acc["log_term"] + log_half - _log_step(i, shift))).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    upper = F.when(odd, erfc(F.sqrt(half)) + total).otherwise(total)
    return (
        F.when(x.isNull() | df.isNull() | F.isnan(x), F.lit(None).cast("double"))
        .when((df <= 0) | (x <= 0), F.lit(1.0))
        .otherwise(F.least(upper, F.lit(1.0)))
    )


def _log_step(i: Column, shift: Column) -> Column:
    """log of the factor by which gamma(i+shift) grows; 0 at the start of an even sum."""
    step = i - 1 + shift
    return F.when(step > 0, F.ln(step)).otherwise(F.lit(0.0))


MANY_DEGREES = 1e6


def _near_normal(t2: Column, df: Column) -> Column:
    """The same for very many degrees: a normal deviate, right to about 1 / df**3."""
    a = df - 0.5
    y = a * F.log1p(t2 / df)
    return normal_two_sided(F.sqrt(y) * (1.0 + (y + 3.0) / (48.0 * a * a)))


def student_t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|), the regularised incomplete beta I_x(df/2, 1/2) at x = df/(df+t*t)."""
    a = df / 2.0
    t2 = t * t
    x = df / (df + t2)
    y = t2 / (df + t2)
    # gamma(a+1/2)/gamma(a): asymptotic series at a+16, stepped back down to a
    s = a + 16.0
    top = F.exp(
        0.5 * F.ln(s) - 1 / (8 * s) + 1 / (192 * F.pow(s, 3)) - 1 / (640 * F.pow(s, 5))
        + 17 / (14336 * F.pow(s, 7)) - 31 / (18432 * F.pow(s, 9))
    )
    gamma_ratio = F.aggregate(
        F.sequence(F.lit(0), F.lit(15)), top, lambda acc, i: acc * (a + i) / (a + i + 0.5)
    )
    front = F.exp(-a * F.log1p(t2 / df)) * F.sqrt(y) * gamma_ratio / _SQRT_PI
    tail = front * _beta_fraction(a, F.lit(0.5), x, df) / a
    head = 1.0 - front * _beta_fraction(F.lit(0.5), a, y, df) / 0.5
    return (
        F.when(t.isNull() | df.isNull() | (df < 1), F.lit(None).cast("double"))
        .when(t2 == 0, F.lit(1.0))
        .when(df > MANY_DEGREES, _near_normal(t2, df))
        .when(x < (a + 1) / (a + 2.5), tail)
        .otherwise(head)
    )


def _beta_fraction(a: Column, b: Column, x: Column, df: Column) -> Column:
    """Continued fraction of the incomplete beta, evaluated from the inside out.

    It needs about sqrt(max(a, b)) steps to settle.
    """
    steps = (F.lit(60) + 4 * F.sqrt(F.least(df, F.lit(MANY_DEGREES)))).cast("int")

    def coefficient(m: Column) -> tuple[Column, Column]:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return even, odd

    def fold(acc: Column, m: Column) -> Column:
        even, odd = coefficient(m.cast("double"))
        return 1.0 + even / (1.0 + odd / acc)

    inner = F.aggregate(F.sequence(steps, F.lit(1)), F.lit(1.0), fold)
    _, first = coefficient(F.lit(0.0))
    return 1.0 / (1.0 + first / inner)
