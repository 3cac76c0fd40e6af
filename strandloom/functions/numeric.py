"""Effect sizes, test statistics, tail probabilities and number formatting."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def fixed(value: Column, digits: int) -> Column:
    """Fixed-point text, NULL for NULL; exact ties round to the even digit, and a negative number keeps
    its sign where all digits are zero, as in C.

    ``bround`` goes by the shortest decimal of a number. Where that is a tie and the number itself is
    not, the exact error of its product with a power of ten tells the side it lies on.
    """
    number = value.cast("double")
    size = F.abs(number)
    power = 10.0 ** (digits + 1)
    scaled = size * power
    whole = F.rint(scaled)
    big = size * 134217729.0
    high = big - (big - size)
    side = (scaled - whole) + ((high * power - scaled) + (size - high) * power)
    tie = (whole % 10 == 5) & (whole / power == size)
    near = F.when(tie & (side != 0), (whole + F.signum(side) * 5) / power).otherwise(F.bround(size, digits))
    negative = (number < 0) | ((number == 0) & (number.cast("string") == "-0.0"))
    text = F.format_string(f"%.{digits}f", near)
    return F.when(value.isNotNull(), F.concat(F.when(negative, "-").otherwise(""), text))


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, NULL where the denominator is zero."""
    return F.when(bottom != 0, top / bottom)


def approximate_p(mean1, var1, n1, mean2, var2, n2) -> Column:
    """Rough p-value ``1 / (1 + t * sqrt(df / 2))`` of the haplotype statistics.

    A side with fewer than two values gives 1. Without any variance, equal means give NULL and
    different means give 0.
    """
    spread = F.sqrt(ratio(var1, n1) + ratio(var2, n2))
    gap = F.abs(mean1 - mean2)
    t = ratio(gap, spread)
    p = F.lit(1.0) / (F.lit(1.0) + t * F.sqrt(F.greatest(n1 + n2 - 2, F.lit(0)) / F.lit(2.0)))
    return (
        F.when((n1 < 2) | (n2 < 2), F.lit(1.0))
        .when(spread > 0, p)
        .when(gap > 0, F.lit(0.0))
    )


def welch_t(mean1, var1, n1, mean2, var2, n2) -> Column:
    """Welch's t; infinite for different means without variance, NULL for equal ones."""
    gap, spread = mean1 - mean2, F.sqrt(ratio(var1, n1) + ratio(var2, n2))
    return (
        F.when(spread > 0, gap / spread)
        .when((spread == 0) & (gap != 0), F.signum(gap) * F.lit(float("inf")))
    )


def welch_df(var1, n1, var2, n2) -> Column:
    """Welch–Satterthwaite degrees of freedom; 1 where both variances are zero."""
    a, b = ratio(var1, n1), ratio(var2, n2)
    spread = ratio(a * a, n1 - 1) + ratio(b * b, n2 - 1)
    return F.when(spread > 0, (a + b) * (a + b) / spread).when(spread == 0, F.lit(1.0))


def cohens_d_simple(mean1, var1, mean2, var2) -> Column:
    """Difference of means over the root of the plain mean of both variances."""
    return ratio(mean1 - mean2, F.sqrt((var1 + var2) / F.lit(2.0)))


def cohens_d_weighted(mean1, var1, n1, mean2, var2, n2) -> Column:
    """Difference of means over the standard deviation pooled by degrees of freedom."""
    pooled = ratio((n1 - 1) * var1 + (n2 - 1) * var2, n1 + n2 - 2)
    return ratio(mean1 - mean2, F.sqrt(pooled))


# --- tail probabilities; these only ever see result tables, a few rows per test -------------

_TINY = 1e-300
_EPS = 1e-15


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation)."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 10000):
        for coefficient in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + coefficient * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + coefficient / c
            c = c if abs(c) > _TINY else _TINY
            h *= d * c
        if abs(d * c - 1.0) < _EPS:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def upper_gamma(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * _EPS:
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - front * total
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    h = d
    for i in range(1, 100000):
        coefficient = -i * (i - a)
        b += 2.0
        d = coefficient * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + coefficient / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1.0) < _EPS:
            break
    return front * h


@F.pandas_udf(T.DoubleType())
def t_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided tail probability of Student's t; NULL in, NULL out."""
    return pd.Series([
        incomplete_beta(d / 2.0, 0.5, d / (d + s * s)) if pd.notna(s) and pd.notna(d) else None
        for s, d in zip(t, df)
    ], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_upper_p(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail probability of the chi-square distribution; NULL in, NULL out."""
    return pd.Series([
        (upper_gamma(k / 2.0, s / 2.0) if k > 0 else 1.0) if pd.notna(s) and pd.notna(k) else None
        for s, k in zip(statistic, dof)
    ], dtype="float64")
