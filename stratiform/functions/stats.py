"""Small-sample statistics as column expressions, and exact t probabilities in a vectorised function."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F


def sample_std(x: Column) -> Column:
    """n - 1 in the denominator, 0 below two values."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def cohens_d_weighted(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> Column:
    """Pooled by degrees of freedom; a pooled deviation of 0 counts as 0.001."""
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / F.nullif(n1 + n2 - 2, F.lit(0)))
    return (m2 - m1) / F.when(F.coalesce(pooled, F.lit(0.0)) == 0, 0.001).otherwise(pooled)


def cohens_d_plain(m1: Column, v1: Column, m2: Column, v2: Column) -> Column:
    """Mean of the two variances; 0 where the deviation is."""
    pooled = F.sqrt((v1 + v2) / 2)
    return F.when(pooled > 0, (m2 - m1) / F.nullif(pooled, F.lit(0.0))).otherwise(0.0)


def paired_t(d: Column) -> Column:
    """t statistic of differences, 0 where they do not vary."""
    s = F.stddev_samp(d) / F.sqrt(F.count(d))
    return F.when(s > 0, F.avg(d) / F.nullif(s, F.lit(0.0))).otherwise(0.0)


# Bounds of the t statistic and the p they stand for, from 30 degrees of freedom on and below.
P_STEPS = {"large": [(3.29, 0.001), (2.58, 0.01), (1.96, 0.05)], "small": [(4.0, 0.001), (3.0, 0.01), (2.0, 0.05)]}


def p_step(t: Column, df: Column) -> Column:
    """Step approximation of a two-sided p, by degrees of freedom; 0.1 where no bound is passed."""
    steps = {}
    for kind, bounds in P_STEPS.items():
        steps[kind] = F.lit(0.1)
        for bound, p in reversed(bounds):
            steps[kind] = F.when(F.abs(t) > bound, p).otherwise(steps[kind])
    return F.when(df >= 30, steps["large"]).otherwise(steps["small"])


def t_quantile(df: Column, confidence: float = 0.95) -> Column:
    """t beyond which 1 - confidence lies on both sides, by bisection of the exact p (a pandas function over distinct degrees of freedom)."""

    @F.pandas_udf("double")
    def run(a: pd.Series) -> pd.Series:
        known: dict[float, float] = {}
        for n in a.dropna().unique():
            lo, hi = 0.0, 1e6
            for _ in range(200):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if two_sided_p(mid, n) > 1 - confidence else (lo, mid)
            known[n] = (lo + hi) / 2
        return a.map(known)

    return run(F.when(df > 0, df.cast("double")))


def ci_half_width(s: Column, n: Column) -> Column:
    """Half of a 95 % interval by the normal quantile."""
    return F.when(n > 0, 1.96 * s / F.sqrt(n)).otherwise(0.0)


def effect_word(d: Column) -> Column:
    """By the signed effect, as reports word it: a drop is negligible."""
    return F.when(d >= 0.8, "large").when(d >= 0.5, "medium").when(d >= 0.2, "small").otherwise("negligible")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def two_sided_p(t: float, df: float) -> float:
    """Probability of a t statistic at least as far from 0."""
    return 1.0 if df <= 0 or t != t else incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def p_value(t: Column, df: Column) -> Column:
    """Exact two-sided p of aggregated rows (a pandas function: there is no built-in)."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([two_sided_p(x, y) for x, y in zip(a, b)])

    return run(t.cast("double"), df.cast("double"))
