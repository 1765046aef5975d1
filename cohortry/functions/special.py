"""Tail probabilities for one-row-per-test tables (numpy only, a few values each)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F, types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    value = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-12:
            break
    return value


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    log_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                 + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b
    return math.exp(log_front) * _beta_fraction(a, b, x) / a


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F >= f); with d1 = 1 and f = t^2 this is the two-sided t test."""
    if not f > 0.0:
        return 1.0
    return beta_cdf(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


@F.pandas_udf(T.DoubleType())
def f_test_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([f_tail(*row) for row in zip(f, d1, d2)])
