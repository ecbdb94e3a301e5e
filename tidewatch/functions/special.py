"""Vectorised distribution functions that Spark lacks: incomplete beta and what follows from it."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by the continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 400):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            c = 1 + term / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * value


def beta_quantile(p: float, a: float, b: float) -> float:
    """Inverse of beta_cdf by bisection."""
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if beta_cdf(middle, a, b) < p else (low, middle)
    return (low + high) / 2


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return beta_cdf(df / (df + t * t), df / 2, 0.5) if df > 0 else 1.0


def f_upper(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if f > 0 and d2 > 0 else 1.0


@F.pandas_udf(DoubleType())
def beta_interval_end(p: pd.Series, alpha: pd.Series, beta: pd.Series) -> pd.Series:
    return pd.Series([beta_quantile(*x) for x in zip(p, alpha, beta, strict=True)])


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a Pearson correlation r over n pairs; 1 below three pairs."""
    def one(r: float, n: float) -> float:
        if n < 3 or not r == r:
            return 1.0
        return 0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)

    return pd.Series([one(*x) for x in zip(r, n, strict=True)])


def t_inverse(p: float, df: float) -> float:
    """Quantile of Student's t for p of one half or more, from the beta quantile."""
    x = beta_quantile(2 * (1 - p), df / 2, 0.5)
    return math.sqrt(df * (1 - x) / x) if x > 0 else math.inf


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of t statistics."""
    return pd.Series([1.0 if not a == a else t_two_sided(a, d) for a, d in zip(t, df, strict=True)])


@F.pandas_udf(DoubleType())
def t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_inverse(*x) for x in zip(p, df, strict=True)])
