"""Tail probabilities and critical values for small result tables."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of the chi-square distribution (series, then continued fraction)."""
    a, half = df / 2.0, x / 2.0
    if half <= 0:
        return 1.0
    front = math.exp(a * math.log(half) - half - math.lgamma(a))
    if half < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= half / k
            total += term
        return max(0.0, 1.0 - front * total)
    b = half + 1 - a
    c, d = 1e300, 1.0 / b
    value = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / d
    value = d
    for m in range(1, 2000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1.0 / (1.0 + even * d), 1.0 + even / c
        value *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1.0 / (1.0 + odd * d), 1.0 + odd / c
        value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) with ``df`` degrees of freedom."""
    if math.isinf(df):
        return normal_two_sided(t)
    x = df / (df + t * t)
    if x >= 1.0:
        return 1.0
    a, b = df / 2.0, 0.5
    log_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                 + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1 - x) / b


@lru_cache(maxsize=4096)
def t_critical(df: float, level: float = 0.95) -> float:
    """Two-sided critical value, found by bisection on :func:`t_two_sided`."""
    if math.isinf(df):
        return NormalDist().inv_cdf(0.5 + level / 2)
    low, high = 0.0, 2.0
    while t_two_sided(high, df) > 1 - level:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if t_two_sided(mid, df) > 1 - level:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def _missing(*values) -> bool:
    return any(v is None or v != v for v in values)


@F.pandas_udf(DoubleType())
def t_critical_of(df: pd.Series) -> pd.Series:
    return pd.Series([None if _missing(v) or v <= 0 else t_critical(float(v)) for v in df], dtype="float64")


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if _missing(a, b) else t_two_sided(float(a), float(b)) for a, b in zip(t, df)],
                     dtype="float64")


@F.pandas_udf(DoubleType())
def normal_p_value(z: pd.Series) -> pd.Series:
    return pd.Series([None if _missing(v) else normal_two_sided(float(v)) for v in z], dtype="float64")


@F.pandas_udf(DoubleType())
def chi2_p_value(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if _missing(a, b) else chi2_sf(float(a), float(b)) for a, b in zip(x, df)],
                     dtype="float64")
