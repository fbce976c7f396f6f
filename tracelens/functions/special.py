"""Statistical functions that Spark lacks: column expressions, and p-values as Arrow UDFs for small, aggregated tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_continued(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1.0 - (a + b) * x / (a + 1.0)), tiny) * math.copysign(1, 1.0 - (a + b) * x / (a + 1.0))
    out = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_continued(a, b, x) / a
    return 1.0 - front * _beta_continued(b, a, 1.0 - x) / b


def t_two_sided(t: float | None, df: float | None) -> float | None:
    """Two-sided p-value of Student's t."""
    if t is None or df is None or math.isnan(t) or df <= 0:
        return None
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def _opt(x) -> float | None:
    return None if x is None or pd.isna(x) else float(x)


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(_opt(a), _opt(b)) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def correlation_pvalue(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation of n pairs; null below 3 pairs."""
    def one(r: float | None, n: float | None) -> float | None:
        if r is None or n is None or n < 3:
            return None
        if abs(r) >= 1.0:
            return 0.0
        return t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)

    return pd.Series([one(_opt(a), _opt(b)) for a, b in zip(r, n)], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return pd.Series([None if _opt(x) is None else math.erfc(abs(x) / math.sqrt(2)) for x in z], dtype="float64")


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of x > 0 (else null): Stirling's series, from 10 on directly, below by recurrence."""
    small = x < 10
    y = F.when(small, x + 10).otherwise(x)
    z = 1 / (y * y)
    # Coefficients of the series.
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188 - z * 691 / 360360))))) / y
    value = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series
    below = x
    for k in range(1, 10):
        below = below * (x + k)
    return F.when(x > 0, F.when(small, value - F.ln(below)).otherwise(value))
