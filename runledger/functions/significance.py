"""Student-t and signed-rank probabilities as Arrow-batched UDFs.

They run on rows that are already aggregated: one per configuration or model pair.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_tail(a: float, b: float, x: float, y: float) -> float:
    """The regularised incomplete beta function at x (y = 1 - x, exactly), by its continued fraction.

    The fraction is evaluated from the front with modified Lentz steps; it
    converges fast below the mean of the distribution, so the other tail is
    used above it.
    """
    if x <= 0 or y <= 0:
        return 0.0 if x <= 0 else 1.0
    if x * (a + b + 2) > a + 1:
        return 1.0 - _beta_tail(b, a, y, x)
    tiny = 1e-300
    value, front, back = 1.0, 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1))
    value = back
    for m in range(1, 100_000):
        change = 1.0
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            back = 1.0 + term * back
            back = 1.0 / (back if abs(back) > tiny else tiny)
            front = 1.0 + term / front
            front = front if abs(front) > tiny else tiny
            change = back * front
            value *= change
        if abs(change - 1.0) < 1e-15:
            break
    scale = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(y)
    return math.exp(scale) * value / a


def t_two_sided(t: float, df: int) -> float:
    """P(|T| >= |t|), by the incomplete beta function for any degrees of freedom."""
    square = t * t
    return _beta_tail(df / 2, 0.5, df / (df + square), square / (df + square))


def t_quantile(level: float, df: int) -> float:
    """Half-width multiplier of a two-sided interval at the given level."""
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > 1 - level:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if t_two_sided(middle, df) > 1 - level else (low, middle)
    return (low + high) / 2


def signed_rank_p(statistic: float, n: int, ties: bool, tie_term: float) -> float:
    """Two-sided p of min(W+, W-): exact for n <= 50 without ties, else normal."""
    if n == 0:
        return 1.0
    if n <= 50 and not ties:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1.0
        for rank in range(1, n + 1):
            shifted = ways.copy()
            shifted[rank:] += ways[:-rank]
            ways = shifted / 2
        return float(min(1.0, 2 * ways[: int(round(statistic)) + 1].sum()))
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tie_term / 48.0)
    z = (statistic - n * (n + 1) / 4.0) / spread
    return float(math.erfc(abs(z) / math.sqrt(2)))


@F.pandas_udf(T.DoubleType())
def t_critical_95(df: pd.Series) -> pd.Series:
    table = {d: t_quantile(0.95, int(d)) for d in df.dropna().unique()}
    return df.map(table)


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(a) or pd.isna(b) else 0.0 if math.isinf(a) else t_two_sided(a, int(b)) for a, b in zip(t, df)],
        dtype="float64",
    )


@F.pandas_udf(T.DoubleType())
def wilcoxon_p_value(statistic: pd.Series, n: pd.Series, ties: pd.Series, tie_term: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if pd.isna(w) else signed_rank_p(w, int(k), bool(has_ties), float(term))
            for w, k, has_ties, term in zip(statistic, n, ties, tie_term)
        ],
        dtype="float64",
    )
