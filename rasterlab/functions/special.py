"""Tail probabilities of the test statistics, as pandas UDFs on one row per test."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fraction(step, tiny: float = 1e-300, limit: int = 10_000) -> float:
    """Continued fraction by the modified Lentz method; ``step(i)`` gives (a_i, b_i)."""
    _, b = step(0)
    f = c = b or tiny
    d = 0.0
    for i in range(1, limit):
        a, b = step(i)
        d = 1.0 / ((b + a * d) or tiny)
        c = (b + a / c) or tiny
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return f


def gamma_upper(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(s, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + s * math.log(x) - math.lgamma(s))
    if x < s + 1:
        term = total = 1.0 / s
        k = s
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - scale * total)
    return scale / _fraction(lambda i: (0.0 if i == 0 else -i * (i - s), x + 2 * i + 1 - s))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a

    def step(i):
        if i == 0:
            return 0.0, 1.0
        m = i // 2
        if i % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    return front / _fraction(step)


def mann_whitney_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p-value without ties, from the count of rank sums."""
    ways = np.zeros((n1 + 1, n1 * n2 + 1), dtype=object)
    ways[0, 0] = 1
    for j in range(1, n1 + n2 + 1):  # choose n1 of the ranks; a rank adds its excess over the minimum
        for k in range(min(j, n1), 0, -1):
            shift = j - k
            if shift <= n1 * n2:
                ways[k, shift:] = ways[k, shift:] + ways[k - 1, : n1 * n2 + 1 - shift]
    tail = sum(ways[n1, int(max(u, n1 * n2 - u)):])
    return min(1.0, 2.0 * float(tail) / float(math.comb(n1 + n2, n1)))


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| > z) for z >= 0, never above 1."""
    return z.map(lambda v: min(1.0, math.erfc(v / math.sqrt(2))) if v == v else None)


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([gamma_upper(d / 2, v / 2) if v == v else None for v, d in zip(x, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([beta_inc(d / 2, 0.5, d / (d + v * v)) if v == v else None for v, d in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def mann_whitney_small(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """Exact p-value for samples whose smaller side has at most 8 values, NULL otherwise."""
    return pd.Series([
        mann_whitney_exact(a, int(b), int(c)) if min(b, c) <= 8 else None for a, b, c in zip(u, n1, n2)
    ], dtype="float64")
