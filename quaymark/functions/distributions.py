"""Tails and quantiles of the normal, t, chi-squared and signed-rank distributions, exact to about 1e-12.

The columns are for reports of a few rows; the values are computed in Python, as Spark has no error, beta or gamma function.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pairs up to which the signed-rank distribution is enumerated.
EXACT_PAIRS = 25
_TINY, _EPS = 1e-300, 1e-16


def _fraction(step, first: float) -> float:
    """A continued fraction by the modified Lentz method: first + a1 / (b1 + a2 / (b2 + ...)), step(i) = (a_i, b_i)."""
    f = first or _TINY
    c, d = f, 0.0
    for i in range(1, 100_000):
        a, b = step(i)
        d = 1 / ((b + a * d) or _TINY)
        c = (b + a / c) or _TINY
        f *= c * d
        if abs(c * d - 1) < _EPS * 8:
            break
    return f


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)

    def step(i: int) -> tuple[float, float]:
        m = i // 2
        return (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))), 1.0

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front / a / _fraction(step, 1.0)


def gamma_tail(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * _EPS:
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    return front / _fraction(lambda i: (-i * (i - a), x - a + 1 + 2 * i), x - a + 1)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def t_two_sided(t: float, freedom: float) -> float:
    return beta_inc(freedom / 2, 0.5, freedom / (freedom + t * t))


def chi2_tail(x: float, freedom: float) -> float:
    return gamma_tail(freedom / 2, x / 2)


def t_quantile(share: float, freedom: float) -> float:
    """The value that lies above ``share`` (over a half) of the t distribution, by bisection."""
    low, high = 0.0, 1.0
    while t_two_sided(high, freedom) > 2 * (1 - share):
        low, high = high, high * 2
    while high - low > 1e-14 * high:
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if t_two_sided(mid, freedom) > 2 * (1 - share) else (low, mid)
    return (low + high) / 2


def signed_rank_two_sided(w: float, ranks: list[float]) -> float:
    """The chance that a sum of signed ranks lies as far from its mean as w, by dynamic programming over sums of (doubled) ranks."""
    doubled = [round(2 * r) for r in ranks]
    ways = [1] + [0] * sum(doubled)
    for r in doubled:
        for s in range(len(ways) - 1, r - 1, -1):
            ways[s] += ways[s - r]
    far = abs(2 * w - sum(doubled) / 2)
    return sum(n for s, n in enumerate(ways) if abs(s - sum(doubled) / 2) >= far - 1e-9) / 2 ** len(ranks)


def _of(f):
    """f as a column of doubles, null where an argument is null or out of its range."""

    def safe(*values):
        try:
            return None if any(v is None or v != v for v in values) else f(*values)
        except (ValueError, ZeroDivisionError, OverflowError):
            return None

    return safe


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return z.map(_of(normal_two_sided)).astype(float)


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, freedom: pd.Series) -> pd.Series:
    return pd.Series([_of(t_two_sided)(a, b) if b > 0 else None for a, b in zip(t, freedom, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, freedom: pd.Series) -> pd.Series:
    return pd.Series([_of(chi2_tail)(a, b) for a, b in zip(x, freedom, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def t_at(share: pd.Series, freedom: pd.Series) -> pd.Series:
    return pd.Series([_of(t_quantile)(a, b) if b > 0 else None for a, b in zip(share, freedom, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def signed_rank_p(w: pd.Series, ranks: pd.Series) -> pd.Series:
    """Of w and an array of all ranks; null for a null array."""
    return pd.Series([None if r is None else signed_rank_two_sided(a, list(r)) for a, r in zip(w, ranks, strict=True)], dtype=float)
