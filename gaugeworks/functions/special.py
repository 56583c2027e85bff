"""Distribution functions as Arrow-batched UDFs: Spark SQL has no erf, incomplete beta or incomplete gamma (ST-5, 8, 11, 12)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_erfc = np.vectorize(math.erfc, otypes=[float])


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction, evaluated with Lentz's method."""
    if math.isnan(x) or x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    up, down, value = 1.0, 0.0, 1.0  # value -> 1 + d1 / (1 + d2 / (1 + ...))
    for i in range(1, 500):
        m = i // 2
        step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        down = 1 / (1 + step * down or 1e-300)
        up = 1 + step / up or 1e-300
        value *= up * down
        if abs(1 - up * down) < 1e-15:
            break
    return front / value


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def binom_two_sided(k: int, n: int) -> float:
    """Exact, p = 1/2: all outcomes no likelier than k."""
    if n == 0:
        return 1.0
    own = math.comb(n, k)
    return min(1.0, sum(math.comb(n, i) for i in range(n + 1) if math.comb(n, i) <= own) / 2**n)


def _each(f, *cols: pd.Series) -> pd.Series:
    return pd.Series([None if any(pd.isna(v) for v in row) else f(*row) for row in zip(*cols)], dtype="float64")


@F.pandas_udf(DoubleType())
def norm_sf(z: pd.Series) -> pd.Series:
    """P(Z > z)."""
    return pd.Series(0.5 * _erfc(z.to_numpy(float) / math.sqrt(2)))


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided."""
    return _each(t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def f_p_value(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _each(f_upper, f, d1, d2)


@F.pandas_udf(DoubleType())
def chi2_p_value(x: pd.Series, df: pd.Series) -> pd.Series:
    return _each(lambda v, d: gamma_q(d / 2, v / 2), x, df)


@F.pandas_udf(DoubleType())
def binom_p_value(k: pd.Series, n: pd.Series) -> pd.Series:
    return _each(lambda a, b: binom_two_sided(int(a), int(b)), k, n)


def t_upper_quantile(p: float, df: float) -> float:
    """The t below which a share p of one half or more lies: Student's tail halved between bounds that hold it."""
    lo, hi = 0.0, 2.0
    while t_two_sided(hi, df) > 2 * (1 - p):
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > 2 * (1 - p) else (lo, mid)
        if hi - lo <= 1e-13 * hi:
            break
    return (lo + hi) / 2


_z, _wz = (8 * v for v in np.polynomial.legendre.leggauss(128))
_s, _ws = np.polynomial.legendre.leggauss(96)


def range_upper(q: float, k: float, df: float) -> float:
    """P(studentized range of k means > q): the chance of a range within r, over the normal density, over the density of the error's root."""
    half = 9 / math.sqrt(2 * df)
    lo, hi = max(1e-9, 1 - half), 1 + half
    s, ws = (hi - lo) / 2 * _s + (hi + lo) / 2, (hi - lo) / 2 * _ws
    log_d = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    phi = np.exp(-_z * _z / 2) / math.sqrt(2 * math.pi)
    below = 0.5 * _erfc(-_z / math.sqrt(2))
    lower = 0.5 * _erfc(-(_z - q * s[:, None]) / math.sqrt(2))
    inner = k * (_wz * phi * (below - lower) ** (k - 1)).sum(1)
    return float(min(1.0, max(0.0, 1 - (ws * np.exp(log_d) * inner).sum())))


@F.pandas_udf(DoubleType())
def norm_quantile(p: pd.Series) -> pd.Series:
    """The z below which a share p lies."""
    from statistics import NormalDist

    inverse = NormalDist().inv_cdf
    return p.map(lambda v: inverse(v) if 0 < v < 1 else None).astype("float64")


@F.pandas_udf(DoubleType())
def t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    """For shares of one half or more."""
    known = {x: t_upper_quantile(*x) for x in set(zip(p, df)) if not any(pd.isna(v) for v in x) and x[1] > 0}
    return pd.Series([known.get(x) for x in zip(p, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def range_p_value(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    """Of the studentized range."""
    return _each(lambda a, b, c: range_upper(a, b, c) if c > 0 else None, q, k, df)
