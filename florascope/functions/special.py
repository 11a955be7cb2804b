"""Tails of the normal, chi-square, t, F and hypergeometric distributions in numpy and plain Python."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_EPS = 1e-15


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
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
        return max(0.0, 1 - total * front)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < _EPS:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def beta_lower(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_lower(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            h *= c * d
        if abs(c * d - 1) < _EPS:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return beta_lower(df / 2, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_lower(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def hypergeom_upper(x: int, n: int, k: int, m: int) -> float:
    """P(X >= x) for m draws from n of which k are marked."""
    lc = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    lo, hi = max(x, k + m - n, 0), min(k, m)
    base = lc(n, m)
    return min(1.0, sum(math.exp(lc(k, i) + lc(n - k, m - i) - base) for i in range(lo, hi + 1)))


def log_factorials(n: int) -> np.ndarray:
    return np.concatenate([[np.longdouble(0)], np.cumsum(np.log(np.arange(1, n + 1, dtype=np.longdouble)))])


def hypergeom_tails(x: np.ndarray, n: int, k: np.ndarray, m: np.ndarray, lf: np.ndarray) -> np.ndarray:
    """hypergeom_upper of arrays, lf the log factorials up to n. Each distinct combination is computed once.

    Terms are added from x on away from the mean, where they only fall, until they no longer count; x at or below the mean takes the lower tail's complement.
    """
    sizes, at = np.unique(np.concatenate([k, m]), return_inverse=True)
    ik, im = at[: len(k)].astype(np.int64), at[len(k) :].astype(np.int64)
    code, inverse = np.unique((np.minimum(ik, im) * len(sizes) + np.maximum(ik, im)) * (n + 1) + x, return_inverse=True)
    pair, x = np.divmod(code, n + 1)
    k, m = sizes[pair // max(1, len(sizes))].astype(np.int64), sizes[pair % max(1, len(sizes))].astype(np.int64)
    up = x * n > k * m
    i = np.where(up, x, x - 1)
    lo, hi = np.maximum(0, k + m - n), np.minimum(k, m)
    total = np.zeros(len(x))
    live = np.flatnonzero((i >= lo) & (i <= hi))
    K, M, j, u = k[live], m[live], i[live], up[live]
    t = np.exp(lf[K] - lf[j] - lf[K - j] + lf[n - K] - lf[M - j] - lf[n - K - M + j] - lf[n] + lf[M] + lf[n - M]).astype(float)
    while len(live):
        total[live] += t
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(u, t * ((K - j) / (j + 1.0)) * ((M - j) / (n - K - M + j + 1.0)), t * (j / (K - j + 1.0)) * ((n - K - M + j) / (M - j + 1.0)))
        j = np.where(u, j + 1, j - 1)
        go = t > total[live] * 1e-17
        live, K, M, j, u, t = live[go], K[go], M[go], j[go], u[go], t[go]
    return np.clip(np.where(up, total, 1 - total), 0.0, 1.0)[inverse]


def _each(f):
    """f on each distinct combination of a batch: ranks and counts take few values, so a batch of pixels asks for few tails."""

    def run(*cols: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy("float64", na_value=np.nan) for c in cols], 1)
        out = np.full(len(x), np.nan)
        live = np.flatnonzero(~np.isnan(x).any(1))
        if len(live):
            once, at = np.unique(x[live], axis=0, return_inverse=True)
            out[live] = np.array([f(*map(float, r)) for r in once])[at.ravel()]
        return pd.Series(out).where(~np.isnan(out), None).astype("Float64")

    return run


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value."""
    return _each(normal_two_sided)(z)


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _each(chi2_sf)(x, df)


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(t_two_sided)(t, df)


@F.pandas_udf(DoubleType())
def hypergeom_p(x: pd.Series, n: pd.Series, k: pd.Series, m: pd.Series) -> pd.Series:
    """Upper tail; each distinct combination is computed once in a batch."""
    rows = list(zip(x.astype(int), n.astype(int), k.astype(int), m.astype(int), strict=True))
    known = {r: hypergeom_upper(*r) for r in set(rows)}
    return pd.Series([known[r] for r in rows], dtype="float64")
