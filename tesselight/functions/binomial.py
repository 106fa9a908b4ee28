"""Exact binomial tests and bounds: NumPy kernels, pandas UDFs and Column forms."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, LongType

#: Slack in thresholds on floating shares, and in the family test's level.
SHARE_SLACK = LEVEL_SLACK = 1e-9

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def upper_tail(k: np.ndarray, n: np.ndarray, p: np.ndarray | float) -> np.ndarray:
    """P(Bin(n, p) >= k), as the regularised incomplete beta function I_p(k, n - k + 1)."""
    k, n, p = np.broadcast_arrays(np.asarray(k, float), np.asarray(n, float), np.asarray(p, float))
    out = np.where(k <= 0, 1.0, 0.0)
    inner = (k > 0) & (k <= n)
    out[inner & (p >= 1)] = 1.0
    inner &= (p > 0) & (p < 1)
    if inner.any():
        out[inner] = incomplete_beta(k[inner], n[inner] - k[inner] + 1, p[inner])
    return out


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta; the continued fraction runs on the side where it converges fast."""
    flip = x > (a + 1) / (a + b + 2)
    aa, bb, xx = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    front = np.exp(aa * np.log(xx) + bb * np.log1p(-xx) - (_lgamma(aa) + _lgamma(bb) - _lgamma(aa + bb))) / aa
    value = front / _fraction(aa, bb, xx)
    return np.clip(np.where(flip, 1 - value, value), 0.0, 1.0)


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """1 + d1 x / (1 + d2 x / (1 + ...)) by forward recurrence of numerators and denominators."""
    # A_m / B_m are the convergents; both are scaled by B_m after each step
    a0, b0, a1, b1 = np.ones_like(x), np.ones_like(x), np.ones_like(x), np.ones_like(x)
    a0[:], b0[:] = 1.0, 0.0
    value = np.ones_like(x)
    live = np.arange(len(x))
    for m in range(1, 5000):
        i, half = live, m // 2
        if m % 2 == 0:
            d = half * (b[i] - half) * x[i] / ((a[i] + m - 1) * (a[i] + m))
        else:
            d = -(a[i] + half) * (a[i] + b[i] + half) * x[i] / ((a[i] + m - 1) * (a[i] + m))
        a2, b2 = a1[i] + d * a0[i], b1[i] + d * b0[i]
        scale = np.where(b2 == 0, 1e-300, b2)
        a0[i], b0[i], a1[i], b1[i] = a1[i] / scale, b1[i] / scale, a2 / scale, b2 / scale
        new = a1[i] / np.where(b1[i] == 0, 1e-300, b1[i])
        done = (np.abs(new - value[i]) <= 1e-15 * np.abs(new)) & (m > 2)
        value[i] = new
        live = live[~done]
        if not len(live):
            break
    return value


def exact_lower(k: np.ndarray, n: np.ndarray, alpha: np.ndarray | float) -> np.ndarray:
    """One-sided exact (Clopper-Pearson) lower bound of a purity at level ``alpha``."""
    k, n, alpha = np.broadcast_arrays(np.asarray(k, float), np.asarray(n, float), np.asarray(alpha, float))
    low, high = np.zeros(k.shape), np.ones(k.shape)
    inner = (k > 0) & (k < n)
    if inner.any():
        lo, hi = np.zeros(int(inner.sum())), k[inner] / n[inner]
        for _ in range(60):
            mid = (lo + hi) / 2
            above = upper_tail(k[inner], n[inner], mid) > alpha[inner]
            lo, hi = np.where(above, lo, mid), np.where(above, mid, hi)
        low[inner] = lo
    full = (k == n) & (n > 0)
    low[full] = alpha[full] ** (1 / n[full])
    return low


def exact_upper(k: np.ndarray, n: np.ndarray, alpha: np.ndarray | float) -> np.ndarray:
    """One-sided exact upper bound: the lower bound of the failures, from 1."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    return 1 - exact_lower(n - k, n, alpha)


def least_certified(n: np.ndarray, tau: np.ndarray | float, level: np.ndarray | float, strict: bool = False) -> np.ndarray:
    """Smallest k with P(Bin(n, tau) >= k) <= level; n + 1 if none.

    ``strict`` is the form for unequal rows: k must also exceed the exact ceiling of n * tau by
    one, and the level is held a little lower.
    """
    n, tau, level = np.broadcast_arrays(np.asarray(n, np.int64), np.asarray(tau, float), np.asarray(level, float))
    held = level * (1 - LEVEL_SLACK) if strict else level
    low, high = np.zeros(n.shape, np.int64), n + 1  # the tail exceeds the level at low, and not at high
    while (high - low > 1).any():
        mid = (low + high) // 2
        above = upper_tail(mid, n, tau) > held
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    if strict:
        floor = np.array([-(-int(m) * t[0] // t[1]) + 1 for m, t in zip(n.ravel(), (float(x).as_integer_ratio() for x in tau.ravel()))], np.int64).reshape(n.shape)
        high = np.minimum(np.maximum(high, floor), n + 1)
    return high


def z_score(alpha: float) -> float:
    return NormalDist().inv_cdf(1 - alpha)


def _by_distinct(f, *series: pd.Series) -> pd.Series:
    """Work once for each distinct row: cells of equal size are many."""
    frame = pd.concat(series, axis=1, keys=range(len(series)))
    distinct = frame.drop_duplicates()
    return frame.merge(distinct.assign(value=f(*(distinct[c].to_numpy() for c in distinct))), how="left")["value"]


@pandas_udf(DoubleType())
def exact_lower_udf(k: pd.Series, n: pd.Series, alpha: pd.Series) -> pd.Series:
    return _by_distinct(exact_lower, k, n, alpha)


@pandas_udf(DoubleType())
def exact_upper_udf(k: pd.Series, n: pd.Series, alpha: pd.Series) -> pd.Series:
    return _by_distinct(exact_upper, k, n, alpha)


@pandas_udf(DoubleType())
def upper_tail_udf(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return _by_distinct(upper_tail, k, n, p)


@pandas_udf(LongType())
def least_certified_udf(n: pd.Series, tau: pd.Series, level: pd.Series) -> pd.Series:
    return _by_distinct(least_certified, n, tau, level)


@pandas_udf(LongType())
def least_certified_strict_udf(n: pd.Series, tau: pd.Series, level: pd.Series) -> pd.Series:
    return _by_distinct(lambda *a: least_certified(*a, strict=True), n, tau, level)


@pandas_udf(DoubleType())
def z_udf(alpha: pd.Series) -> pd.Series:
    return _by_distinct(lambda a: np.array([z_score(x) for x in a]), alpha)


def wilson(k: Column, n: Column, z: Column | float, side: int) -> Column:
    """Wilson score bound, ``side`` -1 (lower) or 1 (upper), as a Column."""
    z = F.lit(z) if not isinstance(z, Column) else z
    p = k / n
    half = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (p + z * z / (2 * n) + side * half) / (1 + z * z / n)))


def wilson_lower(k: Column, n: Column, z: Column | float) -> Column:
    return wilson(k, n, z, -1)


def wilson_upper(k: Column, n: Column, z: Column | float) -> Column:
    return wilson(k, n, z, 1)


def least_pure(n: Column, tau: Column | float) -> Column:
    """Fewest positives that make n rows pure enough: one at least."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(n * tau - SHARE_SLACK))


def benjamini_hochberg(p: list[float], q: float) -> list[bool]:
    """Step-up decisions for p-values, in their order."""
    order = sorted(range(len(p)), key=lambda i: p[i])
    last = max((r for r, i in enumerate(order, 1) if p[i] <= q * r / len(p)), default=0)
    out = [False] * len(p)
    for i in order[:last]:
        out[i] = True
    return out


def batches(total: int, size: int) -> Iterator[tuple[int, int]]:
    for s in range(0, total, size):
        yield s, min(total, s + size)
