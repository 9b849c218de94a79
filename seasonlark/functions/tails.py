"""Tail probabilities of the t and F distributions, by the regularised incomplete beta function."""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.vectorize(lgamma, otypes=[float])


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised I_x(a, b), element-wise, by a continued fraction (Lentz)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    ok = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    swap = ok & (x > (a + 1) / (a + b + 2))
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inner = ok & (z > 0)
    p, q, z = p[inner], q[inner], z[inner]
    tiny = 1e-300
    if p.size:
        c, d = np.ones_like(p), 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 500):
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-14):
                break
        front = np.exp(p * np.log(z) + q * np.log1p(-np.minimum(z, 1 - 1e-16)) + _lgamma(p + q) - _lgamma(p) - _lgamma(q))
        out[inner] = front * h / p
    out[ok & ~inner] = 0.0
    return np.where(swap, 1 - out, out)


def t_two_sided(t, df) -> np.ndarray:
    """P(|T| >= |t|) with ``df`` degrees of freedom."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    with np.errstate(all="ignore"):
        x = np.where(np.isinf(t), 0.0, df / (df + t * t))
    return incomplete_beta(df / 2, 0.5, x)


def f_upper(f, d1, d2) -> np.ndarray:
    """P(F >= f)."""
    f, d1, d2 = np.asarray(f, float), np.asarray(d1, float), np.asarray(d2, float)
    with np.errstate(all="ignore"):
        x = np.where(np.isinf(f), 0.0, d2 / (d2 + d1 * f))
    return incomplete_beta(d2 / 2, d1 / 2, x)


@F.pandas_udf(T.DoubleType())
def t_sf(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of a t statistic; null for null or impossible input."""
    return pd.Series(t_two_sided(t, df), index=t.index)


@F.pandas_udf(T.DoubleType())
def f_sf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper p-value of an F statistic; null for null or impossible input."""
    return pd.Series(f_upper(f, d1, d2), index=f.index)
