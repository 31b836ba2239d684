"""Upper tails of the F, t and normal distributions, vectorised, for pandas UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_cf(a, b, x, steps: int = 300):
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def beta_inc(a, b, x):
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    if ok.any():
        lg = np.vectorize(math.lgamma, otypes=[float])
        pp, qq, yy = p[ok], q[ok], y[ok]
        with np.errstate(divide="ignore", invalid="ignore"):
            front = np.exp(lg(pp + qq) - lg(pp) - lg(qq) + pp * np.log(yy) + qq * np.log1p(-yy)) / pp
        v = np.where(yy <= 0, 0.0, front * _beta_cf(pp, qq, yy))
        out[ok] = np.where(swap[ok], 1 - v, v)
    return out


def f_tail(f, d1, d2):
    f = np.asarray(f, float)
    return beta_inc(np.asarray(d2, float) / 2, np.asarray(d1, float) / 2, d2 / (d2 + d1 * f))


def t_two_sided(t, df):
    t = np.asarray(t, float)
    return beta_inc(np.asarray(df, float) / 2, 0.5, df / (df + t * t))


def normal_two_sided(z):
    return np.vectorize(lambda v: math.erfc(abs(v) / math.sqrt(2)), otypes=[float])(np.asarray(z, float))


def wilcoxon_p(w: float, n: int, ties: float = 0.0) -> float:
    """Two-sided p of the signed-rank sum ``w`` of n non-zero differences: exact up to 25 without ties, else normal."""
    if n == 0:
        return 1.0
    if n <= 25 and not ties and float(w).is_integer():
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        ways /= ways.sum()
        return float(min(1.0, 2 * min(ways[: int(w) + 1].sum(), ways[int(w) :].sum())))
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return float(normal_two_sided((w - mean) / math.sqrt(var))) if var > 0 else 1.0


def _null(x) -> pd.Series:
    return pd.Series(x).where(~pd.isna(pd.Series(x)), None)


@F.pandas_udf(DoubleType())
def f_sf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _null(f_tail(f.astype(float).to_numpy(), d1.astype(float).to_numpy(), d2.astype(float).to_numpy()))


@F.pandas_udf(DoubleType())
def t_sf2(t: pd.Series, df: pd.Series) -> pd.Series:
    return _null(t_two_sided(t.astype(float).to_numpy(), df.astype(float).to_numpy()))


@F.pandas_udf(DoubleType())
def wilcoxon_sf2(w: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
    return _null([None if pd.isna(a) else wilcoxon_p(a, int(b), c) for a, b, c in zip(w, n, ties, strict=True)])
