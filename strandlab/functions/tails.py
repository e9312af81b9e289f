"""Tail probabilities of t and F statistics (Arrow-batched, aggregated rows only).

With x = sin(u)^2 the beta integral is one of sin(u)^(2a-1) cos(u)^(2b-1) over an angle: smooth for a, b >= 1/2, with
one peak.  Both sides of the wanted angle are integrated by Gauss-Legendre panels that narrow towards the peak.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NODES, WEIGHTS = np.polynomial.legendre.leggauss(32)
#: Panel borders around the peak, in units of its width.
STEPS = np.concatenate([-(2.0 ** np.arange(6, -3, -1)), [0.0], 2.0 ** np.arange(-2, 7)])


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function for a, b >= 1/2: the share of the integral below the angle of ``x``."""
    shape = np.broadcast_shapes(*(np.shape(v) for v in (a, b, x)))
    a, b, x = (np.broadcast_to(np.asarray(v, float), shape).reshape(-1) for v in (a, b, x))
    s, c, quarter = 2 * a[:, None] - 1, 2 * b[:, None] - 1, np.pi / 2
    angle = np.arcsin(np.sqrt(np.clip(x, 0.0, 1.0)))[:, None]
    peak = np.arctan2(np.sqrt(s), np.sqrt(c))
    width = 1.0 / np.sqrt(2 * (s + c) + 1.0)
    top = s * _log(np.sin(peak)) + c * _log(np.cos(peak))
    borders = np.sort(np.clip(np.concatenate([peak + STEPS * width, np.zeros_like(angle), angle, np.full_like(angle, quarter)], axis=1), 0.0, quarter), axis=1)
    half, middle = np.diff(borders, axis=1) / 2, (borders[:, 1:] + borders[:, :-1]) / 2
    u = middle[:, :, None] + half[:, :, None] * NODES
    panel = half * (np.exp(s[:, :, None] * _log(np.sin(u)) + c[:, :, None] * _log(np.cos(u)) - top[:, :, None]) @ WEIGHTS)
    below = np.where(middle < angle, panel, 0.0).sum(axis=1)
    return np.clip(below / panel.sum(axis=1), 0.0, 1.0).reshape(shape)


def _log(v: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(v, 1e-300))


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) with ``df`` degrees of freedom; null without a statistic."""

    @F.pandas_udf("double")
    def tail(stat: pd.Series, dof: pd.Series) -> pd.Series:
        s, d = stat.to_numpy(float), dof.to_numpy(float)
        ok = ~np.isnan(s) & (d > 0)
        out = np.full(len(s), np.nan)
        if ok.any():
            out[ok] = incomplete_beta(d[ok] / 2, 0.5, 1.0 / (1.0 + s[ok] ** 2 / d[ok]))
        return pd.Series(out).where(ok, None).astype("float64")

    return tail(t.cast("double"), df.cast("double"))


def f_upper(f: Column, df1: Column, df2: Column) -> Column:
    """P(F >= f) for a variance ratio."""

    @F.pandas_udf("double")
    def tail(stat: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        s, a, b = (v.to_numpy(float) for v in (stat, d1, d2))
        ok = np.isfinite(s) & (a > 0) & (b > 0) & (s >= 0)
        out = np.full(len(s), np.nan)
        if ok.any():
            out[ok] = incomplete_beta(b[ok] / 2, a[ok] / 2, b[ok] / (b[ok] + a[ok] * s[ok]))
        return pd.Series(out)

    return tail(f.cast("double"), df1.cast("double"), df2.cast("double"))
