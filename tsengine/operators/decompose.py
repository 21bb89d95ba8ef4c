"""Seasonal-trend decomposition by LOESS (Cleveland et al. 1990), one task per series.

A series holds one value per calendar day, so a task's input is bounded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsengine.schema import DATE, DEFAULTS, SERIES
from tsengine.session import spread


def odd_at_least(x: float) -> int:
    n = int(np.ceil(x))
    return n if n % 2 else n + 1


def _tricube(offsets: np.ndarray, q: int, n: int) -> np.ndarray:
    """Weights of points at the given offsets, one row per evaluation point."""
    reach = np.abs(offsets).max(axis=-1, keepdims=True).astype(float)
    reach = np.maximum(reach + ((q - n) // 2 if q > n else 0), 1e-12)
    r = np.abs(offsets) / reach
    return np.where(r <= 0.001, 1.0, np.where(r <= 0.999, (1.0 - r**3) ** 3, 0.0))


def _line(s0, s1, s2, t0, t1, n: int) -> np.ndarray:
    """Local line at offset zero from weighted sums; the local mean where the points do not spread."""
    total = np.where(s0 > 0, s0, 1.0)
    mean_d, mean_y = s1 / total, t0 / total
    spread = np.maximum(s2 / total - mean_d**2, 0.0)
    tilt = (t1 / total - mean_d * mean_y) / np.where(spread > 0, spread, 1.0)
    return mean_y - np.where(np.sqrt(spread) > 0.001 * (n - 1), mean_d * tilt, 0.0)


class Loess:
    """Degree-one LOESS of n equally spaced points with window q, evaluated at every point.

    All inner points share one kernel, applied as a correlation; the points near each end
    share one window, applied as a matrix.
    """

    def __init__(self, n: int, q: int):
        self.n, self.width = n, min(q, n)
        half = self.width // 2 if q <= n else n
        window = np.arange(self.width)
        self.ends = []
        for at, start in ((np.arange(0, min(half, n)), 0), (np.arange(max(n - half, min(half, n)), n), n - self.width)):
            offsets = (window[None, :] + start) - at[:, None]
            self.ends.append((slice(start, start + self.width), self._moments(offsets, q)))
        inner = window[None, :] - half
        self.inner = [m[0] for m in self._moments(inner, q)] if n > 2 * half else None

    def _moments(self, offsets: np.ndarray, q: int):
        if len(offsets) == 0:
            return [np.zeros((0, self.width))] * 3
        w = _tricube(offsets, q, self.n)
        return [w, w * offsets, w * offsets**2]

    def __call__(self, y: np.ndarray, robustness: np.ndarray | None = None) -> np.ndarray:
        rho = np.ones(self.n) if robustness is None else robustness
        weighted = rho * y
        pieces = []
        for window, (w0, w1, w2) in self.ends:
            r, v = rho[window], weighted[window]
            pieces.append(_line(w0 @ r, w1 @ r, w2 @ r, w0 @ v, w1 @ v, self.n))
        if self.inner is None:
            return np.concatenate(pieces)
        w0, w1, w2 = self.inner
        sums = [np.correlate(rho, w, "valid") for w in (w0, w1, w2)]
        sums += [np.correlate(weighted, w, "valid") for w in (w0, w1)]
        return np.concatenate([pieces[0], _line(*sums, self.n), pieces[1]])


def _cycle_lines(rows: np.ndarray, q: int, weights: np.ndarray) -> np.ndarray:
    """LOESS of each row of equally long cycle subseries, one point beyond both ends."""
    k = rows.shape[-1]
    width = min(q, k)
    at = np.arange(-1, k + 1)
    start = np.clip(at - width // 2, 0, k - width)
    index = start[:, None] + np.arange(width)[None, :]
    offsets = index - at[:, None]
    w = _tricube(offsets, q, k) * weights[:, index]
    values = rows[:, index]
    return _line(
        w.sum(-1), (w * offsets).sum(-1), (w * offsets**2).sum(-1), (w * values).sum(-1), (w * offsets * values).sum(-1), k
    )


def _moving_average(x: np.ndarray, width: int) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(x)])
    return (sums[width:] - sums[:-width]) / width


def _cycle_smooth(x: np.ndarray, period: int, q: int, robustness: np.ndarray) -> np.ndarray:
    """Smooth each cycle subseries and extend it by one period on both sides."""
    n = len(x)
    out = np.empty(n + 2 * period)
    for k in {n // period, n // period + 1}:
        phases = [p for p in range(period) if len(range(p, n, period)) == k]
        if not phases or k == 0:
            continue
        rows = np.stack([x[p::period] for p in phases])
        weights = np.stack([robustness[p::period] for p in phases])
        for p, values in zip(phases, _cycle_lines(rows, q, weights)):
            out[p::period][: k + 2] = values
    return out


def decompose(y: np.ndarray, period: int, seasonal: int = 7, robust: bool = True):
    """Trend, seasonal and residual of y."""
    trend_width = odd_at_least(1.5 * period / (1.0 - 1.5 / seasonal))
    low_width = odd_at_least(period + 1)
    inner, outer = (2, 15) if robust else (5, 0)
    n = len(y)
    low_pass, trend_smoother = Loess(n, low_width), Loess(n, trend_width)
    weights = np.ones(n)
    trend, season = np.zeros(n), np.zeros(n)
    for round_no in range(outer + 1):
        used = weights if round_no else None
        for _ in range(inner):
            cycles = _cycle_smooth(y - trend, period, seasonal, weights)
            low = _moving_average(_moving_average(_moving_average(cycles, period), period), 3)
            season = cycles[period : period + n] - low_pass(low)
            trend = trend_smoother(y - season, used)
        if round_no < outer:
            size = np.abs(y - trend - season)
            limit = 6.0 * np.median(size)
            r = size / limit if limit > 0 else np.zeros(n)
            weights = np.where(r <= 0.001, 1.0, np.where(r <= 0.999, (1.0 - r * r) ** 2, 0.0))
    return trend, season, y - trend - season


def seasonal_period(n: int, period: int) -> int:
    return period if n >= 2 * period else max(7, n // 3)


def stl(
    df: DataFrame,
    value: str = "temperature",
    period: int = DEFAULTS.season_length,
    seasonal: int = 7,
    robust: bool = True,
    keys=SERIES,
) -> DataFrame:
    """Trend, seasonal component and residual per present reading."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(DATE)
        y = pdf[value].to_numpy(dtype=float)
        p = seasonal_period(len(y), period)
        if len(y) < 2 * p:
            trend, season, residual = y, np.zeros(len(y)), np.zeros(len(y))
        else:
            trend, season, residual = decompose(y, p, seasonal, robust)
        return pdf.assign(trend=trend, seasonal_component=season, residual=residual)

    repeated = F.raise_error(F.lit("duplicate date in series"))
    daily = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, DATE)
        .agg(F.when(F.count("*") > 1, repeated).otherwise(F.first(value)).alias(value))
    )
    types = dict(df.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in (*keys, DATE, value))
    return spread(daily, *keys).groupBy(*keys).applyInPandas(
        run, f"{schema}, trend double, seasonal_component double, residual double"
    )
