"""Triple exponential smoothing, one task per series.

The recursion is sequential in time, so a series runs inside one task. Its input is bounded: one
value per calendar day, which the fit enforces on the way in. Several fits of a series differ in
where they end. All begin at its first reading, so a series is shipped once, one run of the
recursion serves all its fits of one season length, and each fit's error and state are noted at its end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsengine.operators.order import POS
from tsengine.schema import DATE, DEFAULTS, SERIES
from tsengine.session import spread

MODEL = (
    "n int, season_length int, alpha double, beta double, gamma double, phi double, "
    "level double, slope double, season array<double>, sse double, "
    "fitted array<double>, trend_kind string, season_kind string, failed boolean"
)


def season_length(n: int, wanted: int, divisor: int = 0) -> int:
    """The wanted season, shortened for short series; a ``divisor`` first caps it at n / divisor."""
    m = min(wanted, n // divisor) if divisor else wanted
    return m if n >= 2 * m else max(7, n // 4)


def start_state(y: np.ndarray, m: int, trend: str | None, season: str | None):
    """Level, slope and season from the first two seasons."""
    first = y[:m] if season else y[: max(2, min(10, len(y)))]
    second = y[m : 2 * m] if season else first
    level = float(np.mean(first)) if season else float(y[0])
    slope = 0.0
    if trend == "add":
        slope = float(np.mean(second) - np.mean(first)) / m if season else float(y[1] - y[0])
    elif trend == "mul":
        slope = float(np.mean(second) / np.mean(first)) ** (1.0 / m) if season else float(y[1] / y[0])
    if season == "add":
        return level, slope, first - level
    return level, slope, first / level if season == "mul" else np.zeros(m)


def smooth(y, m, trend, season, alpha, beta, gamma, phi, ends=None, keep_fitted=False):
    """Run the recursion for arrays of parameters at once, each candidate over its first ``ends`` readings.

    Returns the squared error and the state of each candidate at its end, and the one-step
    fits of the first candidate that runs longest if asked for.
    """
    size = len(alpha)
    ends = np.full(size, len(y)) if ends is None else np.asarray(ends)
    order = np.argsort(-ends, kind="stable")  # the longest first: those that end are the last ones
    alpha, beta, gamma, phi, ends = (p[order] for p in (alpha, beta, gamma, phi, ends))
    level0, slope0, season0 = start_state(y, m, trend, season)
    level = np.full(size, level0)
    slope = np.full(size, slope0)
    seasons = np.repeat(np.asarray(season0, dtype=float)[:, None], size, axis=1)
    sse = np.zeros(size)
    noted = [np.empty(size), np.empty(size), np.empty(size), np.empty((m, size))]
    fitted = np.empty(ends[0]) if keep_fitted else None
    for start, stop in zip([0, *np.unique(ends)], np.unique(ends)):
        for t in range(start, stop):
            value, s = y[t], seasons[t % m]
            step = slope**phi if trend == "mul" else phi * slope
            base = level * step if trend == "mul" else level + step if trend else level
            forecast = base * s if season == "mul" else base + s if season else base
            error = value - forecast
            sse += error * error
            if keep_fitted:
                fitted[t] = forecast[0]
            observed = value / s if season == "mul" else value - s if season else value
            new_level = alpha * observed + (1.0 - alpha) * base
            if trend == "add":
                slope = beta * (new_level - level) + (1.0 - beta) * step
            elif trend == "mul":
                slope = beta * (new_level / level) + (1.0 - beta) * step
            if season:
                detrended = value / base if season == "mul" else value - base
                seasons[t % m] = gamma * detrended + (1.0 - gamma) * s
            level = new_level
        on = int((ends[: len(level)] > stop).sum())
        # Season values in forecast order: the next step first.
        state = (sse, level, slope, np.roll(seasons, -(stop % m), axis=0))
        for note, now in zip(noted, state):
            note[..., order[on : len(level)]] = now[..., on:]
        alpha, beta, gamma, phi, level, slope, sse = (p[:on] for p in (alpha, beta, gamma, phi, level, slope, sse))
        seasons = seasons[:, :on].copy()
    return *noted, fitted


def search(y, m, trend, season, damped, ends):
    """Best parameters of the fits that end at ``ends``: a grid, then two finer grids around each fit's best."""
    ranges = {
        "alpha": (0.02, 0.9),
        "beta": (0.0, 0.5) if trend else (0.0, 0.0),
        "gamma": (0.0, 0.9) if season else (0.0, 0.0),
        "phi": (0.8, 0.995) if damped else (1.0, 1.0),
    }
    spans = [dict(ranges) for _ in ends]
    best, best_sse = [None] * len(ends), [np.inf] * len(ends)
    for _ in range(3):
        axes = [[np.unique(np.linspace(*s, 5 if s[0] < s[1] else 1)) for s in own.values()] for own in spans]
        grids = [np.stack([g.ravel() for g in np.meshgrid(*own, indexing="ij")]) for own in axes]
        sizes = [g.shape[1] for g in grids]
        with np.errstate(all="ignore"):
            sse = smooth(y, m, trend, season, *np.concatenate(grids, axis=1), ends=np.repeat(ends, sizes))[0]
        sse = np.where(np.isfinite(sse), sse, np.inf)
        for f, (grid, errors) in enumerate(zip(grids, np.split(sse, np.cumsum(sizes)[:-1]))):
            i = int(np.argmin(errors))
            if errors[i] <= best_sse[f]:
                best[f], best_sse[f] = grid[:, i], errors[i]
            for k, v in zip(ranges, best[f]):
                quarter = (spans[f][k][1] - spans[f][k][0]) / 4
                spans[f][k] = (max(ranges[k][0], v - quarter / 2), min(ranges[k][1], v + quarter / 2))
    return np.stack(best)


def _fit_group(wanted, divisor, trend, season, damped, fixed, keys):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        y = pdf["_y"].to_numpy(dtype=float)
        parts = next((p for p in pdf["_parts"] if p is not None), [(0, len(y), divisor)])
        rows, by_season = [], {}
        for number, end, cap in (map(int, p) for p in parts):
            m = max(fixed["m"] if fixed else season_length(end, wanted, cap), 1)
            positive = not ("mul" in (trend, season) and (y[:end] <= 0).any())
            usable = positive and (m >= 2 and end >= 2 * m if season else end >= 2)
            row = {k: pdf[k].iloc[0] for k in keys}
            row.update(fit=number, n=end, season_length=m, trend_kind=trend, season_kind=season, failed=not usable)
            rows.append(row)
            if usable:
                by_season.setdefault(m, []).append(row)
        for m, fits in by_season.items():
            fits.sort(key=lambda r: -r["n"])
            ends = np.array([r["n"] for r in fits])
            given = [[fixed[k] for k in ("alpha", "beta", "gamma", "phi")]] * len(fits) if fixed else None
            best = np.array(given, dtype=float) if fixed else search(y, m, trend, season, damped, ends)
            with np.errstate(all="ignore"):
                sse, level, slope, ahead, fitted = smooth(y, m, trend, season, *best.T, ends=ends, keep_fitted=True)
            for i, row in enumerate(fits):
                row.update(zip(("alpha", "beta", "gamma", "phi"), map(float, best[i])))
                row.update(level=float(level[i]), slope=float(slope[i]), season=ahead[:, i], sse=float(sse[i]))
                row["failed"] = not np.isfinite(sse[i])
            if ends[0] == len(y):
                fits[0]["fitted"] = fitted
        names = [*keys, "fit", *(f.split()[0] for f in MODEL.split(", "))]
        return pd.DataFrame([[row.get(k) for k in names] for row in rows], columns=names)

    return fit


def fit_parts(
    df: DataFrame,
    value: str,
    parts: Column | None,
    wanted: int = DEFAULTS.season_length,
    divisor: int = 0,
    trend: str | None = "add",
    season: str | None = "add",
    damped: bool = False,
    fixed: dict | None = None,
    keys=SERIES,
) -> DataFrame:
    """One model row per key and ``fit``; missing values are skipped.

    ``parts`` lists the fits of a series as arrays (fit, end, divisor): the fit takes the first ``end``
    readings, and a ``divisor`` other than 0 first caps its season at end / divisor. One row of a series
    with a non-null list is enough. Without ``parts`` the one fit 0 takes all readings. ``fixed`` gives
    parameters instead of searching them. Only a fit of all readings has ``fitted``.
    """
    listed = F.lit(None).cast("array<array<bigint>>") if parts is None else parts
    rows = df.filter(F.col(value).isNotNull()).select(
        *keys, F.col(DATE).alias("_at"), F.col(value).alias("_y"), listed.alias("_parts")
    )
    # The day-grain guard: at most one reading per key and day reaches a task.
    repeated = F.raise_error(F.lit("duplicate date in series"))
    daily = rows.groupBy(*keys, "_at").agg(
        F.when(F.count("*") > 1, repeated).otherwise(F.first("_y")).alias("_y"),
        F.first("_parts", ignorenulls=True).alias("_parts"),
    )
    types = dict(df.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", fit int, " + MODEL
    fit = _fit_group(wanted, divisor, trend, season, damped, fixed, list(keys))
    return spread(daily, *keys).groupBy(*keys).applyInPandas(fit, schema)


def fit_smoothing(df: DataFrame, value: str = "temperature", keys=SERIES, **settings) -> DataFrame:
    """One model row per key, fitted on all its readings; ``settings`` as for ``fit_parts``."""
    return fit_parts(df, value, None, keys=keys, **settings).drop("fit")


def forecast_value(h: Column) -> Column:
    """h-step forecast from the state columns of a model row."""
    phi = F.col("phi")
    geometric = phi * (1.0 - F.pow(phi, h)) / (1.0 - F.when(phi != 1.0, phi))
    steps = F.when(phi == 1.0, h.cast("double")).otherwise(geometric)
    base = (
        F.when(F.col("trend_kind") == "add", F.col("level") + steps * F.col("slope"))
        .when(F.col("trend_kind") == "mul", F.col("level") * F.pow("slope", steps))
        .otherwise(F.col("level"))
    )
    seasonal = F.try_element_at("season", (F.pmod(h - 1, F.col("season_length")) + 1).cast("int"))
    return (
        F.when(F.col("season_kind") == "add", base + seasonal)
        .when(F.col("season_kind") == "mul", base * seasonal)
        .otherwise(base)
    )


def forecast(models: DataFrame, steps: int | Column, keys=SERIES) -> DataFrame:
    """Forecast rows for steps 1..n of every usable model."""
    last = F.lit(steps) if isinstance(steps, int) else steps
    rows = models.filter(~F.col("failed")).drop("fitted").withColumn("step", F.explode(F.sequence(F.lit(1), last)))
    return rows.select(*keys, "step", forecast_value(F.col("step")).alias("forecast"))


def fitted_values(models: DataFrame, keys=SERIES) -> DataFrame:
    """One-step fits by position among the readings that are present."""
    rows = models.filter(~F.col("failed"))
    return rows.select(*keys, F.posexplode("fitted").alias(POS, "fitted"))
