import numpy as np
import pytest
from conftest import seasonal

from tsengine.operators import decompose, smoothing


def recursion(y, m, a, b, g, phi=1.0):
    """Additive smoothing, one value at a time."""
    level, slope = np.mean(y[:m]), (np.mean(y[m : 2 * m]) - np.mean(y[:m])) / m
    season = [v - level for v in y[:m]]
    fits = []
    for t, v in enumerate(y):
        s = season[t % m]
        fits.append(level + phi * slope + s)
        new = a * (v - s) + (1 - a) * (level + phi * slope)
        season[t % m] = g * (v - level - phi * slope) + (1 - g) * s
        slope, level = b * (new - level) + (1 - b) * phi * slope, new
    ahead = [level + slope * sum(phi**i for i in range(1, h + 1)) + season[(len(y) + h - 1) % m] for h in range(1, 2 * m + 1)]
    return np.array(fits), np.array(ahead)


@pytest.mark.parametrize("phi", [1.0, 0.9])
def test_fixed_parameters_match_the_recursion(series_frame, phi):
    y = seasonal(60, noise=1.0)
    fixed = {"m": 7, "alpha": 0.4, "beta": 0.1, "gamma": 0.3, "phi": phi}
    models = smoothing.fit_smoothing(series_frame({"a": y}), fixed=fixed).cache()
    fits, ahead = recursion(y, 7, 0.4, 0.1, 0.3, phi)
    got = [r.fitted for r in smoothing.fitted_values(models).orderBy("pos").collect()]
    np.testing.assert_allclose(got, fits)
    got = [r.forecast for r in smoothing.forecast(models, 14).orderBy("step").collect()]
    np.testing.assert_allclose(got, ahead)


def test_search_beats_simple_models(series_frame):
    y = seasonal(365 * 4, slope=0.7, noise=1.0)
    row = smoothing.fit_smoothing(series_frame({"a": y})).first()
    x = np.arange(len(y))
    linear = ((y - np.polyval(np.polyfit(x, y, 1), x)) ** 2).sum()
    naive = (np.diff(y) ** 2).sum()
    assert row.season_length == 365 and row.n == len(y)
    assert row.sse < linear and row.sse < naive


@pytest.mark.parametrize("trend,season,damped", [("add", "mul", False), ("mul", "add", False), ("mul", "mul", True), ("add", None, True), (None, "add", False)])
def test_other_kinds_fit_and_forecast(series_frame, trend, season, damped):
    t = np.arange(120)
    y = (50 + 0.1 * t) * (1 + 0.3 * np.sin(2 * np.pi * t / 12))
    models = smoothing.fit_smoothing(series_frame({"a": y}), wanted=12, trend=trend, season=season, damped=damped).cache()
    assert not models.first().failed
    ahead = np.array([r.forecast for r in smoothing.forecast(models, 24).orderBy("step").collect()])
    truth = (50 + 0.1 * np.arange(120, 144)) * (1 + 0.3 * np.sin(2 * np.pi * np.arange(120, 144) / 12))
    limit = 3.0 if season else 30.0
    assert np.isfinite(ahead).all() and np.sqrt(np.mean((ahead - truth) ** 2)) < limit


def test_season_length_of_short_series():
    assert smoothing.season_length(3653, 365) == 365
    assert smoothing.season_length(600, 365) == 150
    assert smoothing.season_length(20, 365) == 7
    assert smoothing.season_length(900, 365, 3) == 300 and smoothing.season_length(3000, 365, 3) == 365


def test_unusable_series_is_marked(series_frame):
    df = series_frame({"short": [1.0, 2.0, 3.0], "fine": list(seasonal(100))})
    rows = {r.series_id: r for r in smoothing.fit_smoothing(df).collect()}
    assert rows["short"].failed and not rows["fine"].failed
    assert smoothing.forecast(smoothing.fit_smoothing(df), 5).select("series_id").distinct().count() == 1
    negative = smoothing.fit_smoothing(series_frame({"a": [-1.0] * 40}), season="mul").first()
    assert negative.failed


def test_missing_values_are_skipped_and_duplicates_raise(spark, series_frame):
    y = list(seasonal(80))
    model = smoothing.fit_smoothing(series_frame({"a": y[:40] + [None] + y[40:]})).first()
    assert model.n == 80
    df = series_frame({"a": y})
    with pytest.raises(Exception, match="duplicate date"):
        smoothing.fit_smoothing(df.union(df)).collect()


def brute_loess(y, q, weights, at):
    n, out = len(y), []
    for x in at:
        width = min(q, n)
        lo = int(np.clip(x - width // 2, 0, n - width))
        j = np.arange(lo, lo + width)
        d = j - x
        reach = np.abs(d).max() + ((q - n) // 2 if q > n else 0)
        r = np.abs(d) / reach
        k = np.where(r <= 0.001, 1, np.where(r <= 0.999, (1 - r**3) ** 3, 0)) * weights[j]
        design = np.stack([np.ones(width), d], 1)
        root = np.sqrt(k)
        out.append(np.linalg.lstsq(root[:, None] * design, root * y[j], rcond=None)[0][0])
    return np.array(out)


@pytest.mark.parametrize("q", [7, 21, 59, 61, 81])
def test_loess_against_least_squares(q):
    rng = np.random.default_rng(5)
    y, w = rng.normal(size=60), rng.uniform(0.2, 1, 60)
    np.testing.assert_allclose(decompose.Loess(60, q)(y, w), brute_loess(y, q, w, range(60)), atol=1e-10)
    rows = decompose._cycle_lines(y.reshape(3, 20), 7, w.reshape(3, 20))
    np.testing.assert_allclose(rows[1], brute_loess(y[20:40], 7, w[20:40], range(-1, 21)), atol=1e-10)


def test_decomposition(series_frame):
    y = seasonal(1500, slope=0.7, noise=0.5)
    y[700] += 60.0
    rows = decompose.stl(series_frame({"a": y})).orderBy("date").toPandas()
    np.testing.assert_allclose(rows["trend"] + rows["seasonal_component"] + rows["residual"], y)
    truth = 10 * np.sin(2 * np.pi * np.arange(1500) / 365.25)
    assert np.sqrt(np.mean((rows["seasonal_component"] - truth) ** 2)) < 1.0
    assert rows["residual"][700] > 50  # robust weights leave the spike in the residual


def test_decomposition_of_short_series(series_frame):
    rows = decompose.stl(series_frame({"a": list(seasonal(60)), "b": [1.0, 2.0]})).toPandas()
    assert len(rows) == 62 and rows["trend"].notna().all()
    assert decompose.seasonal_period(60, 365) == 20 and decompose.seasonal_period(730, 365) == 365


@pytest.mark.parametrize("fixed", [None, {"m": 7, "alpha": 0.4, "beta": 0.1, "gamma": 0.3, "phi": 0.95}])
def test_snapshots_equal_separate_fits(series_frame, fixed):
    from pyspark.sql import functions as F

    from tsengine.operators import evaluate

    y = list(seasonal(200, noise=1.0, seed=3))
    ends = {0: 200, 1: 90, 2: 150, 3: 10}  # the last is too short for two seasons of 7
    parts = F.array(*[F.array(*[F.lit(v).cast("bigint") for v in (k, n, 0)]) for k, n in ends.items()])
    ranked = evaluate.readings(series_frame({"a": y}))
    rows = {r.fit: r for r in evaluate.smoothing_fits(ranked, parts, wanted=7, fixed=fixed).collect()}
    assert set(rows) == set(ends) and rows[3].failed
    for fit in (0, 1, 2):
        alone = smoothing.fit_smoothing(series_frame({"a": y[: ends[fit]]}), wanted=7, fixed=fixed).first()
        got = rows[fit]
        assert (got.n, got.season_length, got.alpha, got.beta, got.gamma) == (ends[fit], 7, alone.alpha, alone.beta, alone.gamma)
        np.testing.assert_allclose([got.level, got.slope, got.sse, *got.season], [alone.level, alone.slope, alone.sse, *alone.season])
    np.testing.assert_allclose(rows[0].fitted, smoothing.fit_smoothing(series_frame({"a": y}), wanted=7, fixed=fixed).first().fitted)
    assert rows[1].fitted is None
