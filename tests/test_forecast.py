import numpy as np
import pytest
from conftest import days, seasonal
from pyspark.sql import functions as F

from tsengine.operators import evaluate, forecast, joins, smoothing


def accuracy_of(spark, pairs):
    df = spark.createDataFrame([("a", a, p) for a, p in pairs], "series_id string, actual double, predicted double")
    return evaluate.accuracy(df).first()


def test_accuracy(spark):
    a, p = np.array([1.0, 2, 3, 4, 5]), np.array([1.1, 2.1, 2.9, 4.2, 4.8])
    row = accuracy_of(spark, zip(a.tolist(), p.tolist()))
    assert row.rmse == pytest.approx(np.sqrt(np.mean((a - p) ** 2))) and row.mae == pytest.approx(np.mean(abs(a - p)))
    assert row.mape == pytest.approx(np.mean(abs(a - p) / a) * 100)
    assert row.r_squared == pytest.approx(1 - ((a - p) ** 2).sum() / ((a - a.mean()) ** 2).sum())


def test_accuracy_edges(spark):
    row = accuracy_of(spark, [(None, 1.0), (2.0, None)])
    assert (row.rows, row.rmse, row.mae, row.mape, row.r_squared) == (0, 0.0, 0.0, 0.0, 0.0)
    row = accuracy_of(spark, [(0.0, 1.0), (0.0, -1.0)])
    assert row.mape == 0.0 and row.r_squared == 0.0 and row.rmse == 1.0


@pytest.mark.parametrize("n,want", [(2499, [(1404, 1769), (1769, 2134), (2134, 2499)]), (1200, [(730, 1095)]), (1500, [(730, 1095), (1095, 1460)]), (900, [])])
def test_fold_bounds(spark, n, want):
    row = spark.range(1).select(evaluate.fold_bounds(F.lit(n).cast("bigint")).alias("f")).first()
    assert [(f.train_end, f.test_end) for f in row.f] == want


def test_series_without_folds_gets_zeros(series_frame):
    df = series_frame({"long": list(seasonal(1200)), "short": list(seasonal(300))})
    folds = evaluate.validate_linear(df)
    rows = {r.series_id: r for r in evaluate.summarize_folds(folds, df.select("series_id").distinct()).collect()}
    assert rows["short"].n_folds == 0 and rows["short"].avg_rmse == 0.0
    assert rows["long"].n_folds == 1 and rows["long"].avg_rmse > 0 and rows["long"].std_rmse == 0.0
    assert evaluate.validate_smoothing(df).count() == 1


def test_benchmark(series_frame):
    y = list(seasonal(1500, noise=0.5))
    ranked = evaluate.readings(series_frame({"a": y}))
    ends = evaluate.training_ends(F.col("_n"))
    sizes = {p[0]: (p[1], p[2]) for p in ranked.select(ends.alias("p")).first().p}
    assert sizes == {0: (1500, 0), -1: (1135, 3), 1: (730, 3), 2: (1095, 3)}
    fits = evaluate.smoothing_fits(ranked, ends).cache()
    assert {r.fit: r.n for r in fits.collect()} == {k: v[0] for k, v in sizes.items()}
    models = fits.filter("fit = -1")
    predicted = evaluate.baseline_predictions(ranked, models=models).toPandas()
    assert set(predicted["model"]) == set(evaluate.MODELS) and (predicted.groupby("model").size() == 365).all()
    by = predicted.sort_values("pos").groupby("model")["predicted"].apply(list)
    assert set(by["naive"]) == {y[1134]}
    assert by["seasonal_naive"] == y[1135 - 365 : 1135]
    x = np.arange(1135)
    np.testing.assert_allclose(by["linear_trend"], np.polyval(np.polyfit(x, y[:1135], 1), np.arange(1135, 1500)))


def test_short_holdout(series_frame):
    predicted = evaluate.baseline_predictions(series_frame({"a": list(range(100))})).toPandas()
    assert (predicted.groupby("model").size() == 30).all()
    cycle = predicted[predicted.model == "seasonal_naive"].sort_values("pos")["predicted"].tolist()
    assert cycle == list(range(30))  # the season is the whole training part


def test_ranking_and_choice(spark):
    metrics = [("a", "holt_winters", 10, 5.0), ("a", "naive", 10, 4.6), ("a", "seasonal_naive", 10, 4.6), ("a", "linear_trend", 0, 0.0),
               ("b", "holt_winters", 10, 5.0), ("b", "naive", 10, 4.4), ("b", "seasonal_naive", 10, 9.0), ("b", "linear_trend", 10, 9.0)]
    ranked = evaluate.rank_models(spark.createDataFrame(metrics, "series_id string, model string, rows long, rmse double"))
    order = {(r.series_id, r.model): r["rank"] for r in ranked.collect()}
    assert [order["a", m] for m in evaluate.MODELS] == [3, 1, 2, 4]
    choice = {r.series_id: r for r in evaluate.choose_model(ranked).collect()}
    assert choice["a"].use_primary and choice["a"].best_model == "naive"
    assert choice["a"].recommendation.startswith("Holt-Winters selected (RMSE: 5.000)")
    assert not choice["b"].use_primary
    assert choice["b"].recommendation.startswith("Naive outperformed Holt-Winters (RMSE: 4.400 vs 5.000)")


def test_autocorrelation(series_frame):
    y = np.random.default_rng(2).normal(size=300).cumsum()
    rows = evaluate.autocorrelation(series_frame({"a": y, "b": y[:20]}), "temperature").toPandas()
    a = rows[rows.series_id == "a"].sort_values("lag")
    c = y - y.mean()
    want = np.array([(c[k:] * c[: len(c) - k]).sum() for k in range(61)]) / (c * c).sum()
    np.testing.assert_allclose(a["acf"], want)
    assert a["band"].iloc[0] == 0 and a["band"].iloc[1] == pytest.approx(1.959964 / np.sqrt(300), rel=1e-6)
    assert a["band"].iloc[3] == pytest.approx(1.959964 * np.sqrt((1 + 2 * (want[1] ** 2 + want[2] ** 2)) / 300), rel=1e-6)
    assert rows[rows.series_id == "b"]["lag"].max() == 9


def test_quantile_pairs(series_frame):
    from statistics import NormalDist

    y = [3.0, 1.0, 2.0, 2.0, 50.0]
    rows = evaluate.quantile_pairs(series_frame({"a": y}), "temperature").orderBy("rank").collect()
    assert [r.sample for r in rows] == sorted(y)
    assert [r.theoretical for r in rows] == pytest.approx([NormalDist().inv_cdf(i / 6) for i in range(1, 6)], abs=1e-9)


def test_value_slots_are_even_whatever_the_spread(spark):
    """One outlier, and mostly zeros: no slot holds more than a few of the distinct values."""
    outlier = [(v / 128,) for v in range(5000)] + [(1e6,)]
    values = spark.createDataFrame(outlier, "sample double").selectExpr("'a' series_id", "sample", "1L _copies")
    sizes = [r["count"] for r in evaluate.value_slots(values).groupBy("_slot").count().collect()]
    assert sum(sizes) == 5001 and max(sizes) < 3 * 5001 / 64
    dry = spark.range(4000).selectExpr("'a' series_id", "if(id % 10 = 0, id / 7, 0.0) temperature")
    rows = evaluate.quantile_pairs(dry, "temperature").orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 4001))
    assert [r["sample"] for r in rows] == sorted([0.0] * 3600 + [i / 7 for i in range(0, 4000, 10)])


def test_seasonal_naive_steps_repeat_the_last_season(series_frame):
    ranked = evaluate.readings(series_frame({"a": list(range(10)), "b": [1, 2]}))
    rows = forecast.seasonal_naive_steps(ranked, 7, season=3).orderBy("series_id", "step").collect()
    assert [r.forecast for r in rows] == [7, 8, 9, 7, 8, 9, 7, 1, 2, 1, 2, 1, 2, 1]
    assert [r.forecast for r in forecast.naive_steps(ranked, 2).orderBy("series_id", "step").collect()] == [9, 9, 2, 2]


def test_intervals_and_dates(spark):
    steps = spark.createDataFrame([("a", 1, 10.0), ("a", 365, 10.0)], "series_id string, step int, forecast double")
    residuals = spark.createDataFrame([("a", 2.0, days("2024-12-31", 1)[0])], "series_id string, residual_std double, last_date date")
    rows = forecast.with_interval(steps, residuals).orderBy("date").collect()
    assert str(rows[0].date) == "2025-01-01"
    assert rows[1].forecast_upper - 10 == pytest.approx(1.96 * 2 * np.sqrt(365 / 365.25))
    wide = forecast.with_interval(steps, residuals, 0.99).orderBy("date").collect()
    assert 10 - wide[0].forecast_lower == pytest.approx(2.576 * 2 * np.sqrt(1 / 365.25))


@pytest.fixture
def year_ahead(make):
    y = seasonal(365, noise=0)
    cols = {"series_id": ["a"] * 365, "date": days("2025-01-01", 365), "forecast": y, "forecast_upper": y + 2, "forecast_lower": y - 2}
    return make(cols, "series_id string, date date, forecast double, forecast_upper double, forecast_lower double")


def checks(spark, table, fc_trend=0.3, hist=0.3, mean=25.0):
    summary = spark.createDataFrame([("a", mean, hist, fc_trend)], "series_id string, mean_value double, hist_trend double, fc_trend double")
    return forecast.quality_checks(table, summary).first()


def test_quality_passes(spark, year_ahead):
    row = checks(spark, year_ahead)
    assert row.quality_passed and row.quality_issues == [] and row.missing_values == 0 and row.invalid_intervals == 0


@pytest.mark.parametrize("change,word", [
    ({"forecast": "if(date = '2025-01-01', null, forecast)"}, "NaN"),
    ({"forecast_upper": "if(date = '2025-01-01', forecast_lower - 5, forecast_upper)"}, "invalid confidence intervals"),
    ({"forecast": "forecast + 100"}, "deviates"),
    ({"forecast": "100D"}, "physically unreasonable"),
    ({"forecast_upper": "forecast + 19"}, "very large"),
])
def test_quality_failures(spark, year_ahead, change, word):
    table = year_ahead.withColumns({k: F.expr(v) for k, v in change.items()})
    row = checks(spark, table)
    assert not row.quality_passed and any(word in i for i in row.quality_issues)


def test_quality_of_trends(spark, year_ahead):
    assert any("extreme" in i for i in checks(spark, year_ahead, fc_trend=15.0).quality_issues)
    assert any("Trend ratio (10.00x)" in i for i in checks(spark, year_ahead, fc_trend=3.0).quality_issues)
    assert checks(spark, year_ahead, hist=0.0).quality_passed


SUMMARY = dict(
    series_id="a", mean_value=25.0, hist_trend=0.3, hist_trend_per_year=0.03, hist_r2=0.2, hist_p=0.01, fc_trend=0.33, fc_trend_per_year=0.033,
    fc_r2=0.6, fc_p=0.001, rmse=1.0, n_folds=3, avg_rmse=2.0, avg_r_squared=0.7, use_primary=True, quality_issues=[],
)


def assessed(spark, **changes):
    row = {**SUMMARY, **changes}
    kinds = {str: "string", float: "double", int: "int", bool: "boolean", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in row.items())
    return forecast.assess(spark.createDataFrame([tuple(row.values())], schema)).first()


def test_reliable_forecast(spark):
    row = assessed(spark)
    factors = {"consistency": 0.95, "r_squared": 1.0, "rmse_accuracy": 0.8, "significance": 1.0, "validation": 0.8, "quality": 1.0, "benchmark": 0.8}
    assert row.reliability_factors.asDict() == pytest.approx(factors)
    weights = (0.20, 0.15, 0.15, 0.10, 0.20, 0.10, 0.10)
    assert row.reliability_score == pytest.approx(round(sum(w * f for w, f in zip(weights, factors.values())), 3))
    assert row.reliability_label == "Very High" and row.forecast_class == "reliable" and row.classification_reasons == []
    assert row.trend_consistency_ratio == 1.1 and not row.trend_dampening_applied and row.trend_per_year == 0.033


def test_low_r2_lowers_the_class(spark):
    row = assessed(spark, fc_r2=0.05)
    assert row.forecast_class == "low_confidence" and "0.0500" in row.classification_reasons[0]


def test_unstable_forecast_falls_back(spark):
    row = assessed(spark, fc_trend=-9.0, fc_trend_per_year=-0.9, quality_issues=["too hot"], use_primary=True)
    assert row.primary_class == "exploratory" and row.used_linear_fallback
    assert row.trend_per_decade == 0.3 and row.trend_consistency_ratio == 1.0
    assert row.reliability_factors.benchmark == 0.4 and row.reliability_factors.quality == 1.0
    assert row.forecast_class == "reliable" and not row.trend_dampening_applied


def test_dampening_keeps_a_steep_but_usable_forecast(spark):
    row = assessed(spark, fc_trend=1.5, fc_trend_per_year=0.15)
    assert row.forecast_class == "low_confidence" and not row.used_linear_fallback
    assert row.trend_dampening_applied and row.trend_per_decade == pytest.approx(0.9)
    assert row.trend_per_year == pytest.approx(0.09) and row.dampening_factor == pytest.approx(0.6)
    assert row.trend_consistency_ratio == 5.0 and row.original_trend_per_decade == 1.5
    assert "Trend ratio (5.00x) exceeds acceptable threshold (3x)" in row.classification_reasons[0]


def test_no_historical_trend(spark):
    row = assessed(spark, hist_trend=0.0, hist_trend_per_year=0.0)
    assert row.trend_ratio == float("inf") and not row.trend_dampening_applied and not row.used_linear_fallback
    assert row.reliability_factors.consistency == 0.0


def test_failed_validation(spark):
    row = assessed(spark, avg_rmse=6.0, avg_r_squared=-0.1, fc_trend=0.6)
    assert row.primary_class == "exploratory" and row.used_linear_fallback
    assert [r[:12] for r in row.classification_reasons[:2]] == ["Walk-forward", "Walk-forward"]


def test_overlay(series_frame, year_ahead):
    rows = joins.overlay(series_frame({"a": [1.0, 2.0]}), year_ahead).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in rows} == {"history": 2, "forecast": 365}


def test_whole_run(series_frame):
    df = series_frame({"a": list(seasonal(2200)), "b": list(seasonal(2200, slope=0.5, seed=1))})
    out = forecast.run_forecast(df, horizon_years=1)
    assert out["forecast"].groupBy("series_id").count().collect()[0]["count"] == 365
    row = out["summary"].filter("series_id = 'a'").first()
    assert row.n_folds == 3 and row.r_squared > 0.8 and row.avg_rmse < 4
    first = out["forecast"].filter("series_id = 'a'").orderBy("date").first()
    assert str(first.date) == "2021-01-09" and first.forecast_lower < first.forecast < first.forecast_upper
    assert out["benchmark"].count() == 8 and out["fitted"].filter("residual is null").count() == 0
    models = smoothing.fit_smoothing(df)
    assert models.filter("failed").count() == 0


def test_fold_lines_equal_fits_of_every_training_part(spark):
    """Lines from merged moments against least squares on the rows, with a large offset and slope."""
    import numpy as np

    rng = np.random.default_rng(6)
    y = 1e6 + 3.0 * np.arange(500) + rng.normal(0, 1, 500)
    rows = [("a", i, float(v), 500) for i, v in enumerate(y)]
    ranked = spark.createDataFrame(rows, "series_id string, pos long, y double, _n long")
    lines = evaluate.fold_lines(ranked, splits=3, test=100, min_train=50).collect()
    assert sorted(r.train_end for r in lines) == [200, 300, 400]
    for r in lines:
        slope, intercept = np.polyfit(np.arange(r.train_end), y[: r.train_end], 1)
        assert abs(r.slope - slope) < 1e-9 and abs(r.intercept - intercept) < 1e-6
    tested = evaluate.test_rows(ranked, splits=3, test=100, min_train=50)
    assert tested.count() == 300 and tested.filter("step < 1 or step > 100").count() == 0
