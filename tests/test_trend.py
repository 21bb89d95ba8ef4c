import math

import numpy as np
import pytest
from conftest import seasonal

from tsengine.functions import stats
from tsengine.functions.stats import normal_quantile
from tsengine.operators import forecast, rules, trend
from pyspark.sql import functions as F
from statistics import NormalDist


@pytest.fixture
def student_t_two_sided(spark):
    """The column function over arrays."""

    def run(t, dof):
        rows = spark.createDataFrame([(i, float(x), float(d)) for i, (x, d) in enumerate(zip(t, dof))], "i int, t double, d double")
        p = stats.student_t_two_sided(F.col("t"), F.col("d")).alias("p")
        return np.array([r.p for r in rows.select("i", p).orderBy("i").collect()])

    return run


def test_student_t_against_tables(student_t_two_sided):
    # Two-sided 5 % and 1 % points of the t distribution.
    for dof, t05, t01 in ((1, 12.7062047, 63.6567412), (5, 2.5705818, 4.0321430), (30, 2.0422725, 2.7499957), (1000, 1.9623391, 2.5807547)):
        got = student_t_two_sided(np.array([t05, t01]), np.array([dof, dof]))
        np.testing.assert_allclose(got, [0.05, 0.01], rtol=1e-6)
    assert student_t_two_sided(np.array([0.0, math.inf]), np.array([7, 7])).tolist() == [1.0, 0.0]
    # One degree of freedom is a Cauchy distribution.
    t = np.array([0.1, 1.0, 50.0])
    np.testing.assert_allclose(student_t_two_sided(t, np.ones(3)), 1 - 2 * np.arctan(t) / np.pi, rtol=1e-10)


def test_normal_quantile_against_library(spark):
    ps = [1e-12, 1e-6, 0.001, 0.02425, 0.075, 0.3, 0.5, 0.8, 0.975, 0.9999, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal_quantile(F.col("p")).alias("z"))
    for r in df.collect():
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-9, abs=1e-12)


def test_rising_series(series_frame):
    row = trend.linear_trend(series_frame({"a": seasonal(slope=0.7, noise=1.0)})).first()
    assert row.trend_per_decade > 0 and 0 < row.r_squared < 1 and row.p_value < 0.001


def test_against_closed_form(series_frame, student_t_two_sided):
    y = np.array([1.0, 3.0, 2.0, 5.0, 4.0, 7.0])
    x = np.arange(6.0)
    slope, intercept = np.polyfit(x, y, 1)
    residual = y - slope * x - intercept
    std_err = math.sqrt((residual**2).sum() / 4 / ((x - x.mean()) ** 2).sum())
    row = trend.linear_trend(series_frame({"a": y})).first()
    assert row.slope == pytest.approx(slope) and row.intercept == pytest.approx(intercept)
    assert row.std_err == pytest.approx(std_err)
    assert row.p_value == pytest.approx(student_t_two_sided(np.array([slope / std_err]), np.array([4.0]))[0])


def test_degenerate_series(series_frame):
    df = series_frame({"one": [5.0], "none": [None, None], "flat": [2.0] * 5, "two": [1.0, 2.0], "pair": [3.0, 3.0]})
    rows = {r.series_id: r for r in trend.linear_trend(df).collect()}
    for name in ("one", "none"):
        assert rows[name].degenerate and rows[name].slope == 0.0 and rows[name].p_value == 1.0
    assert rows["flat"].r_squared == 0.0 and rows["flat"].p_value == 1.0
    assert rows["two"].p_value == 0.0 and rows["pair"].p_value == 1.0
    lines = {r.series_id: r.trend for r in trend.trend_line(df).collect()}
    assert lines["one"] == 5.0 and lines["flat"] == 2.0


def test_missing_values_count_as_days(series_frame):
    row = trend.linear_trend(series_frame({"a": [None, 1.0, None, 3.0]})).first()
    assert row.slope == pytest.approx(1.0) and row.intercept == pytest.approx(0.0)
    hist = forecast.historical_trend(series_frame({"a": [0.0, 1.0, 2.0]})).first()
    assert hist.hist_trend == pytest.approx(3652.5)


def test_warnings_with_catalogue(series_frame):
    noisy = np.random.default_rng(1).normal(0, 1, 400)
    found = rules.categorize(trend.trend_warnings(trend.linear_trend(series_frame({"a": noisy})))).collect()
    kinds = {r.type: r for r in found}
    assert kinds["LOW_R2"].severity == "medium" and kinds["LOW_R2"].category == "Statistical"
    assert kinds["LOW_R2"].details.startswith("Temperature trend explains very little variance (R²=")


def test_unknown_warning_keeps_its_row(spark):
    row = rules.categorize(spark.createDataFrame([("OTHER",)], "type string")).first()
    assert row.category == "Unknown" and row.severity == "unknown" and row.interpretation == ""
