import numpy as np
import pandas as pd
import pytest
from conftest import CORE, days, weather

from tsengine.operators import eda, joins


def test_summary_matches_pandas(weather_frame):
    rows = {r.variable: r for r in eda.summary_statistics(weather_frame).collect()}
    s = pd.Series(weather()["temperature"])
    r = rows["temperature"]
    for name, want in (("mean", s.mean()), ("std", s.std()), ("q25", s.quantile(0.25)), ("median", s.median()), ("q75", s.quantile(0.75))):
        assert getattr(r, name) == pytest.approx(want)
    approx = {r.variable: r for r in eda.summary_statistics(weather_frame, approx=True).collect()}
    assert approx["temperature"].median == pytest.approx(s.median(), abs=0.2)


def test_correlation(make):
    data = weather()
    data["humidity"] = np.full(366, 5.0)
    data["wind_speed"][3] = np.nan
    df = make({"series_id": ["a"] * 366, "date": days("2020-01-01", 366), **data}, "series_id string, date date, " + ", ".join(f"{c} double" for c in CORE))
    rows = {(r.var_x, r.var_y): r["corr"] for r in eda.correlation(df).collect()}
    want = pd.DataFrame(data).corr()
    assert len(rows) == 25 and rows["humidity", "temperature"] is None and rows["humidity", "humidity"] is None
    assert rows["temperature", "wind_speed"] == pytest.approx(want.loc["temperature", "wind_speed"])
    assert eda.correlation(df.select("series_id", "date", "temperature")).count() == 0


def test_annual_trend_uses_the_ordinal_of_the_year(make):
    dates = days("2015-06-01", 1) + days("2018-06-01", 1) + days("2019-06-01", 1)
    df = make({"series_id": ["a"] * 3, "date": dates, "temperature": [1.0, 2.0, 3.0], "precipitation": [3.0, 2.0, 1.0]}, "series_id string, date date, temperature double, precipitation double")
    row = eda.annual_trends(df).first()
    assert row.temperature_trend_per_year == pytest.approx(1.0) and row.temperature_trend_per_decade == pytest.approx(10.0)
    assert eda.annual_trends(df.limit(1)).count() == 0


def test_month_reports(weather_frame):
    data = weather()
    months = pd.Series(pd.date_range("2020-01-01", periods=366)).dt.month
    totals = pd.Series(data["precipitation"]).groupby(months).sum()
    rows = eda.top_months(weather_frame).orderBy("rank").collect()
    assert [r.month for r in rows] == totals.nlargest(3).index.tolist()
    wet = eda.wet_days(weather_frame).first()
    assert wet.wet_days == (data["precipitation"] > 1).sum() and wet.peak_month == totals.idxmax()
    means = pd.Series(data["temperature"]).groupby(months).agg(["mean", "std"])
    card = eda.season_card(weather_frame).first()
    assert card.warmest_month == means["mean"].idxmax() and card.most_variable_month == means["std"].idxmax()
    assert card.seasonal_range == pytest.approx(means["mean"].max() - means["mean"].min())


def test_month_means_of_an_empty_month(series_frame):
    rows = {r.month: r["mean"] for r in eda.month_means(series_frame({"a": [2.0] * 31})).collect()}
    assert len(rows) == 12 and rows[1] == 2.0 and rows[2] == 0.0


def test_box_statistics(series_frame):
    row = eda.box_statistics(series_frame({"a": [1, 2, 3, 4, 5, 100]})).first()
    assert (row.whisker_low, row.whisker_high, row.outliers) == (1.0, 5.0, 1)


def test_histogram(series_frame):
    rows = eda.histogram(series_frame({"a": [0, 1, 2, 10], "flat": [3, 3]}), "temperature", bins=10).collect()
    a = {r.bin: r.rows for r in rows if r.series_id == "a"}
    assert a == {1: 1, 2: 1, 3: 1, 10: 1}
    assert [(r.bin, r.rows) for r in rows if r.series_id == "flat"] == [(1, 2)]


def test_half_period(make):
    dates = [d for y in range(2015, 2019) for d in days(f"{y}-01-01", 2)]
    df = make({"series_id": ["a"] * 8, "date": dates, "precipitation": [1.0, 1.0, 2.0, 2.0, 3.0, 3.0, 4.0, None]}, "series_id string, date date, precipitation double")
    row = eda.half_period_contrast(df).first()
    assert row.mid_year == 2016.5 and row.first_half_mean == 1.5 and row.second_half_mean == pytest.approx(10 / 3)
    span = eda.analysis_span(df).first()
    assert (span.analysis_start_year, span.analysis_end_year, span.total_years) == (2015, 2018, 4)


def test_merge_prefers_primary_and_keeps_both_sides(make):
    schema = "series_id string, date date, temperature double, humidity double"
    first = make({"series_id": ["a"] * 2, "date": days("2024-01-01", 2), "temperature": [1.0, None], "humidity": [5.0, 6.0]}, schema)
    second = make({"series_id": ["a"] * 2, "date": days("2024-01-02", 2), "temperature": [20.0, 30.0], "wind_speed": [1.0, 2.0]}, "series_id string, date date, temperature double, wind_speed double")
    rows = joins.merge_sources(first, second).orderBy("date").collect()
    assert [r.temperature for r in rows] == [1.0, 20.0, 30.0]
    assert [r.humidity for r in rows] == [5.0, 6.0, None] and [r.wind_speed for r in rows] == [None, 1.0, 2.0]
    assert joins.align(first.select("series_id", "date"), second.select("series_id", "date")).count() == 1


def test_range_card(weather_frame):
    row = eda.range_card(weather_frame).first()
    assert row.temperature_range == 60.0 and row.humidity_spread == "significant" and row.solar_peak == "high"
