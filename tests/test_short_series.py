"""Short series stay in the results; rolling windows, CSV scans and the forest's draw."""

import math

from conftest import days, seasonal
from tsengine.operators import features, forecast, isolation
from tsengine.sources import files


def test_no_series_is_lost(series_frame):
    lengths = (1, 2, 10, 13, 14, 30, 31, 32, 33, 400)
    daily = series_frame({f"s{n}": seasonal(n) for n in lengths})
    out = forecast.run_forecast(daily, horizon_years=1, season=14)
    rows = {r["series_id"]: r for r in out["summary"].collect()}
    assert set(rows) == {f"s{n}" for n in lengths}
    assert rows["s1"]["failed"] and rows["s1"]["used_linear_fallback"] and not rows["s400"]["failed"]
    ahead = {r["series_id"]: r["n"] for r in out["forecast"].groupBy("series_id").agg({"forecast": "count"}).toDF("series_id", "n").collect()}
    assert ahead == {f"s{n}": 365 for n in lengths}


def test_series_without_a_reading_has_a_row(series_frame):
    out = forecast.run_forecast(series_frame({"a": seasonal(60), "none": [None] * 900}), horizon_years=1, season=14)
    rows = {r["series_id"]: r for r in out["summary"].collect()}
    assert rows["none"]["failed"] and rows["none"]["forecast_class"] is None and not rows["a"]["failed"]
    assert [r["series_id"] for r in out["forecast"].select("series_id").distinct().collect()] == ["a"]


def test_rolling_mean_forgets_what_left_the_window(series_frame):
    values = [float(v) for v in range(40)]
    for odd in (1e17, math.inf):
        values[10] = odd
        rows = features.rolling_means(series_frame({"a": values}), {"temperature": (7,)}).collect()
        means = {r["date"]: r["temperature_ma7"] for r in rows}
        dates = days("2015-01-01", 40)
        assert [means[dates[i]] for i in (30, 31, 32)] == [27.0, 28.0, 29.0]


def test_csv_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("precipitation,note,date,temperature\n1.5,x,2020-01-02,20.5\n,y,bad,21\n")
    rows = files.read_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [(r["series_id"], str(r["date"]), r["temperature"], r["precipitation"]) for r in rows] == [
        ("series", "2020-01-02", 20.5, 1.5),
        ("series", "None", 21.0, None),
    ]
    (tmp_path / "b.csv").write_text("date,temperature\n2020-01-02,20.5\n")
    try:
        files.read_csv(spark, str(tmp_path / "b.csv"))
    except ValueError as e:
        assert "precipitation" in str(e)
    else:
        raise AssertionError("a missing required column must raise")


def test_forest_draws_by_one_rule(spark):
    from pyspark.sql import functions as F

    for n in (300, 5000):
        place = F.pmod(F.xxhash64("id"), F.lit(isolation.PRIME))
        rows = spark.range(n).select("id", F.lit("a").alias("k"), place.alias("_day"), F.lit(n).alias("_rows"))
        drawn = isolation.samples(rows, ["k"], 10, 16, 3)
        assert {r["tree"]: r["n"] for r in drawn.groupBy("tree").agg(F.count("*").alias("n")).collect()} == dict.fromkeys(range(10), 16)
