import json

import numpy as np
import pytest
from conftest import days, seasonal

from tsengine import session
from tsengine.operators import quality
from tsengine.plans import pipeline
from tsengine.schema import UNITS, VARIABLES, Settings, with_units


@pytest.fixture(scope="module")
def result(spark):
    """Six years of two stations, with one gap and one missing reading."""
    n, rows = 2192, []
    for k, station in enumerate(("north", "south")):
        columns = {v: seasonal(n, slope=0.1 * k, seed=10 * k + j) for j, v in enumerate(VARIABLES)}
        columns["precipitation"] = np.abs(columns["precipitation"] - 25)
        for i, d in enumerate(days("2015-01-01", n)):
            if (k, i) != (0, 100):
                values = [float(columns[v][i]) for v in VARIABLES]
                rows.append((station, d, *[None if (i, v) == (50, "temperature") else x for v, x in zip(VARIABLES, values)]))
    schema = "series_id string, date date, " + ", ".join(f"{v} double" for v in VARIABLES)
    stations = spark.createDataFrame([("north", "North", 60.0, 25.0)], "series_id string, name string, lat double, lon double")
    return pipeline.run(spark.createDataFrame(rows, schema), Settings(horizon_years=1), stations)


def test_features(result):
    df = result["features"]
    assert df.count() == 2 * 2192 - 1 and df.filter("temperature is null").count() == 0
    assert {"year", "season", "temperature_ma365", "precipitation_ma30", "temperature_lag30"} <= set(df.columns)
    assert df.filter("temperature_lag30 is null").count() == 0


def test_results_per_stage(result):
    assert set(result["eda"]) == {"summary_statistics", "monthly_aggregations", "annual_aggregations", "correlation_matrix", "annual_trends"}
    assert result["eda"]["correlation_matrix"].count() == 50
    assert "anomaly_combined" in result["flagged"].columns
    for row in result["anomaly_summary"].collect():
        assert row.total_anomaly_days > 0 and row.iforest_days + row.zscore_days >= row.total_anomaly_days
    assert result["forecast"]["forecast"].count() == 2 * 365


def test_summary(result):
    for row in result["summary"].collect():
        assert row.risk_category in ("Low", "Moderate", "High", "Very High") and 0 <= row.risk_score <= 1
        assert row.data_quality_status == "PASS" and row.total_years == 6 and row.validation_n_folds == 3
        assert len(row.insights) == 4 and row.recommendations[-1].startswith("Review and update")


def test_feeds(result, tmp_path):
    feeds = result["feeds"]
    assert list(feeds) == ["executive_summary", "dashboard_metrics", "climate_summary", "daily_trends", "anomalies", "forecast", "regional_map"]
    pipeline.write_feeds(feeds, str(tmp_path))
    lines = [json.loads(x) for f in (tmp_path / "forecast").glob("part-*") for x in f.read_text().splitlines()]
    north = next(x for x in lines if x["series_id"] == "north")
    assert len(north["data"]) == 365 and set(north["data"][0]) == {"date", "forecast", "forecast_upper", "forecast_lower"}
    assert {"forecast_class", "reliability_label", "consistency_ratio"} <= set(north["metadata"])
    assert feeds["daily_trends"].filter("series_id = 'north'").count() == 1096
    places = {r.series_id: r for r in feeds["regional_map"].collect()}
    assert places["north"].name == "North" and places["south"].name is None and places["south"].anomaly_days > 0
    metrics = {r.series_id: r for r in feeds["dashboard_metrics"].collect()}
    assert {k: r.data_points for k, r in metrics.items()} == {"north": 2191, "south": 2192}
    assert str(metrics["north"].date_range.start) == "2015-01-01"


def test_rows_without_a_date_are_counted(result, spark):
    assert {r.series_id: r.rejected_rows for r in result["rejected"].collect()} == {"north": 0, "south": 0}
    texts = [("a", "2020-01-01"), ("a", "bad"), ("a", None), ("b", "never"), ("c", "2020-02-30")]
    rows = quality.rejected_rows(spark.createDataFrame(texts, "series_id string, date string")).collect()
    assert {r.series_id: (r.total_rows, r.rejected_rows) for r in rows} == {"a": (3, 2), "b": (1, 1), "c": (1, 1)}


def test_gaps_are_not_filled_before_the_figures(series_frame):
    """Every third day observed: lags and means run over the observed rows, none is added."""
    rows = series_frame({"a": [float(v) for v in range(90)]}).filter("day(date) % 3 = 1")
    out = pipeline.preprocess(rows, settings=Settings(rolling={"temperature": (2,)}, lags={"temperature": (1,)})).orderBy("date").collect()
    values = [r.temperature for r in rows.orderBy("date").collect()]
    assert [r.temperature for r in out] == values
    assert [r.temperature_ma2 for r in out[1:]] == [(a + b) / 2 for a, b in zip(values, values[1:])]
    assert [r.temperature_lag1 for r in out[1:]] == values[:-1] and "pos" not in out[0]


def test_missing_share(series_frame):
    df = series_frame({"bad": [None, 1.0], "good": [1.0, 2.0]})
    assert {r.series_id: r.data_quality_status for r in pipeline.missing_share(df).collect()} == {"bad": "WARNING", "good": "PASS"}


def test_units_are_metadata(weather_frame):
    df = with_units(weather_frame)
    assert df.schema["wind_speed"].metadata == {"unit": UNITS["wind_speed"]}


def test_scratch_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "checkpoint_folder", lambda _: str(tmp_path))
    assert session.materialize(spark.range(5)).count() == 5
    assert list(tmp_path.glob("tsengine/*/*"))
    session.clear_scratch(spark)
    assert not list(tmp_path.glob("tsengine/*"))


def test_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, name, default=None):
            return {"spark.sql.warehouse.dir": "file:/warehouse"}.get(name, default)

    class Cluster:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "yarn"})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_folder(Cluster())
    Cluster.sparkContext.master = "local[2]"
    assert session.checkpoint_folder(Cluster()) == "file:/warehouse"
