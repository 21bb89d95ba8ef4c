"""Feeds refreshed by series, payloads without a schema, and thresholds on the unrounded rate."""

import os

import pytest
from conftest import days
from pyspark.sql import functions as F

from tsengine.operators import rules
from tsengine.plans import pipeline
from tsengine.sources import files, payloads


@pytest.fixture
def two(series_frame):
    return series_frame({"a": [1.0, 2.0], "b/ä": [3.0, None], "c": [5.0]})


def stamps(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.startswith("part-")}


def test_only_changed_series_are_rewritten(two, spark, tmp_path):
    path = str(tmp_path / "feeds")
    pipeline.refresh_feeds({"daily": two}, path)
    before = stamps(path)
    assert len(before) == 3
    after = two.withColumn("temperature", F.when(F.col("series_id") == "b/ä", F.col("temperature") + 1).otherwise(F.col("temperature")))
    changed = pipeline.changed_series(two, after)
    assert [r.series_id for r in changed.collect()] == ["b/ä"]
    pipeline.refresh_feeds({"daily": after}, path, changed)
    now = stamps(path)
    kept = {f for f in before if now.get(f) == before[f]}
    assert len(now) == 3 and len(kept) == 2
    rows = files.read_parts(spark, f"{path}/daily", two.schema).select("series_id", "date", "temperature")
    assert sorted(rows.collect(), key=str) == sorted(after.select("series_id", "date", "temperature").collect(), key=str)


def test_changed_series(two):
    none = two.limit(0)
    assert {r.series_id for r in pipeline.changed_series(none, two).collect()} == {"a", "b/ä", "c"}
    assert pipeline.changed_series(two, two.orderBy(F.desc("date"))).count() == 0
    assert pipeline.changed_series(two, two.union(two.filter("series_id = 'c'"))).count() == 1
    assert pipeline.changed_series(two, none).count() == 0
    assert pipeline.changed_series(two, two.withColumn("more", F.lit(1))).count() == 3


def test_variant_payloads(spark):
    texts = [
        ("a", '{"properties": {"parameter": {"T": {"20200101": 1.5, "20200102": null, "20200103": "2.5", "x": 4}, "NOTE": {"2020-01-01": "dry", "20200102": -999}}}}'),
        ("b", '{"properties": {"parameter": {}}}'),
        ("c", "{broken"),
        ("d", None),
        ("e", '{"properties": {"parameter": {"W": {"20200101": true, "20200102": [1]}}}}'),
    ]
    df = spark.createDataFrame(texts, "series_id string, payload string")
    rows = payloads.parse_variant_payload(df, sentinels=(-999.0,)).collect()
    got = {(r.series_id, r.parameter, str(r.date)): (r.value, r.text) for r in rows}
    assert got["a", "T", "2020-01-01"] == (1.5, None) and got["a", "T", "2020-01-02"] == (None, None)
    assert got["a", "T", "2020-01-03"] == (2.5, None) and got["a", "T", "None"] == (4.0, None)
    assert got["a", "NOTE", "2020-01-01"] == (None, "dry") and got["a", "NOTE", "2020-01-02"] == (None, None)
    assert {r.series_id for r in rows} == {"a", "e"}
    assert payloads.parse_variant_payload(df.limit(0)).count() == 0


@pytest.mark.parametrize("raw,strong", [(0.2003, True), (0.2, False), (0.1996, False)])
def test_insight_threshold_reads_the_raw_rate(spark, raw, strong):
    columns = {
        "warming_rate_raw": raw, "warming_rate_per_decade": 0.2, "historical_trend_r_squared": 0.5, "historical_trend_p_value": 0.01,
        "trend_consistency_ratio": 1.0, "forecast_trend_per_decade": 0.2, "historical_trend_per_decade": 0.2, "forecast_trend_r_squared": 0.5,
        "avg_precipitation": 1.0, "anomaly_percentage": 1.0,
    }
    kpis = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()], F.lit(3).alias("forecast_horizon_years"), F.lit(4).alias("anomaly_days"))
    text = rules.insights(kpis).first().insights[0]
    assert ("p=" in text) == strong
