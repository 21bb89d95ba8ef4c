import numpy as np
import pandas as pd
import pytest
from conftest import CORE, days, weather
from pyspark.sql import functions as F

from tsengine.operators import anomaly, isolation


def test_injected_extremes(weather_frame):
    flagged = anomaly.zscore_flags(weather_frame, ["temperature"]).filter("anomaly_zscore")
    assert {str(r.date) for r in flagged.collect()} >= {"2020-02-20", "2020-04-10"}
    assert anomaly.iqr_flags(weather_frame).filter("anomaly_iqr").count() >= 2
    assert dict(flagged.dtypes)["anomaly_zscore"] == "boolean"


def test_constant_and_missing(series_frame):
    df = series_frame({"flat": [1.0] * 10, "gap": [None, 1.0, 1.1, 1.0, 1.1, 1.0, 1.1, 1.0, 1.1, 1.0, 9.0]})
    rows = anomaly.zscore_flags(df, ["temperature"]).filter("anomaly_zscore").collect()
    assert [r.temperature for r in rows] == [9.0]
    scaled = anomaly.standard_scale(df, ["temperature"])
    assert {r.temperature for r in scaled.filter("series_id = 'flat'").collect()} == {0.0}


def test_summary(weather_frame):
    flagged = anomaly.combine_flags(anomaly.zscore_flags(weather_frame))
    got = anomaly.deviation_card(anomaly.anomaly_summary(flagged)).first()
    data = pd.DataFrame(weather())
    z = ((data - data.mean()) / data.std()).abs().gt(2.5).any(axis=1)
    assert got.total_anomaly_days == z.sum() and got.zscore_days == z.sum()
    assert got.anomaly_mean == pytest.approx(data["temperature"][z].mean())
    assert got.normal_days == 366 - z.sum()
    assert got.largest_deviation == pytest.approx(max(abs(v - data["temperature"].mean()) for v in (50, -10)))
    none = anomaly.anomaly_summary(flagged.withColumn("anomaly_combined", F.lit(False))).first()
    assert none.total_anomaly_days == 0 and none.anomaly_mean is None


def test_combination_skips_absent_flags(weather_frame):
    df = weather_frame.withColumn("anomaly_zscore", F.lit(None).cast("boolean"))
    assert anomaly.combine_flags(df).filter("anomaly_combined").count() == 0


def test_forest_share_and_extremes(weather_frame):
    df = isolation.forest_flags(weather_frame)
    rows = df.filter("anomaly_iforest").collect()
    assert abs(len(rows) / 366 - 0.05) < 0.005
    assert {"2020-02-20", "2020-04-10"} <= {str(r.date) for r in rows}


def test_forest_does_not_depend_on_partitions(spark, weather_frame):
    one = isolation.forest_flags(weather_frame.coalesce(1)).select("date", "anomaly_iforest")
    many = isolation.forest_flags(weather_frame.repartition(7)).select("date", "anomaly_iforest")
    assert one.exceptAll(many).count() == 0


def test_pooled_forest_on_many_rows(spark):
    rows = 30_000
    df = spark.range(rows).select(
        (F.col("id") % 10).cast("string").alias("series_id"),
        F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") / 10).cast("int")).alias("date"),
        F.when(F.col("id") % 100 == 7, 30.0).otherwise(F.randn(1)).alias("temperature"),
        F.when(F.col("id") % 100 == 7, -30.0).otherwise(F.randn(2)).alias("humidity"),
    )
    df = df.select("*").cache()
    names = ["temperature", "humidity"]
    flagged = isolation.forest_flags(df, names, trees=20, sample=64, pooled=True)  # more rows than 8 * trees * sample
    counts = flagged.groupBy((F.col("temperature") == 30.0).alias("far")).agg(F.count("*").alias("n"), F.count_if("anomaly_iforest").alias("hit"))
    got = {r.far: r for r in counts.collect()}
    assert got[True].hit == got[True].n == 300
    assert abs((got[True].hit + got[False].hit) / rows - 0.05) < 0.005


def test_every_series_has_its_own_forest(spark):
    """A few cold days beside many warm ones are no anomalies; a short series has no flags."""
    sizes, rng, rows = {"warm": (2000, 25.0), "cold": (150, -20.0), "short": (9, 0.0)}, np.random.default_rng(8), []
    for name, (n, mean) in sizes.items():
        values = rng.normal(mean, 3, n), rng.uniform(30, 90, n)
        values[0][n // 2] = mean + 60
        rows += [(name, d, float(a), float(b)) for d, a, b in zip(days("2015-01-01", n), *values)]
    df = spark.createDataFrame(rows, "series_id string, date date, temperature double, humidity double")
    flagged = isolation.forest_flags(df, trees=40, sample=64).collect()
    assert len(flagged) == len(rows)
    for name, (n, mean) in sizes.items():
        hit = [r for r in flagged if r.series_id == name and r.anomaly_iforest]
        assert len(hit) == 0 if name == "short" else abs(len(hit) / n - 0.05) < 0.005
        assert name == "short" or any(r.temperature == mean + 60 for r in hit)


def test_forest_needs_columns_and_rows(weather_frame):
    assert isolation.forest_flags(weather_frame.select("series_id", "date", "humidity")).filter("anomaly_iforest").count() == 0
    assert isolation.forest_flags(weather_frame.limit(9)).filter("anomaly_iforest").count() == 0


def test_forest_leaves_incomplete_rows_unflagged(make):
    data = weather()
    data["humidity"][50] = np.nan
    df = make({"series_id": ["a"] * 366, "date": days("2020-01-01", 366), **data}, "series_id string, date date, " + ", ".join(f"{c} double" for c in CORE))
    row = isolation.forest_flags(df).filter("humidity is null").first()
    assert row.anomaly_iforest is False and row.anomaly_score is None


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_global_quantile_is_exact(spark, q):
    values = np.random.default_rng(3).beta(2, 5, 2000).round(3)
    values[:700] = 0.25  # a third of the rows share one value
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert isolation.global_quantile(df, "v", q, buckets=8) == pytest.approx(np.quantile(values, q), abs=1e-12)


def plain_forest(rows, trees, sample, seed):
    """Scores of one series ``a`` from trees that are grown node by node."""
    import hashlib
    import math

    def number(text, start=0):
        return int(hashlib.md5(text.encode()).hexdigest()[start : start + 13], 16)

    def average(n):
        return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    prime, size = 2147483647, min(sample, len(rows))
    height = max(1, math.ceil(math.log2(size)))
    total = {d: 0.0 for d, _ in rows}
    for tree in range(trees):
        factor, offset = 1 + number(f"{seed}|factor|{tree}") % (prime - 1), number(f"{seed}|offset|{tree}") % prime
        drawn = sorted(rows, key=lambda r: ((factor * (number(f"a|{r[0]}") % prime) + offset) % prime, r[0]))[:size]

        def path(inside, day, depth, node):
            spans = [(min(c), max(c)) for c in zip(*(x for _, x in inside))]
            open_ = [j for j, (lo, hi) in enumerate(spans) if hi > lo]
            if depth >= height or len(inside) <= 1 or not open_:
                return depth + average(len(inside))
            text = f"{seed}|a|{tree}|{node}"
            j = open_[math.floor(number(text) / 2**52 * len(open_))]
            lo, hi = spans[j]
            cut = lo + number(text, 13) / 2**52 * (hi - lo)
            cut = cut if cut < hi else lo
            right = day[1][j] > cut
            return path([r for r in inside if (r[1][j] > cut) == right], day, depth + 1, 2 * node + right)

        for r in rows:
            total[r[0]] += path(drawn, r, 0, 1)
    return {str(d): 2 ** (-v / (average(size) * trees)) for d, v in total.items()}


def test_forest_equals_one_grown_node_by_node(spark):
    rng = np.random.default_rng(5)
    rows = [("a", d, float(x), float(y)) for d, x, y in zip(days("2015-01-01", 60), rng.normal(0, 1, 60).round(1), rng.integers(0, 4, 60))]
    df = spark.createDataFrame(rows, "series_id string, date date, temperature double, humidity double")
    got = isolation.scores(df, ["temperature", "humidity"], trees=7, sample=16, seed=3).collect()
    want = plain_forest([(r[1], r[2:]) for r in rows], 7, 16, 3)
    assert {str(r.date): round(r.anomaly_score, 12) for r in got} == {d: round(v, 12) for d, v in want.items()}


def test_forest_of_constant_variables(spark):
    df = spark.createDataFrame([("a", d, 1.0, 2.0) for d in days("2015-01-01", 30)], "series_id string, date date, temperature double, humidity double")
    got = isolation.forest_flags(df, trees=5, sample=16)
    assert got.filter("anomaly_iforest").count() == 0 and got.select("anomaly_score").distinct().count() == 1
