"""Mergeable quantile sketches, bucketed tables, and p-values without Python workers."""

import io
import math
import uuid
from contextlib import redirect_stdout

import numpy as np
import pytest
from conftest import days
from pyspark.sql import functions as F

from tsengine.functions import stats
from tsengine.operators import anomaly, eda, joins, sketches, trend
from tsengine.sources import files


def ranks_hold(values, found, points=sketches.QUARTILES, error=0.005):
    values = np.sort(values)
    return all(
        np.searchsorted(values, q, "left") / len(values) <= p + error and np.searchsorted(values, q, "right") / len(values) >= p - error
        for p, q in zip(points, found)
    )


@pytest.fixture(scope="module")
def fine(spark):
    """A reading every few minutes: many more than a sketch holds."""
    rng = np.random.default_rng(5)
    y = np.concatenate([rng.normal(20, 5, 60_000), np.full(20_000, 7.0)])  # a third are ties
    day = np.array(days("2020-01-01", 400))[np.arange(len(y)) % 400]
    import pandas as pd

    pdf = pd.DataFrame({"series_id": "a", "date": day, "temperature": y, "precipitation": None})
    return spark.createDataFrame(pdf, "series_id string, date date, temperature double, precipitation double").repartition(5).cache(), y, day


def test_merged_sketches_keep_the_ranks(fine):
    df, y, day = fine
    months = sketches.monthly_sketches(df, ("temperature", "precipitation")).cache()
    assert months.count() == 14 * 2
    whole = {r.variable: r for r in sketches.statistics(sketches.merged(months)).collect()}
    assert whole["temperature"]["count"] == len(y) and ranks_hold(y, whole["temperature"].quantiles)
    assert (whole["temperature"].min, whole["temperature"].max) == (y.min(), y.max())
    assert whole["precipitation"]["count"] == 0 and whole["precipitation"].quantiles is None
    part = sketches.statistics(sketches.merged(months, "2020-02", "2020-04")).filter("variable = 'temperature'").first()
    inside = y[[d.month in (2, 3, 4) and d.year == 2020 for d in day]]
    assert part["count"] == len(inside) and ranks_hold(inside, part.quantiles)
    years = sketches.merged(months, by=("series_id", "year")).filter("variable = 'temperature'")
    assert years.count() == 2


def test_small_sketches_are_exact(make):
    df = make({"series_id": ["a"] * 5, "date": days("2020-01-30", 5), "temperature": [5.0, None, 1.0, 3.0, 2.0]}, "series_id string, date date, temperature double")
    row = sketches.statistics(sketches.merged(sketches.monthly_sketches(df)), (0.0, 0.5, 1.0)).first()
    assert row["count"] == 4 and row.quantiles == [1.0, 2.0, 5.0]
    assert sketches.monthly_sketches(df.limit(0)).count() == 0


def test_approximate_quartiles_everywhere(fine):
    df, y, day = fine
    rows = {r.variable: r for r in eda.summary_statistics(df, ("temperature", "precipitation"), approx=True).collect()}
    assert ranks_hold(y, (rows["temperature"].q25, rows["temperature"].median, rows["temperature"].q75))
    assert rows["precipitation"].median is None
    boxes = eda.box_statistics(df, ("temperature",), approx=True).collect()
    for r in boxes:
        month = y[[d.month == r.month for d in day]]
        assert ranks_hold(month, (r.q1, r.median, r.q3), error=0.01) and r.whisker_low >= month.min()
    flagged = anomaly.iqr_flags(df, approx=True).filter("anomaly_iqr").count()
    exact = anomaly.iqr_flags(df).filter("anomaly_iqr").count()
    assert abs(flagged - exact) < 0.01 * len(y)


def plan_of(df):
    with redirect_stdout(io.StringIO()) as text:
        df.explain()
    return text.getvalue()


def test_bucketed_tables_merge_without_an_exchange(spark, make, tmp_path):
    schema = "series_id string, date date, temperature double"
    first = make({"series_id": ["a"] * 300, "date": days("2020-01-01", 300), "temperature": [1.0] * 300}, schema)
    second = make({"series_id": ["a"] * 300, "date": days("2020-03-01", 300), "temperature": [2.0] * 300}, schema)

    def stored(df, **how):
        name = f"t_{uuid.uuid4().hex}"
        return files.write_buckets(df, name, str(tmp_path / name), 4, **how)

    merged = joins.merge_sources(stored(first), stored(second))
    assert "Exchange" not in plan_of(merged) and "SortMergeJoin" in plan_of(merged)
    assert merged.count() == 360 and merged.filter("temperature = 1").count() == 300
    ranked = stored(first, by=("series_id",)).selectExpr("*", "row_number() OVER (PARTITION BY series_id ORDER BY date) AS r")
    assert "Exchange" not in plan_of(ranked) and ranked.agg(F.max("r")).first()[0] == 300


def test_p_values_against_closed_forms(spark):
    t = [0.0, 1e-9, 1e-3, 0.3, 1.0, -2.0, 7.0, 40.0, 1e6, math.inf]
    rows = spark.createDataFrame([(x, d) for x in t for d in (1.0, 2.0, 4.0, 1e6)], "t double, d double")
    forms = {
        1.0: lambda x: 1 - 2 / math.pi * math.atan(x) if x < 1e3 else 2 / math.pi * math.atan(1 / x),
        2.0: lambda x: 1 - x / math.sqrt(2 + x * x) if x < 1e3 else 0.0,
        4.0: lambda x: 1 - x / math.sqrt(4 + x * x) * (1 + 2 / (4 + x * x)) if x < 1e3 else 0.0,
        1e6: lambda x: math.erfc(x / math.sqrt(2)),
    }
    for r in rows.select("t", "d", stats.student_t_two_sided(F.col("t"), F.col("d")).alias("p")).collect():
        assert r.p == pytest.approx(forms[r.d](abs(r.t)), abs=1e-5 if r.d > 4 else 1e-12)
    none = spark.createDataFrame([(1.0, 0.0), (1.0, None), (None, 3.0)], "t double, d double")
    assert [r.p for r in none.select(stats.student_t_two_sided(F.col("t"), F.col("d")).alias("p")).collect()] == [None] * 3


def test_trends_run_without_python(series_frame):
    plan = plan_of(trend.linear_trend(series_frame({"a": [1.0, 2.0, 2.5, 4.5]}), ("temperature",)))
    assert "Python" not in plan.split("Scan")[0] and "ArrowEval" not in plan
