import numpy as np
import pytest
from conftest import days
from pyspark.sql import functions as F

from tsengine.operators import features
from tsengine.operators.order import carried, date_spine, day_index, framed, with_position
from tsengine.operators.features import rolling_stages

rng = np.random.default_rng(7)
LONG = [None if rng.random() < 0.3 else float(v) for v in rng.normal(10, 3, 400)]
SHORT = [None, None, 1.0, None, 4.0, None]


def pandas_of(df):
    return df.orderBy("series_id", "date").toPandas()


@pytest.fixture
def ragged(series_frame):
    """A long series beside short ones, with missing days and values; none of it fits one block."""
    gaps = {i for i in range(400) if i % 17 == 3}
    return series_frame({"long": LONG, "short": SHORT, "void": [None] * 5}, gaps=gaps)


def test_position_over_many_blocks(ragged):
    got = pandas_of(with_position(ragged, block_days=16))
    want = got.groupby("series_id").cumcount()
    assert (got["pos"] == want).all()
    assert (got["_n"] == got.groupby("series_id")["pos"].transform("size")).all()


def test_rolling_over_many_blocks(ragged):
    ranked = with_position(ragged)
    spec = {"temperature": (3, 30, 100)}
    got = pandas_of(framed(ranked, lambda w: rolling_stages(spec, w), before=99, block_rows=16))
    strict = pandas_of(framed(ranked, lambda w: rolling_stages(spec, w, True), before=99, block_rows=16))
    assert len(got) == ragged.count()
    for w in spec["temperature"]:
        groups = got.groupby("series_id")["temperature"]
        loose = groups.transform(lambda s: s.rolling(w, min_periods=1).mean())
        full = groups.transform(lambda s: s.rolling(w, min_periods=w).mean())
        np.testing.assert_allclose(got[f"temperature_ma{w}"], loose, atol=1e-9)
        np.testing.assert_allclose(strict[f"temperature_ma{w}"], full, atol=1e-9)


def test_carry_over_many_blocks(ragged):
    got = pandas_of(carried(ragged, ["temperature"], day_index(), block_days=16))
    groups = got.groupby("series_id")["temperature"]
    np.testing.assert_array_equal(got["_prev_temperature"], groups.ffill())
    np.testing.assert_array_equal(got["_next_temperature"], groups.bfill())


def test_spine_fills_days_and_rejects_duplicates(series_frame, make):
    df = series_frame({"a": [1, 2, 3, 4], "b": [5, 6]}, gaps={1})
    got = pandas_of(date_spine(df))
    assert len(got) == 5 and got["temperature"].isna().sum() == 1
    twice = make({"series_id": ["a", "a"], "date": days("2020-01-01", 1) * 2, "temperature": [1.0, 2.0]}, "series_id string, date date, temperature double")
    with pytest.raises(Exception, match="duplicate date"):
        date_spine(twice).collect()


@pytest.mark.parametrize("regular", [True, False])
def test_impute_matches_interpolation(series_frame, regular):
    df = series_frame({"long": LONG, "short": SHORT, "void": [None] * 5, "one": [None, 7.0, None]})
    got = pandas_of(features.impute_linear(df, regular=regular))
    want = pandas_of(df).groupby("series_id")["temperature"].transform(
        lambda s: s.astype(float).interpolate("linear", limit_direction="both").ffill().bfill()
    )
    np.testing.assert_allclose(got["temperature"], want, atol=1e-12)


def test_impute_is_by_row_not_by_day(series_frame):
    df = series_frame({"a": [0, None, 9, 9, 9, 30]}, gaps={2, 3, 4})
    assert pandas_of(features.impute_linear(df))["temperature"].tolist() == [0, 15, 30]


@pytest.mark.parametrize("regular", [True, False])
def test_lags_match_shift_and_backfill(series_frame, regular):
    df = series_frame({"long": LONG, "short": SHORT, "void": [None] * 5})
    got = pandas_of(features.lag_features(df, {"temperature": (1, 7, 30)}, regular=regular))
    base = pandas_of(df)
    for k in (1, 7, 30):
        want = base.groupby("series_id")["temperature"].transform(lambda s: s.astype(float).shift(k).bfill())
        np.testing.assert_array_equal(got[f"temperature_lag{k}"], want)


def test_no_window_runs_in_one_partition(ragged):
    for df in (features.rolling_means(ragged), features.lag_features(ragged), features.impute_linear(ragged)):
        assert "SinglePartition" not in df._jdf.queryExecution().toString()


def test_sampling(series_frame):
    df = series_frame({"a": range(2500), "b": range(10)})
    kept = pandas_of(features.systematic_sample(df, 1000)).groupby("series_id")["temperature"].apply(list)
    assert kept["a"] == list(range(0, 2500, 2)) and kept["b"] == list(range(10))
    thin = pandas_of(features.thin(df, 365)).groupby("series_id")["temperature"].apply(list)
    assert thin["a"] == list(range(0, 2500, 6)) and thin["b"] == list(range(10))
    assert pandas_of(features.tail(df, 3))["temperature"].tolist() == [2497, 2498, 2499, 7, 8, 9]
    assert pandas_of(features.head(df, 2))["temperature"].tolist() == [0, 1, 0, 1]


def test_calendar(series_frame):
    df = features.temporal_features(series_frame({"a": [1] * 366}, start="2020-01-01"))
    rows = {str(r.date): r for r in df.collect()}
    assert rows["2020-12-31"].day_of_year == 366 and rows["2020-12-31"].season == "Winter"
    assert [rows[f"2020-{m:02d}-15"].season for m in (3, 6, 9)] == ["Spring", "Summer", "Autumn"]
    elapsed = features.elapsed_days(df).agg(F.max("elapsed")).first()[0]
    assert elapsed == 365
    assert features.date_range(df, "2020-02-01", "2020-02-29").count() == 29


def test_fills(series_frame):
    df = series_frame({"a": SHORT})
    assert pandas_of(features.forward_fill(df, ["temperature"]))["temperature"].fillna(-1).tolist() == [-1, -1, 1, 1, 4, 4]
    assert pandas_of(features.backward_fill(df, ["temperature"]))["temperature"].fillna(-1).tolist() == [1, 1, 1, 4, 4, -1]


def test_ordered_steps_spread_over_tasks_by_rows(spark, make, monkeypatch):
    """Imputation holds wide rows in sorts: a task's rows do not grow with the panel, and results stay."""
    from tsengine.operators import order
    from tsengine.plans import pipeline
    from tsengine.session import materialize

    n, rng = 60, np.random.default_rng(4)
    dates = np.tile(np.arange("2019-01-01", "2019-03-02", dtype="datetime64[D]").astype(object), 64)
    values = np.where(rng.random(64 * n) < 0.2, np.nan, rng.normal(20, 5, 64 * n))
    columns = {"series_id": [f"s{i // n}" for i in range(64 * n)], "date": list(dates), "temperature": list(values)}
    rows = materialize(make(columns, "series_id string, date date, temperature double"))
    largest = []

    def watched(df):
        largest.append(max(df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()))
        return materialize(df)

    monkeypatch.setattr(pipeline, "materialize", watched)
    # a panel this small would be broadcast to the short tables that it is joined to
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole = sorted(map(tuple, pipeline.preprocess(rows).collect()), key=repr)
        monkeypatch.setattr(order, "TASK_ROWS", 256, raising=False)
        spread = sorted(map(tuple, pipeline.preprocess(rows).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert spread == whole and len(whole) == 64 * n
    assert largest[1] < 64 * n / 4
