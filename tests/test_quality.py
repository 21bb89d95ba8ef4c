import pytest
from conftest import days

from tsengine.operators import quality
from tsengine.operators.features import lag_features, rolling_means, temporal_features


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([("2020-01-01",)], "date string")
    issues = quality.schema_issues(df)
    assert ("missing_column", "temperature") in issues and ("missing_column", "precipitation") in issues
    assert any(k == "type_mismatch" and d.startswith("date") for k, d in issues)
    with pytest.raises(ValueError, match="temperature"):
        quality.load_and_validate(df)


def test_full_schema_has_no_issues(weather_frame):
    assert quality.validate_schema(weather_frame).count() == 0


def test_convert_types(make):
    df = make(
        {"series_id": ["a"] * 4, "date": ["2020-01-01", "bad", "2020-01-03", None], "temperature": ["1.5", "x", "NaN", ""], "precipitation": ["1", "2", "3", "4"]},
        "series_id string, date string, temperature string, precipitation string",
    )
    rows = quality.load_and_validate(df).rows.collect()
    assert [str(r.date) for r in rows] == ["2020-01-01", "None", "2020-01-03", "None"]
    assert [r.temperature for r in rows] == [1.5, None, None, None]
    assert dict(quality.convert_types(df).dtypes)["date"] == "date"


def test_date_bounds(series_frame):
    row = quality.date_bounds(series_frame({"a": [1, 2, 3]}), "2015-01-01", "2015-01-04").first()
    assert not row.starts_late and row.ends_early


def test_quality_report(series_frame):
    df = series_frame({"a": [1, None, 3, None], "b": [1, 2, 3, 4]})
    rows = {(r.series_id, r.column_name): r for r in quality.quality_report(df).collect()}
    assert rows["a", "temperature"].missing == 2 and rows["a", "temperature"].column_missing_percentage == 50.0
    assert rows["a", "date"].missing_percentage == 25.0 and rows["b", "temperature"].missing_cells == 0
    status = quality.quality_report(df).withColumn("s", quality.overall_status(None)).select("series_id", "s").distinct()
    assert {r.series_id: r.s for r in status.collect()} == {"a": "WARNING", "b": "PASS"}


def test_duplicates_and_score(make):
    df = make(
        {"series_id": ["a"] * 4, "date": [days("2020-01-01", 1)[0]] * 3 + days("2020-01-02", 1), "temperature": [1.0, 1.0, 2.0, 3.0]},
        "series_id string, date date, temperature double",
    )
    assert quality.duplicate_rows(df).first().duplicate_rows == 1
    row = quality.quality_score(df).first()
    assert row.consistency == 0.0 and row.completeness == 100.0 and row.assessment == "REVIEW REQUIRED"


def test_constant_column_has_no_outliers(series_frame):
    assert quality.outlier_counts(series_frame({"a": [5.0] * 50})).first().outliers == 0
    spiky = series_frame({"a": [5.0, 5.1] * 100 + [50.0]})
    assert quality.top_outlier_columns(spiky).first().outliers == 1


def test_column_profile(series_frame):
    rows = {r.column_name: r for r in quality.column_profile(series_frame({"a": [1, None, 3]})).collect()}
    assert rows["temperature"].mean == 2.0 and rows["temperature"].data_type == "double"
    assert rows["date"].min is None and rows["date"].data_type == "date"


def test_engineered_columns(weather_frame):
    df = lag_features(rolling_means(temporal_features(weather_frame), regular=True), regular=True)
    kinds = {}
    for r in quality.engineered_columns(df).collect():
        kinds.setdefault(r.kind, []).append(r.column_name)
    assert kinds["temporal"] == ["year", "month", "day_of_year", "season"]
    assert len(kinds["rolling"]) == 5 and kinds["lag"] == [f"temperature_lag{k}" for k in (1, 7, 30)]


def test_normalized_names(spark):
    df = spark.createDataFrame([(1, 2, "A b-c.d ")], "`Wind Speed` int, `T-2.M ` int, name string")
    assert quality.normalize_columns(df).columns == ["wind_speed", "t_2_m", "name"]
    assert quality.normalize_names(df, "name", "n").first().n == "a_b_c_d"


def broken(make):
    return make(
        {
            "series_id": ["a", "a", "b", "b", None],
            "date": ["2020-01-01", "13/2020", "2020-01-03", None, "2020-01-05"],
            "temperature": ["1.5", "x", "NaN", " ", "2"],
            "precipitation": ["1", None, "3", "4,5", "6"],
        },
        "series_id string, date string, temperature string, precipitation string",
    )


def test_validation_measures_in_one_pass(make):
    checked = quality.load_and_validate(broken(make), "2020-01-01", "2020-02-01")
    kept = checked.written(lambda rows: rows.filter("date is not null"))
    assert kept.count() == 3 and "_cells" not in kept.columns
    report = {r.column_name: r for r in checked.report().collect()}
    assert report["date"].total_rows == 5 and report["date"].missing == 2 and report["date"].rejected == 1
    assert report["temperature"].missing == 3 and report["temperature"].rejected == 3
    assert report["precipitation"].missing == 2 and report["precipitation"].rejected == 1
    assert report["date"].missing_cells == 7 and report["date"].missing_percentage == 46.67
    bounds = checked.bounds().first()
    assert (str(bounds.first_date), str(bounds.last_date), bounds.starts_late, bounds.ends_early) == ("2020-01-01", "2020-01-05", False, True)
    issues = {r.column_name: r.rejected_cells for r in checked.issues().collect()}
    assert issues == {"date": 1, "temperature": 3, "precipitation": 1}


def test_rejects_carry_the_raw_row_and_a_reason(make):
    got = {(r.column_name, r.value, r.reason) for r in quality.load_and_validate(broken(make)).rejects().collect()}
    assert got == {
        ("date", "13/2020", "no date"), ("temperature", "x", "not numeric"), ("temperature", "NaN", "not a number"),
        ("temperature", " ", "empty"), ("precipitation", "4,5", "not numeric"),
    }
    raw = quality.load_and_validate(broken(make)).rejects().filter("value = '13/2020'").first().raw
    assert "13/2020" in raw and '"temperature":"x"' in raw


def test_validation_of_an_empty_table(make, spark):
    empty = spark.createDataFrame([], broken(make).schema)
    checked = quality.load_and_validate(empty)
    assert checked.bounds().first().first_date is None
    assert {r.missing_percentage for r in checked.report().collect()} == {0.0}
    assert checked.rejects().count() == 0
