import json

import pytest
from pyspark.errors import AnalysisException

from tsengine.schema import PANEL_SCHEMA
from tsengine.sources import files, payloads

MAPS = {
    "properties": {
        "parameter": {
            "T2M": {"20190310": -3.25, "20190309": -4.5},
            "PRECTOTCORR": {"20190309": 0.75, "20190310": 11.0, "20190311": 7.0},
            "RH2M": {"20190309": 81.5},
            "ALLSKY_SFC_SW_DWN": {"20190309": 9.25, "20190310": -999.0},
            "WS2M": {"20190309": 2.125, "20190310": 3.5},
        }
    }
}
ARRAYS = {
    "daily": {
        "time": ["2018-11-29", "2018-11-30"],
        "temperature_2m_mean": [7.5, 6.25],
        "temperature_2m_max": [10.5, 9.75, 40.0],
        "temperature_2m_min": [4.0],
        "precipitation_sum": [1.125, None],
        "relative_humidity_2m_mean": [73.0, 68.5],
        "shortwave_radiation_sum": [4.5, 5.25],
    }
}


def frame(spark, *documents):
    return spark.createDataFrame(
        [(f"s{i}", json.dumps(d)) for i, d in enumerate(documents)], "series_id string, payload string"
    )


def test_map_payload_axis_is_first_parameter(spark):
    rows = payloads.parse_map_payload(frame(spark, MAPS)).orderBy("date").collect()
    assert [str(r.date) for r in rows] == ["2019-03-09", "2019-03-10"]
    assert [r.temperature for r in rows] == [-4.5, -3.25]
    assert [r.precipitation for r in rows] == [0.75, 11.0]
    assert [r.humidity for r in rows] == [81.5, None]
    assert [r.temperature_max for r in rows] == [None, None]
    assert [r.solar_radiation for r in rows] == [9.25, -999.0]


def test_map_payload_sentinel(spark):
    rows = payloads.parse_map_payload(frame(spark, MAPS), sentinels=(-999.0,)).orderBy("date").collect()
    assert [r.solar_radiation for r in rows] == [9.25, None]


def test_first_parameter_outside_the_map_still_gives_the_axis(spark):
    document = {"properties": {"parameter": {"OTHER": {"20240105": 1.0}, "T2M": {"20240105": 2.0, "20240106": 3.0}}}}
    rows = payloads.parse_map_payload(frame(spark, document)).collect()
    assert [(str(r.date), r.temperature) for r in rows] == [("2024-01-05", 2.0)]


@pytest.mark.parametrize("document", [{"properties": {"parameter": {}}}, {"properties": {}}, {}])
def test_empty_map_payload_fails(spark, document):
    with pytest.raises(Exception, match="no parameter data"):
        payloads.parse_map_payload(frame(spark, document)).collect()


def test_array_payload_pads_and_cuts(spark):
    rows = payloads.parse_array_payload(frame(spark, ARRAYS)).orderBy("date").collect()
    assert len(rows) == 2
    assert [r.temperature_max for r in rows] == [10.5, 9.75]
    assert [r.temperature_min for r in rows] == [4.0, None]
    assert [r.precipitation for r in rows] == [1.125, None]
    assert [r.wind_speed for r in rows] == [None, None]


def test_empty_array_payload_fails(spark):
    with pytest.raises(Exception, match="no daily data"):
        payloads.parse_array_payload(frame(spark, {"daily": None})).collect()


def test_payload_round_trip_keeps_rows(spark, weather_frame):
    full = weather_frame.selectExpr("*", "temperature + 1 as temperature_max", "temperature - 1 as temperature_min")
    keys = ("series_id", "payload_year")
    for write, read in (
        (payloads.map_payloads, payloads.parse_map_payload),
        (payloads.array_payloads, payloads.parse_array_payload),
    ):
        back = read(write(full), keys=keys).drop("payload_year").select(full.columns)
        assert back.exceptAll(full).count() == 0 and full.exceptAll(back).count() == 0


def test_csv_and_json_round_trips(spark, tmp_path, weather_frame):
    full = weather_frame.selectExpr(
        "series_id", "date", "temperature", "temperature as temperature_max", "nullif(temperature, temperature) as temperature_min",
        "precipitation", "humidity", "solar_radiation", "wind_speed",
    )
    files.write_csv(full, str(tmp_path / "csv"))
    files.write_csv(full, str(tmp_path / "csv"))  # overwrite
    back = files.read_csv(spark, str(tmp_path / "csv"))
    assert back.schema == PANEL_SCHEMA and back.exceptAll(full).count() == 0 and back.count() == 366
    files.write_json(full, str(tmp_path / "json"))
    assert files.read_json(spark, str(tmp_path / "json"), PANEL_SCHEMA).exceptAll(full).count() == 0
    files.write_table(full, str(tmp_path / "table"))
    assert files.read_table(spark, str(tmp_path / "table")).filter("year = 2020").count() == 366


def test_missing_file_raises(spark, tmp_path):
    with pytest.raises(AnalysisException):
        files.read_csv(spark, str(tmp_path / "absent"))


def test_document_per_file(spark, tmp_path):
    (tmp_path / "feed.json").write_text(json.dumps({"metadata": {"a": 1}, "data": [{"x": 1.5}]}, indent=2))
    schema = "metadata struct<a: int>, data array<struct<x: double>>"
    row = files.read_json(spark, str(tmp_path / "feed.json"), schema, lines=False).first()
    assert row.metadata.a == 1 and row.data[0].x == 1.5
