"""Nested JSON payloads to daily rows.

Both readers take one payload document per row, so documents spread over tasks and no
document leaves its task before it has become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsengine.functions.columns import nan_to_null
from tsengine.schema import ARRAY_PAYLOAD_COLUMNS, DATE, MAP_PAYLOAD_COLUMNS, SERIES

MAP_PAYLOAD = "properties struct<parameter: map<string, map<string, double>>>"


def array_payload_type(columns: dict[str, str] = ARRAY_PAYLOAD_COLUMNS) -> str:
    fields = ", ".join(f"{name}: array<double>" for name in columns)
    return f"daily struct<time: array<string>, {fields}>"


def _clean(value: Column, sentinels) -> Column:
    value = nan_to_null(value)
    return F.when(~value.isin(*sentinels), value) if sentinels else value


def parse_map_payload(
    df: DataFrame,
    payload: str = "payload",
    keys=SERIES,
    columns: dict[str, str] = MAP_PAYLOAD_COLUMNS,
    sentinels=(),
) -> DataFrame:
    """Map of parameter -> (yyyyMMdd -> value); ``keys`` identify a document.

    The date axis is that of the first parameter. An empty document raises.
    """
    parsed = F.from_json(payload, MAP_PAYLOAD)["properties"]["parameter"]
    filled = F.when(
        F.coalesce(F.size(parsed), F.lit(0)) <= 0, F.raise_error(F.lit("no parameter data in payload"))
    ).otherwise(parsed)
    documents = df.select(*keys, filled.alias("_parameters"))
    readings = (
        documents.select(
            *keys,
            F.element_at(F.map_keys("_parameters"), 1).alias("_first"),
            F.explode("_parameters").alias("_parameter", "_days"),
        )
        .filter((F.col("_parameter") == F.col("_first")) | F.col("_parameter").isin(*columns))
        .select(
            *keys,
            (F.col("_parameter") == F.col("_first")).alias("_on_axis"),
            "_parameter",
            F.explode("_days").alias("_day", "_value"),
        )
    )
    # A document's rows share a task, so the partial aggregate already folds them to one per day.
    return (
        readings.groupBy(*keys, "_day")
        .agg(
            F.max("_on_axis").alias("_on_axis"),
            *[
                F.max(F.when(F.col("_parameter") == source, _clean(F.col("_value"), sentinels))).alias(name)
                for source, name in columns.items()
            ],
        )
        .filter("_on_axis")
        .select(*keys, F.to_date("_day", "yyyyMMdd").alias(DATE), *columns.values())
    )


def parse_array_payload(
    df: DataFrame,
    payload: str = "payload",
    keys=SERIES,
    columns: dict[str, str] = ARRAY_PAYLOAD_COLUMNS,
    sentinels=(),
) -> DataFrame:
    """Struct of parallel arrays; short or absent arrays pad with null, long ones are cut."""
    daily = F.from_json(payload, array_payload_type(columns))["daily"]
    absent = F.expr("cast(array() as array<double>)")
    arrays = [F.coalesce(daily[name], absent).alias(name) for name in columns]
    axis = F.when(
        daily["time"].isNull(), F.raise_error(F.lit("no daily data in payload"))
    ).otherwise(daily["time"])
    return (
        df.select(*keys, axis.alias("time"), *arrays)
        .select(*keys, F.size("time").alias("_n"), F.arrays_zip("time", *columns).alias("_rows"))
        .select(*keys, F.inline(F.slice("_rows", F.lit(1), F.col("_n"))))
        .select(
            *keys,
            F.to_date("time").alias(DATE),
            *[_clean(F.col(source), sentinels).alias(name) for source, name in columns.items()],
        )
    )


def parse_variant_payload(
    df: DataFrame, payload: str = "payload", keys=SERIES, path: str = "$.properties.parameter", sentinels=()
) -> DataFrame:
    """Readings of whatever parameters a document has, in long form: ``date``, ``parameter``, ``value``, ``text``.

    ``path`` leads to an object parameter -> (day -> reading). Documents need no common schema: parameters
    may differ, and readings may be of mixed types. Numbers, also as text, are the ``value``; other text is the
    ``text``; nulls and ``sentinels`` have neither. Days are yyyyMMdd or yyyy-MM-dd, other names null. A document
    that is no JSON or has nothing at the path has no rows. Keys must not be named pos, key or value.
    """
    tvf = df.sparkSession.tvf
    documents = df.select(*keys, F.try_variant_get(F.try_parse_json(payload), path, "variant").alias("_parameters"))
    named = documents.lateralJoin(tvf.variant_explode(F.col("_parameters").outer()))
    named = named.select(*keys, F.col("key").alias("parameter"), F.col("value").alias("_days"))
    days = named.lateralJoin(tvf.variant_explode(F.col("_days").outer()))
    day = F.coalesce(F.try_to_timestamp("key", F.lit("yyyyMMdd")), F.try_to_timestamp("key", F.lit("yyyy-MM-dd")))
    found = days.select(
        *keys,
        day.cast("date").alias(DATE),
        "parameter",
        F.try_variant_get("value", "$", "double").alias("_number"),
        F.try_variant_get("value", "$", "string").alias("_text"),
    )
    text = F.when(F.col("_number").isNull(), F.col("_text"))
    return found.select(*keys, DATE, "parameter", _clean(F.col("_number"), sentinels).alias("value"), text.alias("text"))


def canonical_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Source column names to canonical ones; columns outside the map keep their names."""
    return df.withColumnsRenamed(columns)


def map_payloads(
    panel: DataFrame, keys=SERIES, columns: dict[str, str] = MAP_PAYLOAD_COLUMNS, one_type: bool = True
) -> DataFrame:
    """Daily rows to map payload documents, one per key and calendar year.

    Columns of different types need ``one_type=False``: parameters are then fields and not map entries.
    """

    def days(name: str) -> Column:
        pair = F.struct(F.date_format(DATE, "yyyyMMdd").alias("d"), F.col(name).alias("v"))
        return F.map_from_entries(F.sort_array(F.collect_list(pair)))

    if one_type:
        parameters = F.create_map(*[c for source, name in columns.items() for c in (F.lit(source), days(name))])
    else:
        parameters = F.struct(*[days(name).alias(source) for source, name in columns.items()])
    document = F.to_json(F.struct(F.struct(parameters.alias("parameter")).alias("properties")))
    return panel.groupBy(*keys, F.year(DATE).alias("payload_year")).agg(document.alias("payload"))


def array_payloads(panel: DataFrame, keys=SERIES, columns: dict[str, str] = ARRAY_PAYLOAD_COLUMNS) -> DataFrame:
    """Daily rows to array payload documents, one per key and calendar year."""
    row = F.struct(F.date_format(DATE, "yyyy-MM-dd").alias("time"), *columns.values())
    rows = panel.groupBy(*keys, F.year(DATE).alias("payload_year")).agg(
        F.sort_array(F.collect_list(row)).alias("_rows")
    )
    daily = F.struct(
        F.col("_rows.time").alias("time"),
        *[F.col(f"_rows.{name}").alias(source) for source, name in columns.items()],
    )
    return rows.select(*keys, "payload_year", F.to_json(F.struct(daily.alias("daily"))).alias("payload"))
