"""Merging sources, aligning series, and overlaying history with forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsengine.schema import DATE, SERIES, VARIABLES


SALTS = 8


def attach(df: DataFrame, small: DataFrame, keys=SERIES, salts: int = SALTS) -> DataFrame:
    """Inner join of one row per key to all rows of that key, with no hot key.

    The one-row side is repeated per salt and the rows carry the number of the partition
    they come from, so even a key with a third of all rows is spread over many tasks. No
    broadcast is forced: the planner picks one only when the measured size allows it.
    """
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*keys, "_salt"]).drop("_salt")


def merge_sources(primary: DataFrame, fallback: DataFrame, keys=SERIES) -> DataFrame:
    """Full outer join by series and day; each variable takes the primary's value if it has one.

    The key has one row per day on both sides, so no key is hot. Order is left to the sink.
    """
    on = [*keys, DATE]
    joined = primary.alias("p").join(fallback.alias("f"), on, "full_outer")
    columns = []
    for name in VARIABLES:
        sides = [F.col(f"{a}.{name}") for a, df in (("p", primary), ("f", fallback)) if name in df.columns]
        if sides:
            columns.append(F.coalesce(*sides).alias(name))
    return joined.select(*on, *columns)


def align(actual: DataFrame, predicted: DataFrame, keys=SERIES) -> DataFrame:
    """Rows whose series and day both sides have."""
    return actual.join(predicted, [*keys, DATE], "inner")


def overlay(history: DataFrame, forecast: DataFrame, value: str = "temperature", keys=SERIES) -> DataFrame:
    """History and forecast on one time axis, tagged by ``kind``."""
    bounds = ["forecast_upper", "forecast_lower"]
    past = history.select(
        *keys,
        DATE,
        F.lit("history").alias("kind"),
        F.col(value).alias("value"),
        *[F.lit(None).cast("double").alias(b) for b in bounds],
    )
    ahead = forecast.select(
        *keys, DATE, F.lit("forecast").alias("kind"), F.col("forecast").alias("value"), *bounds
    )
    return past.unionByName(ahead)
