"""Transaction tables to canonical daily panels.

Money is summed in whole cents, so that a panel is the same whatever the order of
summation. The price divisor is a prime near one million, so that no panel value sits
exactly on a decimal rounding boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRICE_UNIT = 999983.0


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _hundredths(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("bigint")


def _price(cents: Column, rows: Column | float = 1.0) -> Column:
    return cents.cast("double") * 10.0 / (F.lit(PRICE_UNIT) * rows)


def shipment_panel(spark: SparkSession, folder: str, series: Column | None = None) -> DataFrame:
    """lineitem by series and shipping day; the series is return flag + line status by default."""
    if series is None:
        series = F.concat("l_returnflag", "l_linestatus")
    n = F.count("*")
    return (
        table(spark, folder, "lineitem")
        .groupBy(series.alias("series_id"), F.to_date("l_shipdate").alias("date"))
        .agg(
            _price(F.sum(_hundredths("l_extendedprice")), n).alias("temperature"),
            _price(F.max(_hundredths("l_extendedprice"))).alias("temperature_max"),
            _price(F.min(_hundredths("l_extendedprice"))).alias("temperature_min"),
            F.sum("l_quantity").alias("precipitation"),
            (F.sum(_hundredths("l_discount")) / n).alias("humidity"),
            (F.sum(_hundredths("l_tax")) / n).alias("solar_radiation"),
            n.cast("double").alias("wind_speed"),
        )
    )


def supplier_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The shipment panel with one series per supplier."""
    return shipment_panel(spark, folder, F.col("l_suppkey").cast("string"))


def status_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The shipment panel with one series per line status, comparable with ``order_panel``."""
    return shipment_panel(spark, folder, F.col("l_linestatus"))


def order_panel(spark: SparkSession, folder: str) -> DataFrame:
    """orders by status and order day: a second source with fewer columns and some gaps.

    The temperature of every 13th of a month is missing.
    """
    n = F.count("*")
    price = _price(F.sum(_hundredths("o_totalprice")), n)
    return (
        table(spark, folder, "orders")
        .groupBy(F.col("o_orderstatus").alias("series_id"), F.to_date("o_orderdate").alias("date"))
        .agg(price.alias("temperature"), n.cast("double").alias("wind_speed"))
        .withColumn("temperature", F.when(F.dayofmonth("date") != 13, F.col("temperature")))
    )


def station_names(spark: SparkSession, folder: str) -> DataFrame:
    """Supplier series with nation and region as the station dimension."""
    supplier = table(spark, folder, "supplier")
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").cast("string").alias("series_id"),
            F.concat_ws(", ", "n_name", "r_name").alias("name"),
        )
    )
