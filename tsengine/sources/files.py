"""File scans and sinks: CSV, JSON and Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsengine.schema import DATE, PANEL_SCHEMA, REQUIRED, SERIES


def read_csv(spark: SparkSession, path: str, schema: T.StructType = PANEL_SCHEMA, series: str = "series") -> DataFrame:
    """CSV scan by column name: other orders and other columns in the file do not matter.

    A missing path or required column raises; other absent columns are null. Without a
    ``series_id`` the file is one series, named ``series``. Unreadable values are null.
    """
    text = read_csv_text(spark, path)
    found = {c.strip().lower(): c for c in text.columns}
    missing = [c for c in REQUIRED if c in schema.names and c not in found]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")

    def column(field: T.StructField) -> Column:
        if field.name in found:
            return F.col("`" + found[field.name].replace("`", "``") + "`").try_cast(field.dataType)
        return F.lit(series if field.name in SERIES else None).cast(field.dataType)

    return text.select(*[column(f).alias(f.name) for f in schema])


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV scan with every column as text, for ``quality.convert_types``."""
    return spark.read.option("header", True).option("encoding", "UTF-8").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("encoding", "UTF-8")
        .option("dateFormat", "yyyy-MM-dd")
        .csv(path)
    )


def read_json(spark: SparkSession, path: str, schema: T.StructType, lines: bool = True) -> DataFrame:
    """JSON scan; ``lines=False`` reads one document per file."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document per line; missing fields are left out."""
    df.write.mode("overwrite").json(path)


def replace_parts(df: DataFrame, path: str, by=SERIES) -> None:
    """JSON documents in one folder for each value of ``by``; folders of values that ``df`` lacks stay as they are."""
    parted = df.withColumns({f"_part_{c}": F.col(c) for c in by})
    names = [f"_part_{c}" for c in by]
    (
        parted.repartition(*names)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*names)
        .json(path)
    )


def read_parts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Documents of all folders; the columns that name the folders are also in the documents."""
    return spark.read.schema(schema).json(path).select(*schema.names)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """Parquet partitioned by year.

    The rebalance hint lets adaptive execution split large years and merge small ones, so
    file sizes stay even at any volume and no year is one task.
    """
    out = df if "year" in df.columns else df.withColumn("year", F.year(DATE))
    (
        out.hint("rebalance", "year")
        .sortWithinPartitions("year", "series_id", DATE)
        .write.mode("overwrite")
        .partitionBy("year")
        .parquet(path)
    )


def write_buckets(df: DataFrame, name: str, path: str, buckets: int, by: tuple = (*SERIES, DATE)) -> DataFrame:
    """A Parquet table in ``path``, bucketed by ``by`` and sorted by series and day within a bucket; read back.

    Two tables of equally many buckets merge or align by series and day without an exchange, and days
    spread a hot series over all buckets. Bucketed by series alone (``by=SERIES``), ranks and windows per
    series need no exchange either, at the price of a hot series being one bucket. One task writes a
    bucket, as one file.
    """
    rows = df.repartition(buckets, *by).write.mode("overwrite").format("parquet").option("path", path)
    rows.bucketBy(buckets, *by).sortBy(*SERIES, DATE).saveAsTable(name)
    return df.sparkSession.table(name)
