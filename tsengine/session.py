"""Session builder for local runs, and lineage cuts that survive executor loss."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "tsengine") -> SparkSession:
    parallel = os.cpu_count() or 4 if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parallel))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where that is unset in local mode, the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return spark.conf.get("spark.sql.warehouse.dir")


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows once as a Parquet table in the shared folder and read them back.

    Branches then neither recompute the rows nor depend on executors that are lost, and
    the table's size is known to the planner.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _scratch_root(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/tsengine/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, for tables of this application."""
    return f"{_scratch_root(spark)}/{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables this application has materialized; results that read them end here."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash the groups over all task slots before a CPU-bound grouped function.

    Adaptive execution merges small partitions by their bytes; a model fit is small in
    bytes and long in time, so the partition number is fixed here. The grouping that
    follows reuses this partitioning: there is no second exchange.
    """
    spark = df.sparkSession
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(wanted, spark.sparkContext.defaultParallelism), *keys)
