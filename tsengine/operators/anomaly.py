"""Statistical anomaly flags and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsengine.functions.columns import any_of, banded, display, safe_divide
from tsengine.operators import sketches
from tsengine.operators.joins import attach
from tsengine.schema import CORE_VARIABLES, DEFAULTS, SERIES, present

ZSCORE, FOREST, COMBINED = "anomaly_zscore", "anomaly_iforest", "anomaly_combined"


def with_moments(df: DataFrame, values, keys=SERIES, population: bool = False) -> DataFrame:
    """Mean and deviation of each value beside every row of its series.

    The moments have one row per series; ``attach`` spreads the rows of a hot one.
    """
    spread = F.stddev_pop if population else F.stddev_samp
    moments = df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"_mean_{c}") for c in values], *[spread(c).alias(f"_std_{c}") for c in values]
    )
    return attach(df, moments, keys)


def zscore(c: str) -> Column:
    return F.try_divide(F.col(c) - F.col(f"_mean_{c}"), F.col(f"_std_{c}"))


def zscore_flags(
    df: DataFrame, values=CORE_VARIABLES, threshold: float = DEFAULTS.zscore_threshold, keys=SERIES
) -> DataFrame:
    """True where any variable is further than ``threshold`` sample deviations from its mean."""
    names = present(df, values)
    flag = any_of([F.coalesce(F.abs(zscore(c)) > threshold, F.lit(False)) for c in names])
    return with_moments(df, names, keys).select(*df.columns, flag.alias(ZSCORE))


def iqr_flags(
    df: DataFrame,
    value: str = "temperature",
    multiplier: float = DEFAULTS.iqr_multiplier,
    approx: bool = False,
    keys=SERIES,
) -> DataFrame:
    """True strictly outside the quartile fences; ``approx`` takes them from a sketch of fixed size."""
    points = (0.25, 0.75)
    q = sketches.quantiles(value, points) if approx else F.percentile(value, F.array(*[F.lit(p) for p in points]))
    quartiles = df.groupBy(*keys).agg(q.alias("_q"))
    reach = (F.col("_q")[1] - F.col("_q")[0]) * multiplier
    outside = (F.col(value) < F.col("_q")[0] - reach) | (F.col(value) > F.col("_q")[1] + reach)
    return attach(df, quartiles, keys).select(
        *df.columns, F.coalesce(outside, F.lit(False)).alias("anomaly_iqr")
    )


def standard_scale(df: DataFrame, values, keys=SERIES) -> DataFrame:
    """(x - mean) / population deviation; a constant column is only centred."""
    scaled = {}
    for c in values:
        divisor = F.when(F.col(f"_std_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_std_{c}"))
        scaled[c] = (F.col(c) - F.col(f"_mean_{c}")) / divisor
    return with_moments(df, values, keys, population=True).withColumns(scaled).select(*df.columns)


def combine_flags(df: DataFrame, flags=(ZSCORE, FOREST)) -> DataFrame:
    """OR of the flags that are present; a missing flag counts as false."""
    names = present(df, flags)
    return df.withColumn(COMBINED, any_of([F.coalesce(F.col(c), F.lit(False)) for c in names]))


def threshold_band(
    df: DataFrame, value: str = "temperature", threshold: float = DEFAULTS.zscore_threshold, keys=SERIES
) -> DataFrame:
    mean, std = F.avg(value), F.stddev_samp(value)
    return df.groupBy(*keys).agg(
        mean.alias("mean"),
        std.alias("std"),
        (mean + threshold * std).alias("upper"),
        (mean - threshold * std).alias("lower"),
    )


def anomaly_days(df: DataFrame, keys=SERIES) -> DataFrame:
    """Flagged days with two variables, rounded for export."""
    return df.filter(COMBINED).select(
        *keys, "date", *[display(F.col(c), 2).alias(c) for c in present(df, ("temperature", "precipitation"))]
    )


def anomaly_summary(df: DataFrame, value: str = "temperature", keys=SERIES) -> DataFrame:
    """Flagged days, their share, the value among them, and days per method; one pass."""
    flagged = F.when(F.col(COMBINED), F.col(value))
    counts = [F.count_if(c).alias(f"{name}_days") for c, name in ((ZSCORE, "zscore"), (FOREST, "iforest")) if c in df.columns]
    out = df.groupBy(*keys).agg(
        F.count("*").alias("total_rows"),
        F.count_if(COMBINED).alias("total_anomaly_days"),
        F.avg(flagged).alias("anomaly_mean"),
        F.max(flagged).alias("anomaly_max"),
        F.min(flagged).alias("anomaly_min"),
        F.avg(value).alias("overall_mean"),
        *counts,
    )
    share = safe_divide(F.col("total_anomaly_days") * 100.0, F.col("total_rows"))
    return out.withColumn("anomaly_percentage", display(share, 2))


def deviation_card(summary: DataFrame) -> DataFrame:
    """Normal days, largest deviation of a flagged value from the mean, and a frequency label."""
    share = safe_divide(F.col("total_anomaly_days") * 100.0, F.col("total_rows"))
    largest = F.greatest(
        F.abs(F.col("anomaly_max") - F.col("overall_mean")),
        F.abs(F.col("anomaly_min") - F.col("overall_mean")),
    )
    return summary.withColumns(
        {
            "normal_days": F.col("total_rows") - F.col("total_anomaly_days"),
            "largest_deviation": largest,
            "frequency": banded([(share > 5, "frequent"), (share > 2, "occasional")], "rare"),
        }
    )
