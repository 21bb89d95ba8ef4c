"""Summaries, calendar aggregates, correlation and distribution statistics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsengine.functions.columns import banded, display
from tsengine.operators import sketches
from tsengine.operators.joins import attach
from tsengine.schema import CORE_VARIABLES, DATE, SERIES, VARIABLES, present

QUARTILES = (0.25, 0.5, 0.75)


def quantiles(c: str, approx: bool = False) -> Column:
    """Quartiles; exact and interpolated unless ``approx``.

    The exact form keeps a count per distinct value, which one reading per day bounds. Rows
    of a finer grain take ``approx``, a sketch of fixed size.
    """
    return sketches.quantiles(c, QUARTILES) if approx else F.percentile(c, F.array(*[F.lit(q) for q in QUARTILES]))


def summary_statistics(df: DataFrame, values=VARIABLES, approx: bool = False, keys=SERIES) -> DataFrame:
    """Mean, sample deviation, extremes, quartiles and count per variable; one pass."""
    names = present(df, values)
    wide = df.groupBy(*keys).agg(
        *[
            F.struct(
                F.lit(c).alias("variable"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).alias("min"),
                F.max(c).alias("max"),
                quantiles(c, approx).alias("q"),
                F.count(c).alias("count"),
            ).alias(c)
            for c in names
        ]
    )
    rows = wide.select(*keys, F.inline(F.array(*names)))
    q = F.col("q")
    return rows.withColumns({"q25": q[0], "median": q[1], "q75": q[2]}).drop("q")


def monthly_aggregates(df: DataFrame, values=VARIABLES, keys=SERIES) -> DataFrame:
    return (
        df.filter(F.col(DATE).isNotNull())
        .groupBy(*keys, F.year(DATE).alias("year"), F.month(DATE).alias("month"))
        .agg(*[F.avg(c).alias(c) for c in present(df, values)])
    )


def monthly_feed(df: DataFrame, keys=SERIES) -> DataFrame:
    """Monthly means of four variables, rounded for export."""
    names = present(df, ("temperature", "precipitation", "humidity", "solar_radiation"))
    monthly = monthly_aggregates(df, names, keys)
    return monthly.select(*keys, "year", "month", *[display(F.col(c), 2).alias(c) for c in names])


def annual_aggregates(df: DataFrame, values=VARIABLES, keys=SERIES) -> DataFrame:
    stats = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    return (
        df.filter(F.col(DATE).isNotNull())
        .groupBy(*keys, F.year(DATE).alias("year"))
        .agg(*[fn(c).alias(f"{c}_{s}") for c in present(df, values) for s, fn in stats.items()])
    )


def correlation(df: DataFrame, values=CORE_VARIABLES, keys=SERIES) -> DataFrame:
    """Pairwise-complete Pearson correlation in long form; null where a side is constant."""
    names = present(df, values)

    def pearson(x: str, y: str) -> Column:
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        spread = F.sqrt(F.var_samp(F.when(both, F.col(x))) * F.var_samp(F.when(both, F.col(y))))
        return F.try_divide(F.covar_samp(x, y), spread)

    if len(names) < 2:
        empty = df.select(*keys).limit(0)
        return empty.selectExpr(*keys, "'' as var_x", "'' as var_y", "0D as corr")
    pairs = list(combinations(names, 2))
    wide = df.groupBy(*keys).agg(
        *[pearson(x, y).alias(f"{x}|{y}") for x, y in pairs],
        *[F.when(F.var_samp(c) > 0, F.lit(1.0)).alias(f"{c}|{c}") for c in names],
    )
    cells = [(x, y, f"{x}|{y}") for x, y in pairs]
    cells += [(y, x, f"{x}|{y}") for x, y in pairs] + [(c, c, f"{c}|{c}") for c in names]
    rows = F.array(
        *[
            F.struct(F.lit(x).alias("var_x"), F.lit(y).alias("var_y"), F.col(f"`{n}`").alias("corr"))
            for x, y, n in cells
        ]
    )
    return wide.select(*keys, F.inline(rows))


def annual_trends(df: DataFrame, keys=SERIES) -> DataFrame:
    """Slope of the annual means over the ordinal of the year; at least two years."""
    names = present(df, ("temperature", "precipitation"))
    annual = df.groupBy(*keys, F.year(DATE).alias("year")).agg(*[F.avg(c).alias(c) for c in names])
    # One row per series and year: a window over it is at most a few thousand rows.
    by_year = Window.partitionBy(*keys).orderBy("year")
    ranked = annual.withColumn("_ordinal", (F.row_number().over(by_year) - 1).cast("double"))
    slopes = ranked.groupBy(*keys).agg(
        F.count("*").alias("years"), *[F.regr_slope(c, "_ordinal").alias(f"{c}_trend_per_year") for c in names]
    )
    out = slopes.filter(F.col("years") >= 2)
    if "temperature" in names:
        out = out.withColumn("temperature_trend_per_decade", F.col("temperature_trend_per_year") * 10)
    return out


def month_totals(df: DataFrame, value: str = "precipitation", keys=SERIES) -> DataFrame:
    """Total per calendar month over all years; nothing measured counts as zero."""
    return df.groupBy(*keys, F.month(DATE).alias("month")).agg(
        F.coalesce(F.sum(value), F.lit(0.0)).alias("total")
    )


def top_months(df: DataFrame, value: str = "precipitation", k: int = 3, keys=SERIES) -> DataFrame:
    ranked = Window.partitionBy(*keys).orderBy(F.desc("total"), "month")
    return (
        month_totals(df, value, keys)
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
    )


def wet_days(df: DataFrame, value: str = "precipitation", limit: float = 1.0, keys=SERIES) -> DataFrame:
    """Daily mean and maximum, days above the limit, and the month with the largest total."""
    per_month = df.groupBy(*keys, F.month(DATE).alias("_month")).agg(
        F.sum(value).alias("_sum"),
        F.count(value).alias("_count"),
        F.max(value).alias("_max"),
        F.count_if(F.col(value) > limit).alias("_wet"),
        F.coalesce(F.sum(value), F.lit(0.0)).alias("_total"),
    )
    best = F.max_by(F.struct("_month", "_total"), F.struct("_total", -F.col("_month")))
    return per_month.groupBy(*keys).agg(
        F.try_divide(F.sum("_sum"), F.sum("_count")).alias("mean"),
        F.max("_max").alias("max"),
        F.sum("_wet").alias("wet_days"),
        best["_month"].alias("peak_month"),
        best["_total"].alias("peak_total"),
    )


def month_profile(df: DataFrame, value: str = "temperature", keys=SERIES) -> DataFrame:
    return df.groupBy(*keys, F.month(DATE).alias("month")).agg(
        F.avg(value).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.stddev_samp(value).alias("std"),
    )


def season_card(df: DataFrame, value: str = "temperature", keys=SERIES) -> DataFrame:
    """Warmest, coldest and most variable month, their range, and the mean of monthly means."""
    early = -F.col("month")
    out = month_profile(df, value, keys).groupBy(*keys).agg(
        F.max_by("month", F.struct("mean", early)).alias("warmest_month"),
        F.max("mean").alias("warmest"),
        F.min_by("month", F.struct("mean", "month")).alias("coldest_month"),
        F.min("mean").alias("coldest"),
        F.max_by("month", F.struct("std", early)).alias("most_variable_month"),
        F.avg("mean").alias("mean_of_months"),
    )
    return out.withColumn("seasonal_range", F.col("warmest") - F.col("coldest"))


def month_means(df: DataFrame, value: str = "temperature", keys=SERIES) -> DataFrame:
    """Mean of each of the twelve months, zero for a month without values."""
    wide = df.groupBy(*keys).agg(
        *[F.avg(F.when(F.month(DATE) == m, F.col(value))).alias(f"_m{m}") for m in range(1, 13)]
    )
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("month"), F.coalesce(f"_m{m}", F.lit(0.0)).alias("mean"))
            for m in range(1, 13)
        ]
    )
    return wide.select(*keys, F.inline(rows))


def box_statistics(
    df: DataFrame, values=("temperature", "precipitation", "humidity"), reach: float = 1.5, keys=SERIES, approx: bool = False
) -> DataFrame:
    """Quartiles, whiskers inside the 1.5-IQR fences, and outliers per calendar month; ``approx`` as in ``quantiles``."""
    names = present(df, values)
    group = [*keys, "month"]
    daily = df.withColumn("month", F.month(DATE)).select(*group, *names)
    quartiles = daily.groupBy(*group).agg(*[quantiles(c, approx).alias(f"_q_{c}") for c in names])
    joined = attach(daily, quartiles, group)

    def box(c: str) -> Column:
        q = F.col(f"_q_{c}")
        low = q[0] - reach * (q[2] - q[0])
        high = q[2] + reach * (q[2] - q[0])
        inside = F.when((F.col(c) >= low) & (F.col(c) <= high), F.col(c))
        return F.struct(
            F.lit(c).alias("variable"),
            F.first(q[0]).alias("q1"),
            F.first(q[1]).alias("median"),
            F.first(q[2]).alias("q3"),
            F.least(F.min(inside), F.first(q[0])).alias("whisker_low"),
            F.greatest(F.max(inside), F.first(q[2])).alias("whisker_high"),
            F.count_if((F.col(c) < low) | (F.col(c) > high)).alias("outliers"),
        ).alias(c)

    boxes = joined.groupBy(*group).agg(*[box(c) for c in names])
    return boxes.select(*group, F.inline(F.array(*names)))


# Deviation limits and labels of the range cards.
SPREAD_BANDS = {
    "temperature": ((5, "wide"), (3, "moderate"), (None, "narrow")),
    "humidity": ((15, "significant"), (10, "moderate"), (None, "mild")),
}
# Limits and labels of the range and peak of solar radiation, and of mean humidity.
SOLAR_RANGE_BANDS = ((10, "wide"), (6, "moderate"), (None, "narrow"))
SOLAR_PEAK_BANDS = ((22, "high"), (18, "moderate"), (None, "low"))
REGIME_LIMIT = (55, "monsoon-influenced", "semi-arid")


def _above(c: Column, bands) -> Column:
    return banded([(c > limit, label) for limit, label in bands[:-1]], bands[-1][1])


def range_card(df: DataFrame, keys=SERIES) -> DataFrame:
    """Mean, extremes, deviation, range and their labels for three variables."""
    names = ("temperature", "humidity", "solar_radiation")
    out = df.groupBy(*keys).agg(
        *[
            fn(c).alias(f"{c}_{s}")
            for c in names
            for s, fn in (("mean", F.avg), ("max", F.max), ("min", F.min), ("std", F.stddev_samp))
        ]
    )
    ranges = {f"{c}_range": F.col(f"{c}_max") - F.col(f"{c}_min") for c in names}
    out = out.withColumns(ranges)
    return out.withColumns(
        {
            "temperature_spread": _above(F.col("temperature_std"), SPREAD_BANDS["temperature"]),
            "humidity_spread": _above(F.col("humidity_std"), SPREAD_BANDS["humidity"]),
            "humidity_regime": F.when(
                F.col("humidity_mean") > REGIME_LIMIT[0], REGIME_LIMIT[1]
            ).otherwise(REGIME_LIMIT[2]),
            "solar_spread": _above(F.col("solar_radiation_range"), SOLAR_RANGE_BANDS),
            "solar_peak": _above(F.col("solar_radiation_max"), SOLAR_PEAK_BANDS),
        }
    )


def analysis_span(df: DataFrame, keys=SERIES) -> DataFrame:
    """First and last year and the number of distinct years."""
    years = df.groupBy(*keys, F.year(DATE).alias("_year")).agg(F.count("*").alias("_rows"))
    return years.groupBy(*keys).agg(
        F.min("_year").alias("analysis_start_year"),
        F.max("_year").alias("analysis_end_year"),
        F.count("*").alias("total_years"),
    )


def half_period_contrast(df: DataFrame, value: str = "precipitation", keys=SERIES) -> DataFrame:
    """Mean up to the median year of the rows, and mean after it.

    Years fold to one row each before the median is taken, so a series is only as long as
    its years.
    """
    years = df.groupBy(*keys, F.year(DATE).alias("_year")).agg(
        F.count("*").alias("_rows"), F.sum(value).alias("_sum"), F.count(value).alias("_count")
    )
    middle = years.groupBy(*keys).agg(F.percentile("_year", F.lit(0.5), F.col("_rows")).alias("mid_year"))
    rows = years.join(middle, list(keys))
    first = F.col("_year") <= F.col("mid_year")

    def mean(condition: Column) -> Column:
        return F.try_divide(F.sum(F.when(condition, F.col("_sum"))), F.sum(F.when(condition, F.col("_count"))))

    return rows.groupBy(*keys).agg(
        F.first("mid_year").alias("mid_year"),
        mean(first).alias("first_half_mean"),
        mean(~first).alias("second_half_mean"),
    )


def station_rollup(summary: DataFrame, stations: DataFrame, keys=SERIES) -> DataFrame:
    """Per-series rollup with the station's name and place."""
    return summary.join(stations, list(keys), "left")


def histogram(df: DataFrame, value: str, bins: int = 50, keys=SERIES) -> DataFrame:
    """Counts in equal bins between the extremes; the top edge belongs to the last bin."""
    edges = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value)
    rows = attach(rows, edges, keys)
    slot = F.floor(F.try_divide((F.col(value) - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo")))
    bin_no = F.least(F.coalesce(slot, F.lit(0)) + 1, F.lit(bins))
    width = (F.col("_hi") - F.col("_lo")) / bins
    counts = rows.groupBy(*keys, "_lo", "_hi", bin_no.alias("bin")).agg(F.count("*").alias("rows"))
    return counts.select(
        *keys,
        "bin",
        (F.col("_lo") + (F.col("bin") - 1) * width).alias("bin_start"),
        (F.col("_lo") + F.col("bin") * width).alias("bin_end"),
        "rows",
    )
