"""Linear trends, their significance, and the lines they draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsengine.functions.columns import codes
from tsengine.functions.stats import ols, ols_columns, trend_p_value
from tsengine.operators.joins import attach
from tsengine.schema import DATE, SERIES, present


def fit_trends(df: DataFrame, values, x: Column, origin: Column, keys=SERIES, p_value: bool = True) -> DataFrame:
    """OLS of each value on x, in one pass; x counts from ``origin``, an aggregate of x.

    The slope does not depend on the origin, so no second pass looks it up.
    """
    names = present(df, values)
    fitted = df.withColumn("_x", x.cast("double")).groupBy(*keys).agg(
        origin.cast("double").alias("_origin"),
        *[
            F.struct(
                F.lit(c).alias("variable"), F.avg(c).alias("mean"), ols(F.col(c), F.col("_x")).alias("fit")
            ).alias(c)
            for c in names
        ],
    )
    rows = fitted.select(*keys, "_origin", F.inline(F.array(*names)))
    columns = ols_columns(F.col("fit"))
    shifted = F.when(columns["degenerate"], F.lit(0.0)).otherwise(
        columns["intercept"] + F.coalesce(F.col("fit.slope"), F.lit(0.0)) * F.col("_origin")
    )
    out = rows.select(*keys, "variable", "mean", *[c.alias(n) for n, c in {**columns, "intercept": shifted}.items()])
    if p_value:
        p = trend_p_value(F.col("n"), F.col("slope"), F.col("std_err"), F.col("r_squared"))
        out = out.withColumn("p_value", F.when(F.col("degenerate"), F.lit(1.0)).otherwise(p))
    return out


def linear_trend(df: DataFrame, values=("temperature", "precipitation"), keys=SERIES, p_value: bool = True) -> DataFrame:
    """Trend of each variable over the days since the first date of the series."""
    day = F.unix_date(DATE)
    return fit_trends(df, values, day, F.min("_x"), keys, p_value)


def ordinal_trend(df: DataFrame, value: str, position: str, keys=SERIES, p_value: bool = True) -> DataFrame:
    """Trend of one value over a 0-based position column; non-finite values are skipped."""
    finite = F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.col(value))
    return fit_trends(
        df.withColumn(value, finite), [value], F.col(position), F.lit(0.0), keys, p_value
    )


def trend_line(df: DataFrame, value: str = "temperature", keys=SERIES) -> DataFrame:
    """Fitted line at every row; the mean where no line can be fitted."""
    fit = linear_trend(df, [value], keys, p_value=False)
    origin = df.groupBy(*keys).agg(F.min(DATE).alias("_origin"))
    small = fit.join(origin, list(keys)).select(*keys, "slope", "intercept", "mean", "degenerate", "_origin")
    line = F.when(F.col("degenerate"), F.col("mean")).otherwise(
        F.col("slope") * F.datediff(DATE, "_origin") + F.col("intercept")
    )
    return attach(df, small, keys).select(*df.columns, line.alias("trend"))


def significance_codes(p_value: Column, r_squared: Column) -> Column:
    """Rule codes for a weak trend."""
    return codes([(p_value > 0.05, "NON_SIGNIFICANT"), (r_squared < 0.01, "LOW_R2")])


def trend_warnings(trends: DataFrame) -> DataFrame:
    """One row per weak-trend warning, with the text of the warning."""
    name = F.initcap("variable")
    weak = F.format_string(
        "%s trend is not statistically significant (p=%.4f > 0.05). Trend may be due to random variation.",
        name,
        F.col("p_value"),
    )
    vague = F.format_string(
        "%s trend explains very little variance (R²=%.6f). Linear model may be inappropriate.",
        name,
        F.col("r_squared"),
    )
    listed = trends.withColumn("type", F.explode(significance_codes(F.col("p_value"), F.col("r_squared"))))
    return listed.withColumn("details", F.when(F.col("type") == "LOW_R2", vague).otherwise(weak))


def forecast_divergence(historical: Column, forecast: Column) -> Column:
    """Rule code for the difference between the two trends, null if they agree."""
    difference = F.abs(F.try_divide(forecast, historical) - 1.0) * 100
    return F.when(difference > 100, "TREND_DIVERGENCE").when(difference > 50, "TREND_DIVERGENCE_MINOR")
