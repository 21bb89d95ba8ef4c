"""Forecast tables, and the checks, scores and classes of a forecast.

Assessments are column arithmetic over one summary row per series. The summary's columns:
``hist_trend`` and ``fc_trend`` (per decade), ``fc_trend_per_year``, ``fc_r2``, ``fc_p``,
``trend_ratio``, ``rmse`` (in sample), ``mean_value``, the fold averages of
``evaluate.summarize_folds``, ``use_primary``, and the outcome of ``quality_checks``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsengine.functions import texts
from tsengine.functions.columns import banded, clip, codes, total
from tsengine.functions.stats import DAYS_PER_YEAR, z_score
from tsengine.operators import evaluate, smoothing
from tsengine.operators.order import POS, ROWS
from tsengine.operators.trend import fit_trends, ordinal_trend
from tsengine.schema import DATE, DEFAULTS, SERIES
from tsengine.session import materialize

INFINITY = float("inf")


def with_interval(
    steps: DataFrame, residuals: DataFrame, confidence: float = DEFAULTS.confidence, keys=SERIES
) -> DataFrame:
    """Dates and expanding bounds for (series, step, forecast) rows.

    ``residuals`` has one row per series with ``residual_std`` and ``last_date``.
    """
    margin = z_score(confidence) * F.col("residual_std") * F.sqrt(F.col("step") / DAYS_PER_YEAR)
    return steps.join(residuals, list(keys)).select(
        *keys,
        F.date_add("last_date", F.col("step")).alias(DATE),
        "forecast",
        (F.col("forecast") + margin).alias("forecast_upper"),
        (F.col("forecast") - margin).alias("forecast_lower"),
    )


def residual_spread(fitted: DataFrame, actual: str, predicted: str, keys=SERIES) -> DataFrame:
    """Sample deviation of the residuals and the last day of each series."""
    return fitted.groupBy(*keys).agg(
        F.stddev_samp(F.col(actual) - F.col(predicted)).alias("residual_std"),
        F.max(DATE).alias("last_date"),
    )


def horizon(models: DataFrame, steps: int) -> DataFrame:
    return models.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))


def linear_steps(history: DataFrame, steps: int, keys=SERIES) -> DataFrame:
    """Straight line of ranked readings (``y``, ``pos``), continued for the given steps.

    A series with one reading, which has no line, keeps its value.
    """
    fit = evaluate.linear_model(history, keys)
    length = history.groupBy(*keys).agg((F.max(POS) + 1).alias(ROWS), F.avg("y").alias("_mean"))
    line = F.col("slope") * (F.col(ROWS) + F.col("step") - 1) + F.col("intercept")
    value = F.coalesce(line, F.col("_mean"))
    return horizon(length.join(fit, list(keys), "left"), steps).select(*keys, "step", value.alias("forecast"))


def naive_steps(history: DataFrame, steps: int, keys=SERIES) -> DataFrame:
    """The last reading, repeated."""
    last = history.groupBy(*keys).agg(F.max_by("y", POS).alias("forecast"))
    return horizon(last, steps).select(*keys, "step", "forecast")


def seasonal_naive_steps(
    history: DataFrame, steps: int, season: int = DEFAULTS.season_length, keys=SERIES
) -> DataFrame:
    """The last season, repeated: each of its readings is copied to the steps it serves."""
    cycle = F.least(F.lit(season), F.col(ROWS))
    first = (F.col(POS) - (F.col(ROWS) - cycle) + 1).cast("int")
    last_cycle = history.filter(F.col(POS) >= F.col(ROWS) - cycle)
    served = F.when(first <= steps, F.sequence(first, F.lit(steps), cycle.cast("int")))
    return last_cycle.select(*keys, F.explode(served).alias("step"), F.col("y").alias("forecast"))


def linear_forecast(
    history: DataFrame,
    residuals: DataFrame,
    steps: int,
    confidence: float = DEFAULTS.confidence,
    keys=SERIES,
) -> DataFrame:
    """The fallback forecast: the straight line with expanding bounds."""
    return with_interval(linear_steps(history, steps, keys), residuals, confidence, keys)


def forecast_trend(steps: DataFrame, keys=SERIES) -> DataFrame:
    """Straight line through the forecast over its ordinal."""
    fit = ordinal_trend(steps.withColumn("_ordinal", F.col("step") - 1), "forecast", "_ordinal", keys)
    return fit.select(
        *keys,
        F.col("trend_per_year").alias("fc_trend_per_year"),
        F.col("trend_per_decade").alias("fc_trend"),
        F.col("r_squared").alias("fc_r2"),
        F.col("p_value").alias("fc_p"),
    )


def historical_trend(df: DataFrame, value: str = "temperature", keys=SERIES) -> DataFrame:
    """Straight line through the daily series; days without a value are skipped but counted."""
    fit = fit_trends(df, [value], F.unix_date(DATE), F.min("_x"), keys)
    return fit.select(
        *keys,
        F.col("mean").alias("mean_value"),
        F.col("trend_per_year").alias("hist_trend_per_year"),
        F.col("trend_per_decade").alias("hist_trend"),
        F.col("r_squared").alias("hist_r2"),
        F.col("p_value").alias("hist_p"),
    )


def trend_ratio(forecast: Column, historical: Column) -> Column:
    """|forecast / historical|, infinite where there is no historical trend."""
    return F.coalesce(F.abs(F.try_divide(forecast, historical)), F.lit(INFINITY))


def quality_checks(
    forecast: DataFrame,
    summary: DataFrame,
    floor: float = DEFAULTS.value_floor,
    ceiling: float = DEFAULTS.value_ceiling,
    max_ratio: float = DEFAULTS.max_trend_ratio,
    keys=SERIES,
) -> DataFrame:
    """Six checks of a forecast table against its history: one aggregate, then columns.

    ``summary`` needs ``mean_value``, ``hist_trend`` and ``fc_trend``.
    """
    width = F.col("forecast_upper") - F.col("forecast_lower")
    value = F.when(~F.isnan("forecast"), F.col("forecast"))
    shape = forecast.groupBy(*keys).agg(
        F.count_if(value.isNull()).alias("missing_values"),
        F.coalesce(F.min(value), F.lit(0.0)).alias("fc_min"),
        F.coalesce(F.max(value), F.lit(0.0)).alias("fc_max"),
        F.avg(value).alias("fc_mean"),
        F.count_if(width < 0).alias("invalid_intervals"),
        F.avg(width).alias("mean_width"),
    )
    rows = shape.join(summary, list(keys))
    c = F.col
    deviation = F.coalesce(F.abs(F.try_divide(c("fc_mean") - c("mean_value"), c("mean_value"))), F.lit(0.0))
    rows = rows.withColumns(
        {
            "mean_deviation_pct": deviation * 100,
            "_ratio": F.abs(F.try_divide(c("fc_trend"), c("hist_trend"))),
        }
    )
    def filled(key: str, *args) -> Column:
        return F.format_string(texts.QUALITY_ISSUES[key], *args)

    issues = codes(
        [
            (c("missing_values") > 0, filled("missing", "missing_values")),
            (
                (c("fc_min") < floor) | (c("fc_max") > ceiling),
                filled("range", "fc_min", "fc_max", F.lit(floor), F.lit(ceiling)),
            ),
            (F.abs(c("fc_trend")) > 10.0, filled("slope", "fc_trend")),
            (c("invalid_intervals") > 0, filled("interval", "invalid_intervals")),
            (c("mean_width") > 20.0, filled("width", "mean_width")),
            (c("mean_deviation_pct") > 20.0, filled("mean", "fc_mean", "mean_deviation_pct", "mean_value")),
            (c("_ratio") > max_ratio * 2, filled("ratio", "_ratio")),
        ]
    )
    kept = [
        "missing_values", "fc_min", "fc_max", "fc_mean", "invalid_intervals", "mean_width",
        "mean_deviation_pct", "quality_issues",
    ]
    checked = rows.withColumn("quality_issues", issues)
    return checked.select(*keys, *kept, (F.size("quality_issues") == 0).alias("quality_passed"))


def reliability_label(score: Column) -> Column:
    *bands, (_, lowest) = texts.RELIABILITY
    return banded([(score >= limit, label) for limit, label in bands], lowest)


# Weights of the seven reliability factors.
RELIABILITY_WEIGHTS = {
    "consistency": 0.20,
    "r_squared": 0.15,
    "rmse_accuracy": 0.15,
    "significance": 0.10,
    "validation": 0.20,
    "quality": 0.10,
    "benchmark": 0.10,
}


def reliability(
    ratio: Column, fc_r2: Column, fc_p: Column, issues: Column, use_primary: Column
) -> Column:
    """Struct of the score, its label and its factors, from the summary row."""
    mean = F.abs("mean_value")

    def closeness(error: Column, undefined: float) -> Column:
        return F.greatest(F.lit(0.0), F.coalesce(1.0 - F.try_divide(error * 100.0, mean) / 20.0, F.lit(undefined)))

    validated = (clip(F.col("avg_r_squared") / 0.5, 0.0, 1.0) + closeness(F.col("avg_rmse"), 0.5)) / 2
    factors = {
        "consistency": F.when(ratio >= 1.0, F.greatest(F.lit(0.0), 1.0 - (ratio - 1.0) / 2.0)).otherwise(1.0),
        "r_squared": F.least(F.lit(1.0), fc_r2 / 0.5),
        "rmse_accuracy": closeness(F.col("rmse"), 0.0),
        "significance": F.when(fc_p < 0.05, 1.0).otherwise(0.5),
        "validation": F.when(F.col("n_folds") > 0, validated).otherwise(0.5),
        "quality": F.greatest(F.lit(0.0), 1.0 - issues * 0.25),
        "benchmark": F.when(use_primary, 0.8).otherwise(0.4),
    }
    score = F.round(total([factors[k] * w for k, w in RELIABILITY_WEIGHTS.items()]), 3)
    return F.struct(
        score.alias("score"),
        reliability_label(score).alias("label"),
        F.struct(*[F.round(v, 3).alias(k) for k, v in factors.items()]).alias("factors"),
    )


def classify(
    score: Column,
    ratio: Column,
    fc_r2: Column,
    fc_trend: Column,
    issues: Column,
    max_ratio: float = DEFAULTS.max_trend_ratio,
) -> Column:
    """Struct of the forecast class, its reasons and the recommended action."""
    hist = F.col("hist_trend")
    poor_rmse, poor_r2 = F.col("avg_rmse") > 5.0, F.col("avg_r_squared") < 0.0
    validation_failed = poor_rmse | poor_r2
    quality_failed = F.size(issues) > 0
    high_ratio, low_r2 = ratio > max_ratio, fc_r2 < 0.10
    opposed = (hist != 0) & (fc_trend != 0) & ((hist > 0) != (fc_trend > 0))
    disqualified = high_ratio | low_r2 | opposed | validation_failed | quality_failed
    found = texts.FORECAST_REASONS
    validation = codes(
        [
            (poor_rmse, F.format_string(found["validation_rmse"], "avg_rmse")),
            (poor_r2, F.format_string(found["validation_r2"], "avg_r_squared")),
        ]
    )
    quality = F.transform(issues, lambda issue: F.format_string(found["quality"], issue))
    others = codes(
        [
            (high_ratio, F.format_string(found["ratio"], ratio, F.lit(max_ratio))),
            (low_r2, F.format_string(found["low_r2"], fc_r2)),
            (opposed, found["direction"]),
        ]
    )
    kind = banded(
        [
            ((score >= 0.60) & ~disqualified, "reliable"),
            ((score >= 0.40) & ~validation_failed & ~quality_failed, "low_confidence"),
        ],
        "exploratory",
    )
    actions = F.create_map(*[F.lit(v) for pair in texts.FORECAST_ACTIONS.items() for v in pair])
    return F.struct(
        kind.alias("forecast_class"),
        F.concat(validation, quality, others).alias("classification_reasons"),
        F.element_at(actions, kind).alias("recommended_action"),
    )


def assess(summary: DataFrame, max_ratio: float = DEFAULTS.max_trend_ratio) -> DataFrame:
    """Reliability and class of every forecast, the switch to the linear fallback, and dampening.

    Both candidates are scored for every series and one is chosen per row. The linear
    fallback has the historical trend itself, so its ratio is one.
    """
    c = F.col
    no_issues = F.expr("cast(array() as array<string>)")
    rows = summary.withColumn("trend_ratio", trend_ratio(c("fc_trend"), c("hist_trend")))
    rows = rows.withColumn(
        "_primary", reliability(c("trend_ratio"), c("fc_r2"), c("fc_p"), F.size("quality_issues"), c("use_primary"))
    )
    rows = rows.withColumn(
        "_primary_class",
        classify(c("_primary.score"), c("trend_ratio"), c("fc_r2"), c("fc_trend"), c("quality_issues"), max_ratio),
    )
    rows = rows.withColumn("linear_ratio", trend_ratio(c("hist_trend"), c("hist_trend")))
    rows = rows.withColumn(
        "_linear", reliability(c("linear_ratio"), c("hist_r2"), c("hist_p"), F.lit(0), F.lit(False))
    )
    rows = rows.withColumn(
        "_linear_class",
        classify(c("_linear.score"), c("linear_ratio"), c("hist_r2"), c("hist_trend"), no_issues, max_ratio),
    )
    switch = (c("_primary_class.forecast_class") == "exploratory") & (c("linear_ratio") < c("trend_ratio"))
    rows = rows.withColumn("used_linear_fallback", switch)

    def chosen(linear: Column, primary: Column) -> Column:
        return F.when(c("used_linear_fallback"), linear).otherwise(primary)

    rows = rows.withColumns(
        {
            "primary_class": c("_primary_class.forecast_class"),
            "primary_score": c("_primary.score"),
            "reliability": chosen(c("_linear"), c("_primary")),
            "_class": chosen(c("_linear_class"), c("_primary_class")),
            "original_trend_per_decade": chosen(c("hist_trend"), c("fc_trend")),
            "_per_year": chosen(c("hist_trend_per_year"), c("fc_trend_per_year")),
            "trend_r_squared": chosen(c("hist_r2"), c("fc_r2")),
            "trend_p_value": chosen(c("hist_p"), c("fc_p")),
            "_ratio": chosen(c("linear_ratio"), c("trend_ratio")),
        }
    )
    dampened = (c("_ratio") > max_ratio) & (c("hist_trend") != 0)
    factor = F.when(c("_ratio") > max_ratio, F.lit(max_ratio) / c("_ratio")).otherwise(1.0)
    rows = rows.withColumns({"trend_dampening_applied": dampened, "dampening_factor": factor})
    per_decade = F.when(
        c("trend_dampening_applied"), c("original_trend_per_decade") * c("dampening_factor")
    ).otherwise(c("original_trend_per_decade"))
    per_year = F.when(c("trend_dampening_applied"), per_decade / 10).otherwise(c("_per_year"))
    return rows.withColumns(
        {
            "trend_per_decade": per_decade,
            "trend_per_year": per_year,
            "trend_consistency_ratio": F.round("_ratio", 3),
            "reliability_score": c("reliability.score"),
            "reliability_label": c("reliability.label"),
            "reliability_factors": c("reliability.factors"),
            "forecast_class": c("_class.forecast_class"),
            "classification_reasons": c("_class.classification_reasons"),
            "recommended_action": c("_class.recommended_action"),
        }
    ).drop("_primary", "_primary_class", "_linear", "_linear_class", "_class", "_per_year", "_ratio", "reliability")


def run_forecast(
    daily: DataFrame,
    value: str = "temperature",
    horizon_years: int = DEFAULTS.horizon_years,
    confidence: float = DEFAULTS.confidence,
    season: int = DEFAULTS.season_length,
    floor: float = DEFAULTS.value_floor,
    ceiling: float = DEFAULTS.value_ceiling,
    keys=SERIES,
    fixed: dict | None = None,
) -> dict[str, DataFrame]:
    """Fit, validate, benchmark, forecast, check, score, classify and choose, for all series.

    Days without a reading may be absent or null. Returns the tables ``forecast``, ``summary``, ``folds``,
    ``benchmark`` and ``fitted``. All fits of a series (full, folds, holdout) are snapshots of one run
    over its readings; their results are written once and read by every later step. ``fixed`` gives the
    smoothing parameters instead of searching them. A series whose smoothing fit fails has the straight
    line as its forecast and ``failed`` in the summary; one without any reading has a summary row with
    ``failed`` and nulls, and no forecast rows.
    """
    steps = horizon_years * 365
    ranked = materialize(evaluate.readings(daily, value, keys))
    ends = evaluate.training_ends(F.col(ROWS))
    fits = materialize(evaluate.smoothing_fits(ranked, ends, keys, wanted=season, fixed=fixed))
    models = fits.filter(F.col("fit") == evaluate.FULL_FIT).drop("fit")
    fold_models = fits.filter(F.col("fit") > evaluate.FULL_FIT).withColumnRenamed("fit", "fold")
    folds = materialize(evaluate.validate_smoothing(ranked, value, keys, fold_models))
    holdout = fits.filter(F.col("fit") == evaluate.HOLDOUT_FIT).drop("fit")
    predictions = evaluate.baseline_predictions(ranked, value, season=season, models=holdout, keys=keys)
    benchmark = materialize(
        evaluate.rank_models(evaluate.accuracy(predictions, keys=(*keys, "model")), keys)
    )
    fitted = materialize(ranked.join(smoothing.fitted_values(models, keys), [*keys, POS], "left"))
    in_sample = evaluate.accuracy(fitted, "y", "fitted", keys)
    residuals = materialize(residual_spread(fitted, "y", "fitted", keys))
    smoothed = materialize(smoothing.forecast(models, steps, keys))
    unfitted = ranked.select(*keys).distinct().join(smoothed.select(*keys).distinct(), list(keys), "left_anti")
    lines = linear_steps(ranked.join(unfitted, list(keys), "left_semi"), steps, keys)
    ahead = smoothed.select(*keys, "step", "forecast").unionByName(lines.withColumn("step", F.col("step").cast(smoothed.schema["step"].dataType)))
    primary = with_interval(ahead, residuals, confidence, keys)
    trends = forecast_trend(ahead, keys).join(historical_trend(daily, value, keys), list(keys), "left")
    trends = materialize(trends)
    checks = quality_checks(primary, trends, floor, ceiling, keys=keys)
    choice = evaluate.choose_model(benchmark, keys=keys)
    summary = (
        trends.join(in_sample.drop("rows"), list(keys))
        .join(evaluate.summarize_folds(folds, trends, keys), list(keys))
        .join(choice, list(keys))
        .join(checks, list(keys))
        .join(residuals.select(*keys, "residual_std"), list(keys))
    )
    summary = assess(summary).withColumn("forecast_horizon_years", F.lit(horizon_years))
    summary = summary.join(unfitted.withColumn("failed", F.lit(True)), list(keys), "left").na.fill(False, ["failed"])
    switched = F.coalesce(F.col("used_linear_fallback"), F.lit(False)) | F.col("failed")
    summary = summary.withColumn("used_linear_fallback", switched)
    without = daily.select(*keys).distinct().join(ranked.select(*keys).distinct(), list(keys), "left_anti")
    without = without.withColumns({"failed": F.lit(True), "forecast_horizon_years": F.lit(horizon_years)})
    summary = materialize(summary.unionByName(without, allowMissingColumns=True))
    linear = with_interval(linear_steps(ranked, steps, keys), residuals, confidence, keys)
    switched = summary.select(*keys, "used_linear_fallback").filter(F.col("used_linear_fallback").isNotNull())
    chosen = (
        primary.join(switched, list(keys)).filter(~F.col("used_linear_fallback"))
        .unionByName(linear.join(switched, list(keys)).filter("used_linear_fallback"))
        .drop("used_linear_fallback")
    )
    return {
        "forecast": chosen,
        "summary": summary,
        "folds": folds,
        "benchmark": benchmark,
        "fitted": fitted.withColumn("residual", F.col("y") - F.col("fitted")),
    }
