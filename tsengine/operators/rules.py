"""Risk score, KPIs, findings and recommendations over one row per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsengine.functions import texts
from tsengine.functions.columns import banded, clip, codes, display
from tsengine.operators.trend import forecast_divergence
from tsengine.schema import DEFAULTS, SERIES


# -- risk ---------------------------------------------------------------------------------


def trend_metric(rate: Column) -> Column:
    """0..1, with 0.5 per decade as 1."""
    return clip(rate / 0.5, 0.0, 1.0)


def rainfall_metric(current: Column, baseline: Column) -> Column:
    """0..1, with a 50 % deviation from the baseline as 1; 0 without a baseline."""
    deviation = F.coalesce(F.try_divide(F.abs(current - baseline), baseline), F.lit(0.0))
    return clip(deviation / 0.5, 0.0, 1.0)


def anomaly_metric(percentage: Column) -> Column:
    """0..1, with 10 % as 1."""
    return clip(percentage / 10.0, 0.0, 1.0)


def forecast_factor(ratio: Column) -> Column:
    return F.when(ratio > 2.0, 1.15).when(ratio > 1.5, 1.05).otherwise(1.0)


def risk_category(score: Column) -> Column:
    return banded([(score >= 0.75, "Very High"), (score >= 0.50, "High"), (score >= 0.25, "Moderate")], "Low")


def with_risk(df: DataFrame, weights=DEFAULTS.risk_weights) -> DataFrame:
    """Risk columns from ``warming_rate_per_decade``, the half-period means,
    ``anomaly_percentage`` and ``trend_consistency_ratio``."""
    c = F.col
    out = df.withColumns(
        {
            "temp_trend_metric": trend_metric(c("warming_rate_per_decade")),
            "rainfall_metric": rainfall_metric(c("second_half_mean"), c("first_half_mean")),
            "anomaly_metric": anomaly_metric(c("anomaly_percentage")),
            "forecast_factor": forecast_factor(F.coalesce(c("trend_consistency_ratio"), F.lit(1.0))),
        }
    )
    raw = (
        weights[0] * c("temp_trend_metric") + weights[1] * c("rainfall_metric") + weights[2] * c("anomaly_metric")
    )
    out = out.withColumn("raw_score", raw)
    score = clip(c("raw_score") * clip(c("forecast_factor"), 0.8, 1.2), 0.0, 1.0)
    out = out.withColumn("risk_score", score)
    return out.withColumn("risk_category", risk_category(c("risk_score")))


# -- KPIs ---------------------------------------------------------------------------------


def executive_kpis(
    averages: DataFrame, trends: DataFrame, anomalies: DataFrame, forecasts: DataFrame, spans: DataFrame, keys=SERIES
) -> DataFrame:
    """The KPI row per series, rounded for reports; all inputs have one row per series."""
    on = list(keys)
    c = F.col
    averages = averages.select(
        *keys,
        display(F.col("temperature_mean"), 2).alias("avg_temperature"),
        display(F.col("temperature_max"), 2).alias("max_temperature"),
        display(F.col("temperature_min"), 2).alias("min_temperature"),
        display(F.col("precipitation_mean"), 2).alias("avg_precipitation"),
    )
    trends = trends.filter(c("variable") == "temperature").select(
        *keys,
        display(F.col("trend_per_decade"), 3).alias("warming_rate_per_decade"),
        c("trend_per_decade").alias("warming_rate_raw"),
        display(F.col("r_squared"), 4).alias("historical_trend_r_squared"),
        c("p_value").alias("historical_trend_p_value"),
    )
    anomalies = anomalies.select(*keys, c("total_anomaly_days").alias("anomaly_days"), "anomaly_percentage")
    forecasts = forecasts.select(
        *keys,
        display(F.col("trend_per_decade"), 3).alias("forecast_trend_per_decade"),
        display(F.col("trend_r_squared"), 4).alias("forecast_trend_r_squared"),
        c("trend_p_value").alias("forecast_trend_p_value"),
        "trend_consistency_ratio",
        display(F.col("hist_trend"), 3).alias("historical_trend_per_decade"),
        "forecast_class",
        "classification_reasons",
        "recommended_action",
        c("reliability_label").alias("forecast_reliability"),
        c("reliability_score").alias("forecast_reliability_score"),
        "reliability_factors",
        display(F.col("r_squared"), 4).alias("model_r_squared"),
        c("n_folds").alias("validation_n_folds"),
        *[display(F.col(f"avg_{m}"), 4).alias(f"validation_avg_{m}") for m in ("rmse", "mae", "mape", "r_squared")],
        c("best_model").alias("benchmark_best_model"),
        c("use_primary").alias("benchmark_use_hw"),
        c("recommendation").alias("benchmark_recommendation"),
        c("quality_passed").alias("quality_checks_passed"),
        "quality_issues",
        c("rmse").alias("model_rmse"),
        c("mae").alias("model_mae"),
        c("mape").alias("model_mape"),
        "original_trend_per_decade",
        "trend_dampening_applied",
        "forecast_horizon_years",
    )
    for part in (trends, anomalies, forecasts, spans):  # no series is lost for want of a part
        averages = averages.join(part, on, "left")
    return averages


def report_metrics(kpis: DataFrame) -> DataFrame:
    """Significance and consistency flags with their texts."""
    c = F.col
    significant, consistent = c("historical_trend_p_value") < 0.05, c("trend_consistency_ratio") < 2.0
    same, differs = texts.CONSISTENCY
    return kpis.withColumns(
        {
            "hist_significant": significant,
            "hist_sig_text": F.when(significant, texts.SIGNIFICANCE[0]).otherwise(texts.SIGNIFICANCE[1]),
            "fc_consistent": consistent,
            "fc_consistency_text": F.when(consistent, same).otherwise(
                F.format_string(differs, "trend_consistency_ratio")
            ),
        }
    )


# -- labels -------------------------------------------------------------------------------


def r2_text(r2: Column) -> Column:
    *bands, (_, lowest) = texts.R2_BANDS
    return banded([(r2 > limit, text) for limit, text in bands], lowest)


def p_text(p: Column) -> Column:
    *bands, (_, highest) = texts.P_BANDS
    return banded([(p < limit, text) for limit, text in bands], highest)


def rmse_text(rmse: Column, mean: Column) -> Column:
    share = F.try_divide(rmse * 100.0, F.abs(mean))
    (low, first), (mid, second), (_, third) = texts.RMSE_BANDS
    return (
        F.when(share.isNull(), texts.RMSE_UNDEFINED)
        .when(share < low, F.format_string(first, share))
        .when(share < mid, F.format_string(second, share))
        .otherwise(F.format_string(third, share))
    )


def confidence_level(r2: Column, p: Column) -> Column:
    return banded([((r2 > 0.3) & (p < 0.05), "High"), ((r2 > 0.1) | (p < 0.05), "Moderate")], "Low")


def practical_text(rate: Column, r2: Column, p: Column, variable: str = "Temperature") -> Column:
    """Statistical against practical significance of a trend."""
    name, share = F.lit(variable.lower()), r2 * 100
    size = F.abs(rate)
    text = texts.PRACTICAL
    return (
        F.when(p >= 0.05, F.format_string(text["none"], name, p))
        .when(r2 < 0.1, F.format_string(text["weak"], name, p, r2, share))
        .when(size < 0.1, F.format_string(text["small"], name, rate, share))
        .when(size < 0.5, F.format_string(text["moderate"], name, rate, share))
        .otherwise(F.format_string(text["substantial"], name, rate, share))
    )


def forecast_guidance(ratio: Column, fc_r2: Column) -> Column:
    text = texts.FORECAST_GUIDANCE
    first = banded([(ratio > 2.0, text["diverges"]), (ratio > 1.5, text["moderate"])], text["consistent"])
    return F.concat_ws(" ", first, F.when(fc_r2 < 0.1, text["low_r2"]))


def interpretations(kpis: DataFrame) -> DataFrame:
    c = F.col
    r2, p = c("historical_trend_r_squared"), c("historical_trend_p_value")
    return kpis.withColumns(
        {
            "r2_text": r2_text(r2),
            "p_text": p_text(p),
            "rmse_text": rmse_text(c("model_rmse"), c("avg_temperature")),
            "confidence_level": confidence_level(r2, p),
            "practical_text": practical_text(c("warming_rate_per_decade"), r2, p),
            "forecast_guidance": forecast_guidance(c("trend_consistency_ratio"), c("forecast_trend_r_squared")),
        }
    )


def dashboard_labels(kpis: DataFrame) -> DataFrame:
    """Trend direction, confidence, fit and temperature band for display."""
    c = F.col
    rate, r2, mean = c("warming_rate_per_decade"), c("forecast_trend_r_squared"), c("avg_temperature")
    return kpis.withColumns(
        {
            "trend_direction": banded([(rate > 0, "Increasing"), (rate < 0, "Decreasing")], "Stable"),
            "confidence_label": F.when(c("quality_checks_passed"), "High").otherwise("Moderate"),
            "fit_label": banded([(r2 > 0.8, "Strong fit"), (r2 > 0.5, "Moderate fit")], "Weak fit"),
            "temperature_band": banded([(mean >= 30, "30+"), (mean >= 25, "25-30"), (mean >= 20, "20-25")], "<20"),
            "anomaly_direction": F.when(c("anomaly_percentage") > 5, "up").otherwise("stable"),
        }
    )


# -- findings -----------------------------------------------------------------------------


def insights(kpis: DataFrame) -> DataFrame:
    """Ordered findings per series; texts show the rounded rate, thresholds read ``warming_rate_raw`` where it is given."""
    c, text = F.col, texts.INSIGHTS
    rate, r2, p = c("warming_rate_per_decade"), c("historical_trend_r_squared"), c("historical_trend_p_value")
    raw = c("warming_rate_raw") if "warming_rate_raw" in kpis.columns else rate
    sure = F.when(p < 0.05, texts.SIGNIFICANCE[0]).otherwise(texts.SIGNIFICANCE[1])
    trend = F.when(raw > 0.2, F.format_string(text["strong_trend"], rate, sure, r2, p, p_text(p))).otherwise(
        F.format_string(text["trend"], rate, sure, r2, p_text(p))
    )
    ratio, fc = c("trend_consistency_ratio"), c("forecast_trend_per_decade")
    hist, fc_r2, years = c("historical_trend_per_decade"), c("forecast_trend_r_squared"), c("forecast_horizon_years")
    outlook = F.when(
        ratio > 2.0, F.format_string(text["divergent"], years, fc, F.abs(ratio - 1) * 100, hist, fc_r2)
    ).otherwise(F.format_string(text["consistent"], years, fc, hist, fc_r2))
    found = codes(
        [
            (rate.isNotNull(), trend),
            (c("avg_precipitation").isNotNull(), F.format_string(text["precipitation"], "avg_precipitation")),
            (c("anomaly_days").isNotNull(), F.format_string(text["anomalies"], "anomaly_days", "anomaly_percentage")),
            (fc.isNotNull(), outlook),
        ]
    )
    return kpis.withColumn("insights", found)


def recommendations(kpis: DataFrame) -> DataFrame:
    """Ordered recommendations per series."""
    c, text = F.col, texts.RECOMMENDATIONS
    risk, ratio = c("risk_category"), c("trend_consistency_ratio")
    significant = c("historical_trend_p_value") < 0.05
    high, moderate = risk.isin("High", "Very High"), risk == "Moderate"
    low = ~high & ~moderate
    always = F.lit(True)
    found = codes(
        [
            (high & significant, text["high_confirmed"]),
            (high, text["high_plans"]),
            (high, text["high_invest"]),
            (moderate, text["moderate_monitor"]),
            (moderate, text["moderate_codes"]),
            (low, text["low_monitor"]),
            (low, text["low_maintain"]),
            (~significant, text["not_significant"]),
            (c("historical_trend_r_squared") < 0.1, text["low_r2"]),
            (ratio > 2.0, text["divergent"]),
            (ratio > 2.0, text["divergent_review"]),
            ((ratio > 1.5) & (ratio <= 2.0), text["moderate_divergence"]),
            (c("anomaly_percentage") > 5, F.format_string(text["anomalies"], "anomaly_percentage")),
            (always, text["coverage"]),
            (always, text["update"]),
        ]
    )
    return kpis.withColumn("recommendations", found)


def recommendation_tiers(df: DataFrame, keys=SERIES) -> DataFrame:
    """One row per recommendation: the first is high, the next two medium, the rest low."""
    rows = df.select(*keys, F.posexplode("recommendations").alias("position", "recommendation"))
    tier = banded([(F.col("position") == 0, "High"), (F.col("position") < 3, "Medium")], "Low")
    return rows.withColumn("priority", tier)


def consistency_warnings(kpis: DataFrame, max_ratio: float = DEFAULTS.max_trend_ratio) -> DataFrame:
    """Contradictions between the KPIs of a series."""
    c, text = F.col, texts.CONSISTENCY_WARNINGS
    warming, fc = c("warming_rate_per_decade"), c("forecast_trend_per_decade")
    ratio, risk, share = c("trend_consistency_ratio"), c("risk_category"), c("anomaly_percentage")
    p, fc_r2, mean = c("historical_trend_p_value"), c("forecast_trend_r_squared"), c("avg_temperature")
    elevated = risk.isin("High", "Very High")
    found = codes(
        [
            (
                (warming != 0) & (ratio > max_ratio),
                F.format_string(text["divergence"], fc, warming, ratio, F.lit(max_ratio)),
            ),
            ((warming == 0) & (fc != 0), F.format_string(text["zero_history"], fc)),
            (elevated & (share < 2), F.format_string(text["risk_high"], risk, share)),
            (
                (warming > 0.3) & (c("risk_score") < 0.3),
                F.format_string(text["risk_low_score"], warming, "risk_score"),
            ),
            ((risk == "Low") & (share > 8), F.format_string(text["low_risk_anomalies"], share)),
            (elevated & (p > 0.05), F.format_string(text["high_risk_trend"], risk, p)),
            ((fc_r2 < 0.1) & (ratio > 2.0), F.format_string(text["low_forecast_r2"], fc_r2)),
            ((mean < -10) | (mean > 60), F.format_string(text["implausible"], mean)),
        ]
    )
    return kpis.withColumn("consistency_warnings", found)


def report_warnings(kpis: DataFrame) -> DataFrame:
    """Missing KPIs, a risk score that differs from its KPI, and dampened trends."""
    text = texts.REPORT_WARNINGS
    rules: list[tuple[Column, Column | str]] = []
    for name in texts.REQUIRED_KPIS:
        absent = F.col(name).isNull() if name in kpis.columns else F.lit(True)
        rules.append((absent, text["missing"] % name))
    if "normalized_score" in kpis.columns:
        differs = ~F.col("risk_score").eqNullSafe(F.col("normalized_score"))
        shown = [F.col(n).cast("string") for n in ("risk_score", "normalized_score")]
        rules.append((differs, F.format_string(text["mismatch"], *shown)))
    dampened = F.format_string(text["dampened"], "original_trend_per_decade", "forecast_trend_per_decade")
    rules.append((F.col("trend_dampening_applied"), dampened))
    return kpis.withColumn("report_warnings", codes(rules))


def divergence_warnings(kpis: DataFrame, variable: str = "Temperature", keys=SERIES) -> DataFrame:
    """Rule code and text where the forecast trend leaves the historical one."""
    hist, fc = F.col("historical_trend_per_decade"), F.col("forecast_trend_per_decade")
    share = F.abs(F.try_divide(fc, hist) - 1.0) * 100
    name = F.lit(variable.lower())
    code = forecast_divergence(hist, fc)
    text = F.when(
        code == "TREND_DIVERGENCE",
        F.format_string(texts.DIVERGENCE["TREND_DIVERGENCE"], hist, fc, name, share),
    ).when(
        code == "TREND_DIVERGENCE_MINOR",
        F.format_string(texts.DIVERGENCE["TREND_DIVERGENCE_MINOR"], hist, fc, name, share),
    )
    return kpis.select(*keys, code.alias("type"), text.alias("details")).filter(F.col("type").isNotNull())


def rule_catalogue(spark) -> DataFrame:
    """The warning types as a dimension of fifteen rows."""
    rows = [(k, *v) for k, v in texts.WARNINGS.items()]
    return spark.createDataFrame(
        rows, "type string, category string, severity string, interpretation string, recommended_action string"
    )


def categorize(warnings: DataFrame) -> DataFrame:
    """Category, severity and texts of warning rows with ``type``; an unknown type keeps its row."""
    known = F.broadcast(rule_catalogue(warnings.sparkSession))  # fifteen fixed rows
    defaults = {"category": "Unknown", "severity": "unknown", "interpretation": "", "recommended_action": ""}
    return warnings.join(known, "type", "left").na.fill(defaults)
