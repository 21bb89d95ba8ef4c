import pytest
from pyspark.sql import functions as F

from tsengine.functions import texts
from tsengine.operators import rules

KPI = dict(
    series_id="a", avg_temperature=24.53, avg_precipitation=2.09, warming_rate_per_decade=-0.041, historical_trend_r_squared=0.0,
    historical_trend_p_value=0.9179202625516085, anomaly_days=247, anomaly_percentage=6.76, forecast_trend_per_decade=-0.041,
    forecast_trend_r_squared=0.0, trend_consistency_ratio=1.0, historical_trend_per_decade=-0.041, forecast_horizon_years=3,
    first_half_mean=1.0, second_half_mean=1.0 + 0.5 * 0.5617842610148359, model_rmse=1.0176856826140843, quality_checks_passed=False,
    original_trend_per_decade=-0.041, trend_dampening_applied=False,
)


def kpi(spark, **changes):
    row = {**KPI, **changes}
    kinds = {str: "string", float: "double", int: "int", bool: "boolean"}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in row.items()))
    return rules.with_risk(df) if "risk_category" not in changes else df


def test_published_example(spark):
    """The published sample KPIs give the published score, findings and recommendations."""
    df = rules.consistency_warnings(rules.recommendations(rules.insights(kpi(spark))))
    row = df.first()
    assert row.risk_score == pytest.approx(0.3713352783044508) and row.risk_category == "Moderate"
    assert row.insights[0].startswith("Temperature trend: -0.041 °C/decade (not statistically significant, R-squared=0.0000). Not stat")
    assert row.insights[1:3] == ["Average daily precipitation: 2.09 mm/day.", "Detected 247 anomaly days (6.8% of analysis period)."]
    assert row.insights[3].startswith("3-year forecast projects -0.041 °C/decade, consistent with the historical trend (-0.041 °C/decade).")
    r = texts.RECOMMENDATIONS
    assert row.recommendations == [
        r["moderate_monitor"], r["moderate_codes"], r["not_significant"], r["low_r2"], r["anomalies"] % 6.8, r["coverage"], r["update"],
    ]
    assert row.consistency_warnings == []
    tiers = [x.priority for x in rules.recommendation_tiers(df).orderBy("position").collect()]
    assert tiers == ["High", "Medium", "Medium", "Low", "Low", "Low", "Low"]


@pytest.mark.parametrize("score,label", [(0.0, "Low"), (0.2499, "Low"), (0.25, "Moderate"), (0.5, "High"), (0.75, "Very High"), (1.0, "Very High")])
def test_risk_bands(spark, score, label):
    assert spark.range(1).select(rules.risk_category(F.lit(score)).alias("c")).first().c == label


def test_metrics(spark):
    c = spark.range(1).select(
        rules.trend_metric(F.lit(0.25)), rules.trend_metric(F.lit(-3.0)), rules.trend_metric(F.lit(9.0)), rules.trend_metric(F.lit(None).cast("double")),
        rules.rainfall_metric(F.lit(1.2), F.lit(1.0)), rules.rainfall_metric(F.lit(5.0), F.lit(0.0)), rules.rainfall_metric(F.lit(9.0), F.lit(1.0)),
        rules.anomaly_metric(F.lit(5.0)), rules.forecast_factor(F.lit(2.1)), rules.forecast_factor(F.lit(1.6)), rules.forecast_factor(F.lit(1.5)),
    ).first()
    assert list(c) == pytest.approx([0.5, 0, 1, 0, 0.4, 0, 1, 0.5, 1.15, 1.05, 1.0])


def test_high_risk(spark):
    df = kpi(spark, warming_rate_per_decade=0.6, anomaly_percentage=1.5, trend_consistency_ratio=4.0, historical_trend_p_value=0.2,
             second_half_mean=2.0, forecast_trend_per_decade=2.4)
    row = rules.consistency_warnings(rules.recommendations(rules.insights(df))).first()
    assert row.risk_category == "Very High" and row.forecast_factor == 1.15
    assert row.recommendations[:2] == [texts.RECOMMENDATIONS["high_plans"], texts.RECOMMENDATIONS["high_invest"]]
    assert texts.RECOMMENDATIONS["divergent_review"] in row.recommendations
    assert len(row.consistency_warnings) == 4
    assert row.consistency_warnings[0].endswith("Actual ratio: 4.00x (exceeds 3.0x threshold).")
    assert "deviating 300% from" in row.insights[3] and row.insights[0].startswith("Temperature trend: +0.600 °C/decade")


def test_other_consistency_rules(spark):
    zero = rules.consistency_warnings(kpi(spark, warming_rate_per_decade=0.0, forecast_trend_per_decade=0.5, avg_temperature=70.0)).first()
    assert len(zero.consistency_warnings) == 2
    calm = rules.consistency_warnings(kpi(spark, anomaly_percentage=8.1, second_half_mean=1.0, risk_category="Low", risk_score=0.1)).first()
    assert calm.consistency_warnings == ["Anomaly rate (8.1%) is elevated for a Low risk category."]
    warm = rules.consistency_warnings(kpi(spark, warming_rate_per_decade=0.31, risk_category="Low", risk_score=0.2)).first()
    assert "Verify risk weight calibration" in warm.consistency_warnings[0]


def test_report_warnings(spark):
    df = kpi(spark, trend_dampening_applied=True, original_trend_per_decade=5.0).drop("anomaly_days").withColumn("normalized_score", F.lit(0.9))
    found = rules.report_warnings(df).first().report_warnings
    assert found[0] == "Missing required KPI: anomaly_days" and found[1].startswith("Risk score mismatch") and found[2] == "Trend dampening applied: 5.000 -> -0.041 °C/decade"
    assert rules.report_warnings(kpi(spark)).first().report_warnings == []


def test_interpretations(spark):
    row = rules.interpretations(kpi(spark)).first()
    assert row.r2_text == texts.R2_BANDS[3][1] and row.p_text == texts.P_BANDS[3][1] and row.confidence_level == "Low"
    assert row.rmse_text == "Low forecast error (4.1% of mean); high accuracy."
    assert row.practical_text.startswith("The temperature trend is not statistically significant (p=9.18e-01)")
    assert row.forecast_guidance.endswith(texts.FORECAST_GUIDANCE["low_r2"])
    steep = rules.interpretations(kpi(spark, historical_trend_p_value=0.001, historical_trend_r_squared=0.4, warming_rate_per_decade=0.7, avg_temperature=0.0)).first()
    assert "substantial magnitude (+0.700 °C/decade)" in steep.practical_text and "40.0% of variance" in steep.practical_text
    assert steep.rmse_text == texts.RMSE_UNDEFINED and steep.confidence_level == "High"


def test_divergence(spark):
    def found(hist, fc):
        rows = rules.categorize(rules.divergence_warnings(kpi(spark, historical_trend_per_decade=hist, forecast_trend_per_decade=fc))).collect()
        return [(r.type, r.severity) for r in rows]

    assert found(0.1, 0.3) == [("TREND_DIVERGENCE", "info")]
    assert found(0.1, 0.16) == [("TREND_DIVERGENCE_MINOR", "info")]
    assert found(0.1, 0.14) == [] and found(0.0, 5.0) == []


def test_labels(spark):
    row = rules.dashboard_labels(kpi(spark)).first()
    assert (row.trend_direction, row.confidence_label, row.fit_label, row.temperature_band) == ("Decreasing", "Moderate", "Weak fit", "20-25")
    metrics = rules.report_metrics(kpi(spark, trend_consistency_ratio=2.5)).first()
    assert not metrics.fc_consistent and metrics.fc_consistency_text.endswith("(ratio: 2.50x).") and not metrics.hist_significant
