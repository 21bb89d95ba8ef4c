"""Compositions of the operators, from a raw panel to the exported feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsengine.functions.columns import display, safe_divide, total
from tsengine.operators import anomaly, eda, features, forecast, isolation, quality, rules, trend
from tsengine.operators.order import POS, ROWS, date_spine, one_row_per_day, with_position
from tsengine.schema import CORE_VARIABLES, DATE, DEFAULTS, SERIES, Settings, present
from tsengine.session import materialize
from tsengine.sources import files


def preprocess(panel: DataFrame, regular: bool = False, settings: Settings = DEFAULTS, keys=SERIES) -> DataFrame:
    """Impute, then add calendar, rolling and lag features; an irregular panel is ranked once for all of them.

    The panel should be a written table: its rows are counted first, for the number of tasks.
    """
    rows = panel.count()
    ranked = panel if regular else with_position(panel, keys, rows=rows)
    imputed = materialize(features.impute_linear(ranked, regular=regular, keys=keys, rows=rows))
    rolled = features.rolling_means(features.temporal_features(imputed), settings.rolling, regular, keys=keys, rows=rows)
    return features.lag_features(rolled, settings.lags, regular, keys=keys, rows=rows).drop(POS, ROWS)


def observed_span(df: DataFrame, keys=SERIES) -> DataFrame:
    """Counts and means of the flagged rows per series: only days that were observed."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("data_points"),
        F.struct(F.min(DATE).alias("start"), F.max(DATE).alias("end")).alias("date_range"),
        display(F.avg("temperature"), 2).alias("avg_temp"),
        display(F.sum("precipitation"), 2).alias("total_precip"),
        F.count_if(anomaly.COMBINED).alias("anomaly_days"),
    )


def explore(df: DataFrame, keys=SERIES) -> dict[str, DataFrame]:
    return {
        "summary_statistics": eda.summary_statistics(df, keys=keys),
        "monthly_aggregations": eda.monthly_aggregates(df, keys=keys),
        "annual_aggregations": eda.annual_aggregates(df, keys=keys),
        "correlation_matrix": eda.correlation(df, keys=keys),
        "annual_trends": eda.annual_trends(df, keys=keys),
    }


def analyze_trends(df: DataFrame, keys=SERIES) -> dict[str, DataFrame]:
    """Trends with warnings, and lines."""
    trends = trend.linear_trend(df, keys=keys)
    return {
        "trends": trends,
        "warnings": rules.categorize(trend.trend_warnings(trends)),
        "temperature_line": trend.trend_line(df, "temperature", keys),
        "precipitation_line": trend.trend_line(df, "precipitation", keys),
    }


def detect_anomalies(df: DataFrame, settings: Settings = DEFAULTS, keys=SERIES) -> tuple[DataFrame, DataFrame]:
    """Rows with their flags, and the summary per series."""
    flagged = anomaly.zscore_flags(df, threshold=settings.zscore_threshold, keys=keys)
    flagged = isolation.forest_flags(
        flagged,
        contamination=settings.contamination,
        trees=settings.forest_trees,
        sample=settings.forest_sample,
        seed=settings.forest_seed,
        keys=keys,
    )
    combined = anomaly.combine_flags(flagged)
    return combined, anomaly.anomaly_summary(combined, keys=keys)


def missing_share(df: DataFrame, keys=SERIES) -> DataFrame:
    """PASS or WARNING per series, from the share of missing cells over all columns."""
    names = [c for c in df.columns if c not in keys]
    missing = total([F.count_if(F.col(c).isNull()) for c in names])
    share = safe_divide(missing * 100.0, F.count("*") * len(names))
    return df.groupBy(*keys).agg(F.when(share < 5, "PASS").otherwise("WARNING").alias("data_quality_status"))


def executive_summary(
    df: DataFrame, anomalies: DataFrame, forecasts: DataFrame, trends: DataFrame | None = None, keys=SERIES
) -> DataFrame:
    """KPIs, risk, findings, recommendations and warnings: one row per series."""
    on = list(keys)
    averages = df.groupBy(*keys).agg(
        F.avg("temperature").alias("temperature_mean"),
        F.max("temperature").alias("temperature_max"),
        F.min("temperature").alias("temperature_min"),
        F.avg("precipitation").alias("precipitation_mean"),
    )
    trends = trend.linear_trend(df, keys=keys) if trends is None else trends
    kpis = rules.executive_kpis(averages, trends, anomalies, forecasts, eda.analysis_span(df, keys), keys)
    kpis = kpis.join(eda.half_period_contrast(df, keys=keys), on, "left").join(missing_share(df, keys), on, "left")
    kpis = materialize(rules.with_risk(kpis))
    return rules.report_warnings(
        rules.consistency_warnings(rules.recommendations(rules.insights(rules.report_metrics(kpis))))
    )


def feeds(
    df: DataFrame,
    summary: DataFrame,
    forecast_rows: DataFrame,
    forecasts: DataFrame,
    stations: DataFrame | None = None,
    keys=SERIES,
) -> dict[str, DataFrame]:
    """The seven exported feeds; nested documents have one row per series."""
    on, c = list(keys), F.col
    span = observed_span(df, keys)
    daily = features.systematic_sample(df.select(*keys, DATE, *present(df, CORE_VARIABLES)), keys=keys)
    rounded = [display(F.col(name), 2).alias(name) for name in present(df, CORE_VARIABLES)]
    thinned = features.thin(forecast_rows, keys=keys)
    bounds = ("forecast", "forecast_upper", "forecast_lower")
    # At most 730 thinned rows per series.
    rows = thinned.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(DATE, *[display(F.col(b), 2).alias(b) for b in bounds]))).alias("data")
    )
    metadata = F.struct(
        "forecast_class",
        "classification_reasons",
        "recommended_action",
        "reliability_score",
        "reliability_label",
        "trend_per_decade",
        "trend_r_squared",
        c("trend_consistency_ratio").alias("consistency_ratio"),
    )
    places = span.join(summary.select(*keys, "risk_category"), on)
    if stations is not None:
        places = eda.station_rollup(places, stations, keys)
    return {
        "executive_summary": summary,
        "dashboard_metrics": summary.join(span.select(*keys, "data_points", "date_range"), on),
        "climate_summary": eda.monthly_feed(df, keys),
        "daily_trends": daily.select(*keys, DATE, *rounded),
        "anomalies": anomaly.anomaly_days(df, keys),
        "forecast": forecasts.select(*keys, metadata.alias("metadata")).join(rows, on, "left"),
        "regional_map": places.drop("data_points", "date_range"),
    }


def write_feeds(tables: dict[str, DataFrame], folder: str) -> None:
    for name, table in tables.items():
        files.write_json(table, f"{folder.rstrip('/')}/{name}")


def changed_series(before: DataFrame, after: DataFrame, keys=SERIES) -> DataFrame:
    """Series of ``after`` that ``before`` lacks or has with other rows, in whatever order.

    A series is told by its row count and the sums of two hashes of its rows, in one aggregate per panel.
    """
    columns = sorted(c for c in after.columns if c not in keys)
    if columns != sorted(c for c in before.columns if c not in keys):
        return after.select(*keys).distinct()

    def marks(df: DataFrame, name: str) -> DataFrame:
        # sums as decimals, which do not overflow
        hashes = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(20,0)")) for seed in (1, 2)]
        return df.groupBy(*keys).agg(F.struct(F.count("*"), *hashes).alias(name))

    both = marks(after, "_after").join(marks(before, "_before"), list(keys), "left")
    return both.filter(~F.col("_after").eqNullSafe(F.col("_before"))).select(*keys)


def refresh_feeds(tables: dict[str, DataFrame], folder: str, changed: DataFrame | None = None, keys=SERIES) -> None:
    """Write the feeds in a folder per series; with ``changed``, those of its series only, and no other file is touched.

    A changed series keeps its former documents in a feed that has no rows for it any more.
    """
    for name, table in tables.items():
        rows = table if changed is None else table.join(changed, list(keys), "left_semi")
        files.replace_parts(rows, f"{folder.rstrip('/')}/{name}", keys)


def run(
    panel: DataFrame, settings: Settings = DEFAULTS, stations: DataFrame | None = None, keys=SERIES, fixed: dict | None = None
) -> dict:
    """The whole pipeline: validate, featurise, explore, forecast, summarise, feed.

    ``fixed`` gives the smoothing parameters instead of searching them.

    All but the forecast works on the observed days; the forecaster adds the missing ones as
    nulls. Rows without a readable date are counted in ``rejected`` and take no further part.
    """
    checked = quality.load_and_validate(panel, settings.start_date, settings.end_date, keys)
    daily = checked.written(lambda rows: one_row_per_day(rows.filter(F.col(DATE).isNotNull()), keys))
    featured = materialize(preprocess(daily, settings=settings, keys=keys))
    flagged, anomalies = detect_anomalies(featured, settings, keys)
    flagged, anomalies = materialize(flagged), materialize(anomalies)
    trends = analyze_trends(featured, keys=keys)
    forecasts = forecast.run_forecast(
        date_spine(featured.select(*keys, DATE, "temperature"), keys),
        horizon_years=settings.horizon_years,
        confidence=settings.confidence,
        season=settings.season_length,
        floor=settings.value_floor,
        ceiling=settings.value_ceiling,
        keys=keys,
        fixed=fixed,
    )
    summary = materialize(
        executive_summary(flagged, anomalies, forecasts["summary"], trends["trends"], keys)
    )
    return {
        "validation": {
            "issues": checked.issues(), "bounds": checked.bounds(), "report": checked.report(), "rejects": checked.rejects()
        },
        "rejected": quality.rejected_rows(panel, keys),
        "features": featured,
        "flagged": flagged,
        "anomaly_summary": anomalies,
        "eda": explore(featured, keys),
        "trends": trends,
        "forecast": forecasts,
        "summary": summary,
        "feeds": feeds(flagged, summary, forecasts["forecast"], forecasts["summary"], stations, keys),
    }
