"""Registered queries: one per operator, each over the whole given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsengine.functions.columns import display
from tsengine.operators import (
    anomaly,
    eda,
    evaluate,
    features,
    forecast,
    isolation,
    joins,
    quality,
    rules,
    sketches,
    smoothing,
    trend,
)
from tsengine.operators.order import date_spine, framed, one_row_per_day, with_position
from tsengine.plans import pipeline
from tsengine.schema import CORE_VARIABLES, DATE, SERIES, VARIABLES
from tsengine.session import materialize, scratch_path
from tsengine.sources import files, payloads, tables

STEPS = 3 * 365


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and integers widened, so that engines can be compared by value."""
    columns = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """The shipment panel as a table: written once, read by every branch of a query."""
    return materialize(tables.shipment_panel(spark, folder))


def spine(spark: SparkSession, folder: str) -> DataFrame:
    return date_spine(panel(spark, folder))


def imputed(spark: SparkSession, folder: str) -> DataFrame:
    return features.impute_linear(materialize(spine(spark, folder)), regular=True)


# -- sources ------------------------------------------------------------------------------


def daily_panel(spark, folder):
    return shown(tables.shipment_panel(spark, folder))


def csv_round_trip(spark, folder):
    path = scratch_path(spark)
    files.write_csv(tables.shipment_panel(spark, folder), path)
    return shown(files.read_csv(spark, path))


def json_round_trip(spark, folder):
    path = scratch_path(spark)
    rows = date_spine(panel(spark, folder))
    files.write_json(rows, path)
    return shown(files.read_json(spark, path, rows.schema))


def table_round_trip(spark, folder):
    path = scratch_path(spark)
    files.write_table(tables.shipment_panel(spark, folder), path)
    return shown(files.read_table(spark, path).select(*SERIES, DATE, "year", *VARIABLES))


def parse_map_payload(spark, folder):
    documents = payloads.map_payloads(tables.shipment_panel(spark, folder))
    keys = (*SERIES, "payload_year")
    return shown(payloads.parse_map_payload(documents, keys=keys).drop("payload_year"))


def parse_array_payload(spark, folder):
    documents = payloads.array_payloads(tables.shipment_panel(spark, folder))
    keys = (*SERIES, "payload_year")
    return shown(payloads.parse_array_payload(documents, keys=keys).drop("payload_year"))


def parse_variant_payload(spark, folder):
    """Documents whose parameters, and the types of their readings, differ by year."""
    rows, keys = panel(spark, folder), (*SERIES, "payload_year")
    odd = F.year(DATE) % 2 == 1
    wordy = rows.filter(odd).withColumns(
        {"wind_speed": F.concat(F.col("wind_speed").cast("string"), F.lit(" m/s")), "humidity": F.when(F.dayofmonth(DATE) == 13, -999.0).otherwise(F.col("humidity"))}
    )
    documents = payloads.map_payloads(
        rows.filter(~odd), columns={"T2M": "temperature", "RAIN": "precipitation", "WIND": "wind_speed"}, one_type=False
    ).unionByName(payloads.map_payloads(wordy, columns={"T2M": "temperature", "RH2M": "humidity", "WIND": "wind_speed"}, one_type=False))
    return shown(payloads.parse_variant_payload(documents, keys=keys, sentinels=(-999.0,)).drop("payload_year"))


def rename_columns(spark, folder):
    """Status counts of orders under canonical names."""
    rows = tables.table(spark, folder, "orders").select("o_orderstatus", F.to_date("o_orderdate").alias("o_orderdate"))
    names = {"o_orderstatus": "series_id", "o_orderdate": "date"}
    counts = payloads.canonical_columns(rows, names).groupBy("series_id", "date").agg(F.count("*").alias("orders"))
    return shown(counts)


# -- quality ------------------------------------------------------------------------------


def broken_text(spark, folder) -> DataFrame:
    """The panel as text, with some values that cannot be read."""
    rows = tables.shipment_panel(spark, folder)
    day = F.dayofmonth(DATE)
    texts = {DATE: F.col(DATE).cast("string")}
    for c in VARIABLES:
        text = F.col(c).cast("string")
        texts[c] = F.when(day % 7 == 3, "n/a").when(day % 11 == 5, "NaN").otherwise(text)
    return rows.select("series_id", *[v.alias(k) for k, v in texts.items()])


def convert_types(spark, folder):
    return shown(quality.load_and_validate(broken_text(spark, folder)).rows)


def broken_dates(spark, folder) -> DataFrame:
    """The panel as text, dates of the 13th unreadable."""
    return broken_text(spark, folder).withColumn(DATE, F.regexp_replace(DATE, "-13$", "-x"))


def validated(spark, folder) -> quality.Validated:
    """The broken panel after its one pass, folded to a row per day on the way."""
    checked = quality.load_and_validate(broken_dates(spark, folder), "1995-01-02", "2001-12-31")
    checked.written(lambda rows: one_row_per_day(rows.filter(F.col(DATE).isNotNull())))
    return checked


def validation_issues(spark, folder):
    return shown(validated(spark, folder).issues())


def validation_bounds(spark, folder):
    return shown(validated(spark, folder).bounds())


def validation_report(spark, folder):
    return shown(validated(spark, folder).report())


def validation_rejects(spark, folder):
    """Unreadable cells by column, reason and value; the many dates count as one."""
    rows = quality.load_and_validate(broken_dates(spark, folder)).rejects()
    rows = rows.withColumn("value", F.when(F.col("column_name") != DATE, F.col("value")))
    cells = rows.groupBy("series_id", "column_name", "reason", "value").agg(F.count("*").alias("cells"))
    return shown(cells)


def engineered_catalogue(spark, folder):
    """Derived columns of the features by kind, with their rows that have a value."""
    rows = pipeline.preprocess(panel(spark, folder))
    kinds = quality.engineered_columns(rows)
    names = [r.column_name for r in kinds.collect()]  # a row for each column of the schema
    counts = rows.agg(*[F.count(c).alias(c) for c in names])
    filled = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled")) for c in names])).alias("c"))
    return shown(kinds.join(filled.select("c.*"), "column_name"))


def rejected_rows(spark, folder):
    return shown(quality.rejected_rows(broken_dates(spark, folder)))


def date_bounds(spark, folder):
    return shown(quality.date_bounds(tables.shipment_panel(spark, folder), "1995-01-02", "2001-12-31"))


def quality_report(spark, folder):
    report = quality.quality_report(spine(spark, folder))
    return shown(report.withColumn("status", quality.overall_status(report)))


def quality_score(spark, folder):
    return shown(quality.quality_score(materialize(spine(spark, folder))))


def column_profile(spark, folder):
    return shown(quality.column_profile(spine(spark, folder)).drop("data_type"))


def top_outlier_columns(spark, folder):
    return shown(quality.top_outlier_columns(materialize(spine(spark, folder))))


def duplicate_rows(spark, folder):
    rows = tables.table(spark, folder, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("series_id"),
        F.to_date("l_shipdate").alias("date"),
        "l_quantity",
    )
    return shown(quality.duplicate_rows(rows))


def normalize_names(spark, folder):
    rows = tables.table(spark, folder, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("orders"))
    return shown(quality.normalize_names(rows, "o_orderpriority", "normalized"))


def impute_linear(spark, folder):
    return shown(imputed(spark, folder))


def fill_gaps(spark, folder):
    rows = materialize(spine(spark, folder).select("series_id", DATE, "temperature", "precipitation"))
    filled = features.forward_fill(rows, ["temperature"])
    return shown(features.backward_fill(filled, ["precipitation"]))


# -- order and features -------------------------------------------------------------------


def date_spine_query(spark, folder):
    return shown(spine(spark, folder))


def temporal_features(spark, folder):
    rows = tables.shipment_panel(spark, folder).select("series_id", DATE, "temperature")
    return shown(features.temporal_features(rows))


def rolling_means(spark, folder):
    rows = imputed(spark, folder).select("series_id", DATE, "temperature", "precipitation")
    return shown(features.rolling_means(rows, regular=True))


def rolling_by_row(spark, folder):
    rows = panel(spark, folder).select("series_id", DATE, "humidity", "solar_radiation")
    return shown(features.rolling_means(rows, {"humidity": (30, 365), "solar_radiation": (30,)}))


def rolling_strict(spark, folder):
    rows = panel(spark, folder).select("series_id", DATE, "temperature")
    return shown(features.rolling_means(rows, {"temperature": (30,)}, strict=True))


def rolling_suppliers(spark, folder):
    rows = materialize(tables.supplier_panel(spark, folder).select("series_id", DATE, "temperature"))
    return shown(features.rolling_means(rows, {"temperature": (7, 30, 365)}))


def lag_features(spark, folder):
    rows = materialize(spine(spark, folder).select("series_id", DATE, "temperature"))
    return shown(features.lag_features(rows, regular=True))


def elapsed_days(spark, folder):
    return shown(features.elapsed_days(panel(spark, folder).select("series_id", DATE, "temperature")))


def row_positions(spark, folder):
    return shown(with_position(panel(spark, folder).select("series_id", DATE, "temperature")))


def head_rows(spark, folder):
    return shown(features.head(panel(spark, folder), 100))


def tail_rows(spark, folder):
    return shown(features.tail(panel(spark, folder), 365))


def systematic_sample(spark, folder):
    return shown(features.systematic_sample(panel(spark, folder)))


def thin_rows(spark, folder):
    return shown(features.thin(panel(spark, folder)))


def date_range(spark, folder):
    return shown(features.date_range(tables.shipment_panel(spark, folder), "1997-03-01", "1998-02-28"))


# -- joins --------------------------------------------------------------------------------


def merge_sources(spark, folder):
    return shown(joins.merge_sources(tables.order_panel(spark, folder), tables.status_panel(spark, folder)))


def merge_buckets(spark, folder):
    """The same merge from two bucketed tables, without an exchange."""
    sides = []
    for rows in (tables.order_panel(spark, folder), tables.status_panel(spark, folder)):
        path = scratch_path(spark)
        sides.append(files.write_buckets(rows, f"panel_{path.rsplit('/', 1)[-1]}", path, buckets=8))
    return shown(joins.merge_sources(*sides))


def align_sources(spark, folder):
    actual = tables.status_panel(spark, folder).select("series_id", DATE, F.col("temperature").alias("actual"))
    other = tables.order_panel(spark, folder).select("series_id", DATE, F.col("temperature").alias("predicted"))
    return shown(joins.align(actual, other))


def align_accuracy(spark, folder):
    actual = tables.status_panel(spark, folder).select("series_id", DATE, F.col("temperature").alias("actual"))
    other = tables.order_panel(spark, folder).select("series_id", DATE, F.col("temperature").alias("predicted"))
    return shown(evaluate.accuracy(joins.align(actual, other)))


# -- exploration --------------------------------------------------------------------------


def _over_panel(fn, digits: int = 6, **options):
    """A query of one pass over the panel, which then needs no written copy."""
    return lambda spark, folder: shown(fn(tables.shipment_panel(spark, folder), **options), digits)


def _over_table(fn, digits: int = 6, **options):
    """A query of several passes over the panel."""
    return lambda spark, folder: shown(fn(panel(spark, folder), **options), digits)


def station_rollup(spark, folder):
    rows = materialize(tables.supplier_panel(spark, folder))
    flagged = anomaly.combine_flags(anomaly.zscore_flags(rows))
    rollup = flagged.groupBy("series_id").agg(
        display(F.avg("temperature"), 2).alias("avg_temp"),
        F.sum("precipitation").alias("total_precip"),
        F.count_if(anomaly.COMBINED).alias("anomaly_days"),
    )
    return shown(eda.station_rollup(rollup, tables.station_names(spark, folder)))


# -- trends -------------------------------------------------------------------------------


def linear_trend(spark, folder):
    return shown(trend.linear_trend(tables.shipment_panel(spark, folder)), 8)


def trend_line(spark, folder):
    return shown(trend.trend_line(panel(spark, folder).select("series_id", DATE, "temperature")))


def trend_warnings(spark, folder):
    found = trend.trend_warnings(trend.linear_trend(tables.shipment_panel(spark, folder)))
    return rules.categorize(found).select(
        "series_id", "variable", "type", "category", "severity", "details", "interpretation", "recommended_action"
    )


def historical_trend(spark, folder):
    return shown(forecast.historical_trend(tables.shipment_panel(spark, folder)), 8)


# -- anomalies ----------------------------------------------------------------------------


def zscore_flags(spark, folder):
    return shown(anomaly.zscore_flags(panel(spark, folder)))


def anomaly_summary(spark, folder):
    flagged = anomaly.combine_flags(anomaly.zscore_flags(panel(spark, folder)))
    return shown(anomaly.deviation_card(anomaly.anomaly_summary(flagged)))


def anomaly_days(spark, folder):
    flagged = anomaly.combine_flags(anomaly.zscore_flags(panel(spark, folder)))
    return shown(anomaly.anomaly_days(flagged))


def isolation_forest(spark, folder):
    return shown(isolation.forest_flags(panel(spark, folder)))


def anomaly_pipeline(spark, folder):
    return shown(pipeline.detect_anomalies(panel(spark, folder))[1])


# -- evaluation and forecasts -------------------------------------------------------------


def fold_split(spark, folder):
    folds = evaluate.in_folds(evaluate.readings(panel(spark, folder)))
    sizes = folds.groupBy("series_id", "fold").agg(
        F.count_if(F.col("role") == "train").alias("train_rows"),
        F.count_if(F.col("role") == "test").alias("test_rows"),
    )
    return shown(sizes.join(evaluate.fold_periods(folds), ["series_id", "fold"]))


def walk_forward_linear(spark, folder):
    return shown(evaluate.validate_linear(panel(spark, folder)))


def walk_forward_summary(spark, folder):
    rows = panel(spark, folder)
    folds = evaluate.validate_linear(rows)
    return shown(evaluate.summarize_folds(folds, rows.select("series_id").distinct()))


def baseline_predictions(spark, folder):
    return shown(evaluate.baseline_predictions(panel(spark, folder)))


def baseline_ranks(rows: DataFrame) -> DataFrame:
    predicted = evaluate.baseline_predictions(rows)
    return evaluate.rank_models(evaluate.accuracy(predicted, keys=(*SERIES, "model")))


def model_ranking(spark, folder):
    return shown(baseline_ranks(panel(spark, folder)))


def model_choice(spark, folder):
    return shown(evaluate.choose_model(baseline_ranks(panel(spark, folder)), primary="seasonal_naive"))


def residual_histogram(spark, folder):
    return shown(eda.histogram(seasonal_fit(panel(spark, folder)), "residual"))


def residual_autocorrelation(spark, folder):
    return shown(evaluate.autocorrelation(panel(spark, folder), "temperature"))


def quantile_pairs(spark, folder):
    return shown(evaluate.quantile_pairs(panel(spark, folder), "temperature"))


def seasonal_fit(rows: DataFrame, season: int = 365) -> DataFrame:
    """In-sample fit of the seasonal-naive model: the reading one season before."""
    ranked = evaluate.readings(rows)
    fit = framed(ranked, lambda w: [{"fitted": F.lag("y", season).over(w)}], before=season)
    return fit.withColumn("residual", F.col("y") - F.col("fitted"))


def seasonal_forecast(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps of the seasonal-naive forecast, and the residual deviation behind its bounds."""
    steps = forecast.seasonal_naive_steps(evaluate.readings(rows), STEPS)
    return steps, forecast.residual_spread(seasonal_fit(rows), "y", "fitted")


def ranked_readings(spark, folder) -> DataFrame:
    return materialize(evaluate.readings(panel(spark, folder)))


def naive_forecast(spark, folder):
    ranked = ranked_readings(spark, folder)
    return shown(forecast.with_interval(forecast.naive_steps(ranked, STEPS), seasonal_forecast(ranked)[1]))


def seasonal_naive_forecast(spark, folder):
    return shown(forecast.with_interval(*seasonal_forecast(ranked_readings(spark, folder))))


def linear_forecast(spark, folder):
    ranked = ranked_readings(spark, folder)
    return shown(forecast.linear_forecast(ranked, seasonal_forecast(ranked)[1], STEPS))


def forecast_feed(spark, folder):
    """The seasonal forecast as exported: thinned and rounded."""
    ahead = features.thin(forecast.with_interval(*seasonal_forecast(ranked_readings(spark, folder))))
    bounds = ("forecast", "forecast_upper", "forecast_lower")
    return shown(ahead.select("series_id", DATE, *[display(F.col(b), 2).alias(b) for b in bounds]))


def daily_feed(spark, folder):
    """The daily rows as exported: sampled and rounded."""
    rows = features.systematic_sample(panel(spark, folder).select("series_id", DATE, *CORE_VARIABLES))
    return shown(rows.select("series_id", DATE, *[display(F.col(v), 2).alias(v) for v in CORE_VARIABLES]))


def forecast_overlay(spark, folder):
    rows = panel(spark, folder)
    ahead = forecast.with_interval(*seasonal_forecast(materialize(evaluate.readings(rows))))
    return shown(joins.overlay(rows, ahead))


def forecast_trend(spark, folder):
    return shown(forecast.forecast_trend(seasonal_forecast(ranked_readings(spark, folder))[0]), 8)


def seasonal_summary(rows: DataFrame) -> DataFrame:
    """Summary row per series with the seasonal-naive model as the primary one."""
    ranked = materialize(evaluate.readings(rows))
    steps, residuals = seasonal_forecast(ranked)
    trends = forecast.historical_trend(rows).join(forecast.forecast_trend(steps), "series_id")
    trends = materialize(trends)
    checks = forecast.quality_checks(forecast.with_interval(steps, residuals), trends)
    in_sample = evaluate.accuracy(seasonal_fit(ranked), "y", "fitted").drop("rows")
    folds = evaluate.summarize_folds(evaluate.validate_linear(ranked), trends)
    choice = evaluate.choose_model(baseline_ranks(ranked), primary="seasonal_naive")
    return materialize(
        trends.join(in_sample, "series_id")
        .join(folds, "series_id")
        .join(choice, "series_id")
        .join(checks, "series_id")
    )


def _joined(name: str) -> Column:
    return F.array_join(name, " | ").alias(name)


def forecast_quality(spark, folder):
    rows = panel(spark, folder)
    steps, residuals = seasonal_forecast(materialize(evaluate.readings(rows)))
    trends = forecast.historical_trend(rows).join(forecast.forecast_trend(steps), "series_id")
    checks = forecast.quality_checks(forecast.with_interval(steps, residuals), trends)
    return shown(checks.withColumn("quality_issues", _joined("quality_issues")))


def assessed(spark, folder) -> DataFrame:
    rows = forecast.assess(seasonal_summary(panel(spark, folder)))
    return rows.withColumn("forecast_horizon_years", F.lit(3))


def reliability_score(spark, folder):
    rows = assessed(spark, folder)
    return shown(
        rows.select("series_id", "trend_ratio", "primary_score", "reliability_score", "reliability_label", "reliability_factors.*")
    )


def forecast_class(spark, folder):
    rows = assessed(spark, folder).select(
        "series_id", "primary_class", "used_linear_fallback", "forecast_class", _joined("classification_reasons"),
        "recommended_action", "trend_consistency_ratio", "trend_dampening_applied", "dampening_factor",
        "original_trend_per_decade", "trend_per_decade", "trend_per_year",
    )
    return shown(rows)


def kpi_rows(spark, folder) -> DataFrame:
    """KPI row per series from the statistical flags and the seasonal-naive forecast."""
    rows = panel(spark, folder)
    flagged = anomaly.combine_flags(anomaly.zscore_flags(rows))
    assessed_rows = forecast.assess(seasonal_summary(rows)).withColumn("forecast_horizon_years", F.lit(3))
    return pipeline.executive_summary(rows, anomaly.anomaly_summary(flagged), assessed_rows)


def _simple(rows: DataFrame) -> DataFrame:
    return rows.select(*[f.name for f in rows.schema if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))])


def executive_kpis(spark, folder):
    return shown(_simple(kpi_rows(spark, folder)))


def exported(spark, folder) -> dict[str, DataFrame]:
    """The feeds, from the statistical flags and the seasonal-naive forecast."""
    rows = panel(spark, folder)
    flagged = anomaly.combine_flags(anomaly.zscore_flags(rows))
    assessed_rows = materialize(assessed(spark, folder))
    summary = pipeline.executive_summary(rows, anomaly.anomaly_summary(flagged), assessed_rows)
    ahead = forecast.with_interval(*seasonal_forecast(materialize(evaluate.readings(rows))))
    size = F.length("series_id")
    stations = rows.select("series_id").distinct().withColumns(
        {"name": F.concat(F.lit("Line "), F.col("series_id")), "lat": size * 1.5, "lon": -size * 2.5}
    )
    return pipeline.feeds(flagged, summary, ahead, assessed_rows, stations)


def feed_dashboard_metrics(spark, folder):
    rows = exported(spark, folder)["dashboard_metrics"]
    return shown(_simple(rows.withColumns({"start": F.col("date_range.start"), "end": F.col("date_range.end")})))


def feed_regional_map(spark, folder):
    return shown(exported(spark, folder)["regional_map"])


def feed_forecast(spark, folder):
    """The forecast documents with their metadata, a row per exported day."""
    rows = exported(spark, folder)["forecast"].select("series_id", "metadata.*", F.inline("data"))
    return shown(rows.withColumn("classification_reasons", _joined("classification_reasons")))


def feed_refresh(spark, folder):
    """The daily feed after a second run in which one series had changed and only its files were rewritten."""
    before = panel(spark, folder)
    hotter = F.when(F.col("series_id") == "RF", F.col("temperature") + 1).otherwise(F.col("temperature"))
    after = before.withColumn("temperature", hotter)
    path = scratch_path(spark)

    def feed(rows: DataFrame) -> dict[str, DataFrame]:
        return {"daily": rows.select("series_id", DATE, *CORE_VARIABLES)}

    pipeline.refresh_feeds(feed(before), path)
    pipeline.refresh_feeds(feed(after), path, pipeline.changed_series(before, after))
    return shown(files.read_parts(spark, f"{path}/daily", feed(after)["daily"].schema))


def risk_score(spark, folder):
    rows = panel(spark, folder)
    flagged = anomaly.anomaly_summary(anomaly.combine_flags(anomaly.zscore_flags(rows)))
    trends = trend.linear_trend(rows, ["temperature"], p_value=False)
    joined = (
        flagged.select("series_id", "anomaly_percentage")
        .join(eda.half_period_contrast(rows).drop("mid_year"), "series_id")
        .join(trends.select("series_id", display(F.col("trend_per_decade"), 3).alias("warming_rate_per_decade")), "series_id")
        .withColumn("trend_consistency_ratio", F.lit(1.0))
    )
    return shown(rules.with_risk(joined))


def interpretations(spark, folder):
    rows = rules.interpretations(kpi_rows(spark, folder))
    return rows.select(
        "series_id", "r2_text", "p_text", "rmse_text", "confidence_level", "practical_text", "forecast_guidance",
        "hist_sig_text", "fc_consistency_text",
    )


def insights(spark, folder):
    rows = kpi_rows(spark, folder)
    return shown(rows.select("series_id", F.posexplode("insights").alias("position", "insight")))


def recommendations(spark, folder):
    return shown(rules.recommendation_tiers(kpi_rows(spark, folder)))


def consistency_warnings(spark, folder):
    rows = kpi_rows(spark, folder)
    return rows.select("series_id", _joined("consistency_warnings"), _joined("report_warnings"))


def divergence_warnings(spark, folder):
    rows = panel(spark, folder)
    trends = forecast.historical_trend(rows).join(
        forecast.forecast_trend(seasonal_forecast(rows)[0]), "series_id"
    )
    kpis = trends.select(
        "series_id",
        display(F.col("hist_trend"), 3).alias("historical_trend_per_decade"),
        display(F.col("fc_trend"), 3).alias("forecast_trend_per_decade"),
    )
    found = rules.categorize(rules.divergence_warnings(kpis))
    return found.select("series_id", "type", "severity", "details")


def dashboard_labels(spark, folder):
    rows = rules.dashboard_labels(kpi_rows(spark, folder))
    return rows.select(
        "series_id", "trend_direction", "confidence_label", "fit_label", "temperature_band", "anomaly_direction"
    )


# -- models per series --------------------------------------------------------------------

# Parameters of the comparison run of the smoothing recursion.
FIXED = {"m": 7, "alpha": 0.3, "beta": 0.05, "gamma": 0.2, "phi": 0.98}


def holt_winters_fixed(spark, folder):
    models = smoothing.fit_smoothing(tables.shipment_panel(spark, folder), fixed=FIXED)
    return shown(smoothing.fitted_values(models))


def holt_winters_fixed_forecast(spark, folder):
    models = smoothing.fit_smoothing(tables.shipment_panel(spark, folder), fixed=FIXED)
    return shown(smoothing.forecast(models, 365))


def holt_winters_fit(spark, folder):
    models = smoothing.fit_smoothing(tables.shipment_panel(spark, folder))
    return shown(models.drop("season", "fitted"))


def holt_winters_forecast(spark, folder):
    models = materialize(smoothing.fit_smoothing(tables.shipment_panel(spark, folder)))
    return shown(smoothing.forecast(models, STEPS))


def walk_forward_smoothing(spark, folder):
    return shown(evaluate.validate_smoothing(panel(spark, folder)))


def forecast_run(spark, folder):
    rows = materialize(spine(spark, folder).select("series_id", DATE, "temperature"))
    return shown(forecast.run_forecast(rows)["forecast"])


def walk_forward_fixed(spark, folder):
    return shown(evaluate.validate_smoothing(panel(spark, folder), fixed=FIXED))


def fixed_run(spark, folder) -> dict[str, DataFrame]:
    """The composed forecast with smoothing as the primary model, on given parameters."""
    return forecast.run_forecast(materialize(spine(spark, folder).select("series_id", DATE, "temperature")), fixed=FIXED)


def forecast_run_fixed(spark, folder):
    return shown(fixed_run(spark, folder)["forecast"])


def benchmark_fixed(spark, folder):
    return shown(fixed_run(spark, folder)["benchmark"])


def forecast_summary_fixed(spark, folder):
    rows = fixed_run(spark, folder)["summary"].select(
        "series_id", *evaluate.METRICS, "n_folds", "avg_rmse", "avg_mae", "best_model", "use_primary", "recommendation",
        "trend_ratio", "primary_class", "primary_score", "used_linear_fallback", "forecast_class", _joined("classification_reasons"),
        "recommended_action", "reliability_score", "reliability_label", _joined("quality_issues"), "trend_dampening_applied",
        "trend_per_decade", "trend_r_squared", "failed",
    )
    return shown(rows)


def pipeline_summary_fixed(spark, folder):
    """The KPI row of the whole pipeline, on given smoothing parameters."""
    return shown(_simple(pipeline.run(panel(spark, folder), fixed=FIXED)["summary"]))


def pipeline_summary(spark, folder):
    return pipeline.run(tables.shipment_panel(spark, folder))["summary"]


def preprocess(spark, folder):
    return shown(pipeline.preprocess(panel(spark, folder)))


def observed_span(spark, folder):
    """Counts, means and flags after preprocessing a panel with many gaps: the observed days alone."""
    rows = pipeline.preprocess(materialize(tables.supplier_panel(spark, folder)))
    span = pipeline.observed_span(anomaly.combine_flags(anomaly.zscore_flags(rows)))
    return shown(span.select("*", "date_range.start", "date_range.end").drop("date_range"))


def sketch_quantiles(spark, folder):
    """Quartiles of 1993 to 1996 from monthly sketches: counts, extremes, and whether their ranks hold."""
    rows = panel(spark, folder)
    months = materialize(sketches.monthly_sketches(rows))
    spans = materialize(sketches.statistics(sketches.merged(months, "1993-01", "1996-12")))
    found = spans.select("series_id", "variable", F.posexplode("quantiles").alias("_i", "_q")).withColumn(
        "point", F.element_at(F.array(*[F.lit(p) for p in sketches.QUARTILES]), F.col("_i") + 1)
    )
    cells = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).alias("value")) for v in VARIABLES])
    values = rows.filter(F.year(DATE).between(1993, 1996)).select("series_id", F.inline(cells))
    value = F.col("value")
    ranks = values.join(found, ["series_id", "variable"]).groupBy("series_id", "variable", "point").agg(
        (F.count_if(value < F.col("_q")) / F.count(value)).alias("_below"), (F.count_if(value <= F.col("_q")) / F.count(value)).alias("_upto")
    )
    holds = (F.col("_below") <= F.col("point") + 0.005) & (F.col("_upto") >= F.col("point") - 0.005)
    checked = ranks.select("series_id", "variable", "point", holds.alias("rank_holds"))
    return shown(spans.drop("quantiles").join(checked, ["series_id", "variable"]))


QUERIES = {
    "daily_panel": daily_panel,
    "csv_round_trip": csv_round_trip,
    "json_round_trip": json_round_trip,
    "table_round_trip": table_round_trip,
    "parse_map_payload": parse_map_payload,
    "parse_array_payload": parse_array_payload,
    "parse_variant_payload": parse_variant_payload,
    "rename_columns": rename_columns,
    "convert_types": convert_types,
    "rejected_rows": rejected_rows,
    "validation_issues": validation_issues,
    "validation_bounds": validation_bounds,
    "validation_report": validation_report,
    "validation_rejects": validation_rejects,
    "engineered_catalogue": engineered_catalogue,
    "date_bounds": date_bounds,
    "quality_report": quality_report,
    "quality_score": quality_score,
    "column_profile": column_profile,
    "top_outlier_columns": top_outlier_columns,
    "duplicate_rows": duplicate_rows,
    "normalize_names": normalize_names,
    "impute_linear": impute_linear,
    "fill_gaps": fill_gaps,
    "date_spine": date_spine_query,
    "temporal_features": temporal_features,
    "rolling_means": rolling_means,
    "rolling_by_row": rolling_by_row,
    "rolling_strict": rolling_strict,
    "rolling_suppliers": rolling_suppliers,
    "lag_features": lag_features,
    "elapsed_days": elapsed_days,
    "row_positions": row_positions,
    "head_rows": head_rows,
    "tail_rows": tail_rows,
    "systematic_sample": systematic_sample,
    "thin_rows": thin_rows,
    "date_range": date_range,
    "merge_sources": merge_sources,
    "merge_buckets": merge_buckets,
    "align_sources": align_sources,
    "align_accuracy": align_accuracy,
    "summary_statistics": _over_panel(eda.summary_statistics),
    "monthly_aggregates": _over_panel(eda.monthly_aggregates),
    "monthly_feed": _over_panel(eda.monthly_feed),
    "annual_aggregates": _over_panel(eda.annual_aggregates),
    "correlation": _over_panel(eda.correlation),
    "annual_trends": _over_panel(eda.annual_trends),
    "month_totals": _over_panel(eda.month_totals),
    "top_months": _over_panel(eda.top_months),
    "wet_days": _over_panel(eda.wet_days),
    "month_profile": _over_panel(eda.month_profile),
    "season_card": _over_panel(eda.season_card),
    "month_means": _over_panel(eda.month_means),
    "sketch_quantiles": sketch_quantiles,
    "box_statistics": _over_table(eda.box_statistics),
    "range_card": _over_panel(eda.range_card),
    "analysis_span": _over_panel(eda.analysis_span),
    "half_period_contrast": _over_table(eda.half_period_contrast),
    "value_histogram": _over_table(eda.histogram, value="temperature"),
    "station_rollup": station_rollup,
    "linear_trend": linear_trend,
    "trend_line": trend_line,
    "trend_warnings": trend_warnings,
    "historical_trend": historical_trend,
    "zscore_flags": zscore_flags,
    "iqr_flags": _over_table(anomaly.iqr_flags, value="precipitation"),
    "standard_scale": _over_table(anomaly.standard_scale, values=["temperature", "humidity"]),
    "threshold_band": _over_panel(anomaly.threshold_band),
    "anomaly_summary": anomaly_summary,
    "anomaly_days": anomaly_days,
    "fold_split": fold_split,
    "walk_forward_linear": walk_forward_linear,
    "walk_forward_summary": walk_forward_summary,
    "baseline_predictions": baseline_predictions,
    "model_ranking": model_ranking,
    "model_choice": model_choice,
    "residual_histogram": residual_histogram,
    "residual_autocorrelation": residual_autocorrelation,
    "quantile_pairs": quantile_pairs,
    "naive_forecast": naive_forecast,
    "seasonal_naive_forecast": seasonal_naive_forecast,
    "linear_forecast": linear_forecast,
    "forecast_feed": forecast_feed,
    "daily_feed": daily_feed,
    "forecast_overlay": forecast_overlay,
    "forecast_trend": forecast_trend,
    "forecast_quality": forecast_quality,
    "reliability_score": reliability_score,
    "forecast_class": forecast_class,
    "risk_score": risk_score,
    "executive_kpis": executive_kpis,
    "feed_dashboard_metrics": feed_dashboard_metrics,
    "feed_regional_map": feed_regional_map,
    "feed_forecast": feed_forecast,
    "feed_refresh": feed_refresh,
    "interpretations": interpretations,
    "insights": insights,
    "recommendations": recommendations,
    "consistency_warnings": consistency_warnings,
    "divergence_warnings": divergence_warnings,
    "dashboard_labels": dashboard_labels,
    "holt_winters_fixed": holt_winters_fixed,
    "holt_winters_fixed_forecast": holt_winters_fixed_forecast,
    "preprocess": preprocess,
    "observed_span": observed_span,
    "holt_winters_fit": holt_winters_fit,
    "holt_winters_forecast": holt_winters_forecast,
    "walk_forward_smoothing": walk_forward_smoothing,
    "isolation_forest": isolation_forest,
    "anomaly_pipeline": anomaly_pipeline,
    "forecast_run": forecast_run,
    "walk_forward_fixed": walk_forward_fixed,
    "forecast_run_fixed": forecast_run_fixed,
    "benchmark_fixed": benchmark_fixed,
    "forecast_summary_fixed": forecast_summary_fixed,
    "pipeline_summary_fixed": pipeline_summary_fixed,
    "pipeline_summary": pipeline_summary,
}
