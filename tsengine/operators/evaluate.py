"""Forecast accuracy, rolling-origin folds, baseline models and their ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsengine.functions.stats import NORMAL_975, normal_quantile, ols
from tsengine.operators import smoothing
from tsengine.operators.joins import attach
from tsengine.operators.order import POS, ROWS, framed, with_position
from tsengine.schema import DATE, DEFAULTS, SERIES
from tsengine.session import materialize

METRICS = ("rmse", "mae", "mape", "r_squared")

# Model keys in comparison order, with their names.
MODELS = {
    "holt_winters": "Holt-Winters",
    "naive": "Naive",
    "seasonal_naive": "Seasonal Naive",
    "linear_trend": "Linear Trend",
}
PRIMARY = "holt_winters"


def readings(df: DataFrame, value: str = "temperature", keys=SERIES) -> DataFrame:
    """Present readings as ``y`` with their rank ``pos`` and the series length ``_n``.

    Already ranked readings pass through, so that callers can rank once and write the result.
    """
    if {"y", POS, ROWS} <= set(df.columns):
        return df
    rows = df.filter(F.col(value).isNotNull()).select(*keys, DATE, F.col(value).alias("y"))
    return with_position(rows, keys)


def accuracy(df: DataFrame, actual: str = "actual", predicted: str = "predicted", keys=SERIES) -> DataFrame:
    """RMSE, MAE, MAPE (non-zero actuals) and R² per key; zeros where nothing is comparable."""
    both = F.col(actual).isNotNull() & F.col(predicted).isNotNull()
    a, error = F.when(both, F.col(actual)), F.when(both, F.col(actual) - F.col(predicted))
    relative = F.when(a != 0, F.abs(F.try_divide(error, a)))
    spread = F.var_pop(a) * F.count(a)
    explained = F.when(spread > 0, 1.0 - F.try_divide(F.sum(error * error), spread))
    zero = F.lit(0.0)
    return df.groupBy(*keys).agg(
        F.count(error).alias("rows"),
        F.coalesce(F.sqrt(F.avg(error * error)), zero).alias("rmse"),
        F.coalesce(F.avg(F.abs(error)), zero).alias("mae"),
        F.coalesce(F.avg(relative) * 100, zero).alias("mape"),
        F.coalesce(explained, zero).alias("r_squared"),
    )


def fold_bounds(
    n: Column,
    splits: int = DEFAULTS.validation_folds,
    test: int = DEFAULTS.validation_test_days,
    min_train: int = DEFAULTS.validation_min_train,
) -> Column:
    """Array of (fold, train_end, test_end) over positions; later folds train on more."""
    short = n < min_train + test
    count = F.when(short, F.greatest(F.lit(1), F.floor((n - min_train) / test))).otherwise(splits)
    start = F.greatest(n - count * test, F.lit(min_train))
    folds = F.transform(
        F.sequence(F.lit(0).cast("bigint"), count.cast("bigint") - 1),
        lambda i: F.struct(
            (i + 1).cast("int").alias("fold"),
            (start + i * test).alias("train_end"),
            (start + (i + 1) * test).alias("test_end"),
        ),
    )
    return F.filter(folds, lambda f: f["test_end"] <= n)


def in_folds(df: DataFrame, keys=SERIES, **bounds) -> DataFrame:
    """Readings repeated per fold they belong to, tagged train or test; one copy per fold."""
    rows = df.withColumn("_fold", F.explode(fold_bounds(F.col(ROWS), **bounds)))
    role = F.when(F.col(POS) < F.col("_fold.train_end"), "train").when(
        F.col(POS) < F.col("_fold.test_end"), "test"
    )
    step = (F.col(POS) - F.col("_fold.train_end") + 1).cast("int")
    return (
        rows.withColumns({"role": role, "fold": F.col("_fold.fold"), "step": step})
        .filter(F.col("role").isNotNull())
        .drop("_fold")
    )


def fold_periods(folds: DataFrame, keys=SERIES) -> DataFrame:
    """First and last day of the training and test part of every fold."""
    return folds.groupBy(*keys, "fold").agg(
        *[
            fn(F.when(F.col("role") == role, F.col(DATE))).alias(f"{role}_{name}")
            for role in ("train", "test")
            for name, fn in (("start", F.min), ("end", F.max))
        ]
    )


def linear_model(train: DataFrame, keys=SERIES) -> DataFrame:
    """OLS of the readings on their position, one row per key."""
    fitted = train.groupBy(*keys).agg(ols(F.col("y"), F.col(POS).cast("double")).alias("_fit"))
    return fitted.select(
        *keys,
        F.coalesce("_fit.slope", F.lit(0.0)).alias("slope"),
        F.coalesce("_fit.intercept", F.lit(0.0)).alias("intercept"),
    )


def segment_moments(ranked: DataFrame, keys=SERIES, **bounds) -> DataFrame:
    """Counts, means and co-moments of the readings between the ends of the training parts, one array per series.

    A reading is in one segment: that of the last training part which it is behind. The training part
    of fold k is then the segments before k, and no reading is copied to the folds that it trains.
    """
    x, y = F.col(POS).cast("double"), F.col("y")
    cut = ranked.withColumn("_folds", fold_bounds(F.col(ROWS), **bounds))
    segment = F.size(F.filter("_folds", lambda f: f["train_end"] <= F.col(POS)))
    parts = cut.withColumn("_segment", segment).groupBy(*keys, "_segment").agg(
        F.count(y).alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"), F.regr_sxx(y, x).alias("xx"), F.regr_sxy(y, x).alias("xy"),
        F.first("_folds").alias("_folds"),
    )
    part = F.struct(F.col("_segment").alias("segment"), "n", "x", "y", "xx", "xy")
    return parts.groupBy(*keys).agg(F.collect_list(part).alias("parts"), F.first("_folds").alias("folds"))


def merged_line(parts: Column) -> Column:
    """Slope and intercept from the moments of parts; co-moments add up with those of the parts' means."""

    def total(of) -> Column:
        return F.aggregate(parts, F.lit(0.0), lambda s, p: s + of(p))

    n = total(lambda p: p["n"].cast("double"))
    mean_x, mean_y = (F.try_divide(total(lambda p, c=c: p["n"] * p[c]), n) for c in "xy")

    def moments(means: Column) -> Column:
        def moment(a: str, b: str) -> Column:
            return F.aggregate(
                parts, F.lit(0.0), lambda s, p: s + p[a + b] + p["n"] * (p[a] - means[a]) * (p[b] - means[b])
            )

        slope = F.try_divide(moment("x", "y"), moment("x", "x"))
        return F.struct(slope.alias("slope"), (means["y"] - slope * means["x"]).alias("intercept"))

    once = F.array(F.struct(mean_x.alias("x"), mean_y.alias("y")))  # evaluated once
    return F.transform(once, moments)[0]


def fold_lines(ranked: DataFrame, keys=SERIES, **bounds) -> DataFrame:
    """``fold``, ``test_end``, ``slope`` and ``intercept`` of the line of every fold's training part."""
    rows = segment_moments(ranked, keys, **bounds).select(*keys, "parts", F.explode("folds").alias("_fold"))
    line = merged_line(F.filter("parts", lambda p: p["segment"] < F.col("_fold.fold")))
    return rows.select(*keys, "_fold.fold", "_fold.train_end", "_fold.test_end", line.alias("_line")).select(
        *keys, "fold", "train_end", "test_end", "_line.slope", "_line.intercept"
    )


def test_rows(ranked: DataFrame, keys=SERIES, **bounds) -> DataFrame:
    """The readings of the test parts with their ``fold`` and ``step``; test parts do not overlap."""
    bounds = fold_bounds(F.col(ROWS), **bounds)
    own = F.get(F.filter(bounds, lambda f: (f["train_end"] <= F.col(POS)) & (F.col(POS) < f["test_end"])), F.lit(0))
    rows = ranked.withColumn("_own", own).filter(F.col("_own").isNotNull())
    step = (F.col(POS) - F.col("_own.train_end") + 1).cast("int")
    return rows.withColumns({"fold": F.col("_own.fold"), "step": step}).drop("_own")


def validate_linear(df: DataFrame, value: str = "temperature", keys=SERIES, **bounds) -> DataFrame:
    """Accuracy per fold of a straight line, from one row of moments per series; no reading is copied."""
    ranked, by = readings(df, value, keys), [*keys, "fold"]
    lines = fold_lines(ranked, keys, **bounds).select(*by, "slope", "intercept")
    tested = test_rows(ranked, keys, **bounds).join(lines, by)
    predicted = F.col("slope") * F.col(POS) + F.col("intercept")
    return accuracy(tested.withColumn("predicted", predicted), "y", "predicted", by)


# Numbers of the fits that are not folds, and the cap of the season in partial training sets.
FULL_FIT, HOLDOUT_FIT, SEASON_CAP = 0, -1, 3


def _fit(number: Column, end: Column, cap: int) -> Column:
    return F.array(number.cast("bigint"), end.cast("bigint"), F.lit(cap).cast("bigint"))


def fold_fits(n: Column, **bounds) -> Column:
    """The fits (fit, end, divisor) of the training parts of the folds."""
    return F.transform(fold_bounds(n, **bounds), lambda f: _fit(f["fold"], f["train_end"], SEASON_CAP))


def training_ends(n: Column, test: int = 365) -> Column:
    """All fits of a series of ``n`` readings: the whole series, the holdout's part, every fold's training part."""
    own = F.array(_fit(F.lit(FULL_FIT), n, 0), _fit(F.lit(HOLDOUT_FIT), n - holdout_days(n, test), SEASON_CAP))
    return F.filter(F.concat(own, fold_fits(n)), lambda p: p[1] > 0)


def smoothing_fits(ranked: DataFrame, ends: Column, keys=SERIES, **settings) -> DataFrame:
    """Smoothing models of ranked readings by ``fit``. A series is shipped once, its list of fits with the first reading."""
    return smoothing.fit_parts(ranked, "y", F.when(F.col(POS) == 0, ends), keys=keys, **settings)


def validate_smoothing(
    df: DataFrame, value: str = "temperature", keys=SERIES, models: DataFrame | None = None, fixed: dict | None = None, **bounds
) -> DataFrame:
    """Accuracy per fold of exponential smoothing.

    ``models`` are fits per (series, fold) made before; ``fixed`` gives parameters instead of searching them.
    """
    ranked, by = readings(df, value, keys), (*keys, "fold")
    if models is None:
        fits = smoothing_fits(ranked, fold_fits(F.col(ROWS), **bounds), keys, fixed=fixed)
        models = fits.withColumnRenamed("fit", "fold")
    horizon = bounds.get("test", DEFAULTS.validation_test_days)
    predicted = smoothing.forecast(models, horizon, by)
    tested = test_rows(ranked, keys, **bounds).join(predicted, [*by, "step"])
    return accuracy(tested, "y", "forecast", by)


def summarize_folds(folds: DataFrame, series: DataFrame, keys=SERIES) -> DataFrame:
    """Mean accuracy over folds and its population deviation; zeros for a series without folds."""
    means = [F.avg(m).alias(f"avg_{m}") for m in METRICS]
    spread = [F.stddev_pop(m).alias(f"std_{m}") for m in ("rmse", "mae")]
    summary = folds.groupBy(*keys).agg(F.count("*").alias("n_folds"), *means, *spread)
    out = series.select(*keys).join(summary, list(keys), "left")
    return out.na.fill(0, ["n_folds", *[f"avg_{m}" for m in METRICS], "std_rmse", "std_mae"])


def holdout_days(n: Column, test: int = 365) -> Column:
    """Length of the test part: shorter where less than a year would be left to train on, whatever the season."""
    return F.when(n <= test + 365, F.greatest(F.lit(30), F.floor(n / 4))).otherwise(test)


def baseline_predictions(
    df: DataFrame, value: str = "temperature", test: int = 365, season: int = 365, models: DataFrame | None = None, keys=SERIES
) -> DataFrame:
    """Predictions of every baseline for the last days of each series, in long form.

    ``models``, smoothing fits of the part before those days, add the primary model.
    """
    ranked = readings(df, value, keys).withColumn("_test", holdout_days(F.col(ROWS), test))
    ranked = ranked.withColumn("_train", F.col(ROWS) - F.col("_test"))
    in_train = F.col(POS) < F.col("_train")
    x = F.col(POS).cast("double")
    y = F.when(in_train, F.col("y"))
    stats = ranked.groupBy(*keys).agg(
        F.max_by(y, F.when(in_train, F.col(POS))).alias("naive"),
        F.regr_slope(y, x).alias("_slope"),
        F.regr_intercept(y, x).alias("_intercept"),
    )
    # Step h of the test part repeats the reading one season (or more) before it.
    # Without a training part there is no source, and every prediction is null.
    cycle = F.greatest(F.least(F.lit(season), F.col("_train")), F.lit(1))
    source = F.when(F.col("_train") > 0, F.col("_train") - cycle + F.pmod(F.col(POS) - F.col("_train"), cycle))
    tested = ranked.filter(~in_train).withColumn("_source", source)
    earlier = ranked.filter(in_train).select(*keys, F.col(POS).alias("_source"), F.col("y").alias("seasonal_naive"))
    wide = tested.join(earlier, [*keys, "_source"], "left").join(stats, list(keys))
    wide = wide.withColumn("linear_trend", F.col("_slope") * x + F.col("_intercept"))
    names = [m for m in MODELS if models is not None or m != PRIMARY]
    if models is not None:
        ahead = smoothing.forecast(models, test, keys).withColumnRenamed("forecast", PRIMARY)
        step = (F.col(POS) - F.col("_train") + 1).cast("int")
        wide = wide.withColumn("step", step).join(ahead, [*keys, "step"], "left")
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("predicted")) for m in names])
    return wide.select(*keys, DATE, POS, F.col("y").alias("actual"), F.inline(rows))


def rank_models(metrics: DataFrame, keys=SERIES) -> DataFrame:
    """Models by RMSE, a failed one last, ties in model order."""
    order = F.create_map(*[F.lit(v) for i, m in enumerate(MODELS) for v in (m, i)])
    sized = metrics.withColumn("rmse", F.when(F.col("rows") > 0, F.col("rmse")).otherwise(float("inf")))
    by_error = Window.partitionBy(*keys).orderBy("rmse", F.element_at(order, F.col("model")))
    return sized.withColumn("rank", F.row_number().over(by_error))


def choose_model(ranked: DataFrame, primary: str = PRIMARY, margin: float = 0.9, keys=SERIES) -> DataFrame:
    """Best model per series, and whether the primary one is kept.

    The primary model goes only when the best one's RMSE is below ``margin`` of its own.
    """
    names = F.create_map(*[F.lit(v) for pair in MODELS.items() for v in pair])
    first = ranked.groupBy(*keys).agg(
        F.min_by("model", "rank").alias("best_model"),
        F.min("rmse").alias("best_rmse"),
        F.max(F.when(F.col("model") == primary, F.col("rmse"))).alias("primary_rmse"),
    )
    keep = ~((F.col("best_model") != primary) & (F.col("best_rmse") < F.col("primary_rmse") * margin))
    outperformed = F.format_string(
        "%s outperformed %s (RMSE: %.3f vs %.3f). Consider alternative model for this dataset.",
        F.element_at(names, F.col("best_model")),
        F.lit(MODELS[primary]),
        "best_rmse",
        "primary_rmse",
    )
    kept = F.format_string(
        "%s selected (RMSE: %.3f). Comparable or superior to baseline models.",
        F.lit(MODELS[primary]),
        "primary_rmse",
    )
    return first.withColumn("use_primary", keep).withColumn(
        "recommendation", F.when(F.col("use_primary"), kept).otherwise(outperformed)
    )


def autocorrelation(df: DataFrame, value: str, max_lag: int = 60, keys=SERIES) -> DataFrame:
    """Biased autocorrelation of the present values with its 95 % band.

    Lags 0..min(max_lag, n // 2 - 1). All lags are columns of one window pass and one
    aggregate, so nothing is joined to itself.
    """
    ranked = readings(df, value, keys)
    mean = ranked.groupBy(*keys).agg(F.avg("y").alias("_mean"))
    centred = attach(ranked, mean, keys).withColumn("_c", F.col("y") - F.col("_mean"))
    lags = range(max_lag + 1)
    lagged = framed(
        centred.select(*keys, DATE, POS, ROWS, "_c"),
        lambda w: [{f"_l{k}": F.lag("_c", k).over(w) for k in lags if k}],
        before=max_lag,
        keys=keys,
    ).withColumn("_l0", F.col("_c"))
    sums = lagged.groupBy(*keys).agg(
        F.max(ROWS).alias("n"), *[F.sum(F.col("_c") * F.col(f"_l{k}")).alias(f"_s{k}") for k in lags]
    )
    cells = F.array(
        *[
            F.struct(F.lit(k).alias("lag"), F.try_divide(F.coalesce(f"_s{k}", F.lit(0.0)), F.col("_s0")).alias("acf"))
            for k in lags
        ]
    )
    rows = sums.select(*keys, "n", F.inline(cells)).filter(
        F.col("lag") <= F.least(F.lit(max_lag), F.floor(F.col("n") / 2) - 1)
    )
    # At most max_lag + 1 rows per series from here on.
    before = Window.partitionBy(*keys).orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum(F.when(F.col("lag") > 0, F.col("acf") * F.col("acf"))).over(before), F.lit(0.0))
    variance = F.when(F.col("lag") == 0, F.lit(0.0)).otherwise((1.0 + 2.0 * earlier) / F.col("n"))
    return rows.withColumn("band", F.lit(NORMAL_975) * F.sqrt(variance))


def value_slots(values: DataFrame, keys=SERIES, slots: int = 64) -> DataFrame:
    """Distinct values with ``_slot``: ordered ranges of about equally many, cut at approximate quantiles.

    The cuts are written, so that every branch places a value alike.
    """
    shares = [i / slots for i in range(1, slots)]
    cuts = materialize(values.groupBy(*keys).agg(F.percentile_approx("sample", shares, 1000).alias("_cuts")))
    slot = F.size(F.filter("_cuts", lambda cut: cut < F.col("sample")))
    return attach(values, cuts, keys).withColumn("_slot", slot).drop("_cuts")


def quantile_pairs(df: DataFrame, value: str, keys=SERIES) -> DataFrame:
    """Sorted values against normal quantiles at i / (n + 1).

    Equal values fold to a count first; ranks come from counts in value ranges, as positions
    do: no task sorts a whole series, whatever its spread.
    """
    present = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("sample"))
    values = materialize(present.groupBy(*keys, "sample").agg(F.count("*").alias("_copies")))
    ranged = value_slots(values, keys)
    sizes = ranged.groupBy(*keys, "_slot").agg(F.sum("_copies").alias("_size"))
    series = Window.partitionBy(*keys)
    earlier = series.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *keys,
        "_slot",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"),
        F.sum("_size").over(series).alias("_n"),
    )
    below = Window.partitionBy(*keys, "_slot").orderBy("sample").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_start") + F.coalesce(F.sum("_copies").over(below), F.lit(0))
    placed = ranged.join(starts, [*keys, "_slot"]).withColumn("_before", before)
    ranked = placed.withColumn("rank", F.explode(F.sequence(F.col("_before") + 1, F.col("_before") + F.col("_copies"))))
    share = F.col("rank").cast("double") / (F.col("_n") + 1)
    return ranked.select(*keys, "rank", "sample", normal_quantile(share).alias("theoretical"))
