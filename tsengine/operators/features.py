"""Imputation, calendar, rolling and lag features, and thinning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsengine.functions.columns import season_of
from tsengine.operators.joins import attach
from tsengine.operators.order import POS, ROWS, carried, day_index, framed, with_position
from tsengine.schema import DATE, DEFAULTS, SERIES


def numeric_columns(df: DataFrame, keys=SERIES) -> list[str]:
    skip = {*keys, DATE, POS, ROWS}
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def _order_index(df: DataFrame, regular: bool, keys) -> tuple[DataFrame, Column, list[str]]:
    """Order index of the rows; an irregular panel is ranked first."""
    if regular:
        return df, day_index(), []
    if POS in df.columns:
        return df, F.col(POS), []
    return with_position(df, keys), F.col(POS), [POS, ROWS]


def impute_linear(df: DataFrame, values=None, regular: bool = False, keys=SERIES, rows: int | None = None) -> DataFrame:
    """Linear interpolation by row position; both edges take the nearest valid value. ``rows`` as in ``dealt``."""
    names = list(values) if values is not None else numeric_columns(df, keys)
    order = df.columns
    df, index, extra = _order_index(df, regular, keys)
    df = df.withColumn("_at", index)
    filled = carried(df, names, F.col("_at"), keys, rows=rows)

    def value(v: str) -> Column:
        prev, after = F.col(f"_prev_{v}"), F.col(f"_next_{v}")
        prev_at, after_at = F.col(f"_prev_at_{v}"), F.col(f"_next_at_{v}")
        between = prev + (after - prev) * F.try_divide(F.col("_at") - prev_at, after_at - prev_at)
        return F.coalesce(F.col(v), between, after, prev)

    return filled.select(*[value(c).alias(c) if c in names else F.col(c) for c in order])


def forward_fill(df: DataFrame, values, keys=SERIES) -> DataFrame:
    filled = carried(df, list(values), day_index(), keys)
    return filled.select(*[F.col(f"_prev_{c}").alias(c) if c in values else F.col(c) for c in df.columns])


def backward_fill(df: DataFrame, values, keys=SERIES) -> DataFrame:
    filled = carried(df, list(values), day_index(), keys)
    return filled.select(*[F.col(f"_next_{c}").alias(c) if c in values else F.col(c) for c in df.columns])


def temporal_features(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "year": F.year(DATE),
            "month": F.month(DATE),
            "day_of_year": F.dayofyear(DATE),
            "season": season_of(F.month(DATE)),
        }
    )


def date_range(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows between two days, both included; the predicate reaches the scan."""
    return df.filter(F.col(DATE).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def rolling_stages(spec, window: WindowSpec, strict: bool = False) -> list[dict[str, Column]]:
    """Trailing means over bounded frames: a reading matters only while it is inside the window."""
    means = {}
    for c, widths in spec.items():
        for w in widths:
            frame = window.rowsBetween(-(w - 1), 0)
            mean = F.avg(c).over(frame)
            means[f"{c}_ma{w}"] = F.when(F.count(c).over(frame) >= w, mean) if strict else mean
    return [means]


def rolling_means(
    df: DataFrame, spec=None, regular: bool = False, strict: bool = False, keys=SERIES, rows: int | None = None
) -> DataFrame:
    """Trailing means over rows, missing values skipped.

    ``spec`` maps a column to its widths; ``strict`` needs a full window of values. ``rows`` as in ``dealt``.
    """
    spec = {c: w for c, w in (spec or DEFAULTS.rolling).items() if c in df.columns}
    kept = df.columns
    df, index, extra = _order_index(df, regular, keys)
    widest = max(w for widths in spec.values() for w in widths)
    out = framed(df, lambda w: rolling_stages(spec, w, strict), before=widest - 1, keys=keys, index=index, rows=rows)
    return out.select(*kept, *[f"{c}_ma{w}" for c, widths in spec.items() for w in widths])


def lag_features(df: DataFrame, spec=None, regular: bool = False, keys=SERIES, rows: int | None = None) -> DataFrame:
    """Lags by row, missing lags back-filled with the next available lagged value. ``rows`` as in ``dealt``."""
    spec = {c: k for c, k in (spec or DEFAULTS.lags).items() if c in df.columns}
    names = list(spec)
    kept = df.columns
    df, index, extra = _order_index(df, regular, keys)
    placed = df.withColumn("_at", index)
    edges = placed.groupBy(*keys).agg(
        F.min("_at").alias("_from"),
        F.max("_at").alias("_to"),
        *[F.min(F.when(F.col(c).isNotNull(), F.col("_at"))).alias(f"_head_at_{c}") for c in names],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(f"_head_{c}") for c in names],
    )
    df = carried(placed, names, F.col("_at"), keys, rows=rows)
    widest = max(k for lags in spec.values() for k in lags)

    def columns(window):
        return [
            {
                f"_lag{k}_{part}": F.lag(f"_next_{part}", k).over(window)
                for c in names
                for k in spec[c]
                for part in (c, f"at_{c}")
            }
        ]

    lagged = attach(framed(df, columns, before=widest, keys=keys, index=F.col("_at"), rows=rows), edges, keys)

    def value(c: str, k: int) -> Column:
        # The valid value at or after the lagged row, as long as its own lag falls inside the series.
        early = F.col("_at") - k < F.col("_from")
        source = F.when(early, F.col(f"_head_{c}")).otherwise(F.col(f"_lag{k}_{c}"))
        source_at = F.when(early, F.col(f"_head_at_{c}")).otherwise(F.col(f"_lag{k}_at_{c}"))
        return F.when(source_at + k <= F.col("_to"), source)

    return lagged.select(*kept, *[value(c, k).alias(f"{c}_lag{k}") for c in names for k in spec[c]])


def elapsed_days(df: DataFrame, keys=SERIES) -> DataFrame:
    """Days since the first date of the series."""
    origin = df.groupBy(*keys).agg(F.min(DATE).alias("_origin"))
    return attach(df, origin, keys).withColumn("elapsed", F.datediff(DATE, "_origin")).drop("_origin")


def systematic_sample(df: DataFrame, target: int = 1000, keys=SERIES) -> DataFrame:
    """Every step-th row by date, with step = max(1, n // min(target, n))."""
    ranked = df if POS in df.columns else with_position(df, keys)
    step = F.greatest(F.lit(1), F.floor(F.col(ROWS) / F.least(F.lit(target), F.col(ROWS))))
    return ranked.filter(F.col(POS) % step == 0).select(*df.columns)


def thin(df: DataFrame, target: int = 365, keys=SERIES) -> DataFrame:
    """Every step-th row by date, with step = max(1, n // target)."""
    ranked = df if POS in df.columns else with_position(df, keys)
    step = F.greatest(F.lit(1), F.floor(F.col(ROWS) / F.lit(target)))
    return ranked.filter(F.col(POS) % step == 0).select(*df.columns)


def head(df: DataFrame, rows: int, keys=SERIES) -> DataFrame:
    """The first rows of every series."""
    return with_position(df, keys).filter(F.col(POS) < rows).select(*df.columns)


def tail(df: DataFrame, rows: int, keys=SERIES) -> DataFrame:
    """The last rows of every series."""
    return with_position(df, keys).filter(F.col(POS) >= F.col(ROWS) - rows).select(*df.columns)
