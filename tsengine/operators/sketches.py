"""Quantiles from mergeable KLL sketches: one per series and month, merged to any span.

A sketch has a fixed size whatever it has seen, so rows of any grain fold on the map side, and a month
that was sketched once is not read again for a longer span. A quantile's rank is off by at most
``RANK_ERROR`` of the count with 99 % confidence; up to ``SIZE`` values it is exact (a value of the data,
not interpolated). Nulls take no part; without any value the quantiles are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsengine.schema import DATE, SERIES, VARIABLES, present

SIZE = 2048
#: Error of a KLL sketch of this size, as its authors give it.
RANK_ERROR = 2.446 / SIZE**0.9433
QUARTILES = (0.25, 0.5, 0.75)


def sketch(c) -> Column:
    """The sketch of a column, as an aggregate."""
    return F.kll_sketch_agg_double(c, F.lit(SIZE))


def quantiles_of(sketched: Column, points=QUARTILES) -> Column:
    """The values at the given shares of a sketch, as an array; null for an empty sketch."""
    return F.when(
        F.kll_sketch_get_n_double(sketched) > 0, F.kll_sketch_get_quantile_double(sketched, F.array(*[F.lit(float(p)) for p in points]))
    )


def quantiles(c, points=QUARTILES) -> Column:
    """Approximate quantiles of a column, as an aggregate of fixed size."""
    return quantiles_of(sketch(c), points)


def monthly_sketches(df: DataFrame, values=VARIABLES, keys=SERIES) -> DataFrame:
    """``year``, ``month``, ``variable``, ``sketch`` and the extremes of every series and month."""
    names = present(df, values)
    months = df.groupBy(*keys, F.year(DATE).alias("year"), F.month(DATE).alias("month"))
    wide = months.agg(
        *[
            F.struct(F.lit(c).alias("variable"), sketch(c).alias("sketch"), F.min(c).alias("min"), F.max(c).alias("max")).alias(c)
            for c in names
        ]
    )
    return wide.select(*keys, "year", "month", F.inline(F.array(*names)))


def merged(sketches: DataFrame, first: str | None = None, last: str | None = None, by: tuple = SERIES) -> DataFrame:
    """The sketches of the months from ``first`` to ``last`` ('yyyy-MM', both included) merged per ``by`` and variable.

    ``by`` may name ``year`` or ``month`` too: years, calendar months over all years, or all series at once.
    """
    at = F.format_string("%04d-%02d", F.col("year"), F.col("month"))
    rows = sketches
    if first is not None:
        rows = rows.filter(at >= first)
    if last is not None:
        rows = rows.filter(at <= last)
    return rows.groupBy(*by, "variable").agg(
        F.kll_merge_agg_double("sketch", F.lit(SIZE)).alias("sketch"), F.min("min").alias("min"), F.max("max").alias("max")
    )


def statistics(sketches: DataFrame, points=QUARTILES) -> DataFrame:
    """``count``, extremes and ``quantiles`` of merged sketches."""
    columns = [c for c in sketches.columns if c not in ("sketch", "min", "max")]
    found = quantiles_of(F.col("sketch"), points)
    return sketches.select(*columns, F.kll_sketch_get_n_double("sketch").alias("count"), "min", "max", found.alias("quantiles"))
