"""Ordered operators that split a series over tasks.

A series is cut into blocks, so a single hot series never has to fit one task:

* ``with_position`` ranks rows with per-block counts and a running sum over the short
  block table;
* ``framed`` evaluates bounded frames (rolling, lag) per block, after copying the few
  rows a frame needs across a block edge;
* ``carried`` evaluates unbounded frames (forward and backward fill) per block and
  carries the last or first valid value over the block table.

A task sorts all rows of its blocks, wide with what the frames add. Where the caller knows the
number of rows, ``dealt`` keeps those of a task near ``TASK_ROWS``.

The contract for all of them is one row per series and day; ``one_row_per_day`` enforces it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tsengine.schema import DATE, SERIES

BLOCK_DAYS = 2048
#: Rows of a task in an ordered step; imputing seven variables holds some 2 KB a row.
TASK_ROWS = 1 << 17
BLOCK = "_block"
POS = "pos"
ROWS = "_n"


def one_row_per_day(df: DataFrame, keys=SERIES) -> DataFrame:
    """Fold to one row per series and day; a duplicate day raises."""
    rest = [c for c in df.columns if c not in (*keys, DATE)]
    repeated = F.raise_error(F.lit("duplicate date in series"))
    return df.groupBy(*keys, DATE).agg(
        *[F.when(F.count("*") > 1, repeated).otherwise(F.first(c)).alias(c) for c in rest]
    )


def date_spine(df: DataFrame, keys=SERIES) -> DataFrame:
    """Every calendar day between a series' first and last date, new days as nulls."""
    bounds = df.groupBy(*keys).agg(F.min(DATE).alias("_from"), F.max(DATE).alias("_to"))
    days = bounds.select(*keys, F.explode(F.expr("sequence(_from, _to, interval 1 day)")).alias(DATE))
    return days.join(one_row_per_day(df, keys), [*keys, DATE], "left").select(*df.columns)


def dealt(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """Hash the groups over as many tasks as ``rows`` rows need; few or unknown rows are left to the planner."""
    if rows is None or rows <= TASK_ROWS:
        return df
    return df.repartition(max(-(-rows // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism), *keys)


def in_blocks(df: DataFrame, block_days: int = BLOCK_DAYS) -> DataFrame:
    return df.withColumn(BLOCK, F.floor(F.unix_date(DATE) / block_days))


def with_position(df: DataFrame, keys=SERIES, block_days: int = BLOCK_DAYS, rows: int | None = None) -> DataFrame:
    """Add the 0-based rank by date (``pos``) and the series length (``_n``); ``rows`` as in ``dealt``."""
    blocked = in_blocks(df, block_days)
    sizes = blocked.groupBy(*keys, BLOCK).agg(F.count("*").alias("_size"))
    series = Window.partitionBy(*keys)
    earlier = series.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *keys,
        BLOCK,
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"),
        F.sum("_size").over(series).alias(ROWS),
    )
    inside = Window.partitionBy(*keys, BLOCK).orderBy(DATE)
    return (
        dealt(blocked, rows, *keys, BLOCK)
        .join(starts, [*keys, BLOCK])
        .withColumn(POS, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_start", BLOCK)
    )


def day_index() -> Column:
    """Order index of a gap-free panel: positions and days are then the same."""
    return F.unix_date(F.col(DATE)).cast("bigint")


def framed(
    df: DataFrame,
    columns: Callable[[WindowSpec], list[Mapping[str, Column]]],
    before: int = 0,
    after: int = 0,
    keys=SERIES,
    index: Column | None = None,
    block_rows: int = BLOCK_DAYS,
    rows: int | None = None,
) -> DataFrame:
    """Add window columns whose frames reach at most ``before`` rows back and ``after`` ahead.

    ``index`` numbers the rows of a series without gaps: ``pos``, or the day of a gap-free
    panel. One exchange on (series, block); a row near a block edge is copied to the
    neighbours that need it. ``columns`` gives the stages: later ones may use earlier ones.
    ``rows`` as in ``dealt``.
    """
    index = F.col(POS) if index is None else index
    first = F.floor((F.col("_index") - after) / block_rows)
    last = F.floor((F.col("_index") + before) / block_rows)
    home = F.floor(F.col("_index") / block_rows)
    copies = df.withColumn("_index", index)
    if before or after:
        copies = copies.withColumn(BLOCK, F.explode(F.sequence(first, last)))
    else:
        copies = copies.withColumn(BLOCK, home)
    window = Window.partitionBy(*keys, BLOCK).orderBy("_index")
    out = dealt(copies, rows, *keys, BLOCK)
    for stage in columns(window):
        out = out.withColumns(dict(stage))
    if before or after:
        out = out.filter(F.col(BLOCK) == home)
    return out.drop("_index", BLOCK)


def carried(
    df: DataFrame,
    values: list[str],
    index: Column,
    keys=SERIES,
    block_days: int = BLOCK_DAYS,
    rows: int | None = None,
) -> DataFrame:
    """Add the nearest valid reading on each side of every row, the row itself included.

    ``_prev_<v>`` at index ``_prev_at_<v>`` is at or before the row, ``_next_<v>`` at
    ``_next_at_<v>`` at or after it. ``rows`` as in ``dealt``.
    """
    blocked = in_blocks(df, block_days).withColumn("_i", index)

    def valid_at(v: str) -> Column:
        return F.when(F.col(v).isNotNull(), F.col("_i"))

    ends = {}
    for v in values:
        ends[f"_last_at_{v}"] = F.max(valid_at(v))
        ends[f"_last_{v}"] = F.max_by(v, valid_at(v))
        ends[f"_first_at_{v}"] = F.min(valid_at(v))
        ends[f"_first_{v}"] = F.min_by(v, valid_at(v))
    per_block = blocked.groupBy(*keys, BLOCK).agg(*[c.alias(name) for name, c in ends.items()])

    blocks = Window.partitionBy(*keys).orderBy(BLOCK)
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    # Looking ahead is a running frame over the reversed order: a frame that is unbounded
    # on the following side would cost a pass over the rest of the block for every row.
    inside = Window.partitionBy(*keys, BLOCK)
    so_far = inside.orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    onward = inside.orderBy(F.desc(DATE)).rowsBetween(Window.unboundedPreceding, 0)
    carry, filled = {}, {}
    for v in values:
        for part, reading in ((f"at_{v}", valid_at(v)), (v, F.col(v))):
            carry[f"_before_{part}"] = F.last(f"_last_{part}", ignorenulls=True).over(earlier)
            carry[f"_after_{part}"] = F.last(f"_first_{part}", ignorenulls=True).over(later)
            filled[f"_prev_{part}"] = F.coalesce(
                F.last(reading, ignorenulls=True).over(so_far), F.col(f"_before_{part}")
            )
            filled[f"_next_{part}"] = F.coalesce(
                F.last(reading, ignorenulls=True).over(onward), F.col(f"_after_{part}")
            )
    edges = per_block.select(*keys, BLOCK, *[c.alias(name) for name, c in carry.items()])
    return dealt(blocked, rows, *keys, BLOCK).join(edges, [*keys, BLOCK]).withColumns(filled).drop(BLOCK, "_i", *carry)
