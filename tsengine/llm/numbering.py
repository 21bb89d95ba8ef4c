"""Gapless global row numbers without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsengine.llm.common import fresh, name

#: Blocks of rows numbered side by side: a fixed number, so that reruns give the same numbers.
BLOCKS = 4096


def numbered(df: DataFrame, order: list[Column], wanted: str = "row_number", blocks: int = BLOCKS) -> tuple[DataFrame, str, str]:
    """``df`` with a number from 0 in the order of a hash of ``order`` and the count of all rows.

    Returned with the names of the two new columns.

    Rows go to blocks by the hash. Numbers are the running count of the blocks before, plus the
    place in the block. Only the block counts, at most ``blocks`` rows, meet in one task. The number
    depends on the rows alone, not on files or partitions: rows that are equal in ``order`` have
    neighbouring numbers and are interchangeable.
    """
    number, block, base = fresh(df, wanted), fresh(df, "block of the row"), fresh(df, "base of the block")
    total = fresh(df, "rows in all")
    key = F.xxhash64(*order)
    place = F.pmod(key, F.lit(blocks))
    counts = df.select(place.alias(block)).groupBy(block).agg(F.count("*").alias("n"))
    running = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = counts.select(block, F.coalesce(F.sum("n").over(running), F.lit(0)).alias(base), F.sum("n").over(all_).alias(total))
    rows = df.withColumn(block, place)
    within = F.row_number().over(Window.partitionBy(block).orderBy(key, *order))
    rows = rows.withColumn(number, within.cast("long") - 1)
    # at most ``blocks`` rows of three numbers: a proven bound for the broadcast
    rows = rows.join(F.broadcast(bases), block)
    columns = [name(c) for c in df.columns]
    return rows.select(*columns, (name(number) + name(base)).alias(number), name(total)), number, total
