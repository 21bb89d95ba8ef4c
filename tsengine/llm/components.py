"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsengine.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of ``x, y``.

    Every round hands the smallest label over each edge and then follows it one step (the label of
    the label), so long chains shorten by half. Labels are written after each round; the driver
    sees one count.
    """
    both = edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    both = written(both.filter("x <> y").distinct())
    labels = written(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("root")))
    while True:
        near = both.join(labels, both["y"] == labels["node"]).groupBy("x").agg(F.min("root").alias("near"))
        best = labels.join(near, labels["node"] == near["x"]).select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("low")
        )
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("lower"))
        best = best.join(jump, "low").select("node", "old", F.least("low", "lower").alias("root"))
        best = written(best)
        changed = best.filter(F.col("root") < F.col("old")).limit(1).count()
        labels = best.select("node", "root")
        if not changed:
            return labels
