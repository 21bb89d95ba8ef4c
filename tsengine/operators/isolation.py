"""Isolation forest: trees grown level by level and scored, both in Spark expressions.

Every series has its own forest and cut. A tree's sample are the rows of its series that come first
in a pseudo-random order of the days; draws and cuts come from ``md5`` of series, tree and node, so
a forest depends on neither partitions nor engine. One exchange brings the samples together by
series and tree; there each tree is one array of at most ``sample`` rows, of which a step of an
aggregate grows a whole level. A split compares a value with a cut between the node's smallest and
largest one, so it is the same whatever the variables' scales, and nothing is scaled.

The nodes of a series meet its days as arrays of at most ``DAYS_TOGETHER`` days, which few series exceed, and
are walked by an expression; no node is copied to a day. On request one pooled forest serves all series; its at most
``trees * (2 * sample - 1)`` nodes go to all tasks.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsengine.operators.anomaly import FOREST
from tsengine.operators.joins import attach
from tsengine.schema import CORE_VARIABLES, DATE, DEFAULTS, SERIES, present
from tsengine.session import materialize, spread

EULER_GAMMA = 0.5772156649015329
LEAST_ROWS = 10
#: Day orders are numbers modulo this prime; fractions have 52 bits, the leading 13 digits of ``md5``.
PRIME = (1 << 31) - 1
DIGITS, FRACTION = 13, float(1 << 52)
SCORE = "anomaly_score"
#: Calendar days of a series that meet its forest as one array: 44 years.
DAYS_TOGETHER = 1 << 14


def average_path(n: Column) -> Column:
    """Mean depth of an unsuccessful search in a random tree of n points."""
    points = F.greatest(n.cast("double"), F.lit(2.0))
    depth = 2.0 * (F.log(points - 1.0) + EULER_GAMMA) - 2.0 * (points - 1.0) / points
    return F.when(n > 2, depth).when(n == 2, 1.0).otherwise(0.0)


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def _number(digest: Column, start: int = 1) -> Column:
    """52 bits of a digest, from its ``start``-th hexadecimal digit on."""
    return F.conv(F.substring(digest, start, DIGITS), 16, 10).cast("long")


def _order(seed: int, trees: int) -> tuple[Column, Column]:
    """Factor and offset of every tree's order of the days: (factor * day + offset) modulo ``PRIME``."""

    def drawn(kind: str, tree: int) -> int:
        return int(hashlib.md5(f"{seed}|{kind}|{tree}".encode()).hexdigest()[:DIGITS], 16)

    factors = [1 + drawn("factor", t) % (PRIME - 1) for t in range(trees)]
    offsets = [drawn("offset", t) % PRIME for t in range(trees)]
    return tuple(F.array(*[F.lit(v).cast("long") for v in column]) for column in (factors, offsets))


def samples(rows: DataFrame, keys: list[str], trees: int, sample: int, seed: int) -> DataFrame:
    """Rows of every tree's sample. ``rows`` have ``_day``, their place modulo ``PRIME``, and ``_rows``, the series' length.

    The trees that may draw a row are found in its own place, so no row is copied to the others.
    """
    factor, offset = _order(seed, trees)
    every = F.sequence(F.lit(0), F.lit(trees - 1))

    def place(t: Column) -> Column:
        return F.pmod(factor[t] * F.col("_day") + offset[t], F.lit(PRIME))

    early = F.filter(every, lambda t: place(t) * F.col("_rows") < 4 * sample * PRIME)
    drawn = rows.withColumn("tree", F.explode(early)).withColumn("_place", place(F.col("tree")))
    ranked = Window.partitionBy(*keys, "tree").orderBy("_place", *[c for c in rows.columns if c not in (*keys, "_rows")])
    return drawn.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= sample).drop("_rank", "_place")


def _bound(value: Column, use) -> Column:
    """``use(value)``, with the value evaluated once."""
    return F.transform(F.array(value), use)[0]


def _levels(sample: int) -> int:
    return max(1, math.ceil(math.log2(max(sample, 2))))


def _decided(n: Column, depth: Column, key: list[Column], features: int) -> Column:
    """An open node (node, points) with its ``feature`` and cut ``value``, or -1 and its path length at a leaf."""
    every = F.sequence(F.lit(0), F.lit(features - 1))

    def span(j: Column) -> Column:
        own = F.transform(n["points"], lambda p: F.get(p, j))
        return F.struct(F.array_min(own).alias("low"), F.array_max(own).alias("high"))

    def result(feature: Column, value: Column) -> Column:
        return F.struct(n["node"].alias("node"), n["points"].alias("points"), feature.cast("int").alias("feature"), value.alias("value"))

    def draw(spans: Column) -> Column:
        wide = F.filter(every, lambda j: F.get(spans, j)["high"] > F.get(spans, j)["low"])

        def cut(open_: Column, digest: Column) -> Column:
            feature = F.get(open_, F.floor(_number(digest) / FRACTION * F.size(open_)).cast("int"))

            def place(of: Column) -> Column:
                at = of["low"] + _number(digest, DIGITS + 1) / FRACTION * (of["high"] - of["low"])
                return _bound(at, lambda x: F.when(x < of["high"], x).otherwise(of["low"]))

            return _bound(feature, lambda j: result(j, _bound(F.get(spans, j), place)))

        def split(open_: Column) -> Column:
            inner = (depth < F.col("_height")) & (F.size(n["points"]) > 1) & (F.size(open_) > 0)
            leaf = result(F.lit(-1), depth.cast("double") + average_path(F.size(n["points"])))
            return F.when(inner, _bound(_digest(*key, n["node"]), lambda d: cut(open_, d))).otherwise(leaf)

        return _bound(wide, split)

    return _bound(F.transform(every, span), draw)


def grown(key: list[Column], features: int, sample: int) -> Column:
    """The tree over ``_points`` of height ``_height``: nodes in level order as (feature, left, value).

    ``feature`` is -1 at a leaf, whose ``value`` is its path length; other nodes send what is at most
    ``value`` to the node at place ``left`` and the rest to the next one. The children of node i have the
    numbers 2i and 2i + 1, which with the key decide their draws. One step grows a whole level.
    """
    start = F.struct(
        F.array(F.struct(F.lit(1).cast("long").alias("node"), F.col("_points").alias("points"))).alias("open"),
        F.lit(0).alias("total"),
        F.array().cast("array<struct<feature:int,left:int,value:double>>").alias("nodes"),
    )

    def children(n: Column) -> Column:
        def side(number: Column, low: bool) -> Column:
            inside = F.filter(n["points"], lambda p: (F.get(p, n["feature"]) <= n["value"]) == F.lit(low))
            return F.struct(number.alias("node"), inside.alias("points"))

        none = F.array().cast("array<struct<node:bigint,points:array<array<double>>>>")
        return F.when(n["feature"] >= 0, F.array(side(2 * n["node"], True), side(2 * n["node"] + 1, False))).otherwise(none)

    def level(state: Column, depth: Column) -> Column:
        def close(decided: Column) -> Column:
            def place(below: Column) -> Column:
                total = state["total"] + F.size(decided)

                def node(n: Column, numbers: Column) -> Column:
                    left = total + F.array_position(numbers, 2 * n["node"]).cast("int") - 1
                    return F.struct(n["feature"].alias("feature"), left.alias("left"), n["value"].alias("value"))

                new = _bound(below["node"], lambda numbers: F.transform(decided, lambda n: node(n, numbers)))
                return F.struct(below.alias("open"), total.alias("total"), F.concat(state["nodes"], new).alias("nodes"))

            return _bound(F.flatten(F.transform(decided, children)), place)

        return _bound(F.transform(state["open"], lambda n: _decided(n, depth, key, features)), close)

    return F.aggregate(F.sequence(F.lit(0), F.lit(_levels(sample))), start, level, lambda state: state["nodes"])


def forests(drawn: DataFrame, values: list[str], keys: list[str], sample: int, seed: int) -> DataFrame:
    """One row per series: ``_trees``, in order, each with the arrays ``feature``, ``left`` and ``value`` of its nodes.

    A tree grows on its at most ``sample`` rows, which are one array.
    """
    size = F.least(F.max("_rows"), F.lit(sample)).cast("double")
    one = drawn.groupBy(*keys, "tree").agg(
        F.collect_list(F.array(*values)).alias("_points"), F.greatest(F.lit(1), F.ceil(F.log2(size))).alias("_height")
    )
    key = [F.lit(seed), *[F.col(k) for k in keys], F.col("tree")]
    trees = one.select(*keys, "tree", grown(key, len(values), sample).alias("_nodes"))
    row = F.struct("tree", *[F.col(f"_nodes.{c}").alias(c) for c in ("feature", "left", "value")])
    return trees.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_trees"))


def path_length(x: Column, sample: int) -> Column:
    """Sum over the trees of the path that the values ``x`` take."""
    levels = F.sequence(F.lit(1), F.lit(_levels(sample)))

    def path(tree: Column) -> Column:
        def step(n: Column, _: Column) -> Column:
            feature = F.get(tree["feature"], n)
            right = F.when(F.get(x, feature) > F.get(tree["value"], n), 1).otherwise(0)
            return F.when(feature < 0, n).otherwise(F.get(tree["left"], n) + right)

        return F.get(tree["value"], F.aggregate(levels, F.lit(0), step))

    return F.aggregate("_trees", F.lit(0.0), lambda total, tree: total + path(tree))


def scores(
    df: DataFrame,
    values: list[str],
    trees: int = DEFAULTS.forest_trees,
    sample: int = DEFAULTS.forest_sample,
    seed: int = DEFAULTS.forest_seed,
    keys=SERIES,
    pooled: bool = False,
) -> DataFrame:
    """Key, day and ``anomaly_score`` of the complete rows; none for forests of under ten rows."""
    day = F.pmod(_number(_digest(*[F.col(k) for k in (*keys, DATE)])), F.lit(PRIME))
    by = ["_forest"] if pooled else list(keys)
    rows = df.dropna(subset=[*values, DATE]).select(*keys, DATE, *values)
    rows = materialize(rows.withColumn("_day", day).withColumn("_forest", F.lit("all")))
    lengths = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") >= LEAST_ROWS)
    counted = attach(spread(rows, *keys, DATE), lengths, by)
    order = [c for c in (DATE, *keys) if c not in by]
    drawn = samples(counted.select(*by, *order, "_day", "_rows", *values), by, trees, sample, seed)
    grown_trees = forests(spread(drawn, *by, "tree"), values, by, sample, seed).join(lengths, by)
    mean = average_path(F.least(F.col("_rows"), F.lit(sample))) * F.size("_trees")

    def scored(x: Column) -> Column:
        return F.pow(F.lit(2.0), -path_length(x, sample) / mean).alias(SCORE)

    if pooled:  # one row of bounded size
        return rows.join(F.broadcast(grown_trees), by).select(*keys, DATE, scored(F.array(*values)))
    # days and nodes meet as arrays: no node is copied to a day, and a series of any length is no single array
    part = F.floor(F.unix_date(DATE) / DAYS_TOGETHER).alias("_part")
    days = rows.groupBy(*keys, part).agg(F.collect_list(F.struct(DATE, F.array(*values).alias("x"))).alias("_days"))
    days = spread(days, *keys, "_part")
    met = days.join(grown_trees, list(keys))
    return met.select(*keys, F.inline(F.transform("_days", lambda d: F.struct(d[DATE].alias(DATE), scored(d["x"])))))


def global_quantile(df: DataFrame, value: str, q: float, buckets: int = 1 << 14) -> float | None:
    """Exact interpolated quantile of a value in [0, 1] over all rows.

    Two passes: counts per bucket find where the rank falls, then only that bucket's
    distinct values are counted. No task or driver sees more than ``buckets`` counts and
    one bucket's distinct values, which are found by halving while they are many.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    low, high, below = 0.0, 1.0 + 1e-9, 0
    count = rows.count()
    if count == 0:
        return None
    rank = q * (count - 1)
    first, second = math.floor(rank), math.ceil(rank)

    def at(position: int) -> float:
        lo, hi, skipped = low, high, below
        while True:
            width = (hi - lo) / buckets
            inside = rows.filter((F.col("v") >= lo) & (F.col("v") < hi))
            slot = F.floor((F.col("v") - lo) / width)
            counts = inside.groupBy(slot.alias("slot")).agg(
                F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
            )
            for row in sorted(counts.collect(), key=lambda r: r["slot"]):
                if position < skipped + row["n"]:
                    break
                skipped += row["n"]
            if row["lo"] == row["hi"]:
                return row["lo"]
            # Narrow to the bucket's own values; the open upper edge keeps its maximum inside.
            lo, hi = row["lo"], math.nextafter(row["hi"], math.inf)

    lower = at(first)
    if first == second:
        return lower
    return lower + (at(second) - lower) * (rank - first)


def forest_flags(
    df: DataFrame,
    values=CORE_VARIABLES,
    contamination: float = DEFAULTS.contamination,
    trees: int = DEFAULTS.forest_trees,
    sample: int = DEFAULTS.forest_sample,
    seed: int = DEFAULTS.forest_seed,
    keys=SERIES,
    pooled: bool = False,
) -> DataFrame:
    """True for the ``contamination`` share of each series' complete rows that isolate fastest.

    ``pooled`` grows one forest and finds one cut over all series. Rows that are not complete, and
    all rows where there are under two variables or ten rows, are not flagged.
    """
    names = present(df, values)
    if len(names) < 2:
        return df.withColumn(FOREST, F.lit(False))
    # Scores are written once: the cuts and the flags both read them. One reading a day bounds
    # the values that a cut is found in.
    found = materialize(scores(df, names, trees, sample, seed, keys, pooled))
    if pooled:
        cut = global_quantile(found, SCORE, 1.0 - contamination)
        flagged = found.withColumn(FOREST, F.col(SCORE) > F.lit(cut))
    else:
        cuts = found.groupBy(*keys).agg(F.percentile(SCORE, F.lit(1.0 - contamination)).alias("_cut"))
        flagged = found.join(cuts, list(keys)).withColumn(FOREST, F.col(SCORE) > F.col("_cut")).drop("_cut")
    return df.join(flagged, [*keys, DATE], "left").na.fill(False, [FOREST])
