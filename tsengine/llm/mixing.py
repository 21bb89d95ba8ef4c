"""Mixing sources to target weights by cube-method balanced sampling.

Every source has a target number of words. Its rate, target over size, gives every document the
whole copies it has in common with all of its source, and a fractional inclusion probability for
one copy more. The cube method rounds these probabilities: three undecided documents at a time
move along the vector that keeps the source's word total and document total (the null space of
the two constraints) until one of them is decided. Chunks of bounded size do this side by side,
large documents first, and leave two documents and a small reserve of all sizes; what they leave
goes through the same step again until one chunk holds a source's rest. There the landing decides
the few documents left, the reserve making up in words for single large ones.

Defined results: sources order by code point, null last, and weigh 5, 2, 1, repeating; a null or
empty text has size 0 and counts as a document only; repeated rows (equal in every column given)
are one unit: whole copies go to all of them and the rest to as many as its sampled number says;
ties are broken by a hash of the row, so reruns agree; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsengine.llm.common import fresh, name, table, word_count, written
from tsengine.llm.numbering import numbered

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Units of one chunk: the bound of a task's group.
CHUNK = 8192
#: Units of all sizes that a chunk leaves undecided, to make up for single large documents later.
RESERVE = 32
#: Last units of the landing, whose choices are all tried.
LANDING = 12
_EDGE = 1e-9


def targets(units: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: ``source_id``, ``source``, ``source_size``, ``target``.

    ``share`` of all sizes is dealt by weight; a target stops at ``most`` times its source's size
    and the excess goes to the others by weight. In the order of the ratio of cap and weight the
    capped sources come first, so running sums give the level that the others share.
    """
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    rows = sums.withColumn("source_id", rank - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("source_id") % len(WEIGHTS) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), "source_id")
    rows = rows.withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(share))
    used = F.coalesce(F.sum("cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("total") - used) / left)
    rows = rows.withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    shared = F.max(F.when(~F.col("capped"), F.col("level"))).over(Window.partitionBy())
    target = F.when(F.col("capped"), F.col("cap")).otherwise(shared * F.col("weight"))
    return rows.select("source_id", "source", "source_size", target.alias("target"))


def flight(size: np.ndarray, p: np.ndarray, units: np.ndarray, rng: np.random.Generator) -> None:
    """Move the probabilities of ``units`` inside the cube, in place, until two at most are fractional.

    Of three units with sizes a, b, c the vector (b - c, c - a, a - b) changes neither total.
    """
    active: list[int] = []
    for i in units:
        if 0 < p[i] < 1:
            active.append(int(i))
        if len(active) < 3:
            continue
        a, b, c = (float(size[k]) for k in active)
        u = (b - c, c - a, a - b) if a != b or b != c else (1.0, -1.0, 0.0)
        up = down = np.inf
        for k, d in zip(active, u):
            if d > 0:
                up, down = min(up, (1 - p[k]) / d), min(down, p[k] / d)
            elif d < 0:
                up, down = min(up, -p[k] / d), min(down, (p[k] - 1) / d)
        # a martingale: the expected probability stays
        step = up if rng.random() * (up + down) < down else -down
        for k, d in zip(active, u):
            p[k] += step * d
            if p[k] < _EDGE:
                p[k] = 0.0
            elif p[k] > 1 - _EDGE:
                p[k] = 1.0
        rest = [k for k in active if 0 < p[k] < 1]
        if len(rest) == 3:  # rounding left all three inside by less than the tolerance
            nearest = min(rest, key=lambda k: abs(p[k] - round(p[k])))
            p[nearest] = float(round(p[nearest]))
            rest.remove(nearest)
        active = rest


def landing(size: np.ndarray, p: np.ndarray) -> None:
    """Decide the fractional rest, in place, largest first.

    Each document goes where the running error in words is smaller; of all choices for the last
    ``LANDING`` ones the nearest in words, then in documents, is taken.
    """
    open_ = np.flatnonzero((p > 0) & (p < 1))
    words = count = 0.0
    for k in open_[: max(len(open_) - LANDING, 0)]:
        take = abs(words + (1 - p[k]) * size[k]) < abs(words - p[k] * size[k])
        words += (take - p[k]) * size[k]
        count += take - p[k]
        p[k] = float(take)
    open_ = open_[max(len(open_) - LANDING, 0) :]
    choices = (np.arange(2 ** len(open_))[:, None] >> np.arange(len(open_))) & 1
    off = np.abs(words + choices @ size[open_] - p[open_] @ size[open_])
    docs = np.abs(count + choices.sum(1) - p[open_].sum())
    p[open_] = choices[np.lexsort((docs, np.round(off, 6)))[0]]


def _cube(last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "number"], ascending=[False, True], ignore_index=True)
        size, p = group["size"].to_numpy(np.int64), group["chance"].to_numpy(float).copy()
        rng = np.random.default_rng([int(group["source_id"].iloc[0]), int(group["number"].min()), len(group)])
        held = min(RESERVE, len(p) // (2 if last else 4))
        reserve = np.zeros(len(p), bool)
        if held:
            reserve[np.linspace(0, len(p) - 1, held).astype(int)] = True
        flight(size, p, np.flatnonzero(~reserve), rng)
        if last:
            landing(size, p)
        group["chance"] = p
        return group[["source_id", "number", "size", "chance"]]

    return run


def sampled(units: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``number`` and ``chance`` (0 or 1) of units of ``source_id, number, size, chance``."""
    schema = "source_id int, number long, size long, chance double"
    done = []
    last = False
    while not last:
        most = units.groupBy("source_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        last = most <= chunk
        place = F.lit(0)
        if not last:
            units, at, _ = numbered(units, [F.col("number")], "place")
            place = F.floor(F.col(at) / chunk)
        groups = units.groupBy("source_id", place.alias("chunk"))
        units = written(groups.applyInPandas(_cube(last), schema))
        inside = (F.col("chance") > 0) & (F.col("chance") < 1)
        done.append(units.filter(~inside).select("number", "chance"))
        units = units.filter(inside)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def decide(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Copies of every distinct row of ``rows`` (columns ``source``, ``size`` and any others).

    Adds ``rows`` (how often it occurs), ``source_size``, ``target``, ``base`` (whole copies of each
    occurrence) and ``extra`` (occurrences that get one copy more).
    """
    columns = rows.columns
    units = written(rows.groupBy(*columns).agg(F.count("*").alias("rows")))
    goals = written(targets(units))
    units = units.join(goals, units["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.withColumn("base", F.floor(rate + F.lit(_EDGE)).cast("long"))
    expected = F.greatest(rate - F.col("base"), F.lit(0.0)) * F.col("rows")
    units = units.withColumn("sure", F.floor(expected + F.lit(_EDGE)).cast("long"))
    chance = F.greatest(expected - F.col("sure"), F.lit(0.0))
    units = units.withColumn("chance", F.when(chance < 1e-6, 0.0).otherwise(chance))
    units, _, total = numbered(units, [name(c) for c in columns], "number")
    units = written(units.drop(total))
    open_ = units.filter("chance > 0").select(F.col("source_id").cast("int"), "number", "size", "chance")
    choice = sampled(open_, chunk).withColumnRenamed("chance", "taken one")
    units = units.join(choice, "number", "left")
    extra = F.col("sure") + F.coalesce(name("taken one"), F.lit(0.0)).cast("long")
    return units.select(*columns, "rows", "source_size", "target", "base", extra.alias("extra"))


def hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType != T.VariantType()]


def mix(docs: DataFrame, text: str = "text", source: str = "source", chunk: int = CHUNK) -> DataFrame:
    """The mix: the rows of ``docs``, each as often as it is taken, with the same columns."""
    key = fresh(docs, "hash of the row")
    keyed = docs.withColumn(key, F.xxhash64(*[name(c) for c in hashable(docs)]))
    slim = keyed.select(name(key).alias("key"), name(source).cast("string").alias("source"), word_count(text).alias("size"))
    plan = decide(slim, chunk).select("key", "rows", "base", "extra", "size")
    plan = plan.groupBy("key").agg(
        F.sum("rows").alias("rows"), (F.sum(F.col("base") * F.col("rows") + F.col("extra"))).alias("copies")
    )
    n, copies, at = fresh(keyed, "occurrences"), fresh(keyed, "copies"), fresh(keyed, "copy")
    plan = plan.filter("copies > 0").select(F.col("key").alias(key), F.col("rows").alias(n), F.col("copies").alias(copies))
    rows = keyed.join(plan, key)
    once, often = rows.filter(name(n) == 1), rows.filter(name(n) > 1)
    # equal rows meet as one, which then stands for all their copies
    often = often.groupBy(key).agg(*[F.first(name(c)).alias(c) for c in [*docs.columns, copies]])
    both = once.select(*[name(c) for c in [*docs.columns, copies]]).unionByName(often.select(*[name(c) for c in [*docs.columns, copies]]))
    return both.withColumn(at, F.explode(F.sequence(F.lit(1), name(copies)))).select(*[name(c) for c in docs.columns])


def taken(plan: DataFrame) -> DataFrame:
    """One row per row again: the first ``extra`` occurrences of a unit have one copy more."""
    rows = plan.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    copies: Column = F.col("base") + F.when(F.col("at") < F.col("extra"), 1).otherwise(0)
    return rows.withColumn("taken", (F.col("size") * copies).cast("long")).drop("at")


def op5_mixing(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count("text").alias("size"))
    return taken(decide(rows)).select("doc_id", "size", "source_size", "target", "taken", "source")
