"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors are dealt into blocks of bounded size, queries likewise, and every block of queries meets
every block of vectors in one task. There each dimension has the list of the block's vectors in the
order of that component. A query reads its lists from the end that its own component prefers, in
steps of growing depth; vectors met for the first time are scored in full; the components at the
depth reached bound the score of every vector not met yet. It stops when that bound is below the
k-th best score: an equal bound could still hide a tie with a smaller id. The best of all blocks
are ranked per query.

Defined results: null vectors and those with a null or non-finite component take no part; a query
meets the vectors of its own length only; a row is never its own candidate, but another row with
the same id or vector is; ties go to the smaller id, null last; rows without an id are candidates
and no queries; an empty table gives an empty result. Scores must fit in a long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsengine.llm.common import name, table, written

K = 5
#: Vectors and queries of a block: the bound of a task's group.
VECTORS, QUERIES = 16_384, 2048
FIRST_DEPTH, GROWTH = 8, 4
#: Stands for a null id inside the search, so that null sorts last.
NO_ID = 2**63 - 1


def components(vectors: DataFrame, vec_id: str, vector: str, scale: float = 256.0) -> DataFrame:
    """``rid`` (one per row), ``vec_id``, ``dim`` and ``x``, the floors of the scaled components."""
    values = name(vector)
    valid = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.filter(values.isNotNull()).filter(valid)
    whole = F.transform(values, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return rows.select(F.monotonically_increasing_id().alias("rid"), name(vec_id).cast("long").alias("vec_id"), F.size(values).alias("dim"), whole.alias("x"))


class Lists:
    """The vectors of a block and, for each dimension, their order by that component."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, most: int):
        self.ids = ids
        exact = float(np.abs(x).max(initial=0)) * most * max(x.shape[1], 1)
        # products and sums stay below the mantissa, so floating point is exact; else integers
        kind = np.float32 if exact < 2**24 else np.float64 if exact < 2**53 else np.int64
        self.x = x.astype(kind)
        self.up = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T)
        self.values = np.take_along_axis(x.T, self.up, 1)

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best for one query; ``own`` is the place of its own row or -1."""
        n = len(self.ids)
        used = np.flatnonzero(query)
        high = query[used] > 0
        q = query.astype(self.x.dtype)
        met = np.zeros(n, bool)
        if own >= 0:
            met[own] = True
        top, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth = 0
        while depth < n:
            until = min(depth + max(FIRST_DEPTH, depth * (GROWTH - 1)), n)
            now = np.zeros(n, bool)
            if len(used):
                now[self.up[used[high], n - until : n - depth].ravel()] = True
                now[self.up[used[~high], depth:until].ravel()] = True
            else:  # a zero query scores zero everywhere: the ids decide, so all are met
                now[:] = True
            now &= ~met
            new = np.flatnonzero(now)
            met |= now
            depth = until
            if len(new):
                got = (self.x[new] @ q).astype(np.int64)
                if len(top) == k:  # what is below the k-th cannot enter
                    new, got = new[got >= scores[-1]], got[got >= scores[-1]]
                top, scores = np.append(top, new), np.append(scores, got)
                order = np.lexsort((self.ids[top], -scores))[:k]
                top, scores = top[order], scores[order]
            if not len(used) or met.all():
                break
            edge = np.where(high, self.values[used, n - depth], self.values[used, depth - 1])
            if len(top) == k and int(edge @ query[used]) < scores[-1]:
                break
        return top, scores


def _search(k: int):
    nothing = pd.DataFrame({"query": [], "vec_id": [], "rid": [], "score": []}).astype("int64")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return nothing
        right = right.sort_values("rid", ignore_index=True)
        dim = len(right["x"].iloc[0])
        x = np.array(right["x"].tolist(), np.int64).reshape(len(right), dim)
        queries = np.array(left["x"].tolist(), np.int64).reshape(len(left), dim)
        ids = right["vec_id"].to_numpy(np.int64)
        lists = Lists(ids, x, int(np.abs(queries).max(initial=0)))
        place = {r: i for i, r in enumerate(right["rid"].tolist())}
        out = []
        for rid, query in zip(left["rid"].tolist(), queries):
            top, scores = lists.best(query, place.get(rid, -1), k)
            out.append(pd.DataFrame({"query": rid, "vec_id": ids[top], "rid": right["rid"].to_numpy()[top], "score": scores}))
        return pd.concat(out, ignore_index=True).astype("int64")

    return run


def top_k(rows: DataFrame, k: int = K, every: int = 50, vectors: int = VECTORS, queries: int = QUERIES) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: queries are the rows whose id is divisible by ``every``.

    ``rows`` come from ``components`` and must be written, so that ``rid`` is the same in all uses.
    """
    asked = rows.filter(F.col("vec_id") % every == 0)
    n, m = rows.count(), asked.count()
    right, below = max(-(-n // vectors), 1), max(-(-m // queries), 1)
    deal = lambda count, salt: F.pmod(F.xxhash64("rid", F.lit(salt)), F.lit(count)).cast("int")
    spread = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = asked.select("rid", "x", "dim", deal(below, 1).alias("q"), spread(right).alias("v"))
    others = rows.select("rid", F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"), "x", "dim", spread(below).alias("q"), deal(right, 2).alias("v"))
    keys = ("dim", "q", "v")
    found = left.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInPandas(_search(k), "query long, vec_id long, rid long, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "rid")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    ids = asked.select(F.col("rid").alias("query"), F.col("vec_id").alias("query_id"))
    vec_id = F.when(F.col("vec_id") != NO_ID, F.col("vec_id"))
    return ranked.join(ids, "query").select("query_id", "rank", vec_id.alias("vec_id"), "score")


def op7_topk(spark, folder: str) -> DataFrame:
    return top_k(written(components(table(spark, folder, "embeddings"), "vec_id", "embedding")))


OP7_SQL = """
WITH v AS (
    SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
    FROM embeddings
    WHERE embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END), 'sum') = 0),
pairs AS (
    SELECT q.r AS q, q.vec_id AS query_id, c.vec_id, c.r,
           list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.r <> c.r AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST, r)::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5
"""
