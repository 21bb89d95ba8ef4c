"""Sharding: a reproducible shuffle whose place of every row can be computed.

All rows are numbered; a Feistel permutation with cycle walking maps the numbers 0..n-1 onto
themselves; the image modulo the shard count is the shard and the quotient is the slot. Shard
counts differ by one at most and slots have no gaps. Spark expressions only.

The permutation works on a rectangle of a x b numbers, a = ceil(sqrt(n)), b = ceil(n / a): each
round adds a keyed hash of one half to the other, modulo that half's side. Images of n and more
walk on through the permutation until they fall below n. Fewer than a numbers lie outside, so a
walk is short. ``WALK`` bounds it; a longer one, which needs a chance of about n**(-WALK/2), raises
instead of returning a wrong place.

Defined results: null and empty texts are rows like others (size 1); rows that are equal in
``doc_id`` and text are interchangeable; an empty table gives an empty result; the numbering is by
content, so file order, partitions and reruns do not change a place. Input columns named like an
output give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsengine.llm.common import fresh, name, table
from tsengine.llm.numbering import numbered

ROUNDS = 4
WALK = 48


def _round(half: Column, side: Column, i: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(half, F.lit(i), F.lit(seed)), side)


def permuted(number: Column, n: Column, seed: int) -> Column:
    """Image of 0 <= number < n under the seeded permutation of 0..n-1."""
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("long")
    b = F.floor((n + a - 1) / a).cast("long")

    def once(x: Column) -> Column:
        # halves travel in a struct, so that each round is evaluated once
        start = F.struct((x % a).alias("u"), F.floor(x / a).cast("long").alias("v"))

        def turn(s: Column, i: Column) -> Column:
            u = F.pmod(s["u"] + F.pmod(F.xxhash64(s["v"], i * 2, F.lit(seed)), a), a)
            v = F.pmod(s["v"] + F.pmod(F.xxhash64(u, i * 2 + 1, F.lit(seed)), b), b)
            return F.struct(u.alias("u"), v.alias("v"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["v"] * a + s["u"])

    walk = F.sequence(F.lit(1), F.lit(WALK))
    image = F.aggregate(walk, once(number), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(image < n, image).otherwise(F.raise_error(F.lit("cycle walk too long; choose another seed")))


def shards(df: DataFrame, count: int, order: list[Column], seed: int = 17) -> DataFrame:
    """All columns of ``df`` and ``shard`` (0..count-1) and ``slot`` (from 0 in each shard)."""
    keep = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    rows, number, total = numbered(df, order)
    place = fresh(rows, "place")
    rows = rows.withColumn(place, permuted(name(number), name(total), seed))
    shard, slot = (name(place) % count).cast("int"), F.floor(name(place) / count).cast("long")
    return rows.select(*[name(c) for c in keep], shard.alias("shard"), slot.alias("slot"))


def text_size(text: str) -> Column:
    """UTF-8 bytes plus 1; null has none."""
    return (F.coalesce(F.octet_length(name(text)), F.lit(0)) + 1).cast("long")


def text_crc(text: str) -> Column:
    return F.crc32(F.coalesce(name(text), F.lit("")).cast("binary"))


def op3_sharding(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    slim = docs.select("doc_id", text_size("text").alias("size"), text_crc("text").alias("text_crc32"))
    rows = shards(slim, 16, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
