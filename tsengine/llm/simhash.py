"""SimHash near-duplicates: BK-trees over shards of the fingerprints.

A fingerprint bit is set where more than half of the document's shingle hashes (XXH64, seed 42) have
it. Equal fingerprints are one class, so copies cost one row each. Classes within ``radius`` bits are
linked; documents take the smallest id of their component.

Shards: the free bits are cut into ``radius + 1`` runs. Two fingerprints that differ in at most
``radius`` bits agree in one whole run, so the class goes to one shard for each run, keyed by the
leading bits of that run, and every link lies inside a shard. A shard of over ``SHARD`` classes is cut
again by the bits that are still free, until it fits; with 12 free bits it always does.

A shard's classes form a BK-tree: the child of a node at key d holds the classes at Hamming distance d
from the node. A search at distance d from a node follows the edges d - radius to d + radius only.
Each class searches the trees of its own shards. A tree goes to those searches and is not broadcast to
every task, since all trees together grow with the corpus. A shard returns a spanning forest of its
links, never all its pairs.

Defined results: words are runs of characters other than space and U+0009 to U+000D, A-Z lower-cased;
with fewer words than a shingle has the whole sequence is one; null, empty and wordless texts have
fingerprint zero and are linked like any other; repeated rows are linked; a component whose ids are
all null has a null id; texts of any length are used whole; an empty table gives an empty result;
further columns of the input take no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsengine.llm.common import map_texts, name, small_batches, table, written
from tsengine.llm.components import components
from tsengine.llm.hashing import text_bytes

WIDTH, RADIUS, SEED = 3, 2, 42
#: Classes of one BK-tree at most: 2 ** SHARD_BITS.
SHARD_BITS = 12
SHARD = 1 << SHARD_BITS
#: Shingle hashes held at a time, and searches that walk a tree together.
HASHES, SEARCHES = 1 << 17, 2048
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(words: list[bytes], width: int = WIDTH):
    """XXH64 of the space-joined shingles, in arrays of at most ``HASHES``."""
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    for lo in range(0, len(words) - width + 1, HASHES):
        some = words[lo : lo + HASHES + width - 1]
        joined = b" ".join(some)
        sizes = np.fromiter(map(len, some), np.int64, len(some))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(some) - width + 1].tolist()
        ends = ends[width - 1 :].tolist()
        yield np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(starts))


def fingerprints(texts: pa.Array, width: int = WIDTH) -> np.ndarray:
    """The fingerprint of every text."""
    data, offsets = text_bytes(texts)
    raw, n = data.tobytes(), len(texts)
    ones, total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    rows: list[int] = []
    parts: list[np.ndarray] = []
    held = 0

    def fold() -> None:
        low = rows[0]
        owner = (np.repeat(np.array(rows) - low, [len(p) for p in parts])) * 256
        span = (rows[-1] - low + 1) * 256
        octets = np.concatenate(parts).astype("<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            seen = np.bincount(owner + octets[:, k], minlength=span).reshape(-1, 256)
            ones[low : rows[-1] + 1, 8 * k : 8 * k + 8] += seen @ _BITS_OF_BYTE

    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        words = raw[a:b].lower().split()  # both know ASCII only
        if not words:
            continue
        for part in shingle_hashes(words, width):
            rows.append(i)
            parts.append(part)
            total[i] += len(part)
            held += len(part)
            if held >= HASHES:
                fold()
                rows, parts, held = [], [], 0
    if rows:
        fold()
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").ravel()


class Forest:
    """BK-trees of several shards. ``starts`` has each shard's first place in ``points``, its root."""

    def __init__(self, points: np.ndarray, starts: np.ndarray):
        self.points = points
        self.root = np.repeat(starts, np.diff(np.append(starts, len(points))))
        keys, children = [], []
        waiting = np.flatnonzero(self.root != np.arange(len(points)))
        node = self.root[waiting]
        while len(waiting):
            key = node * 65 + np.bitwise_count(points[waiting] ^ points[node])
            order = np.argsort(key, kind="stable")
            key, waiting = key[order], waiting[order]
            first = np.append(True, key[1:] != key[:-1])
            child = waiting[first]  # the first at its distance becomes the node, the others go below it
            keys.append(key[first])
            children.append(child)
            node = np.repeat(child, np.diff(np.append(np.flatnonzero(first), len(key))))[~first]
            waiting = waiting[~first]
        keys, children = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, children))
        order = np.argsort(keys)
        self.keys, self.children = keys[order], children[order]

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of points (smaller, larger) within ``radius`` of each other, one being of ``queries``."""
        query, node = queries, self.root[queries]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(query):
            d = np.bitwise_count(self.points[query] ^ self.points[node]).astype(np.int64)
            hit = (d <= radius) & (node < query)
            found.append((node[hit], query[hit]))
            low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right")
            size = high - low
            at = np.arange(size.sum()) + np.repeat(low - np.append(0, np.cumsum(size)[:-1]), size)
            query, node = np.repeat(query, size), self.children[at]
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def spanning(n: int, x: np.ndarray, y: np.ndarray, label: np.ndarray) -> np.ndarray:
    """``label`` lowered to the smallest place of each component of the pairs (x, y)."""
    while True:
        before = label
        label = label.copy()
        np.minimum.at(label, before[x], before[y])
        np.minimum.at(label, before[y], before[x])
        np.minimum.at(label, x, label[y])
        np.minimum.at(label, y, label[x])
        label = label[label]
        if (label == before).all():
            return label


def shard_links(points: np.ndarray, starts: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each shard, as pairs of fingerprints."""
    forest = Forest(points, starts)
    label = np.arange(len(points))
    for lo in range(0, len(points), SEARCHES):
        x, y = forest.within(np.arange(lo, min(lo + SEARCHES, len(points))), radius)
        if len(x):
            label = spanning(len(points), x, y, label)
    linked = np.flatnonzero(label != np.arange(len(points)))
    return points[linked], points[label[linked]]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def narrower(mask: int, radius: int, lead: int = 64) -> list[int]:
    """``mask`` with the first ``lead`` bits of one of ``radius + 1`` runs of its free bits added, for each run."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    cuts = [round(i * len(free) / (radius + 1)) for i in range(radius + 2)]
    return [mask | sum(1 << b for b in free[lo:hi][:lead]) for lo, hi in zip(cuts, cuts[1:])]


def _finer(mask: Column, masks: dict[int, list[int]]) -> Column:
    def number(m: int) -> Column:
        return F.lit(signed(m)).cast("long")

    return F.create_map(*[c for m, more in masks.items() for c in (number(m), F.array(*map(number, more)))])[mask]


def shards(classes: DataFrame, radius: int = RADIUS, most: int = SHARD) -> DataFrame:
    """``points``: the classes of every shard with at least two. ``classes`` has distinct ``print`` values."""
    n = classes.count()
    out = None
    if n <= most:
        return classes.agg(F.collect_list("print").alias("points")).filter(F.size("points") > 1)
    lead = min(max(int(np.ceil(np.log2(n / most))) + 1, 1), 21)
    waiting, masks = classes.select("print", F.lit(0).cast("long").alias("mask")), {0: narrower(0, radius, lead)}
    while True:
        rows = waiting.select("print", F.explode(_finer(F.col("mask"), masks)).alias("mask"))
        rows = written(rows.withColumn("value", F.col("print").bitwiseAND(F.col("mask"))))
        big = written(rows.groupBy("mask", "value").count().filter(F.col("count") > most).select("mask", "value"))
        crowded = big.limit(1).count() > 0
        fit = rows.join(big, ["mask", "value"], "left_anti") if crowded else rows
        fit = fit.groupBy("mask", "value").agg(F.collect_list("print").alias("points")).filter(F.size("points") > 1)
        out = fit.select("points") if out is None else out.unionByName(fit.select("points"))
        if not crowded:
            return out
        waiting = rows.join(big, ["mask", "value"], "left_semi").select("print", "mask")
        masks = {m: narrower(m, radius) for m in sorted({k for more in masks.values() for k in more})}


def links(classes: DataFrame, radius: int = RADIUS, most: int = SHARD) -> DataFrame:
    """``x, y``: links that join all classes within ``radius`` bits into their components."""
    small_batches(classes.sparkSession)

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            points = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            starts = lists.offsets.to_numpy()[:-1].astype(np.int64)
            x, y = shard_links(points, starts - (starts[0] if len(starts) else 0), radius)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["x", "y"])

    return shards(classes, radius, most).mapInArrow(run, "x long, y long")


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, radius: int = RADIUS, most: int = SHARD
) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id``."""
    fields = [T.StructField("print", T.LongType())]

    def build():
        return lambda texts: [pa.array(fingerprints(texts, width).view(np.int64))]

    rows = docs.select(name(doc_id).alias("doc_id"), name(text).alias("text"))
    rows = written(map_texts(rows, "text", fields, build, keep=["doc_id"]))
    classes = written(rows.groupBy("print").agg(F.min("doc_id").alias("least")))
    roots = components(written(links(classes, radius, most)))
    rooted = classes.join(roots.withColumnRenamed("node", "print"), "print", "left")
    rooted = rooted.select("print", "least", F.coalesce("root", "print").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("print", "root").join(least, "root").select("print", "component_id")
    shown = F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint")
    return rows.join(named, "print").select("doc_id", shown, "component_id")


def op13_simhash(spark, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
