"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A short test item inside a long document has a tiny Jaccard similarity, so one signature length
cannot serve all documents. Here documents are partitioned by size: a document of n shingles has a
one-permutation MinHash signature of 2n to 4n bins (a power of two), the smallest shingle hash of
each bin, and an item has a signature for each number of bins. A shingle that both hold is the
smallest of its bin in the document with a chance of at least 0.78, so an item that shares m
shingles is missed with a chance below 0.22**m; items of fewer than ``FEW`` shingles are looked up
with every shingle as its own bin, which misses none. One equal bin makes a candidate. Every
candidate is verified by exact containment of the item's distinct word shingles.

Only bins that may hold an item's hash can be equal, so a document's bins are filled only if one of
its hashes is an item's. Items come in blocks of bounded size, each sent to all tasks; documents
are read once for every block and never shuffled.

Words are runs of characters other than space and U+0009 to U+000D, A-Z lower-cased. Defined
results: items of fewer words than a shingle has are one shingle of all their words; items and
documents that are null, empty or without words are in no pair; repeated rows give a pair each;
texts of any length are searched whole; a null id stays null in its pairs.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsengine.llm.common import arrow_type, name, small_batches, table
from tsengine.llm.hashing import Words, _STEPS, mix, shingles, text_bytes

WIDTH, THRESHOLD = 5, 0.8
#: Items of fewer distinct shingles are searched without loss.
FEW = 12
#: Characters of items in one block that is sent to all tasks.
BLOCK_CHARS = 4 << 20
_FILTER_BITS = 22


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: A-Z, and the six white space characters only


def shingle_set(words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    width = min(width, len(words))
    return set(zip(*(words[i:] for i in range(width)))) if width else set()


class Index:
    """Signatures of a block of items: for every width and number of bins, hash -> items."""

    def __init__(self, texts: list[str], width: int):
        self.width = width
        words = [words_of(t.encode()) for t in texts]
        self.sets = [shingle_set(w, width) for w in words]
        self.lengths = [len(s) for s in self.sets]
        self.by_width: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w:
                self.by_width[min(width, len(w))].append(i)
        hashes, bounds = Words(lower=True)(pa.array(texts, pa.large_string()))
        self.hashes = [np.unique(shingles(hashes[bounds[i] : bounds[i + 1]], width)) for i in range(len(texts))]
        self.filters, self.all = {}, {}
        for w, items in self.by_width.items():
            every = np.unique(np.concatenate([self.hashes[i] for i in items]))
            self.all[w] = every
            self.filters[w] = np.zeros(1 << _FILTER_BITS, bool)
            self.filters[w][(every >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.signatures: dict[tuple[int, int], dict[int, list[int]]] = {}

    def signature(self, width: int, bits: int) -> dict[int, list[int]]:
        """Smallest hash of every bin -> the items that have it, for 2**bits bins."""
        if (width, bits) not in self.signatures:
            out: dict[int, list[int]] = defaultdict(list)
            for i in self.by_width[width]:
                own = self.hashes[i]  # sorted, so the first of each bin is its smallest
                if len(own) >= FEW:
                    own = own[np.append(True, np.diff(own >> np.uint64(64 - bits)) > 0)]
                for h in own.tolist():
                    out[h].append(i)
            self.signatures[width, bits] = dict(out)
        return self.signatures[width, bits]

    def __getstate__(self):
        return self.__dict__ | {"signatures": {}}


def item_hits(index: Index, width: int, hashes: np.ndarray) -> np.ndarray:
    maybe = np.flatnonzero(index.filters[width][(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    every = index.all[width]
    at = np.minimum(np.searchsorted(every, hashes[maybe]), len(every) - 1)
    return maybe[every[at] == hashes[maybe]]


def flat_shingles(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside one text, and where each text's runs start."""
    n = len(words)
    sizes = np.maximum(np.diff(bounds) - width + 1, 0)
    if n < width:
        return words[:0], np.zeros(len(bounds), np.int64)
    out = np.full(n - width + 1, np.uint64(width))
    for i in range(width):
        out += words[i : n - width + 1 + i] * _STEPS[i]
    inside = np.zeros(len(out) + 1, np.int64)
    full = np.flatnonzero(sizes)
    np.add.at(inside, bounds[:-1][full], 1)
    np.add.at(inside, bounds[:-1][full] + sizes[full], -1)
    return mix(out[np.cumsum(inside[:-1]) > 0]), np.concatenate([[0], np.cumsum(sizes)])


def candidates(index: Index, words: np.ndarray, bounds: np.ndarray) -> dict[int, set[int]]:
    """Text -> items with at least one equal signature bin."""
    out: dict[int, set[int]] = defaultdict(set)
    for width in index.by_width:
        hashes, starts = flat_shingles(words, bounds, width)
        if not len(hashes):
            continue
        hit = item_hits(index, width, hashes)
        owner = np.searchsorted(starts, hit, "right") - 1
        for text in np.unique(owner).tolist():
            own = hashes[starts[text] : starts[text + 1]]
            bits = int(len(own)).bit_length() + 1  # 2n to 4n bins
            shift = np.uint64(64 - bits)
            bins = np.full(1 << bits, np.uint64(2**64 - 1))
            np.minimum.at(bins, (own >> shift).astype(np.int64), own)
            signature = index.signature(width, bits)
            for h in np.unique(hashes[hit[owner == text]]).tolist():
                for i in signature.get(h, ()):
                    if len(index.hashes[i]) < FEW or bins[h >> (64 - bits)] == h:
                        out[text].add(i)
    return out


def contained(index: Index, hash_words: Words, texts: pa.Array, threshold: float) -> list[list[tuple[int, int]]]:
    """For every text the verified items: (item, shared distinct shingles)."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
    words, bounds = hash_words(texts)
    found = candidates(index, words, bounds)
    if not found:
        return out
    data, offsets = text_bytes(texts)
    for text, items in found.items():
        own = words_of(data[offsets[text] : offsets[text + 1]].tobytes())
        widths = {i: len(next(iter(index.sets[i]))) for i in items}
        sets = {w: set(zip(*(own[k:] for k in range(w)))) for w in set(widths.values())}
        for i in sorted(items):
            shared = len(index.sets[i] & sets[widths[i]])
            if shared >= threshold * index.lengths[i] - 1e-9:
                out[text].append((i, shared))
    return out


def blocks(items: DataFrame, text: str, item_id: str, width: int, chars: int) -> list[tuple[list, Index]]:
    """The items in blocks of about ``chars`` characters, by a hash: ids and index of each."""
    rows = items.select(name(item_id).alias("id"), name(text).alias("text")).filter(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    count = max(math.ceil(total / chars), 1)
    for b in range(count if total else 0):
        part = rows.filter(F.pmod(F.xxhash64("text"), F.lit(count)) == b).collect()
        part.sort(key=lambda r: (r["id"] is None, r["id"], r["text"]))
        yield [r["id"] for r in part], Index([r["text"] for r in part], width)


def find(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    width: int = WIDTH,
    threshold: float = THRESHOLD,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Pairs: ``doc_id``, ``item_id``, ``shared``, ``item_shingles`` and ``containment``."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(name(doc_id).alias("doc_id"), name(text).alias("text"))
    fields = [
        source.schema["doc_id"],
        T.StructField("item_id", items.schema[item_id].dataType),
        T.StructField("shared", T.LongType()),
        T.StructField("item_shingles", T.LongType()),
    ]
    kinds = [arrow_type(f.dataType) for f in fields[1:]]
    names = [f.name for f in fields]
    out = spark.createDataFrame([], T.StructType(fields))
    for ids, index in blocks(items, text, item_id, width, block_chars):
        shared = spark.sparkContext.broadcast((ids, index))  # at most about ``block_chars`` of items

        def run(batches, shared=shared):
            keys, mine = shared.value
            hash_words = Words(lower=True)
            for batch in batches:
                found = contained(mine, hash_words, batch.column(1), threshold)
                at = [k for k, pairs in enumerate(found) for _ in pairs]
                flat = [p for pairs in found for p in pairs]
                values = [[keys[i] for i, _ in flat], [n for _, n in flat], [mine.lengths[i] for i, _ in flat]]
                arrays = [batch.column(0).take(pa.array(at, pa.int64()))]
                arrays += [pa.array(v, type=k) for v, k in zip(values, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

        out = out.unionByName(source.mapInArrow(run, T.StructType(fields)))
    return out.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", width: int = WIDTH,
          threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that contain no item: all columns, rows as they are."""
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index(text)
    for _, index in blocks(items, text, item_id, width, block_chars):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            hash_words = Words(lower=True)
            for batch in batches:
                found = contained(shared.value, hash_words, batch.column(at), threshold)
                yield batch.filter(pa.array([not pairs for pairs in found], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4_decontamination(spark, folder: str) -> DataFrame:
    return find(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


#: Exact containment of every item in every document.
OP4_SQL = r"""
WITH docs AS (
    SELECT doc_id, row_number() OVER () AS r,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
items AS (
    SELECT item_id, row_number() OVER () AS i,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM benchmark),
item_words AS (SELECT item_id, i, w, least(5, len(w)) AS n FROM items WHERE len(w) > 0),
item_shingles AS (
    SELECT DISTINCT item_id, i, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS s
    FROM item_words),
sizes AS (SELECT i, count(*) AS item_shingles FROM item_shingles GROUP BY i),
doc_shingles AS (
    SELECT DISTINCT r, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS s
    FROM docs, (SELECT DISTINCT n FROM item_words) WHERE len(w) >= n),
shared AS (
    SELECT r, i, item_id, count(*) AS shared FROM doc_shingles JOIN item_shingles USING (n, s) GROUP BY r, i, item_id)
SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment
FROM shared JOIN sizes USING (i) JOIN docs USING (r) WHERE 5 * shared >= 4 * item_shingles
"""
