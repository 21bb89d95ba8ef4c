"""Cross-tokenizer alignment of a byte-level BPE (A) and a sentencepiece model (B).

Both encode a space and the text. A text is first cut before every space that follows a character
other than white space: A's pattern parts the text there and no piece of B goes on over it (checked
when the vocabulary is loaded), so neither tokenizer has a token across the cut and what stands on
one side does not change the tokens of the other. Every distinct segment is encoded once in a worker
and kept in a bounded table; tokens of a batch are gathered from it.

Alignment is two backward ``merge_asof`` joins over a batch, keyed by document: each token start finds
the other side's token that covers it. The union of both directions are the overlaps; overlaps whose
ends are equal are the links, and cut both sides into groups. Documents of over ``SEGMENTS`` segments
are aligned in slices, each ending at a cut, which is the end of a group.

Counts of linked id pairs are a Spark aggregate over all documents. They come back as a table sent to
every task while it has at most ``SENT_PAIRS`` rows, else by a join; the result is the same.

Defined results: null and empty texts, and texts whose A or B bytes differ from the space and the text
(such as those with U+2581), have no tokens: zeros and an empty digest. The strings of special tokens
are plain text. Texts of any length are used whole; repeated rows each count; ties for a B id's
highest count all count; an empty table gives an empty result. Input columns named like an output give
way to it.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsengine.llm.common import fresh, map_texts, name, small_batches, table, written

#: Segments aligned together, tokens kept in a worker's table, and segments kept there.
SEGMENTS = 1 << 16
KEPT_TOKENS, KEPT_SEGMENTS = 1 << 22, 1 << 19
#: Rows of the pair table up to which it goes to every task (17 bytes a row).
SENT_PAIRS = 1 << 22
_UNSTABLE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


def segments(text: str) -> list[str]:
    """Parts of the space and the text, each without the space it begins with."""
    if not _UNSTABLE.search(text) and text[0] != " ":
        return text.split(" ")
    return [s[1:] for s in _CUT.split(" " + text)]


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies print every byte as one character; unprintable ones move to U+0100 and on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(printed)]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(moved)}


class Pair:
    """Both tokenizers, the bytes of their entries, and the table of segments."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path_a}: not a plain byte-level vocabulary")
        byte = byte_of_character()
        self.size_a = self.a.get_vocab_size()
        self.bytes_a = [b""] * self.size_a
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.size_b = self.b.vocab_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError(f"{path_b}: a piece goes on over a space")
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces
        ]
        self.space_b = self.b.piece_to_id("▁")
        rows = [f"{i}{end}" for size, ends in ((self.size_a, ",|"), (self.size_b, ",;")) for end in ends for i in range(size)]
        self.shown = pa.array(rows)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.fine = np.zeros(0, bool)
        # ids, byte lengths and offsets by segment, of A and B
        self.tokens = [[np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1, np.int64)] for _ in "ab"]

    def learn(self, new: list[str]) -> None:
        """Encode segments and add them to the table."""
        own = [
            [e.ids for e in self.a.encode_batch_fast([" " + s for s in new], add_special_tokens=False)],
            [ids if s else [self.space_b] for s, ids in zip(new, self.b.encode(new, num_threads=1))],
        ]
        fine = np.ones(len(new), bool)
        for lists, entries, kept in zip(own, (self.bytes_a, self.bytes_b), self.tokens):
            fine &= [b"".join([entries[i] for i in ids]) == b" " + s.encode() for s, ids in zip(new, lists)]
            flat = np.fromiter((i for ids in lists for i in ids), np.int32)
            sizes = np.fromiter((len(entries[i]) for i in flat.tolist()), np.int32, len(flat))
            ends = np.cumsum([len(ids) for ids in lists]) + kept[2][-1]
            kept[:] = [np.concatenate(x) for x in ((kept[0], flat), (kept[1], sizes), (kept[2], ends))]
        self.place.update(zip(new, range(len(self.fine), len(self.fine) + len(new))))
        self.fine = np.append(self.fine, fine)

    def places(self, parts: list[list[str]]) -> list[np.ndarray]:
        """Table rows of the segments of each document."""
        if len(self.place) > KEPT_SEGMENTS or max(len(t[0]) for t in self.tokens) > KEPT_TOKENS:
            self.clear()
        if new := list(dict.fromkeys(s for p in parts for s in p if s not in self.place)):
            self.learn(new)
        return [np.fromiter(map(self.place.__getitem__, p), np.int64, len(p)) for p in parts]


@functools.cache
def pair(path_a: str, path_b: str) -> Pair:
    """One per Python worker."""
    return Pair(path_a, path_b)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] numbers, then from starts[1], ..."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes)


def overlaps(starts_a: np.ndarray, docs_a: np.ndarray, starts_b: np.ndarray, docs_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of token numbers (A, B) that share bytes, in order. Starts rise over the whole batch."""
    a = pd.DataFrame({"document": docs_a, "start": starts_a, "a": np.arange(len(starts_a))})
    b = pd.DataFrame({"document": docs_b, "start": starts_b, "b": np.arange(len(starts_b))})
    forth = pd.merge_asof(a, b, on="start", by="document")
    back = pd.merge_asof(b, a, on="start", by="document")
    n = max(len(b), 1)
    key = np.concatenate([x["a"].to_numpy(np.int64) * n + x["b"].to_numpy(np.int64) for x in (forth, back)])
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return key // n, key % n


class Tally:
    """What is known of one document: slices are added in order."""

    def __init__(self):
        self.n_a = self.n_b = self.n_groups = self.n_links = self.n_overlaps = 0
        self.digest, self.groups, self.pairs, self.times = hashlib.sha256(), [], [], []

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pairs) == 1:
            return self.pairs[0], self.times[0]
        pairs, place = np.unique(np.concatenate(self.pairs), return_inverse=True)
        return pairs, np.bincount(place, np.concatenate(self.times), len(pairs)).astype(np.int32)


def align_slices(both: Pair, slices: list[tuple[Tally, np.ndarray, bool]], shown: bool) -> None:
    """Align the slices (tally, table rows, last of its document) and add them to their tallies."""
    rows = np.concatenate([r for _, r, _ in slices])
    owner = np.repeat(np.arange(len(slices)), [len(r) for _, r, _ in slices])
    ids, starts, ends, owners = [], [], [], []
    for tokens, sizes, offsets in both.tokens:
        low = offsets[rows]
        n = offsets[rows + 1] - low
        at = ragged(low, n)
        end = np.cumsum(sizes[at], dtype=np.int64)
        ids.append(tokens[at].astype(np.int64))
        starts.append(end - sizes[at])
        ends.append(end)
        owners.append(np.repeat(owner, n))
    a, b = overlaps(starts[0], owners[0], starts[1], owners[1])
    met = ends[0][a] == ends[1][b]
    link_a, link_b = a[met], b[met]
    docs, n = owners[0][link_a], len(slices)
    count_a, count_b, count = (np.bincount(x, minlength=n) for x in (*owners, docs))
    met_all = np.bincount(owners[0][a], minlength=n)

    last_a, last_b = np.zeros(len(ids[0]), np.int64), np.zeros(len(ids[1]), np.int64)
    last_a[link_a], last_b[link_b] = 1, 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    before_b = np.append(0, link_b + 1)  # B tokens of the groups before
    code = np.empty(len(ids[0]) + len(ids[1]), np.int64)
    code[np.arange(len(ids[0])) + before_b[group_a]] = ids[0] + both.size_a * last_a
    code[np.arange(len(ids[1])) + link_a[group_b] + 1] = ids[1] + 2 * both.size_a + both.size_b * last_b
    text = both.shown.take(pa.array(code))
    place = np.frombuffer(text.buffers()[1], np.int32)
    raw = memoryview(text.buffers()[2]) if len(text) else memoryview(b"")
    cuts = place[np.append(0, np.cumsum(count_a + count_b))]

    key = np.sort(docs * (both.size_a * both.size_b) + ids[0][link_a] * both.size_b + ids[1][link_b])
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(key))).astype(np.int32)
    key = key[first]
    of_doc = np.searchsorted(key, np.arange(n + 1) * (both.size_a * both.size_b))
    key = key % (both.size_a * both.size_b)
    for i, (tally, _, final) in enumerate(slices):
        tally.n_a += int(count_a[i])
        tally.n_b += int(count_b[i])
        tally.n_links += int(count[i])
        tally.n_groups += int(count[i])  # of the two tokens of a link none is empty, so a place has one link
        tally.n_overlaps += int(met_all[i])
        part = raw[cuts[i] : cuts[i + 1] - final]  # no mark behind the last group
        tally.digest.update(part)
        if shown:
            tally.groups.append(bytes(part).decode())
        tally.pairs.append(key[of_doc[i] : of_doc[i + 1]])
        tally.times.append(times[of_doc[i] : of_doc[i + 1]])


def align(both: Pair, texts: list[str], shown: bool = False, most: int = SEGMENTS) -> list[Tally | None]:
    """A tally for each text; None where there are no tokens."""
    out: list[Tally | None] = []
    for rows in both.places([segments(t) if t else [] for t in texts]):
        out.append(Tally() if len(rows) and both.fine[rows].all() else None)
        if out[-1]:
            out[-1].rows = rows
    waiting, held = [], 0
    for tally in filter(None, out):
        for lo in range(0, len(tally.rows), most):
            part = tally.rows[lo : lo + most]
            if held and held + len(part) > most:
                align_slices(both, waiting, shown)
                waiting, held = [], 0
            waiting.append((tally, part, lo + most >= len(tally.rows)))
            held += len(part)
    if waiting:
        align_slices(both, waiting, shown)
    return out


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")


def aligned(
    docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: list[str] | None = None, groups: bool = False, batch: int = 128
) -> DataFrame:
    """``keep`` (default: all columns), counts, ``groups_sha256``, ``groups`` if asked for, and the linked
    id pairs (``a * size of B + b``) with how often the document has them."""
    fields = [T.StructField(c, T.LongType()) for c in NUMBERS] + [T.StructField("groups_sha256", T.StringType())]
    fields += [T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))]
    fields += [T.StructField("groups", T.StringType())] * groups

    def build():
        both = pair(path_a, path_b)

        def lists(parts: list[np.ndarray], kind) -> pa.Array:
            flat = np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
            return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32)), pa.array(flat))

        def work(texts: pa.Array) -> list:
            rows = []
            for lo in range(0, len(texts), batch):
                rows += align(both, texts.slice(lo, batch).to_pylist(), groups)
            none = np.zeros(0, np.int64)
            linked = [t.joined() if t else (none, none) for t in rows]
            out = [pa.array([getattr(t, c) if t else 0 for t in rows], pa.int64()) for c in NUMBERS]
            out.append(pa.array([t.digest.hexdigest() if t else "" for t in rows], pa.string()))
            out += [lists([p for p, _ in linked], np.int64), lists([n for _, n in linked], np.int32)]
            return out + ([pa.array(["".join(t.groups) if t else "" for t in rows], pa.string())] if groups else [])

        return work

    return map_texts(docs, text, fields, build, keep)


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """``pair``, its ``count`` over all documents, and ``best``: the count is the highest of its B id."""
    each = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.times").alias("n"))
    counts = written(each.groupBy("pair").agg(F.sum("n").alias("count")))
    b = F.pmod("pair", F.lit(size_b))
    highest = counts.groupBy(b.alias("b")).agg(F.max("count").alias("highest"))
    joined = counts.withColumn("b", b).join(highest, "b")
    return written(joined.select("pair", "count", (F.col("count") == F.col("highest")).alias("best")))


def scored(rows: DataFrame, counts: DataFrame, sent: int = SENT_PAIRS) -> DataFrame:
    """``n_best`` and ``count_sum`` in place of ``pairs`` and ``times``."""
    keep = [c for c in rows.columns if c not in ("pairs", "times")]
    if counts.count() > sent:
        return _scored_by_join(rows, counts, keep)
    spark = rows.sparkSession
    small_batches(spark)
    known = counts.toArrow()  # at most ``sent`` rows
    pairs = known["pair"].to_numpy()
    order = np.argsort(pairs)
    shared = spark.sparkContext.broadcast((pairs[order], known["count"].to_numpy()[order], known["best"].to_numpy()[order]))
    source = rows.select(*[name(c) for c in keep], "pairs", "times")
    schema = T.StructType([*source.schema.fields[:-2], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def run(batches):
        pairs, count, best = shared.value
        for batch in batches:
            lists, times = batch.column(len(keep)), batch.column(len(keep) + 1).flatten().to_numpy().astype(np.int64)
            place = np.searchsorted(pairs, lists.flatten().to_numpy())
            offsets = lists.offsets.to_numpy().astype(np.int64)
            offsets -= offsets[0]
            sums = [np.append(0, np.cumsum(times * x[place]))[offsets] for x in (best, count)]
            arrays = [batch.column(i) for i in range(len(keep))] + [pa.array(np.diff(s), pa.int64()) for s in sums]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema)


def _scored_by_join(rows: DataFrame, counts: DataFrame, keep: list[str]) -> DataFrame:
    """The same without a table in every task. Rows are numbered as the written table has them."""
    number = fresh(rows, "number of the row")
    rows = written(rows.withColumn(number, F.monotonically_increasing_id()))
    each = rows.select(number, F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    each = each.select(number, F.col("p.pairs").alias("pair"), F.col("p.times").alias("times")).join(counts, "pair")
    sums = each.groupBy(number).agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")
    )
    out = rows.select(number, *[name(c) for c in keep]).join(sums, number, "left")
    return out.select(*[name(c) for c in keep], *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")])


def op11_alignment(spark, folder: str) -> DataFrame:
    import public_tokenizers

    paths = [str(public_tokenizers.path(f)) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = written(aligned(docs, *paths, keep=["doc_id"]).drop("n_overlaps"))
    return scored(rows, pair_counts(rows, pair(*paths).size_b))
