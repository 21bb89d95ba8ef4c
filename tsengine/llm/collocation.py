"""Phrase collocations by vertically partitioned, depth-truncated suffix trees of words.

Every word position starts a suffix, truncated to the longest phrase. As in elastic-range suffix tree
construction the tree is never whole:

1. Word counts of all texts are the frequencies of the one-word prefixes.
2. Prefixes are grouped by a memory budget: a prefix of over ``HEAVY`` suffixes is replaced by its
   extensions by one word, and prefixes are dealt to so many groups that a group has about ``BUDGET``
   suffixes. Tasks fold equal suffixes before they send them.
3. A group sorts its suffixes and builds its subtree from their common prefixes; counts are the totals
   of the leaves below a node. Groups do not depend on each other.
4. The tree grows a level at a time: a node below ``least`` occurrences has no child that reaches it,
   nor has a phrase whose rest is rarer. A Bloom filter of fixed size over the level's nodes keeps
   most suffixes that end there from being sent; what passes it by chance is dropped by its own count.

Words are 64-bit hashes of language and word, with a seed for which no two of them share one (checked
over all words), and are resolved to strings by a join. Scores are exact decimals.

Defined results: A-Z are lower-cased; a null text is empty, a null language ``und``; text, rows and
languages of any size; repeated rows each count; ties as the ranking says; an empty table gives an
empty result; further columns of the input take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsengine.llm.common import name, small_batches, table, written
from tsengine.llm.hashing import Words, mix, text_bytes

LEAST, TOP, OVERLAP_PERCENT = 10, 2000, 50
SCALE = 1_000_000
#: Suffixes of a group, of a prefix that is not extended (before folding), and held by a task before it sends.
BUDGET, HEAVY, HELD = 1 << 21, 1 << 18, 1 << 21
#: At most so many prefixes are extended (16 bytes each in every task): beyond, ``HEAVY`` grows.
EXTENDED = 1 << 20
#: Bits of the Bloom filter, and bits set for each phrase.
FILTER_BITS, FILTER_HASHES = 26, 3
#: Seeds tried for ids without clashes; one fails with a chance of about (words)**2 / 2**65.
SEEDS = 20
GAPS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_PHRASE = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407], np.uint64)


class Corpus:
    """Word ids of a batch of (language, text), with the places where a piece ends."""

    def __init__(self, seed: int):
        self.hash, self.seed = Words(lower=True, drop=GAPS + BREAKS), np.uint64(seed)
        self.breaks = np.zeros(256, bool)
        self.breaks[list(BREAKS)] = True

    def __call__(self, langs: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words, bounds of the texts among them, and the number of the piece of each word."""
        words, bounds = self.hash(texts)
        data, offsets = text_bytes(texts)
        coded = pc.fill_null(langs, "und").dictionary_encode()
        own = np.array([xxhash.xxh64_intdigest(s, int(self.seed)) for s in coded.dictionary.to_pylist()], np.uint64)
        lang = own[coded.indices.to_numpy(zero_copy_only=False)] if len(texts) else np.zeros(0, np.uint64)
        ids = mix(words ^ np.repeat(lang, np.diff(bounds)) ^ mix(self.seed + np.ones(1, np.uint64)))
        starts = self.starts(data, offsets)
        pieces = np.cumsum(self.breaks[data], dtype=np.int64)[starts] + np.repeat(np.arange(len(texts)), np.diff(bounds))
        return ids, bounds, pieces

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        inside = self.hash.inside[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[firsts] = inside[firsts]
        return np.flatnonzero(begins)

    def sizes(self, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bytes of the words that start at the given places: to a gap or the text's end."""
        outside = np.append(np.flatnonzero(~self.hash.inside[data]), len(data))
        gap = outside[np.searchsorted(outside, starts)]
        return np.minimum(gap, offsets[np.searchsorted(offsets, starts, "right")]) - starts


def _source(docs: DataFrame, text: str, lang: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(name(lang).cast("string").alias("lang"), F.coalesce(name(text), F.lit("")).alias("text"))


def words(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[DataFrame, int]:
    """``id, lang, word, f`` of every word of every language, and the seed under which ids are distinct."""
    for seed in range(SEEDS):
        rows = _source(docs, text, lang).mapInArrow(_word_rows(seed), "id long, lang string, word string, n long")
        found = rows.groupBy("id").agg(
            F.min("lang").alias("lang"), F.min("word").alias("word"), F.max(F.struct("lang", "word")).alias("last"), F.sum("n").alias("f")
        )
        found = written(found)
        if not found.filter((F.col("lang") != F.col("last.lang")) | (F.col("word") != F.col("last.word"))).limit(1).count():
            return found.drop("last"), seed
    raise RuntimeError("two words share an id under every seed")


def _word_rows(seed: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        corpus, second = Corpus(seed), Words(lower=True, drop=GAPS + BREAKS)
        second.values = np.where(second.values > 0, mix(second.values), np.uint64(0))
        for batch in batches:
            langs, texts = pc.fill_null(batch.column(0), "und"), batch.column(1)
            ids, bounds, _ = corpus(langs, texts)
            if not len(ids):
                continue
            check, _ = second(texts)
            data, offsets = text_bytes(texts)
            order = np.argsort(ids, kind="stable")
            ids, check = ids[order], check[order]
            first = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (check[1:] != check[:-1])))
            places = corpus.starts(data, offsets)[order[first]]
            sizes = corpus.sizes(data, offsets, places)
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1]) + np.repeat(places - (ends - sizes), sizes)
            held = pa.py_buffer(_LOWER[data[at]].tobytes())
            strings = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(np.append(0, ends).astype(np.int32).tobytes()), held)
            owner = np.searchsorted(bounds, order[first], "right") - 1
            arrays = [pa.array(ids[first].view(np.int64)), langs.take(pa.array(owner)), strings, pa.array(np.diff(np.append(first, len(ids))))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "lang", "word", "n"])

    return run


def phrase_hash(columns: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(columns[0]), len(columns), np.uint64)
    for c, step in zip(columns, _IN_PHRASE):
        out = mix(out + c * step)
    return out


class Bloom:
    """Bits of the phrases of one length; says of every other phrase, but for chance hits, that it is not there."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(hashed: np.ndarray) -> list[np.ndarray]:
        low, high = hashed, mix(hashed) | np.uint64(1)
        return [(low + high * np.uint64(i)) >> np.uint64(64 - FILTER_BITS) for i in range(FILTER_HASHES)]

    def has(self, columns: list[np.ndarray]) -> np.ndarray:
        out = np.ones(len(columns[0]), bool)
        for p in self.places(phrase_hash(columns)):
            out &= (self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def bloom(phrases: DataFrame, columns: list[str]) -> Bloom:
    """The filter of the phrases: tasks fold their bits, the driver gets at most 2 ** (FILTER_BITS - 6) numbers of 64."""

    def run(batches):
        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for batch in batches:
            cols = [batch.column(i).to_numpy().view(np.uint64) for i in range(batch.num_columns)]
            for p in Bloom.places(phrase_hash(cols)):
                np.bitwise_or.at(bits, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
        bits = bits.view(np.int64)
        full = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(bits[full])], names=["place", "bits"])

    rows = phrases.select(*columns).mapInArrow(run, "place int, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits"))
    found = rows.toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[found["place"].to_numpy()] = found["bits"].to_numpy()
    return Bloom(bits.view(np.uint8))


def folded(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Suffixes in order, equal ones once: the leaves of a subtree, with their totals."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    differs = np.zeros(max(len(order) - 1, 0), bool)
    for c in columns:
        differs |= c[1:] != c[:-1]
    first = np.flatnonzero(np.append(True, differs)) if len(order) else np.zeros(0, np.int64)
    return [c[first] for c in columns], np.add.reduceat(counts[order], first) if len(first) else counts


class Subtree:
    """A depth-truncated suffix tree of a group: sorted leaves and the depth that each shares with the one before."""

    def __init__(self, columns: list[np.ndarray], counts: np.ndarray):
        self.leaves, self.totals = folded(columns, counts)
        n = len(self.totals)
        self.common = np.zeros(n, np.int64)
        same = np.append(False, np.ones(max(n - 1, 0), bool))[:n]
        for c in self.leaves:
            same[1:] &= c[1:] == c[:-1]
            self.common += same

    def nodes(self, depth: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Labels of the nodes at a depth and the totals of the leaves below them."""
        first = np.flatnonzero(self.common < depth)
        totals = np.add.reduceat(self.totals, first) if len(first) else self.totals
        return [c[first] for c in self.leaves[:depth]], totals


def heavy_prefixes(counts: DataFrame, columns: list[str], heavy: int) -> np.ndarray:
    """Sorted hashes of the prefixes to extend; at most total / heavy of them."""
    some = counts.filter(F.col("f") > heavy).select(*columns).toArrow()
    return np.sort(phrase_hash([some[c].to_numpy().view(np.uint64) for c in columns]))


def _found(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def groups_of(columns: list[np.ndarray], extended: list[np.ndarray], groups: int) -> np.ndarray:
    """The group of each suffix: by its shortest prefix that is not extended."""
    key = phrase_hash(columns[:1])
    open_ = np.ones(len(key), bool)
    for depth, heavy in enumerate(extended, 1):
        open_ &= _found(phrase_hash(columns[:depth]), heavy)
        if not open_.any():
            break
        key = np.where(open_, phrase_hash(columns[: depth + 1]), key)
    return (key % np.uint64(groups)).astype(np.int64)


def level(
    docs: DataFrame, seed: int, depth: int, total: int, extended: list[np.ndarray], known: Bloom | None, least: int, text: str, lang: str
) -> DataFrame:
    """``w1 .. w<depth>, f``: the phrases of ``depth`` words with at least ``least`` occurrences."""
    spark = docs.sparkSession
    groups = max(-(-total // BUDGET), 1)
    shared = spark.sparkContext.broadcast((extended, known))  # bounded by EXTENDED and FILTER_BITS

    def send(batches):
        corpus = Corpus(seed)
        extended, known = shared.value
        held: list[list[np.ndarray]] = [[] for _ in range(depth)]
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in held]
            columns, counts = folded(columns, np.ones(len(columns[0]), np.int64))
            group = groups_of(columns, extended, groups)
            order = np.argsort(group, kind="stable")
            numbers, first = np.unique(group[order], return_index=True)
            for number, part in zip(numbers.tolist(), np.split(order, first[1:])):
                suffixes = np.stack([c[part] for c in columns]).tobytes()
                arrays = [pa.array([number], pa.int64()), pa.array([suffixes], pa.binary()), pa.array([counts[part].astype(np.uint32).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["group", "suffixes", "counts"])

        for batch in batches:
            ids, _, pieces = corpus(batch.column(0), batch.column(1))
            whole = np.flatnonzero(pieces[depth - 1 :] == pieces[: len(pieces) - depth + 1]) if len(ids) >= depth else np.zeros(0, np.int64)
            if known is not None and len(whole):
                inner = np.zeros(len(ids), bool)
                starts = np.flatnonzero(pieces[depth - 2 :] == pieces[: len(pieces) - depth + 2])
                inner[starts] = known.has([ids[starts + k] for k in range(depth - 1)])
                whole = whole[inner[whole] & inner[whole + 1]]
            for k in range(depth):
                held[k].append(ids[whole + k])
            size += len(whole)
            if size >= HELD:
                yield from rows()
                held, size = [[] for _ in range(depth)], 0
        if size:
            yield from rows()

    def build(batch: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(s, np.uint64).reshape(depth, -1) for s in batch["suffixes"]]
        counts = np.concatenate([np.frombuffer(c, np.uint32) for c in batch["counts"]]).astype(np.int64)
        tree = Subtree([np.concatenate([p[k] for p in parts]) for k in range(depth)], counts)
        labels, totals = tree.nodes(depth)
        often = totals >= least
        return pd.DataFrame({f"w{k + 1}": c[often].view(np.int64) for k, c in enumerate(labels)} | {"f": totals[often]})

    sent = _source(docs, text, lang).mapInArrow(send, "group long, suffixes binary, counts binary")
    schema = ", ".join(f"w{k + 1} long" for k in range(depth)) + ", f long"
    return written(sent.groupBy("group").applyInPandas(build, schema))


def counted(docs: DataFrame, longest: int = 3, least: int = LEAST, text: str = "text", lang: str = "lang") -> list[DataFrame]:
    """Tables of the words (``id, lang, word, f``) and of the phrases of 2 to ``longest`` words (``w1, w2, ..., f``)."""
    known, seed = words(docs, text, lang)
    total = known.agg(F.sum("f")).first()[0] or 0
    heavy = max(HEAVY, -(-total // EXTENDED))
    extended = [heavy_prefixes(known, ["id"], heavy)]
    out, filtered = [known], None
    for depth in range(2, longest + 1):
        out.append(level(docs, seed, depth, total, extended, filtered, least, text, lang))
        if depth < longest:
            columns = [f"w{k + 1}" for k in range(depth)]
            filtered = bloom(out[-1], columns)
            extended.append(heavy_prefixes(out[-1], columns, heavy))
    return out


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, percent: int = OVERLAP_PERCENT, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """The best ``top`` phrases of two and three words of every language: lang, rank, phrase, a, l, r, n, score."""
    known, two, three = counted(docs, 3, least, text, lang)
    often = known.filter(F.col("f") >= least)
    totals = known.groupBy("lang").agg(F.sum("f").alias("n"))

    def word(k: int, *columns: str) -> DataFrame:
        kept = {"id": f"w{k}", "word": f"t{k}", "f": f"f{k}", "lang": "lang"}
        return often.select(*[F.col(c).alias(kept[c]) for c in ("id", *columns)])

    pairs = written(two.join(word(1, "word", "f", "lang"), "w1").join(word(2, "word", "f"), "w2"))
    shape = ["w1", "w2", "w3", "lang", "phrase", "a", "l", "r", "k"]
    split2 = pairs.select(
        "w1", "w2", F.lit(None).cast("long").alias("w3"), "lang", F.concat_ws(" ", "t1", "t2").alias("phrase"),
        F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"), F.lit(1).alias("k"),
    )
    first = pairs.select("w1", "w2", "lang", F.concat_ws(" ", "t1", "t2").alias("t12"), F.col("f").alias("f12"), "f1")
    rest = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("f23"), F.col("t2").alias("t3"), F.col("f2").alias("f3"))
    split3 = three.join(first, ["w1", "w2"]).join(rest, ["w2", "w3"])
    cuts = F.array(
        F.struct(F.col("f1").alias("l"), F.col("f23").alias("r"), F.lit(1).alias("k")),
        F.struct(F.col("f12").alias("l"), F.col("f3").alias("r"), F.lit(2).alias("k")),
    )
    split3 = split3.withColumn("cut", F.explode(cuts)).select(
        "w1", "w2", "w3", "lang", F.concat_ws(" ", "t12", "t3").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "cut.k"
    )
    score = F.expr(f"({SCALE} * cast(a AS decimal(16,0)) * cast(a AS decimal(16,0))) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))")
    rows = split2.select(*shape).unionByName(split3.select(*shape)).withColumn("score", score)

    # a three-word phrase has its two cuts in the two rows of the explode: the lowest, then the smallest k
    best = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("best")
    threes = rows.filter("w3 IS NOT NULL").groupBy("w1", "w2", "w3", "lang", "phrase", "a").agg(best)
    threes = threes.select("w1", "w2", "w3", "lang", "phrase", "a", "best.l", "best.r", "best.score")
    longer = three.select("w1", "w2", "f").unionByName(three.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "f"))
    longer = longer.groupBy("w1", "w2").agg(F.max("f").alias("longer"))
    twos = rows.filter("w3 IS NULL").join(longer, ["w1", "w2"], "left")
    twos = twos.filter(F.coalesce(100 * F.col("longer"), F.lit(0)) < percent * F.col("a"))
    kept = ["lang", "phrase", "a", "l", "r", "score"]
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = twos.select(*kept).unionByName(threes.select(*kept)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    out = ranked.join(F.broadcast(totals) if totals.count() <= 1 << 16 else totals, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocation(spark, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


#: All phrases counted at once.
OP12_SQL = r"""
WITH docs AS (
    SELECT coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
runs AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
ones AS (SELECT lang, unnest(w) AS p FROM runs),
grams AS (
    SELECT lang, 2 AS len, unnest(list_transform(range(1, len(w)), lambda i: w[i:i + 1])) AS p FROM runs WHERE len(w) > 1
    UNION ALL
    SELECT lang, 3 AS len, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS p FROM runs WHERE len(w) > 2),
f1 AS (SELECT lang, p, count(*) AS f FROM ones GROUP BY lang, p),
f AS (SELECT lang, len, p, count(*) AS f FROM grams GROUP BY lang, len, p HAVING count(*) >= 10),
cuts AS (
    SELECT g.lang, g.p, g.f AS a, x.f AS l, y.f AS r, 1 AS k FROM f g
    JOIN f1 x ON x.lang = g.lang AND x.p = g.p[1] JOIN f1 y ON y.lang = g.lang AND y.p = g.p[2] WHERE g.len = 2
    UNION ALL
    SELECT g.lang, g.p, g.f, x.f, y.f, 1 FROM f g
    JOIN f1 x ON x.lang = g.lang AND x.p = g.p[1] JOIN f y ON y.lang = g.lang AND y.p = g.p[2:3] AND y.len = 2 WHERE g.len = 3
    UNION ALL
    SELECT g.lang, g.p, g.f, x.f, y.f, 2 FROM f g
    JOIN f x ON x.lang = g.lang AND x.p = g.p[1:2] AND x.len = 2 JOIN f1 y ON y.lang = g.lang AND y.p = g.p[3] WHERE g.len = 3),
scored AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
longer AS (
    SELECT lang, p, max(f) AS f FROM (
        SELECT lang, p[1:2] AS p, f FROM f WHERE len = 3 UNION ALL SELECT lang, p[2:3], f FROM f WHERE len = 3) GROUP BY lang, p),
kept AS (
    SELECT best.* FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.p = best.p
    WHERE longer.f IS NULL OR 100 * longer.f < 50 * best.a),
phrases AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score::BIGINT AS score FROM kept),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM phrases QUALIFY rank <= 2000)
SELECT ranked.lang, rank, phrase, a, l, r, n, score
FROM ranked JOIN (SELECT lang, count(*) AS n FROM ones GROUP BY lang) USING (lang)
"""
