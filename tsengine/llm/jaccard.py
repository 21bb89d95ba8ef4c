"""N-gram Jaccard join: prefix, length, positional and suffix filters, and exact verification.

A document's set are its distinct word shingles, as 64-bit hashes. Documents with equal sets are
one class, known by two digests of the set; all that follows is on classes, so copies cost one
row each. Shingles have one global order, rare first, by counts in a hashed table of fixed size
that covers all documents (ties and shared buckets: by hash; any order gives the same links).

Two sets that reach the similarity share a shingle in the prefixes of that order: 1 in 10 of the
longer set's shingles, half as many of the shorter one's (threshold 0.9). Classes join on prefix
shingles, in two steps that keep large groups of near copies from making all their pairs:

1. groups of at most ``SMALL`` classes give all pairs, larger ones the pairs with the class that
   has the fewest rarer shingles, which is the likely centre of a group of near copies;
2. when the links found have been contracted to components, the larger groups give every pair of
   classes of different components. Pairs inside a component could add no link that matters:
   a group that is one component makes none, others join the classes outside their largest
   component with the whole group, which is at most twice the pairs between components.

Pairs pass the length filter and the positional filter in the join. They are made distinct, pass
the suffix filter (counts of the sets' hashes in ``PARTS`` parts bound the overlap) and are
verified once by the exact overlap of the two sets. Components take their smallest document id.

Defined results: words are runs of characters other than space and U+0009 to U+000D, A-Z
lower-cased; with fewer words than a shingle has the whole sequence is one shingle; null, empty
and wordless texts have an empty set and link with nothing; repeated rows are linked; a component
whose ids are all null has a null id; texts of any length are used whole; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsengine.llm.common import fresh, map_texts, name, small_batches, table, written
from tsengine.llm.components import components
from tsengine.llm.hashing import Words, mix, shingles

WIDTH, PERCENT = 3, 90
#: Counters of the shingle order, and how many of them travel together.
SKETCH_BITS, SLICE_BITS = 20, 14
#: Largest prefix group that gives all its pairs at once.
SMALL = 16
#: Parts of the hash space counted for the suffix filter.
PARTS = 128
#: Up to so many row keys (8 bytes each) go to all tasks; more meet their documents in a shuffle.
SENT_KEYS = 1 << 20


def shingle_sets(texts: pa.Array, hash_words: Words, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    words, bounds = hash_words(texts)
    return [np.unique(shingles(words[bounds[i] : bounds[i + 1]], width)) for i in range(len(texts))]


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set; sums of mixed hashes, so they depend on the set alone."""
    one, two = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xD6E8FEB86659FD93)
    out = np.empty((2, len(sets)), np.uint64)
    for i, s in enumerate(sets):
        out[:, i] = np.add.reduce(mix(s ^ one)), np.add.reduce(mix(s + two))
    sizes = np.array([len(s) for s in sets], np.uint64)
    out += mix(np.stack([sizes ^ two, sizes + one]))
    return out[0].view(np.int64), out[1].view(np.int64)


def _rows_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(name(doc_id), name(text))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def scanned(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """One pass: a row per document with its set's digests, and each task's shingle counts in slices."""
    small_batches(docs.sparkSession)
    source = docs.select(name(doc_id).alias("doc_id"), _rows_key(doc_id, text).alias("row_key"), name(text).alias("text"))
    schema = T.StructType(
        [
            source.schema["doc_id"],
            T.StructField("row_key", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("a", T.LongType()),
            T.StructField("b", T.LongType()),
            T.StructField("parts", T.ArrayType(T.IntegerType())),
            T.StructField("slice", T.IntegerType()),
            T.StructField("places", T.BinaryType()),
            T.StructField("counts", T.BinaryType()),
        ]
    )

    def run(batches):
        hash_words = Words(lower=True)
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            sets = shingle_sets(batch.column(2), hash_words, width)
            a, b = digests(sets)
            for s in sets:
                counts += np.bincount(_bucket(s), minlength=len(counts)).astype(np.uint32) if len(s) > 50_000 else 0
            small = [s for s in sets if 0 < len(s) <= 50_000]
            if small:
                places, n = np.unique(_bucket(np.concatenate(small)), return_counts=True)
                counts[places] += n.astype(np.uint32)
            parts = [np.bincount((s & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS).tolist() for s in sets]
            arrays = [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(a), pa.array(b)]
            arrays.append(pa.array(parts, pa.list_(pa.int32())))
            arrays += [pa.nulls(len(sets), k) for k in (pa.int32(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
        if id_type is None:
            return
        for i in range(1 << (SKETCH_BITS - SLICE_BITS)):
            part = counts[i << SLICE_BITS : (i + 1) << SLICE_BITS]
            full = np.flatnonzero(part)
            if not len(full):
                continue
            arrays = [pa.nulls(1, id_type), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.list_(pa.int32())), pa.array([i], pa.int32())]
            arrays.append(pa.array([full.astype(np.uint16).tobytes()], pa.binary()))
            arrays.append(pa.array([part[full].tobytes()], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return written(source.mapInArrow(run, schema))


def shingle_counts(found: DataFrame) -> np.ndarray:
    """The counters of all tasks added up: ``2 ** SKETCH_BITS`` numbers, whatever the input."""
    slices = 1 << (SKETCH_BITS - SLICE_BITS)
    parts = found.filter(F.col("slice").isNotNull()).select("slice", "places", "counts").repartition(slices, "slice")

    def run(batches):  # streams: memory for the slices of the partition only
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, places, counts in zip(*(c.to_pylist() for c in batch.columns)):
                total = sums.setdefault(i, np.zeros(1 << SLICE_BITS, np.int64))
                total[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.uint32)
        for i, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total.tobytes()])], names=["slice", "counts"])

    out = np.zeros((slices, 1 << SLICE_BITS), np.int64)
    for row in parts.mapInArrow(run, "slice int, counts binary").collect():
        out[row["slice"]] = np.frombuffer(row["counts"], np.int64)
    return np.minimum(out.ravel(), 2**31 - 1).astype(np.int32)


def prefix_length(n: int, percent: int) -> int:
    """Shingles of a set of ``n`` that a set no longer than it, at the threshold, must meet."""
    return n - -(-percent * n // 100) + 1


def entries(docs: DataFrame, doc_id: str, text: str, counts: np.ndarray, seed: int, width: int, percent: int) -> DataFrame:
    """Prefix entries: shingle, class, size of the set and position in its order."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(counts)  # 2 ** SKETCH_BITS numbers
    schema = "shingle long, a long, b long, n int, position int"

    def run(batches):
        hash_words, order = Words(lower=True), shared.value
        seen: set[tuple[int, int]] = set()  # classes of this task: copies add nothing
        for batch in batches:
            sets = shingle_sets(batch.column(0), hash_words, width)
            a, b = digests(sets)
            rows: list[list[np.ndarray]] = [[], [], [], [], []]
            if len(seen) > 500_000:
                seen.clear()
            for s, one, two in zip(sets, a.tolist(), b.tolist()):
                if not len(s) or (one, two) in seen:
                    continue
                seen.add((one, two))
                k = prefix_length(len(s), percent)
                rarity = order[_bucket(s)]
                first = s[np.lexsort((s, rarity))[:k]]
                for column, value in zip(rows, (first.view(np.int64), one, two, len(s))):
                    column.append(value if isinstance(value, np.ndarray) else np.full(k, value, np.int64))
                rows[4].append(np.arange(k))
            flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in rows]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            arrays = [pa.array(c, type=k) for c, k in zip(flat, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["shingle", "a", "b", "n", "position"])

    rows = docs.select(name(text).alias("text")).mapInArrow(run, schema)
    return rows.select("shingle", _class_key(seed).alias("class"), "n", "position")


def _class_key(seed: int) -> Column:
    return F.xxhash64("a", "b", F.lit(seed))


def keyed_classes(found: DataFrame) -> tuple[DataFrame, int]:
    """Classes with a 64-bit key that no two of them share, and the key's seed."""
    rows = found.filter("n > 0").groupBy("a", "b").agg(
        F.min("doc_id").alias("doc_id"), F.min("row_key").alias("row_key"), F.first("n").alias("n"), F.first("parts").alias("parts")
    )
    seed = 0
    while True:
        classes = written(rows.select(_class_key(seed).alias("class"), "doc_id", "row_key", "n", "parts"))
        if not classes.groupBy("class").count().filter("count > 1").limit(1).count():
            return classes, seed
        seed += 1


def _joinable(long_n: Column, long_at: Column, short_n: Column, short_at: Column, percent: int) -> Column:
    """Length, short-prefix and positional filters of a pair that shares a prefix shingle.

    With the threshold as p / 100 the overlap must reach p / (100 + p) of both sizes together.
    """
    must = 100 + percent
    short_prefix = short_n - F.ceil(F.lit(2 * percent) * short_n / must) + 1
    rest = F.least(long_n - long_at, short_n - short_at)
    return (100 * short_n >= percent * long_n) & (short_at < short_prefix) & (rest * must >= percent * (long_n + short_n))


def _groups(rows: DataFrame) -> DataFrame:
    """Prefix entries of the shingles that classes share, with the group's ``members`` and ``centre``.

    Tasks fold their own rows before a group meets, and a large group is dealt over many tasks.
    """
    rows = written(rows.groupBy("shingle", "class").agg(F.first("n").alias("n"), F.first("position").alias("position")))
    sizes = rows.groupBy("shingle").agg(
        F.count("*").alias("members"), F.min(F.struct("position", "n", "class")).alias("centre")
    )
    return written(rows.join(written(sizes.filter("members > 1")), "shingle"))


def _pairs(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (longer, shorter) of classes of two entry tables that share a prefix shingle."""
    x, y = left.alias("x"), right.alias("y")
    first = (F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.class") > F.col("y.class")))
    on = (F.col("x.shingle") == F.col("y.shingle")) & first
    on &= _joinable(F.col("x.n"), F.col("x.position"), F.col("y.n"), F.col("y.position"), percent)
    pairs = x.join(y, on).select(
        F.col("x.class").alias("x"), F.col("y.class").alias("y"), F.col("x.n").alias("nx"), F.col("y.n").alias("ny")
    )
    return pairs.distinct()


def _mixed(many: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries of the groups of more than one component, with ``root`` and ``main``, the group's largest one."""
    rows = many.join(roots.withColumnRenamed("node", "class"), "class", "left")
    rows = written(rows.select("shingle", "class", "n", "position", F.coalesce("root", "class").alias("root")))
    sizes = rows.groupBy("shingle", "root").agg(F.count("*").alias("size"))
    sizes = sizes.groupBy("shingle").agg(F.count("*").alias("roots"), F.max(F.struct("size", "root")).alias("most"))
    sizes = written(sizes.filter("roots > 1").select("shingle", F.col("most.root").alias("main")))
    return written(rows.join(sizes, "shingle"))


def _pairs_apart(mixed: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (longer, shorter) of classes of different components that share a prefix shingle.

    The left side lacks each group's largest component, so no pair inside that one is compared.
    """
    x, y = mixed.filter("root <> main").alias("x"), mixed.alias("y")
    longer = (F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.class") > F.col("y.class")))
    of_x, of_y = ((F.col(f"{s}.n"), F.col(f"{s}.position")) for s in ("x", "y"))
    on = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.root") != F.col("y.root"))
    on &= (F.col("y.root") == F.col("y.main")) | (F.col("x.class") < F.col("y.class"))  # others meet twice
    on &= (longer & _joinable(*of_x, *of_y, percent)) | (~longer & _joinable(*of_y, *of_x, percent))
    own, other = (F.struct(F.col(f"{s}.n"), F.col(f"{s}.class")) for s in ("x", "y"))
    pairs = x.join(y, on).select(F.greatest(own, other).alias("x"), F.least(own, other).alias("y"))
    return pairs.select(
        F.col("x.class").alias("x"), F.col("y.class").alias("y"), F.col("x.n").alias("nx"), F.col("y.n").alias("ny")
    ).distinct()


def _central_pairs(groups: DataFrame, percent: int) -> DataFrame:
    """Pairs of the members of large groups with their group's centre."""
    rows = groups.filter(F.col("members") > SMALL).filter(F.col("class") != F.col("centre.class"))
    own = F.struct(F.col("n"), F.col("class"), F.col("position"))
    other = F.struct(F.col("centre.n").alias("n"), F.col("centre.class").alias("class"), F.col("centre.position").alias("position"))
    rows = rows.select(F.greatest(own, other).alias("x"), F.least(own, other).alias("y"))
    rows = rows.filter(_joinable(F.col("x.n"), F.col("x.position"), F.col("y.n"), F.col("y.position"), percent))
    return rows.select(
        F.col("x.class").alias("x"), F.col("y.class").alias("y"), F.col("x.n").alias("nx"), F.col("y.n").alias("ny")
    ).distinct()


def suffix_filtered(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose part counts allow the overlap: it is at most the sum of the smaller counts."""
    x = classes.select(F.col("class").alias("x"), F.col("parts").alias("px"))
    y = classes.select(F.col("class").alias("y"), F.col("parts").alias("py"))
    rows = pairs.join(x, "x").join(y, "y")
    most = F.aggregate(F.zip_with("px", "py", lambda p, q: F.least(p, q)), F.lit(0), lambda s, v: s + v)
    return rows.filter(most * (100 + percent) >= percent * (F.col("nx") + F.col("ny"))).select("x", "y", "nx", "ny")


def class_sets(docs: DataFrame, doc_id: str, text: str, classes: DataFrame, pairs: DataFrame, seed: int, width: int) -> DataFrame:
    """``class`` and its ``shingles`` for the classes of the pairs, from the text of one document each."""
    wanted = pairs.select(F.col("x").alias("class")).unionByName(pairs.select(F.col("y").alias("class")))
    keys = written(classes.join(wanted, "class", "left_semi").select("row_key"))
    if keys.count() <= SENT_KEYS:
        keys = F.broadcast(keys)
    rows = docs.select(_rows_key(doc_id, text).alias("row_key"), name(text).alias("text"))
    rows = rows.join(keys, "row_key", "left_semi").groupBy("row_key").agg(F.first("text").alias("text"))
    fields = [T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))]

    def build():
        hash_words = Words(lower=True)

        def work(texts: pa.Array) -> list:
            sets = shingle_sets(texts, hash_words, width)
            a, b = digests(sets)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))
            return [pa.array(a), pa.array(b), lists]

        return work

    sets = map_texts(rows, "text", fields, build, keep=[]).select(_class_key(seed).alias("class"), "shingles")
    return written(sets)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links: pairs whose exact overlap reaches the threshold."""
    x = sets.select(F.col("class").alias("x"), F.col("shingles").alias("sx"))
    y = sets.select(F.col("class").alias("y"), F.col("shingles").alias("sy"))
    rows = pairs.join(x, "x").join(y, "y").withColumn("shared", F.size(F.array_intersect("sx", "sy")))
    return rows.filter(F.col("shared") * (100 + percent) >= percent * (F.col("nx") + F.col("ny"))).select("x", "y", "shared")


def linked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: ``doc_id``, ``row_key``, ``n_shingles``, ``component_id``, ``component`` (null: no words).

    Components only, not the links: pairs inside a component of a group of over ``SMALL`` classes
    are verified only as far as the component needs them, so there is no whole list of pairs.
    """
    found = scanned(docs, doc_id, text, width)
    counts = shingle_counts(found)
    classes, seed = keyed_classes(found)

    groups = _groups(entries(docs, doc_id, text, counts, seed, width, percent))

    few, many = groups.filter(F.col("members") <= SMALL), groups.filter(F.col("members") > SMALL)
    pairs = _pairs(few, few, percent).unionByName(_central_pairs(groups, percent)).distinct()
    pairs = written(suffix_filtered(pairs, classes, percent))
    links = written(verified(pairs, class_sets(docs, doc_id, text, classes, pairs, seed, width), percent))

    roots = components(links)
    rest = written(suffix_filtered(_pairs_apart(_mixed(many, roots), percent), classes, percent))
    more = written(verified(rest, class_sets(docs, doc_id, text, classes, rest, seed, width), percent))
    if more.limit(1).count():
        roots = components(links.unionByName(more))

    rooted = classes.join(roots.withColumnRenamed("node", "class"), "class", "left")
    rooted = rooted.select("class", "doc_id", F.coalesce("root", "class").alias("component"))
    least = rooted.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = rooted.select("class", "component").join(least, "component")
    members = found.filter(F.col("slice").isNull()).select("doc_id", "row_key", "n", F.when(F.col("n") > 0, _class_key(seed)).alias("class"))
    out = members.join(named, "class", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "row_key", F.col("n").alias("n_shingles"), own.alias("component_id"), "component")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents without words, and of every component the one with the smallest id; all columns.

    Where rows share the smallest id, the one with the smallest row hash stays, and of rows equal in
    id and text the smallest in all columns.
    """
    rows = linked(docs, text, doc_id, width, percent)
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    kept = rows.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min(best).alias("best"))
    key = fresh(docs, "key of the row")
    keyed = docs.withColumn(key, F.when(F.length(F.regexp_replace(F.coalesce(name(text), F.lit("")), r"[\x20\x09-\x0D]+", "")) > 0, _rows_key(doc_id, text)))
    wordless = keyed.filter(name(key).isNull()).drop(key)
    kept = keyed.join(kept.select(F.col("best.row_key").alias(key)), key, "left_semi")
    if any("map<" in kind for _, kind in docs.dtypes):
        kept = kept.dropDuplicates([key]).drop(key)
    else:
        kept = kept.groupBy(key).agg(F.min(F.struct(*[name(c) for c in docs.columns])).alias("row")).select("row.*")
    return kept.unionByName(wordless)


def op9_jaccard(spark, folder: str) -> DataFrame:
    return linked(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


#: All pairs of documents that share a shingle, and the closure of the links.
OP9_SQL = r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, row_number() OVER () AS r,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
shingles AS (
    SELECT DISTINCT r, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda k: array_to_string(w[k:k + 2], ' '))) AS s
    FROM docs WHERE len(w) > 0),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS o FROM shingles a JOIN shingles b USING (s) GROUP BY a.r, b.r),
links AS (
    SELECT x, y FROM shared JOIN sizes p ON p.r = x JOIN sizes q ON q.r = y WHERE 100 * o >= 90 * (p.n + q.n - o)),
reach AS (
    SELECT r, r AS y FROM docs
    UNION SELECT reach.r, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT d.doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles, min(e.doc_id) AS component_id
FROM reach JOIN docs d ON d.r = reach.r JOIN docs e ON e.r = reach.y LEFT JOIN sizes ON sizes.r = d.r
GROUP BY d.r, d.doc_id
"""
