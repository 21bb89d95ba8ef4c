"""Text operators against brute force, exact round trips and held-out labels, with odd inputs."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import check_oracle
import corpus_pipeline
from tsengine.llm import chat, common, components, decontaminate, jaccard, mixing, pii, quality, sharding, tokens, topk, toxicity
from tsengine.llm.labelled import in_fold, training_rows
from tsengine.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, slot int, n_tokens long, spans string"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


def document(i, text, lang="en", source="a"):
    return (i, text, lang, source, None, "x", "y", 3, 9, "z")


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, null columns, repeated rows, a long text, names that operators use."""
    words = [f"w{i}" for i in range(3000)]
    rows = [
        document(1, None, None, None),
        document(2, ""),
        document(3, " \t\n"),
        document(4, "one"),
        document(5, "ONE"),
        document(6, " ".join(words)),
        document(7, " ".join(words[:2990] + ["x"] * 10), None, "b"),
        document(8, "a b c d e f g h"),
        document(8, "a b c d e f g h"),
        document(None, "a b c d e f g h", "de", None),
        document(None, None, None, "b"),
        document(9, "mail a.b@c.org now " * 40, "fr", "b"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (8, 1, 0), (8, 0, 0), (None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@needs_tables
@pytest.mark.parametrize("query", sorted(ORACLE))
def test_query_matches_sql(spark, query):
    ours = QUERIES[query](spark, FOLDER).toPandas()
    assert check_oracle.difference(ours, check_oracle.tables(FOLDER).execute(ORACLE[query]).df()) is None


# classifiers


@needs_tables
@pytest.mark.parametrize("query, label, least", [("op1_toxicity", "toxic", 0.75), ("op2_quality", "quality", 0.85)])
def test_held_out_accuracy(spark, query, label, least):
    folder = "/root/testdata/sf0.1"
    rows = QUERIES[query](spark, folder).toPandas()
    assert rows["score"].between(0, 1).all() and len(rows) == common.table(spark, folder, "documents").count()
    known = common.table(spark, folder, "labels").toPandas().groupby("doc_id")[label].max()
    held = rows[rows["held_out"]].set_index("doc_id").join(known, how="inner")
    y, order = held[label].to_numpy(), held["score"].rank().to_numpy()
    n1, n0 = y.sum(), (1 - y).sum()
    assert (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.97
    assert (held["predicted"] == y).mean() > 0.95
    assert held.loc[y == 1, "predicted"].mean() > least


def test_classifiers_on_odd_rows(odd, none, labels):
    for module, column in ((toxicity, "toxic"), (quality, "quality")):
        model = module.train(odd, labels, ~in_fold(7, 3))
        rows = module.score(odd, model).collect()
        assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] == 8}) == 1
        assert module.score(none, module.train(none, labels, ~in_fold(7, 3))).count() == 0
    assert quality.accepted(odd, quality.train(odd, labels, ~in_fold(7, 3)), 0.0).columns == odd.columns


def test_training_rows_hold_one_text_an_id(spark):
    docs = spark.createDataFrame([document(1, f"t{i}", f"l{i}") for i in range(10, 40)] + [document(2, "u", None)], DOCS)
    docs = docs.unionByName(spark.createDataFrame([document(1, "long" * 9), document(1, None), document(None, "t")], DOCS))
    known = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    texts, langs, y, shares = training_rows(docs, known, "toxic", ~in_fold(1, 1), 5, 20)
    assert (texts, langs, y.tolist(), shares.tolist()) == (["t10", "u"], ["l10", None], [1, 0], [0.5, 0.5])


def test_toxicity_learns_from_every_row_in_full(spark, monkeypatch):
    """A word that only texts of over 20,000 characters have counts, with several learners, and reruns agree."""
    rows = []
    for i in range(240):
        toxic, long = i % 4 == 0, i % 8 < 2
        words = [f"w{(i * 7 + k * k) % 97}" for k in range(6000 if long else 40)]
        if toxic:
            words[len(words) // 2] = "zzz" if long else "aaa"
        rows.append((i, " ".join(words), "en" if i % 3 else "de", int(toxic)))
    assert all((len(r[1]) > 20_000) == (r[0] % 8 < 2) for r in rows)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    known = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    new = [(1, "w1 w2 w3 zzz w4"), (2, "w1 w2 w3 aaa w4"), (3, "w1 w2 w3 w5 w4"), (4, "w1 w5")]
    new = spark.createDataFrame(new, "doc_id long, text string")
    runs = []
    monkeypatch.setattr(toxicity, "LEARNER_ROWS", 60)
    for _ in range(2):
        model = toxicity.train(docs, known, ~in_fold(1, 1))
        runs.append({r["doc_id"]: r["score"] for r in toxicity.score(new, model).collect()})
        assert min(runs[-1][1], runs[-1][2]) >= 0.5 > max(runs[-1][3], runs[-1][4])
    assert runs[0] == runs[1]


def test_second_moments_outlast_the_fixed_point(spark):
    """Moments that fade over many steps do not turn negative when the learners' weights are averaged."""
    rng = random.Random(6)
    rows = [(0, i % 2, [rng.randrange(1 << 31) for _ in range(5)]) for i in range(300 * toxicity.STEP_TEXTS)]
    learn = spark.createDataFrame(rows, "learner long, y int, words array<int>").coalesce(1)
    work = toxicity._Descent(toxicity.Model(), np.array([1, 1]))
    for bias, *rules in zip(work.model.bias, work.conv, work.bias):
        bias[1:] = -50  # filters that no word reaches, so their moments only fade
        for r in rules:
            r.v[...] = np.linspace(0, 1e-9, r.v.size).reshape(r.v.shape)
    for _ in range(2):
        toxicity._epoch(learn, work)
    assert all((r.v >= 0).all() for r in (*work.conv, *work.bias, work.head))
    assert np.isfinite(work.dense()).all() and np.isfinite(work.model.embed).all()


def test_dense_weights_travel_in_fixed_point():
    model = toxicity.Model()
    work, other = (toxicity._Descent(model, np.array([3, 1])) for _ in range(2))
    rules = [*work.conv, *work.bias, work.head]
    rng = np.random.default_rng(4)
    for r in rules:
        r.v[...] = 10.0 ** rng.uniform(-14, -2, r.v.shape)
        r.m[...] = np.sqrt(r.v) * rng.uniform(-2, 2, r.v.shape)
        r.t = 100
    # a learner of 4,096 rows whose every sum is rounded
    unit = 1 / (toxicity.POINT * 4096)
    other.set_dense(np.floor(work.dense() / unit) * unit)
    for a, b in zip(rules, [*other.conv, *other.bias, other.head]):
        steps = [r.m / (np.sqrt(r.v) + 1e-6) for r in (a, b)]
        assert (b.v >= 0).all() and np.allclose(*steps, atol=1e-3)


def test_steps_take_every_row_once(monkeypatch):
    import pyarrow as pa

    rng = random.Random(3)
    rows = [(owner, i % 2, [i] * rng.choice([0, 1, 5, 30])) for owner in (0, 2, 5) for i in range(rng.choice([40, 100, 160]))]
    monkeypatch.setattr(toxicity, "STEP_WORDS", 200)
    for cut in (7, 64, 1000):
        batches = []
        for lo in range(0, len(rows), cut):
            owner, y, words = zip(*rows[lo : lo + cut])
            kinds = [(owner, pa.int64()), (y, pa.int32()), (words, pa.list_(pa.int32()))]
            batches.append(pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in kinds], names=["learner", "y", "words"]))
        got = []
        for owner, buckets, bounds, y in toxicity._steps(iter(batches)):
            assert len(y) <= toxicity.STEP_TEXTS and bounds[-1] == len(buckets) <= 200 + 30
            got += [(owner, label, buckets[a:b, 0].tolist()) for label, a, b in zip(y, bounds[:-1], bounds[1:])]
        assert got == rows


def test_threshold_is_the_best_cut_of_every_language(spark):
    rng = random.Random(9)
    rows = [("en", int(rng.random() < s), s) for s in (round(rng.random(), 3) for _ in range(600))]
    rows += [("de", int(s > 0.3), s) for s in (rng.random() for _ in range(60))] + [("fr", 1, 0.4)] * 20 + [(None, 0, 0.1)]
    weights = np.array([0.7, 1.9])
    out = toxicity._thresholds(spark.createDataFrame(rows, "lang string, y int, score double"), weights)
    assert set(out) == {"en", "de"}
    for lang, cut in out.items():
        mine = [(y, s) for x, y, s in rows if x == lang]

        def f1(c):
            tp, fp = (weights[v] * sum(y == v and s >= c for y, s in mine) for v in (1, 0))
            return 2 * tp / (tp + fp + weights[1] * sum(y for y, _ in mine))

        known = sorted({s for _, s in mine})
        cuts = [0.5, *((a + b) / 2 for a, b in zip(known, known[1:]))]
        top = max(map(f1, cuts))
        assert cut == min((c for c in cuts if f1(c) >= top - 1e-12), key=lambda c: (abs(c - 0.5), c))


def test_convolution_scores_pieces_like_the_whole(monkeypatch):
    texts = ["good words here " * 50 + "awful thing", "good words here " * 60, "", "awful"] * 8
    y = np.array([1, 0, 0, 1] * 8)
    model = toxicity.fit(texts, y, epochs=6)
    hashes, bounds = toxicity._words()(__import__("pyarrow").array(texts))
    buckets = toxicity._buckets(hashes)
    whole = model.raw(buckets, bounds)
    assert whole[y == 1].min() > whole[y == 0].max()
    monkeypatch.setattr(toxicity, "PIECE_WORDS", 7)
    assert np.allclose(model.raw(buckets, bounds), whole, atol=1e-5)


# sharding


def test_sharding_is_a_permutation(spark, odd, none):
    out = sharding.shards(odd, 5, [common.name(c) for c in odd.columns]).collect()
    sizes = Counter(r["shard"] for r in out)
    assert sum(sizes.values()) == 12 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
    assert sharding.shards(none, 5, [common.name("doc_id")]).count() == 0
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 17, 1000, 4099):
        images = spark.range(n).select(sharding.permuted(F.col("id"), F.lit(n), 17).alias("p")).collect()
        assert sorted(r["p"] for r in images) == list(range(n))


@needs_tables
def test_sharding_query(spark):
    rows = QUERIES["op3_sharding"](spark, FOLDER)
    first = {r["doc_id"]: r for r in rows.collect()}
    again = {r["doc_id"]: r for r in rows.repartition(3).collect()}
    texts = {r["doc_id"]: r["text"] for r in common.table(spark, FOLDER, "documents").collect()}
    assert first == again and len(first) == len(texts)
    for i, r in first.items():
        raw = (texts[i] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "rows"


# chat


def test_chat_round_trip(spark):
    texts = ["", None, "<|end|>", "<~|x", "[INST] ok [/INST]", "a<", "|>b", "<<SYS>>", "é𝄞</s>", "~<~~|text|>"]
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 3, None]), k % 7, rng.choice(["user", "assistant", "<|text|>", None]), rng.choice(texts)) for k in range(120)]
    frame = spark.createDataFrame([r + (1,) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    out = chat.format_chats(frame)
    got = out.select("conv_id", "formatted", "loss", chat.turns_of(out["formatted"]).alias("turns"), chat.masked(out["formatted"], out["loss"]).alias("m"))
    for r in got.collect():
        want = sorted((t, role or "", text or "") for c, t, role, text in rows if c == r["conv_id"])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [w[1:] for w in want]
        assert r["m"] == "".join(w[2] for w in want if w[1] == "assistant")
        assert len(r["loss"]) == sum(w[1] == "assistant" for w in want)
        blocks = 1 + sum(a[1] != b[1] for a, b in zip(want, want[1:]))
        assert r["formatted"].count(chat.BLOCK) == r["formatted"].count(chat.END) == blocks
    assert chat.format_chats(frame.limit(0)).count() == 0


# mixing


def water_level(sizes):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free = {}, set(order)
    while free:
        rest = 1.5 * sum(sizes.values()) - sum(target.values())
        now = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if now[s] > 2 * sizes[s]}
        if not over:
            return target | now
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return target


@pytest.mark.parametrize("chunk", [mixing.CHUNK, 64])
def test_mixing_comes_near_its_targets(spark, chunk):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "b", "b", "b", "c", None]), int(rng.lognormvariate(4, 1))) for i in range(1500)]
    rows += [(5000, "c", 40)] * 30
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long")
    plan = mixing.taken(mixing.decide(frame, chunk)).collect()
    assert sorted((r["doc_id"], r["size"]) for r in plan) == sorted((r[0], r[2]) for r in rows)
    sizes, got = defaultdict(int), defaultdict(int)
    for r in plan:
        sizes[r["source"]] += r["size"]
        got[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    for s, goal in water_level(sizes).items():
        assert abs(got[s] - goal) <= max(0.005 * goal, 60)
        assert {round(r["target"], 6) for r in plan if r["source"] == s} == {round(goal, 6)}
    again = mixing.taken(mixing.decide(frame.repartition(5), chunk)).collect()
    assert Counter(again) == Counter(plan)


def test_mix_keeps_columns_and_repeats_rows(spark, odd, none):
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in odd.collect()}
    assert mixing.mix(none).count() == 0 and mixing.decide(none.selectExpr("doc_id", "source", "0L as size")).count() == 0


def test_long_conversations(spark):
    """Many turns, roles that alternate and repeat, over several runs of parts."""
    rng = random.Random(8)
    rows = [(1, i, rng.choice(["user", "assistant"]), rng.choice(["a", "", "é𝄞", "<|end|>", "long text"])) for i in range(3 * chat.RUN + 1)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = out.select(chat.turns_of(out["formatted"]).alias("turns"), chat.masked(out["formatted"], out["loss"]).alias("m"), "loss").collect()[0]
    assert [(t["role"], t["text"]) for t in got["turns"]] == [r[2:] for r in rows]
    assert got["m"] == "".join(r[3] for r in rows if r[2] == "assistant")
    assert len(got["loss"]) == sum(r[2] == "assistant" for r in rows)


# tokens


@pytest.fixture(scope="module")
def counter():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return tokens.Counter(str(public_tokenizers.path("byte_bpe_50k.json")))


def test_tokens_equal_the_library(counter):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "a", "the", "é", "<|endoftext|>", "'s", "don't ", "\t", "123", "!!", "\x1c", "𝄞", " ab", "<|endo", "ftext|>"]
    assert counter.splittable
    for _ in range(800):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        want = len(counter.tokenizer.encode(text, add_special_tokens=False).ids)
        assert counter.count([text]) == [want]
        assert counter.count([text], limit=4, chunk=rng.randint(3, 20), overlap=rng.randint(1, 6)) == [want]
    long = "x" * 500 + " word and more" * 900
    assert counter.count([long], limit=100, chunk=64, overlap=2) == [len(counter.tokenizer.encode(long, add_special_tokens=False).ids)]


def test_splices_equal_the_library_without_spaces(counter):
    rng = random.Random(5)
    kinds = ["的一是不了人我在有他这为之大来，。！？", "abcdefghijklmnop", "abc123+/", "a'st", "='s ", "aA é\n\t ", "ab\u0301\u200d😀🏽", "'lrevstd "]
    for _ in range(1500):
        letters = rng.choice(kinds) if rng.random() < 0.6 else "".join(rng.sample(kinds, 3))
        parts = [rng.choice(letters) for _ in range(rng.randint(1, 300))]
        if rng.random() < 0.3:
            for _ in range(3):
                parts.insert(rng.randrange(len(parts) + 1), "<|endoftext|>")
        text = "".join(parts)
        assert counter.spliced(text, rng.choice([16, 32, 64]), rng.choice([1, 2, 4, 8])) == counter.encode([text])[0]


@pytest.mark.parametrize("letters", ["的一是不了人我在有他这为之大来以个中上们", "abcdefghijklmnopqrstuvwxyz0123456789+/", "a"])
def test_work_on_texts_without_spaces_is_linear(counter, monkeypatch, letters):
    rng = random.Random(6)
    text = "".join(rng.choice(letters) for _ in range(200_000))
    want, read = counter.encode([text])[0], []
    plain = counter.tokens
    monkeypatch.setattr(counter, "tokens", lambda t, b, e: read.append(e - b) or plain(t, b, e))
    assert counter.spliced(text, 4096, 64) == want
    assert sum(read) <= 8 * len(text)


def test_token_column_on_odd_rows(odd, none, counter):
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    for r in tokens.token_counts(odd, path).collect():
        assert r["n_tokens"] == len(counter.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)
    assert tokens.token_counts(none, path).count() == 0
    other = tokens.Counter(str(public_tokenizers.path("word_bpe_49k.json")))
    assert not other.splittable and other.count(["Some text", ""]) == other.encode(["Some text", ""])


# top k


@pytest.mark.parametrize("blocks", [{}, {"vectors": 40, "queries": 2}])
def test_top_k_equals_brute_force(spark, tmp_path, blocks):
    rng = np.random.default_rng(1)
    x = [[float(v) for v in rng.integers(-3, 4, 6) / 256] for _ in range(300)]
    rows = [(i, v, 0) for i, v in enumerate(x)] + [(50, x[3], 0), (None, x[4], 0), (100, None, 0), (150, [1.0, None], 0)]
    rows += [(200, [float("nan")] * 6, 0), (250, [float("inf")] * 6, 0), (300, [0.0] * 6, 0), (350, [1.0, 2.0], 0), (351, [-1.0, 2.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    frame.write.parquet(str(tmp_path / "v"))
    found = common.written(topk.components(spark.read.parquet(str(tmp_path / "v")), "vec_id", "embedding"))
    got = defaultdict(list)
    for r in topk.top_k(found, **blocks).orderBy("rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    good = [(i, np.floor(256 * np.array(v))) for i, v, _ in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    want = defaultdict(list)
    for a, (i, q) in enumerate(good):
        if i is None or i % 50:
            continue
        scores = [(int(q @ v), j) for b, (j, v) in enumerate(good) if b != a and len(v) == len(q)]
        want[i] += sorted(scores, key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:5]
    assert {k: Counter(v) for k, v in got.items()} == {k: Counter(v) for k, v in want.items()}
    assert topk.top_k(found.limit(0)).count() == 0


# personal data


PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            checks = (True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True)
            checks += (12 <= len(digits) <= 19 and pii.luhn(digits) if kind == 2 else True, 9 <= len(digits) <= 15 if kind == 3 else True)
            if all(checks):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    parts = ["a", ".", "@", "b-c", "1", "22", "255", " ", "-", "+", "(", ")", "+1 (988) 555-2485", "4348649190265535", "10.0.0.1", "é", "\n", "256", "a@b.c"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == plain_spans(text)
    pii.base_spans("a" * 300_000 + "1" * 300_000 + "@" * 1000)  # linear


def test_base_spans_of_long_zero_runs():
    zeros = "0" * 5000
    assert pii.base_spans(f"{zeros}.{zeros}1.2.255") == [(0, 1, 10008)]
    assert pii.base_spans(f"{zeros}256.0.0.0") == []


def test_tagger_gradients():
    rng = np.random.default_rng(0)
    model = pii.Tagger()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, y = rng.integers(0, pii.CLASSES, (3, 7)), np.zeros((3, 7), np.int64)
    y[0, 2:4], y[1, :3] = (1, 2), (3, 4, 4)
    _, grads = model.gradients(x, y)
    for key, grad in grads.items():
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        value = model.w[key][at]
        sides = []
        for sign in (1, -1):
            model.w[key][at] = value + sign * 1e-3
            sides.append(model.gradients(x, y)[0])
        model.w[key][at] = value
        assert abs((sides[0] - sides[1]) / 2e-3 - grad[at]) < 1e-3 * max(1, abs(grad[at]))


def test_windows_reconcile_to_the_whole():
    length = 400
    spans = [(40, 0, 60), (60, 0, 75), (90, 2, 160), (200, 3, 215), (390, 1, 400)]
    tags = pii.tagged(spans, length)
    tiles = np.arange(length // pii.STRIDE + 1)
    padded = np.concatenate([tags, np.zeros(pii.WINDOW, np.int8)])
    rows = np.array([padded[t * pii.STRIDE : t * pii.STRIDE + pii.WINDOW] for t in tiles])
    assert pii.reconciled(tiles, rows, length) == spans


def test_tagger_finds_what_the_patterns_miss(spark):
    """Held-out forms in held-out documents, and documents with no sign of personal data."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    tagger = pii.train(docs.filter("doc_id % 2 = 0"))
    held = [r["text"] for r in docs.filter("doc_id % 2 = 1 AND length(text) BETWEEN 100 AND 5000").collect()]
    plain = [t for t in held if not pii.signs(pii.classes(t)).size]
    rng = np.random.default_rng(99)
    texts, gold = [], []
    for kind, form in pii.forms(rng, 900):
        text = plain[rng.integers(len(plain))]
        at = text.find(" ", int(rng.integers(0, len(text) // 2))) + 1
        texts.append(text[:at] + form + " " + text[at:])
        gold.append((at, kind, at + len(form)))
    base = [pii.base_spans(t) for t in texts]
    assert not any(base)
    found = pii.added_spans(tagger, texts, base)
    assert pii.added_spans(tagger, plain, [[] for _ in plain]) == [[] for _ in plain]
    for kind in range(-1, len(pii.KINDS)):
        rows = [i for i, g in enumerate(gold) if g[1] == kind]
        caught = sum(any(k == kind and s < gold[i][2] and e > gold[i][0] for s, k, e in found[i]) for i in rows)
        if kind < 0:
            assert sum(bool(found[i]) for i in rows) <= 0.05 * len(rows)
        else:
            assert caught >= 0.8 * len(rows), pii.KINDS[kind]
    # two forms further apart than a window, and one over the edge of windows
    key = "0f" * 20
    text = plain[0][:40] + " " + key + " " + plain[1] + " " + key + " " + plain[2]
    spans = pii.added_spans(tagger, [text], [[]])[0]
    assert [text[s:e] for s, k, e in spans if pii.KINDS[k] == "key"] == [key, key]


def test_forms_are_missed_by_the_patterns_and_tagged_where_they_stand():
    rng = np.random.default_rng(4)
    for kind, form in pii.forms(rng, 300):
        assert not pii.base_spans(form)
        window, tags = pii.put_in(rng, "ab cd " * 16, "ef gh " * 16, kind, form)
        assert len(window) == len(tags) == pii.WINDOW
        tagged = "".join(c for c, t in zip(window, tags) if t)
        assert tagged in form and (bool(tagged) == (kind >= 0))
    assert pii.doubtful("see 1234 5678 9012 3456 there", "A" * 29) and pii.doubtful("me dot com", "A" * 10)
    assert not pii.doubtful("version 2.0 of 2024", "A" * 19)


def test_windows_are_those_with_signs():
    for text, has in (("all words", False), ("a dot b", True), ("DOT", True), ("dots anecdot", False), ("é7", True), ("x@y", True), ("", False)):
        assert bool(len(pii.windows(pii.classes(text)))) == has


def test_pii_on_odd_rows(odd, none, monkeypatch):
    monkeypatch.setattr(pii, "PASSED", 3000)
    tagger = pii.train(odd)
    for r in pii.find(odd, tagger).collect():
        base = pii.base_spans(r["text"] or "")
        assert {x for x in pii.joined(base).split(",") if x} <= set(r["spans"].split(",")) and r["n_email"] == sum(s[1] == 0 for s in base)
        assert r["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert r["n_spans"] == len([x for x in r["spans"].split(",") if x])
    assert pii.find(none, pii.train(none)).count() == 0


# benchmark


def test_decontamination_equals_exact_containment(spark):
    rng = random.Random(5)
    vocabulary = [f"t{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 9, 30, 60])))) for i in range(25)]
    items += [(90, None), (91, " "), (92, items[4][1])]
    docs = [(1000, None), (1001, ""), (None, "x " + items[7][1].upper())]
    for i in range(150):
        body = [rng.choice(vocabulary) for _ in range(rng.choice([3, 50, 900]))]
        if i % 2:
            piece = words(rng.choice(items[:25])[1])
            cut = rng.choice([len(piece), max(len(piece) * 9 // 10, 1), len(piece) // 2])
            body[1:1] = piece[:cut]
        docs.append((i, " ".join(body)))
    frame = spark.createDataFrame([d + (1, 2) for d in docs], "doc_id long, text string, shared int, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for d, text in docs:
        own = [w.lower().encode() for w in words(text)]
        for i, item in items:
            parts = decontaminate.shingle_set([w.lower().encode() for w in words(item)], 5)
            if parts:
                shared = len(parts & set(zip(*(own[k:] for k in range(len(next(iter(parts))))))))
                want[d, i, shared, len(parts)] += 5 * shared >= 4 * len(parts)
    want = +want
    for chars in (decontaminate.BLOCK_CHARS, 600):
        got = Counter((r["doc_id"], r["item_id"], r["shared"], r["item_shingles"]) for r in decontaminate.find(frame, bench, block_chars=chars).collect())
        assert got == want
    dirty = {d for d, *_ in want}
    kept = decontaminate.clean(frame, bench, block_chars=600)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _ in docs if d not in dirty)
    assert decontaminate.find(frame.limit(0), bench).count() == decontaminate.find(frame, bench.limit(0)).count() == 0


# Jaccard join


def brute_components(rows, width, percent):
    sets = []
    for _, text in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    least = {r: min((d for d in ids if d is not None), default=None) for r, ids in groups.items()}
    return Counter((rows[i][0], len(sets[i]), least[root(i)]) for i in range(len(rows)))


@pytest.mark.parametrize("width, percent, small", [(3, 90, jaccard.SMALL), (3, 90, 2), (5, 80, 3)])
def test_jaccard_equals_brute_force(spark, monkeypatch, width, percent, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    rng = random.Random(width + small)
    vocabulary = [f"v{i}" for i in range(120)]
    rows = [(1, None), (2, ""), (3, " "), (4, "A"), (5, "a"), (6, "a b"), (6, "a b"), (None, "a B"), (None, None)]
    for g in range(8):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 30, 60, 120]))]
        for _ in range(rng.choice([2, 5, 25])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((rng.randrange(10_000) * 10 + 7, " ".join(copy)))
    rows.append((9, "long " * 30_000))
    frame = spark.createDataFrame([r + (0, 1) for r in rows], "doc_id long, text string, n int, component string")
    out = jaccard.linked(frame, width=width, percent=percent)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect())
    assert got == brute_components(rows, width, percent)
    kept = jaccard.one_of_each(frame, width=width, percent=percent)
    groups = {(r["component"]) for r in out.collect() if r["component"] is not None}
    assert kept.columns == frame.columns and kept.count() == len(groups) + sum(not words(t) for _, t in rows)


def test_large_groups_are_folded_and_compared_across_components_only(spark):
    # shingle 1: one component; 2: a large one, a pair and two single classes; 3: a single class
    roots = {c: 100 for c in range(100, 140)} | {200: 200, 201: 200}
    rows = [(1, c, 50, c % 3) for c in range(100, 140)]
    rows += [(2, c, 50 + c % 4, c % 5) for c in [*range(100, 140), 200, 201, 300, 400]] + [(3, 100, 50, 0)]
    entries = spark.createDataFrame(rows + rows[:30], "shingle long, class long, n int, position int")
    groups = jaccard._groups(entries)
    assert {(r["shingle"], r["class"], r["n"], r["position"]) for r in groups.collect()} == set(rows[:-1])
    for s, members in ((1, 40), (2, 44)):
        centre = min((p, n, c) for t, c, n, p in rows if t == s)
        found = {(r["members"], tuple(r["centre"])) for r in groups.filter(f"shingle = {s}").collect()}
        assert found == {(members, centre)}
    mixed = jaccard._mixed(groups, spark.createDataFrame(list(roots.items()), "node long, root long"))
    assert {(r["shingle"], r["main"]) for r in mixed.collect()} == {(2, 100)} and mixed.count() == 44
    pairs = jaccard._pairs_apart(mixed, 80).collect()
    brute = jaccard._pairs(groups, groups, 80).collect()
    assert set(pairs) == {p for p in brute if roots.get(p["x"], p["x"]) != roots.get(p["y"], p["y"])}
    assert len(pairs) == len(set(pairs)) > 0


def test_jaccard_of_empty_table(none):
    assert jaccard.linked(none).count() == 0 and jaccard.one_of_each(none).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}


# pipeline


@needs_tables
def test_pipeline_stages(spark):
    docs = common.table(spark, FOLDER, "documents")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.written(stage(spark, docs, FOLDER))
        ids = Counter(r["doc_id"] for r in out.select("doc_id").collect())
        before = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        assert out.columns[:5] == docs.columns and set(ids) <= set(before)
        if k == 1:  # one of each component of the exact links, as brute force has them
            rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert set(ids) == {least for _, _, least in brute_components(rows, 5, 80)}
        if k == 2:
            bad = {r["doc_id"] for r in decontaminate.find(docs, common.table(spark, FOLDER, "benchmark")).collect()}
            assert set(ids) == set(before) - bad
        docs = out
    assert {"shard", "slot"} <= set(docs.columns) and docs.count() > 0
    again = corpus_pipeline.run(spark, FOLDER).select("doc_id", "shard", "slot").collect()
    assert Counter(again) == Counter(docs.select("doc_id", "shard", "slot").collect())


def test_pipeline_on_odd_rows(spark, odd, none, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench = spark.createDataFrame([(1, "a b c d e f g h"), (2, None)], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = common.written(stage(spark, docs, str(tmp_path)))
        assert "shard" in docs.columns
