"""Cross-tokenizer alignment, collocations and SimHash against brute force, with odd inputs."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tsengine.llm import alignment, collocation, simhash
from tsengine.llm.queries import ORACLE, QUERIES

tokenizers = pytest.importorskip("public_tokenizers")
PATHS = [str(tokenizers.path(f)) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
ODD = [None, "", " ", "  ", " a", "a ", "ONE", "one two", "a▁b", "<s>hi</s> <|endoftext|>", "x\n\n y\t\x00z", "中文没有空格" * 50, "a b c d e f g h", "a b c d e f g h"]
DOCS = "doc_id long, text string, lang string, fingerprint string, component_id string, n_a string, pairs string, phrase int, rank int"


def mixed_texts(n, seed=1):
    rng = random.Random(seed)
    parts = ["a", "the", "é", "中", " ", "  ", "\n", "\t", "\x00", "▁", "<s>", "1", "23", ".", "'s", "ﬁ", " ", "　", "😀", "́", "xxxxx", "\r\n", "\x85"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def frame(spark, texts, langs=None):
    rows = [(i if i % 7 else None, t, (langs or [None])[i % len(langs or [None])], "f", "c", "n", "p", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# -- alignment ----------------------------------------------------------------------------


def plain_groups(both, text):
    """Groups of one text from whole encodings; None without tokens."""
    if not text:
        return None
    ids = [both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)]
    raw = [[entries[i] for i in own] for own, entries in zip(ids, (both.bytes_a, both.bytes_b))]
    if any(b"".join(r) != (" " + text).encode() for r in raw):
        return None
    ends = [np.cumsum([len(b) for b in r]).tolist() for r in raw]
    out, low = [], [0, 0]
    for cut in sorted(set(ends[0]) & set(ends[1])):
        high = [e.index(cut) + 1 for e in ends]
        out.append([own[lo:hi] for own, lo, hi in zip(ids, low, high)])
        low = high
    return out


def written_out(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


@pytest.mark.parametrize("most", [3, 1 << 16])
def test_groups_equal_those_of_whole_encodings(most):
    both = alignment.pair(*PATHS)
    texts = ODD + mixed_texts(1500)
    for text, tally in zip(texts, alignment.align(both, texts, shown=True, most=most)):
        want = plain_groups(both, text)
        assert (tally is None) == (want is None), text
        if want:
            assert "".join(tally.groups) == written_out(want)
            assert (tally.n_a, tally.n_b, tally.n_groups) == (sum(len(a) for a, _ in want), sum(len(b) for _, b in want), len(want))
            assert Counter(dict(zip(*(x.tolist() for x in tally.joined())))) == Counter(a[-1] * both.size_b + b[-1] for a, b in want)


def test_table_of_segments_may_be_cleared():
    both = alignment.Pair(*PATHS)
    texts = mixed_texts(60, 5)
    want = [t and t.digest.hexdigest() for t in alignment.align(both, texts)]
    both.clear()
    assert [t and t.digest.hexdigest() for x in texts for t in alignment.align(both, [x])] == want


def test_overlaps_are_all_pairs_that_share_bytes():
    rng = np.random.default_rng(4)
    cuts = [np.sort(np.append(rng.choice(np.delete(np.arange(1, 200), 99), 59, replace=False), 100)) for _ in "ab"]  # documents meet at 100
    starts = [np.append(0, c) for c in cuts]
    ends = [np.append(c, 200) for c in cuts]
    docs = [(s >= 100).astype(int) for s in starts]
    a, b = alignment.overlaps(starts[0], docs[0], starts[1], docs[1])
    got = set(zip(a.tolist(), b.tolist()))
    assert got == {(i, j) for i in range(61) for j in range(61) if max(starts[0][i], starts[1][j]) < min(ends[0][i], ends[1][j])}


@pytest.mark.parametrize("sent", [0, 1 << 22])
def test_alignment_counts(spark, sent):
    both, texts = alignment.pair(*PATHS), ODD + mixed_texts(60, 2) + ["the cat sat on the mat"] * 5
    docs = frame(spark, texts)
    rows = alignment.written(alignment.aligned(docs, *PATHS, keep=["doc_id", "phrase"], groups=True))
    got = alignment.scored(rows, alignment.pair_counts(rows, both.size_b), sent).collect()
    groups = [plain_groups(both, t) for t in texts]
    counts = Counter((a[-1], b[-1]) for g in groups if g for a, b in g)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    want = Counter()
    for g in groups:
        linked = [(a[-1], b[-1]) for a, b in g or []]
        digest = hashlib.sha256(written_out(g).encode()).hexdigest() if g else ""
        want[(len(linked), digest, sum(counts[p] == highest[p[1]] for p in linked), sum(counts[p] for p in linked))] += 1
    assert Counter((r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in got) == want
    assert len(got) == len(texts) and all(r.phrase == 1 for r in got)


def test_alignment_of_nothing(spark):
    rows = alignment.written(alignment.aligned(frame(spark, []), *PATHS, keep=["doc_id"]))
    assert alignment.scored(rows, alignment.pair_counts(rows, 32000)).count() == 0


# -- collocations -------------------------------------------------------------------------


def plain_collocations(rows, least, top, percent):
    ones, grams = Counter(), Counter()
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            ones.update((lang or "und", x) for x in w)
            for k in (2, 3):
                grams.update((lang or "und", *w[i : i + k]) for i in range(len(w) - k + 1))
    f = ones + grams
    total = Counter()
    for (lang, _), n in ones.items():
        total[lang] += n
    often = {g: a for g, a in grams.items() if a >= least}
    out = []
    for (lang, *words), a in often.items():
        longer = [n for g, n in often.items() if g[0] == lang and len(g) - 1 > len(words) and any(list(g[i : i + len(words)]) == words for i in range(1, len(g) - len(words) + 1))]
        if any(100 * n >= percent * a for n in longer):
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = f[(lang, *words[:k])], f[(lang, *words[k:])]
            cuts.append((1000000 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), l, r))
    out.sort()
    ranks, got = Counter(), set()
    for lang, score, a, phrase, l, r in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            got.add((lang, ranks[lang], phrase.decode(), -a, l, r, total[lang], -score))
    return got


def word_soup(n, seed):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "é", "中", "x\x1c", "a-b", " q"] + [f"w{i}" for i in range(12)]
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!"]
    soup = ["".join(rng.choice(vocabulary) + rng.choice(ends) for _ in range(rng.randint(0, 120))) for _ in range(n)]
    return soup + ["new york city hall " * 40, None, "", " . , ", "tail", "the the the the the " * 30]


@pytest.mark.parametrize("heavy, budget, held", [(1 << 18, 1 << 21, 1 << 21), (20, 50, 300)])
def test_collocations_equal_brute_force(spark, monkeypatch, heavy, budget, held):
    for k, v in (("HEAVY", heavy), ("BUDGET", budget), ("HELD", held)):
        monkeypatch.setattr(collocation, k, v)
    texts, langs = word_soup(40, 3), ["en", None, "de", "und"]
    rows = [(langs[i % 4], t) for i, t in enumerate(texts)]
    got = collocation.collocations(frame(spark, texts, langs), least=3, top=50).collect()
    assert {(r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == plain_collocations(rows, 3, 50, 50)


def test_collocations_of_nothing(spark):
    assert collocation.collocations(frame(spark, [])).count() == 0
    assert collocation.collocations(frame(spark, [None, "", "one"])).count() == 0


def test_words_at_the_ends_of_texts_stay_apart(spark):
    found, _ = collocation.words(frame(spark, ["alpha", "beta", "alpha", "al"], ["en"]))
    assert {(r.word, r.f) for r in found.collect()} == {("alpha", 2), ("beta", 1), ("al", 1)}


def test_subtree_counts_are_leaf_totals():
    rng = np.random.default_rng(2)
    columns = [rng.integers(0, 4, 500).astype(np.uint64) for _ in range(3)]
    tree = collocation.Subtree(columns, np.ones(500, np.int64))
    for depth in (1, 2, 3):
        labels, totals = tree.nodes(depth)
        assert dict(zip(zip(*(c.tolist() for c in labels)), totals.tolist())) == Counter(zip(*(c.tolist() for c in columns[:depth])))


def test_heavy_prefixes_are_extended():
    columns = [np.repeat(np.uint64(7), 1000), np.arange(1000, dtype=np.uint64) % np.uint64(50)]
    heavy = np.sort(collocation.phrase_hash([np.array([7], np.uint64)]))
    assert len(set(collocation.groups_of(columns, [np.zeros(0, np.uint64)], 16))) == 1
    assert len(set(collocation.groups_of(columns, [heavy], 16))) > 8


# -- SimHash ------------------------------------------------------------------------------


def plain_print(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    width = min(width, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(prints, ids, radius=2):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(prints))]


def test_fingerprints(monkeypatch):
    monkeypatch.setattr(simhash, "HASHES", 50)
    texts = ODD + mixed_texts(200, 9) + word_soup(20, 4)
    assert simhash.fingerprints(pa.array(texts)).tolist() == [plain_print(t) for t in texts]


def test_fingerprint_hash_is_the_one_of_spark(spark):
    assert spark.sql("select xxhash64('a b ü') h").first().h % 2**64 == xxhash.xxh64_intdigest("a b ü", 42)


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_search_equals_all_distances(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 6, dtype=np.uint64)
    points = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for c in centres]))
    rng.shuffle(points)
    starts = np.array([0, len(points) // 3, len(points) // 2])
    forest = simhash.Forest(points, starts)
    x, y = forest.within(np.arange(len(points)), 2)
    shard = np.searchsorted(starts, np.arange(len(points)), "right")
    near = (np.bitwise_count(points[:, None] ^ points[None, :]) <= 2) & (shard[:, None] == shard[None, :])
    want = {(i, j) for i, j in zip(*np.nonzero(near)) if i < j}
    assert set(zip(x.tolist(), y.tolist())) == want and len(want) > 100


@pytest.mark.parametrize("most", [40, 4096])
def test_near_duplicates_equal_brute_force(spark, most):
    """Chains of one-word edits, groups of copies and a dense cloud; a small ``most`` cuts shards again."""
    rng = random.Random(8)
    base = [[f"v{rng.randrange(300)}" for _ in range(300)] for _ in range(6)]
    texts = ODD + [" ".join(b) for b in base for _ in range(3)]
    for b in base:
        for _ in range(25):
            b[rng.randrange(300)] = f"v{rng.randrange(300)}"
            texts.append(" ".join(b))
    docs = frame(spark, texts)
    got = simhash.near_duplicates(docs, most=most).collect()
    ids = [i if i % 7 else None for i in range(len(texts))]
    prints = [plain_print(t) for t in texts]
    want = Counter(zip(ids, [f"{p:016x}" for p in prints], components_of(prints, ids)))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert len({r.component_id for r in got}) < len(set(prints))


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    one = simhash.near_duplicates(frame(spark, [None])).first()
    assert one.fingerprint == "0" * 16 and one.component_id is None


def test_narrower_masks_keep_every_close_pair():
    rng = random.Random(1)
    for lead in (6, 64):
        for _ in range(200):
            x = rng.getrandbits(64)
            y = x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            masks = simhash.narrower(0, 2, lead)
            hit = [m for m in masks if x & m == y & m]
            assert hit
            finer = [k for m in hit for k in simhash.narrower(m, 2)]
            assert any(x & k == y & k for k in finer)


def test_registered():
    names = {"op11_alignment", "op12_collocation", "op13_simhash"}
    assert names <= set(QUERIES) and set(ORACLE) & names == {"op12_collocation"}
