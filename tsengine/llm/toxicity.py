"""Toxicity: a convolutional text classifier trained in numpy.

Every word has two hashed embeddings, from two parts of its hash, laid side by side: a rare word
shares one of them with other words often and both hardly ever. Filters over one, two and three
words, rectified and max-pooled over the whole text, feed a logistic unit. The embeddings start
from the words' smoothed log odds in the training texts, then all weights are trained together.
Scores are calibrated on rows held back from training, and a decision threshold is set for each
language.

All labelled rows take part, in full. The rows are dealt to learners of some ``LEARNER_ROWS`` rows
each; in an epoch every learner descends on its own rows, read as a stream, from the same weights,
and the weights that it changed are averaged. Sums are taken in fixed point, so their order does not
matter. Only weights, whose number is fixed, pass through the driver.

Defined results: a null or empty text has no words, so all pooled features are zero and it scores
as the intercept says; a text of any length is scored whole, in pieces that overlap by the widest
filter; equal texts score equally. With no labelled rows of one class every text has the share of
label 1 as its score. Input columns named like an output give way to it.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsengine.llm.common import crc_of_id, map_texts, small_batches, table, written
from tsengine.llm.hashing import SPACES, Words
from tsengine.llm.labelled import class_shares, in_fold, labelled_rows, logistic_fit_rows, sigmoid

#: Rows of one learner, on average; a longer corpus has more learners.
LEARNER_ROWS = 4096
#: Texts of one step, and words after which a step is taken with fewer.
STEP_TEXTS, STEP_WORDS = 48, 1 << 20
#: Buckets whose weights travel together, and the fixed point of their sums.
BLOCK, POINT = 1 << 10, 2.0**20
BITS, DIM, WIDTHS, FILTERS = 16, 8, (1, 2, 3), 8
PIECE_WORDS = 1 << 15
#: A language with fewer calibration rows of either class keeps the threshold 0.5.
LEAST_ROWS = 8
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def _words() -> Words:
    return Words(lower=True, drop=SPACES + _PUNCTUATION)


def _buckets(hashes: np.ndarray) -> np.ndarray:
    mask = np.uint64((1 << BITS) - 1)
    return np.stack([hashes & mask, (hashes >> np.uint64(32)) & mask], 1).astype(np.int32)


class Model:
    """Embeddings (2, 2**BITS, DIM), one weight block per width, and the logistic unit."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        f32 = np.float32
        self.embed = (rng.normal(0, 0.02, (2, 1 << BITS, DIM))).astype(f32)
        self.conv = [rng.normal(0, 0.15, (w, 2 * DIM, FILTERS)).astype(f32) for w in WIDTHS]
        self.bias = [np.full(FILTERS, -0.1, f32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(f32)
        self.offset = f32(0)
        self.scale, self.shift = 1.0, 0.0

    def vectors(self, buckets: np.ndarray) -> np.ndarray:
        return np.concatenate([self.embed[0][buckets[:, 0]], self.embed[1][buckets[:, 1]]], 1)

    def activations(self, x: np.ndarray, k: int, ends: np.ndarray) -> np.ndarray:
        """Rectified filter values at every word; windows that leave the text are zero."""
        z = np.full((len(x), FILTERS), self.bias[k], np.float32)
        for i in range(WIDTHS[k]):
            z[: len(x) - i] += x[i:] @ self.conv[k][i]
        np.maximum(z, 0, out=z)
        for i in range(1, WIDTHS[k]):
            at = ends - i
            z[at[at >= 0]] = 0
        return z

    def pooled(self, buckets: np.ndarray, bounds: np.ndarray, places: bool = False):
        """Max of every filter over each whole text; with ``places``, also the first word where it is."""
        out = np.zeros((len(bounds) - 1, len(WIDTHS) * FILTERS), np.float32)
        where = np.repeat(bounds[:-1, None], out.shape[1], 1).astype(np.int64) if places else None
        over = max(WIDTHS) - 1
        lo = 0
        while lo < len(out):
            hi = max(int(np.searchsorted(bounds, bounds[lo] + PIECE_WORDS, "right")) - 1, lo + 1)
            for s in range(int(bounds[lo]), max(int(bounds[hi]), int(bounds[lo]) + 1), PIECE_WORDS):
                e = min(s + PIECE_WORDS + over, int(bounds[hi]))
                inner = np.clip(bounds[lo : hi + 1], s, e) - s
                full = np.flatnonzero(inner[1:] > inner[:-1])
                if not len(full):
                    continue
                x = self.vectors(buckets[s:e])
                for k in range(len(WIDTHS)):
                    z = self.activations(x, k, inner[1:][full])
                    part = slice(k * FILTERS, (k + 1) * FILTERS)
                    best = np.maximum.reduceat(z, inner[:-1][full])
                    if places:
                        text = np.repeat(np.arange(len(full)), inner[1:][full] - inner[:-1][full])
                        hit = z >= best[text]
                        first = np.where(hit, np.arange(len(z))[:, None], len(z))
                        first = s + np.minimum.reduceat(first, inner[:-1][full])
                        where[lo + full, part] = np.where(best > out[lo + full, part], first, where[lo + full, part])
                    out[lo + full, part] = np.maximum(out[lo + full, part], best)
            lo = hi
        return (out, where) if places else out

    def raw(self, buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return (self.pooled(buckets, bounds) @ self.out + self.offset).astype(np.float64)

    def score(self, buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * self.raw(buckets, bounds) + self.shift)


def _presence(buckets: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of texts of each label with each bucket: (2 parts, 2 labels, 2**BITS)."""
    out = np.zeros((2, 2, 1 << BITS), np.int64)
    text = np.repeat(np.arange(len(y)), np.diff(bounds))
    for j in range(2):
        seen = np.unique(text * (1 << BITS) + buckets[:, j])
        label, bucket = y[seen >> BITS], seen & ((1 << BITS) - 1)
        for v in (0, 1):
            out[j, v] = np.bincount(bucket[label == v], minlength=1 << BITS)
    return out


def _start(model: Model, presence: np.ndarray, n: np.ndarray) -> None:
    """First coordinate of every embedding: shrunk log odds of the bucket's presence in a text."""
    for j in range(2):
        c = presence[j]
        odds = np.log((c[1] + 0.5) / (n[1] + 1)) - np.log((c[0] + 0.5) / (n[0] + 1))
        total = c[0] + c[1]
        model.embed[j, :, 0] = np.clip(odds * total / (total + 5.0), -2, 4) / 4
    for k in range(len(WIDTHS)):
        model.conv[k][0][0, 0] = model.conv[k][0][DIM, 0] = 1.0
        model.bias[k][0] = -0.8
        model.out[k * FILTERS] = 1.0
    model.offset = np.float32(-1.0)


class _Adam:
    def __init__(self, shape: tuple, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.01 * (gradient * gradient - self.v)
        m, v = self.m / (1 - 0.9**self.t), self.v / (1 - 0.99**self.t)
        return -self.rate * m / (np.sqrt(v) + 1e-6)


class _Descent:
    """A model under training with what its steps remember."""

    def __init__(self, model: Model, n: np.ndarray, rate: float = 0.02):
        self.model = model
        self.touch = np.full(model.embed.shape[:2], 1e-3, np.float32)
        self.conv = [_Adam(c.shape, rate) for c in model.conv]
        self.bias = [_Adam(b.shape, rate) for b in model.bias]
        self.head = _Adam((len(model.out) + 1,), rate)
        self.balance = 0.5 / np.maximum(np.asarray(n) / max(sum(n), 1), 1e-9)
        self.seen = np.zeros(self.touch.shape, bool)

    def dense(self) -> np.ndarray:
        """All that is not kept by bucket, end to end.

        Second moments go as their roots. These are as large as the first moments and the steps divide by them, so
        fixed point is fine enough for both; the moments themselves are so small that rounding turns them negative.
        """
        model, rules = self.model, [*self.conv, *self.bias, self.head]
        weights = [*model.conv, *model.bias, model.out, np.float32(model.offset)]
        moments = [x for r in rules for x in (r.m, np.sqrt(r.v), r.t)]
        return np.concatenate([np.ravel(x).astype(np.float64) for x in (*weights, *moments)])

    def set_dense(self, values: np.ndarray) -> None:
        at = 0

        def take(like):
            nonlocal at
            at += np.size(like)
            return values[at - np.size(like) : at].reshape(np.shape(like)).astype(np.float32)

        model = self.model
        model.conv, model.bias = [take(x) for x in model.conv], [take(x) for x in model.bias]
        model.out, model.offset = take(model.out), np.float32(take(model.offset))
        for r in (*self.conv, *self.bias, self.head):
            r.m, r.v, r.t = take(r.m), np.square(take(r.v)), float(take(r.t))

    def step(self, buckets: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> None:
        """One step on whole texts. The gradient of a max reaches only the words where the max was."""
        if not len(buckets):
            return
        model = self.model
        pooled, where = model.pooled(buckets, bounds, places=True)
        p = sigmoid(pooled @ model.out + model.offset)
        g = ((p - y) * self.balance[y] / len(y)).astype(np.float32)
        through = g[:, None] * model.out * (pooled > 0)
        change = self.head.step(np.append(pooled.T @ g + 1e-4 * model.out, g.sum()).astype(np.float32))
        at, grad = [], []
        for k, width in enumerate(WIDTHS):
            d = through[:, k * FILTERS : (k + 1) * FILTERS]
            t, f = np.nonzero(d)
            pos, d = where[t, k * FILTERS + f], d[t, f]
            dw = np.zeros_like(model.conv[k])
            for i in range(width):
                inside = pos + i < len(buckets)
                here = pos[inside] + i
                np.add.at(dw[i].T, f[inside], d[inside, None] * model.vectors(buckets[here]))
                at.append(here)
                grad.append(d[inside, None] * model.conv[k][i].T[f[inside]])
            model.conv[k] += self.conv[k].step(dw)
            model.bias[k] += self.bias[k].step(np.bincount(f, d, FILTERS).astype(np.float32))
        model.out += change[:-1]
        model.offset += change[-1]
        at, grad = np.concatenate(at), np.concatenate(grad)
        for j in range(2):
            b, back = np.unique(buckets[at, j], return_inverse=True)
            total = np.zeros((len(b), DIM), np.float32)
            np.add.at(total, back, grad[:, j * DIM : (j + 1) * DIM])
            self.touch[j, b] += (total * total).mean(1)
            model.embed[j, b] -= 0.05 * total / np.sqrt(self.touch[j, b])[:, None]
            self.seen[j, b] = True


def fit(texts: list[str], y: np.ndarray, seed: int = 5, epochs: int = 4, batch: int = STEP_TEXTS) -> Model:
    """Train on whole texts that are at hand."""
    hashes, bounds = _words()(pa.array(texts, pa.large_string()))
    buckets = _buckets(hashes)
    model = Model(seed)
    n = np.bincount(y, minlength=2)
    _start(model, _presence(buckets, bounds, y), n)
    rng = np.random.default_rng(seed)
    work = _Descent(model, n)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            some = order[lo : lo + batch]
            rows = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in some]).astype(np.int64)
            work.step(buckets[rows], np.append(0, np.cumsum(np.diff(bounds)[some])), y[some])
    return model


def _packed(hashes: np.ndarray) -> np.ndarray:
    """Both buckets of a word in one 32-bit number."""
    both = _buckets(hashes).astype(np.uint32)
    return (both[:, 0] | (both[:, 1] << np.uint32(BITS))).view(np.int32)


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and bounds of a list column that ``_packed`` made."""
    both = column.flatten().to_numpy(zero_copy_only=False).view(np.uint32)
    bounds = np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
    mask = np.uint32((1 << BITS) - 1)
    return np.stack([both & mask, both >> np.uint32(BITS)], 1).astype(np.int32), bounds


def _hashed(rows: DataFrame, learners: int) -> DataFrame:
    """The rows with their words hashed, dealt to learners and written once, each learner's in an order without pattern."""

    def build():
        words = _words()

        def work(texts):
            hashes, bounds = words(texts)
            return [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(_packed(hashes)))]

        return work

    def drawn(i: int) -> Column:
        return F.xxhash64("doc_id", F.lit(i))

    rows = rows.select("doc_id", "y", "lang", "text", (F.pmod(drawn(1), F.lit(4)) == 3).alias("held"), F.pmod(drawn(2), F.lit(learners)).alias("learner"))
    made = map_texts(rows, "text", [T.StructField("words", T.ArrayType(T.IntegerType()))], build, ["doc_id", "y", "lang", "held", "learner"])
    made = made.repartition(learners, "learner").sortWithinPartitions("held", "learner", drawn(3), "doc_id")
    return written(made.drop("doc_id"))


def _blocks(df: DataFrame, run) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Weight and weighted sum of each bucket's numbers over all tasks, by block.

    ``run`` maps the Arrow batches of a task to tuples of block, weight, places in the block and
    numbers for each place. The tasks' numbers are added in fixed point a few blocks a task, so what reaches the driver
    is one weight and one sum for each place, however many tasks there were.
    """
    names, kinds = ["block", "weight", "at", "numbers"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def emit(batches):
        for block, weight, at, numbers in run(batches):
            cells = (block, weight, at.astype(np.int32).tobytes(), numbers.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names=names)

    def add(batches):
        totals = {}
        for batch in batches:
            for block, weight, at, numbers in zip(*[c.to_pylist() for c in batch.columns]):
                at = np.frombuffer(at, np.int32)
                numbers = np.frombuffer(numbers, np.float32).reshape(len(at), -1)
                weights, sums = totals.setdefault(block, (np.zeros(BLOCK, np.int64), np.zeros((BLOCK, numbers.shape[1]), np.int64)))
                weights[at] += weight
                sums[at] += np.rint(numbers.astype(np.float64) * (weight * POINT)).astype(np.int64)
        for block, (weights, sums) in totals.items():
            cells = (block, 0, weights.tobytes(), sums.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names=names)

    schema = "block int, weight long, at binary, numbers binary"
    parts = df.mapInArrow(emit, schema).repartition("block").mapInArrow(add, schema).collect()
    out = {}
    for r in parts:
        weights = np.frombuffer(r["at"], np.int64)
        out[r["block"]] = (weights, np.frombuffer(r["numbers"], np.int64).reshape(BLOCK, -1) / POINT)
    return out


def _counted(learn: DataFrame) -> np.ndarray:
    """``_presence`` of all rows."""

    def run(batches):
        total = np.zeros((2, 2, 1 << BITS), np.int64)
        for batch in batches:
            total += _presence(*_unpacked(batch.column(1)), batch.column(0).to_numpy().astype(np.int64))
        for j in range(2):
            for lo in range(0, 1 << BITS, BLOCK):
                counts = total[j, :, lo : lo + BLOCK]
                at = np.flatnonzero(counts.any(0))
                if len(at):
                    # float32 holds 16 bits of a count exactly
                    yield (j << BITS | lo) // BLOCK, 1, at, np.stack([counts[0] & 0xFFFF, counts[0] >> 16, counts[1] & 0xFFFF, counts[1] >> 16], 1)[at]

    out = np.zeros((2, 1 << BITS, 2), np.int64)
    for block, (_, sums) in _blocks(learn.select("y", "words"), run).items():
        j, lo = divmod(block * BLOCK, 1 << BITS)
        out[j, lo : lo + BLOCK] = np.rint(sums[:, ::2] + sums[:, 1::2] * 65536)
    return out.transpose(0, 2, 1)


def _steps(batches):
    """Learner, buckets, bounds and labels of each step from Arrow batches of learner, y and words."""
    learner, words, labels = None, [], []

    def made():
        buckets, bounds = _unpacked(pa.concat_arrays(words))
        return learner, buckets, bounds, np.concatenate(labels)

    for batch in batches:
        owner = batch.column(0).to_numpy()
        y = batch.column(1).to_numpy().astype(np.int64)
        size = np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(y):
            if learner != owner[lo]:
                if words:
                    yield made()
                learner, words, labels = owner[lo], [], []
            held = sum(len(w) for w in words)
            room = STEP_WORDS - sum(len(w.flatten()) for w in words) + (size[lo - 1] if lo else 0)
            hi = min(lo + STEP_TEXTS - held, lo + int(np.argmax(np.append(owner[lo:], -1) != learner)), max(int(np.searchsorted(size, room, "right")), lo + 1))
            words.append(batch.column(2).slice(lo, hi - lo))
            labels.append(y[lo:hi])
            if held + hi - lo >= STEP_TEXTS or (hi < len(y) and size[hi] > room):
                yield made()
                words, labels = [], []
            lo = hi
    if words:
        yield made()


def _epoch(learn: DataFrame, work: _Descent) -> None:
    """Every learner descends on its rows once; the weights that any of them changed become their mean, by rows."""
    shared = learn.sparkSession.sparkContext.broadcast(work)  # a fixed number of weights

    def run(batches):
        def changes():
            for j in range(2):
                change = np.column_stack([mine.model.embed[j] - start.model.embed[j], mine.touch[j] - start.touch[j]])
                for lo in range(0, 1 << BITS, BLOCK):
                    at = np.flatnonzero(mine.seen[j, lo : lo + BLOCK])
                    if len(at):
                        yield (j << BITS | lo) // BLOCK, n, at, change[lo + at]
            dense = mine.dense() - start.dense()
            for lo in range(0, len(dense), BLOCK):
                part = dense[lo : lo + BLOCK]
                yield (2 << BITS | lo) // BLOCK, n, np.arange(len(part)), part

        start, learner, mine, n = shared.value, None, None, 0
        for owner, *texts in _steps(batches):
            if mine is None or owner != learner:
                if mine is not None:
                    yield from changes()
                learner, mine, n = owner, copy.deepcopy(start), 0
            mine.step(*texts)
            n += len(texts[-1])
        if mine is not None:
            yield from changes()

    dense = work.dense()
    for block, (weights, sums) in _blocks(learn.select("learner", "y", "words"), run).items():
        mean = sums / np.maximum(weights, 1)[:, None]
        j, lo = divmod(block * BLOCK, 1 << BITS)
        if j < 2:
            work.model.embed[j, lo : lo + BLOCK] += mean[:, :DIM].astype(np.float32)
            work.touch[j, lo : lo + BLOCK] += mean[:, DIM].astype(np.float32)
        else:
            dense[lo : lo + BLOCK] += mean[: len(dense) - lo, 0]
    work.set_dense(dense)
    shared.destroy()


class Toxicity:
    """A fitted model with the share of label 1 and the thresholds by language."""

    def __init__(self, model: Model | None, share: float, thresholds: dict[str, float]):
        self.model, self.share, self.thresholds = model, share, thresholds

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.model is None:
            return np.full(len(texts), self.share)
        hashes, bounds = self.words(texts)
        return self.model.score(_buckets(hashes), bounds)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "words"}

    def __setstate__(self, state):
        self.__dict__ |= state

    def __getattr__(self, item):
        if item == "words":
            self.words = _words()
            return self.words
        raise AttributeError(item)


def train(docs: DataFrame, labels: DataFrame, rows: Column) -> Toxicity:
    """Fit on all labelled rows that meet ``rows`` (a condition on doc_id).

    Three quarters of them set the weights. The last quarter calibrates the score, weighted to the
    class shares of all labelled rows, and sets each language's threshold at the best F1. Where
    either part lacks a class, all rows do both.
    """
    texts, ids = labelled_rows(docs, labels, "toxic", rows)
    shares = class_shares(ids)
    if ids.min() == 0:
        return Toxicity(None, float(shares[1]), {})
    small_batches(docs.sparkSession)
    learners = max(1, round(int(ids.sum()) * 3 / 4 / LEARNER_ROWS))
    known = _hashed(texts, learners)
    counts = np.zeros((2, 2), np.int64)
    for r in known.groupBy("held", "y").agg(F.count("*").alias("n")).collect():
        counts[int(r["held"]), r["y"]] = r["n"]
    if counts.sum(0).min() == 0:
        return Toxicity(None, float(shares[1]), {})
    split = counts.min() > 0
    learn, check = (known.filter(~F.col("held")), known.filter("held")) if split else (known, known)
    n, drawn = (counts[0], counts[1]) if split else (counts.sum(0), counts.sum(0))
    model = Model()
    _start(model, _counted(learn), n)
    work = _Descent(model, n)
    for _ in range(int(np.clip(20_000 * learners // max(n.sum(), 1), 3, 12))):
        _epoch(learn, work)
    raw = written(_raw(check, model))
    weights = shares * drawn.sum() / drawn
    model.scale, model.shift = logistic_fit_rows(raw.select(F.array("raw").alias("x"), "y"), 1, weights, ridge=0.05)
    return Toxicity(model, float(shares[1]), _thresholds(_calibrated(raw, model), weights))


def _raw(rows: DataFrame, model: Model) -> DataFrame:
    """``lang``, ``y`` and the model's output before calibration."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            raw = pa.array(shared.value.raw(*_unpacked(batch.column(2))), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), raw], names=["lang", "y", "raw"])

    return rows.select("lang", "y", "words").mapInArrow(run, "lang string, y int, raw double")


def _calibrated(raw: DataFrame, model: Model) -> DataFrame:
    scale, shift = model.scale, model.shift

    def run(batches):
        for batch in batches:
            score = pa.array(sigmoid(scale * batch.column(2).to_numpy() + shift), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), score], names=["lang", "y", "score"])

    return raw.select("lang", "y", "raw").mapInArrow(run, "lang string, y int, score double")


def _thresholds(scored: DataFrame, weights: np.ndarray) -> dict[str, float]:
    """The cut of the best F1 for each language: midway between two scores, or 0.5; of equals the one nearest to 0.5.

    Scores are dealt by range, so that no language has to fit one task: running counts within a
    range start from those of the ranges above it.
    """
    both = ("pos", "neg")
    scored = scored.filter(F.col("lang").isNotNull())
    classes = [F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")]
    cells = scored.groupBy("lang", "score").agg(*classes)
    cells = written(cells.repartitionByRange("lang", "score").withColumn("part", F.spark_partition_id()))
    ranges = cells.groupBy("lang", "part").agg(*[F.sum(c).alias(c) for c in both], F.max("score").alias("top"))
    lang = Window.partitionBy("lang")
    above = lang.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        "lang",
        "part",
        F.lag("top").over(lang.orderBy("part")).alias("under"),
        *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in both],
    )
    inside = Window.partitionBy("lang", "part")
    onward = inside.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the next score below is the one that follows in falling order
    under = F.coalesce(F.lead("score").over(inside.orderBy(F.desc("score"))), F.col("under"))
    cuts = cells.join(ranges, ["lang", "part"]).select(
        "lang", ((F.col("score") + under) / 2).alias("cut"), *[(F.sum(c).over(onward) + F.col(f"{c}_above")).alias(c) for c in both]
    )
    half = cells.filter(F.col("score") >= 0.5).groupBy("lang").agg(F.lit(0.5).alias("cut"), *[F.sum(c).alias(c) for c in both])
    totals = cells.groupBy("lang").agg(*[F.sum(c).alias(f"all_{c}") for c in both])
    totals = totals.filter(F.least("all_pos", "all_neg") >= LEAST_ROWS)
    w0, w1 = (F.lit(float(w)) for w in weights)
    cuts = cuts.filter(F.col("cut").isNotNull()).unionByName(half).join(totals, "lang")
    f1 = 2 * w1 * F.col("pos") / (w1 * F.col("pos") + w0 * F.col("neg") + w1 * F.col("all_pos"))
    best = F.max_by("cut", F.struct(F.round(f1, 12), -F.abs(F.col("cut") - 0.5), -F.col("cut")))
    return {r["lang"]: r["cut"] for r in cuts.groupBy("lang").agg(best.alias("cut")).collect()}


def score(docs: DataFrame, model: Toxicity, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) and ``score``, label 1 likelier the higher."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # a fixed number of weights

    def build():
        fitted = shared.value
        return lambda texts: [pa.array(fitted.score(texts), pa.float64())]

    return map_texts(docs, text, [T.StructField("score", T.DoubleType())], build, keep)


def flag(scored: DataFrame, model: Toxicity, lang: str = "lang") -> DataFrame:
    """``threshold`` of the row's language (others: 0.5) and ``flagged``: the score reaches it."""
    threshold = F.lit(0.5)
    for code, cut in sorted(model.thresholds.items()):
        threshold = F.when(F.col(lang) == code, cut).otherwise(threshold)
    return scored.withColumn("threshold", threshold).withColumn("flagged", F.col("score") >= F.col("threshold"))


def op1_toxicity(spark, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = train(docs, labels, ~in_fold(5, 0))
    rows = docs.select("doc_id", "lang", (crc_of_id() % 5 == 0).alias("held_out"), "text")
    rows = flag(score(rows, model, keep=["doc_id", "lang", "held_out"]), model)
    predicted = (F.col("score") >= 0.5).cast("int")
    return rows.select("doc_id", "held_out", "score", predicted.alias("predicted"), "threshold", "flagged")
