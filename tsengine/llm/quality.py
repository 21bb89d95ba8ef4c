"""Quality: a compression classifier.

Two zstandard dictionaries are built, one from good and one from bad labelled texts. Every whole
text is compressed with both, in chunks, so that the dictionary and not the text's own beginning
explains each chunk. The difference of the two compressed sizes over their sum, with the share of
the text's bytes that remains under the good dictionary, is calibrated to the chance of label 1.
Only compressed sizes and the length enter the score.

Defined results: a null or empty text has no bytes and gets the share of label 1 as its score;
texts of any length are compressed whole; equal texts score equally. With no labelled rows of one
class every text has that share. Input columns named like an output give way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsengine.llm.common import crc_of_id, map_texts, small_batches, table
from tsengine.llm.hashing import text_bytes
from tsengine.llm.labelled import class_weights, in_fold, logistic_fit, sigmoid, training_rows

#: Documented bounds of the training sample: rows of each class, and characters of one text.
PER_CLASS = 2500
MAX_CHARS = 20_000
CHUNK = 4096
DICTIONARY = 96 << 10
LEVEL = 3


def dictionary(texts: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary; raw text where there is too little to train on."""
    chunks = [t[i : i + CHUNK] for t in texts for i in range(0, len(t), CHUNK)]
    try:
        return zstandard.train_dictionary(size, chunks).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(chunks)[:size]


class Sizes:
    """Compressed sizes of texts under the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.packers = []
        for raw in (good, bad):
            options = {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}
            packer = zstandard.ZstdCompressor(
                level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **options
            )
            self.packers.append(packer)

    def __call__(self, text: memoryview | bytes) -> tuple[int, int, int]:
        n, sums = len(text), [0, 0]
        for i in range(0, n, CHUNK):
            chunk = text[i : i + CHUNK]
            for j, packer in enumerate(self.packers):
                sums[j] += len(packer.compress(chunk))
        return n, sums[0], sums[1]


def features(sizes: np.ndarray) -> np.ndarray:
    """Normalised difference, remaining share, and length, with their products."""
    n, good, bad = sizes[:, 0], np.maximum(sizes[:, 1], 1), np.maximum(sizes[:, 2], 1)
    difference = 10 * (good - bad) / (good + bad)
    share = good / np.maximum(n, 1)
    length = np.log1p(n) / 10
    return np.column_stack(
        [difference, difference**2, share, share**2, share**3, length, difference * length, share * length, difference * share]
    )


class Quality:
    """Dictionaries and the calibration on standardised features; without them a constant share."""

    def __init__(self, share: float, good: bytes = b"", bad: bytes = b"", fitted: tuple | None = None):
        self.share, self.good, self.bad, self.fitted = share, good, bad, fitted

    def scorer(self):
        sizes = Sizes(self.good, self.bad) if self.fitted else None

        def score(texts: pa.Array) -> np.ndarray:
            if sizes is None:
                return np.full(len(texts), self.share)
            data, offsets = text_bytes(texts)
            view = memoryview(np.ascontiguousarray(data))
            each = np.array([sizes(view[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], float).reshape(-1, 3)
            return np.where(each[:, 0] > 0, self.calibrated(each), self.share)

        return score

    def calibrated(self, sizes: np.ndarray) -> np.ndarray:
        mean, spread, beta = self.fitted
        x = np.clip((features(sizes) - mean) / spread, -6, 6)
        return sigmoid(x @ beta[:-1] + beta[-1])


def train(docs: DataFrame, labels: DataFrame, rows: Column, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Quality:
    """Build the dictionaries on half of a bounded sample of the rows that meet ``rows``; calibrate on the other half."""
    texts, _, y, shares = training_rows(docs, labels, "quality", rows, per_class, max_chars)
    raw = [t.encode() for t in texts]
    half = np.arange(len(y)) % 2 == 0
    if min((half & (y == 0)).sum(), (half & (y == 1)).sum(), (~half & (y == 0)).sum(), (~half & (y == 1)).sum()) == 0:
        half = np.ones(len(y), bool)
    learn, check = np.flatnonzero(half), np.flatnonzero(~half if not half.all() else half)
    if len(y) == 0 or y.min() == y.max():
        return Quality(float(shares[1]))
    good, bad = (dictionary([raw[i] for i in learn if y[i] == v]) for v in (1, 0))
    measure = Sizes(good, bad)
    sizes = np.array([measure(raw[i]) for i in check], float)
    x = features(sizes)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    beta = logistic_fit(np.clip((x - mean) / spread, -6, 6), y[check], class_weights(y[check], shares), ridge=0.05)
    return Quality(float(shares[1]), good, bad, (mean, spread, beta))


def score(docs: DataFrame, model: Quality, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) and ``score``, the calibrated chance of good quality."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    def build():
        scorer = shared.value.scorer()
        return lambda texts: [pa.array(scorer(texts), pa.float64())]

    return map_texts(docs, text, [T.StructField("score", T.DoubleType())], build, keep)


def accepted(docs: DataFrame, model: Quality, least: float, text: str = "text") -> DataFrame:
    """The rows that score at least ``least``: all columns, rows as they are."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        scorer = shared.value.scorer()
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch.column(at)) >= least, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = train(docs, labels, ~in_fold(4, 2))
    rows = docs.select("doc_id", (crc_of_id() % 4 == 2).alias("held_out"), "text")
    rows = score(rows, model, keep=["doc_id", "held_out"])
    return rows.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
