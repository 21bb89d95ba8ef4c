"""Labelled texts for training, and score calibration on rows of any number."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsengine.llm.common import crc_of_id, name


def _votes(labels: DataFrame, label: str, train: Column) -> tuple[DataFrame, dict[int, int]]:
    """``doc_id`` and its largest label ``y``, where that is 0 or 1, and the number of ids of each."""
    votes = labels.select(name("doc_id").alias("doc_id"), name(label).cast("int").alias("y"))
    votes = votes.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & train)
    votes = votes.groupBy("doc_id").agg(F.max("y").alias("y"))
    return votes, {r["y"]: r["n"] for r in votes.groupBy("y").agg(F.count("*").alias("n")).collect()}


def _texts(docs: DataFrame) -> DataFrame:
    columns = [name(c).alias(c) for c in ("doc_id", "text")]
    columns.append((name("lang") if "lang" in docs.columns else F.lit(None)).cast("string").alias("lang"))
    return docs.select(*columns)


def _one_text_an_id(rows: DataFrame) -> DataFrame:
    """The smallest text of each id; tasks fold their own rows first."""
    return rows.groupBy("doc_id", "y").agg(F.min(F.struct("text", "lang")).alias("row")).select("doc_id", "y", "row.*")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, train: Column) -> tuple[DataFrame, np.ndarray]:
    """``doc_id``, ``y``, ``text`` and ``lang`` of every labelled document, and the number of ids of each class.

    ``train`` is a condition on ``doc_id``. A document labelled more than once has its largest
    label; null labels and null texts do not count. Where documents share an id, the smallest of
    their texts stands for it, so an id weighs once however often it is repeated.
    """
    votes, counts = _votes(labels, label, train)
    rows = _texts(docs).filter(F.col("text").isNotNull() & train)
    return _one_text_an_id(rows.join(votes, "doc_id")), np.array([counts.get(0, 0), counts.get(1, 0)])


def class_shares(counts: np.ndarray) -> np.ndarray:
    return counts / max(int(counts.sum()), 1)


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, max_chars: int
) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """Texts, languages and labels of at most ``per_class`` labelled rows of each class, and the class shares.

    ``train`` is a condition on ``doc_id``. A document labelled more than once has its largest
    label; null labels do not count. The rows with the smallest md5 of the id are drawn, so a rerun
    draws the same ones. Texts of over ``max_chars`` characters are left out of the sample (they
    are scored in full like all others). Where documents share a drawn id, the smallest of their
    texts stands for it, so an id weighs once however often it is repeated, and the driver holds at
    most ``2 * per_class * max_chars`` characters.
    """
    votes, counts = _votes(labels, label, train)
    order = F.md5(F.col("doc_id").cast("string"))
    picks = [votes.filter(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    picks = picks[0].unionByName(picks[1])
    rows = _texts(docs).filter(F.length("text") <= max_chars)
    # at most 2 * per_class ids: a proven bound for the broadcast
    # one row an id before the driver sees any
    rows = _one_text_an_id(rows.join(F.broadcast(picks), "doc_id"))
    rows = sorted(rows.collect(), key=lambda r: r["doc_id"])
    total = max(sum(counts.values()), 1)
    shares = np.array([counts.get(0, 0) / total, counts.get(1, 0) / total])
    y = np.array([r["y"] for r in rows], np.int64)
    return [r["text"] for r in rows], [r["lang"] for r in rows], y, shares


def in_fold(modulus: int, remainder: int) -> Column:
    return crc_of_id() % modulus == remainder


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def class_weights(y: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Weight of each sampled row so that the classes weigh as among all labelled rows."""
    drawn = np.array([(y == 0).mean(), (y == 1).mean()])
    return (shares / np.maximum(drawn, 1e-9))[y]


def _logistic_sums(x: np.ndarray, y: np.ndarray, weights: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian of these rows, end to end; sums of several sets of rows add."""
    a = np.column_stack([x, np.ones(len(x))])
    z = a @ beta
    p = sigmoid(z)
    z = np.clip(z, -40, 40)
    hessian = (a * (weights * p * (1 - p))[:, None]).T @ a
    return np.concatenate([[np.sum(weights * (np.logaddexp(0, z) - y * z))], a.T @ (weights * (p - y)), hessian.ravel()])


def _newton(sums: Callable[[np.ndarray], np.ndarray], width: int, ridge: float, rounds: int) -> np.ndarray:
    penalty = np.full(width + 1, ridge)
    penalty[-1] = 1e-6

    def measure(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        total = sums(b)
        hessian = total[width + 2 :].reshape(width + 1, width + 1) + np.diag(penalty + 1e-9)
        return float(total[0] + 0.5 * np.sum(penalty * b * b)), total[1 : width + 2] + penalty * b, hessian

    beta = np.zeros(width + 1)
    best, gradient, hessian = measure(beta)
    for _ in range(rounds):
        step, size = np.linalg.solve(hessian, gradient), 1.0
        now, *slopes = measure(beta - step)
        while size > 1e-4 and now > best:
            size /= 2
            now, *slopes = measure(beta - size * step)
        beta, (gradient, hessian) = beta - size * step, slopes
        if best - now < 1e-9:
            break
        best = now
    return beta


def logistic_fit(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton's method for ridge logistic regression; the last coefficient is the intercept."""
    return _newton(lambda beta: _logistic_sums(x, y, weights, beta), x.shape[1], ridge, rounds)


def logistic_fit_rows(rows: DataFrame, width: int, weights: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """``logistic_fit`` over ``x`` (an array of ``width`` doubles) and ``y`` of every row, ``weights`` by class.

    Each task sums its rows and the driver gets one sum a task. Those are added exactly, so their
    order does not matter.
    """
    rows = rows.select("x", "y")

    def sums(beta: np.ndarray) -> np.ndarray:
        def run(batches):
            total = np.zeros(1 + (width + 1) + (width + 1) ** 2)
            for batch in batches:
                x = batch.column(0).flatten().to_numpy().reshape(-1, width)
                y = batch.column(1).to_numpy()
                total += _logistic_sums(x, y, weights[y], beta)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

        parts = [r["sums"] for r in rows.mapInArrow(run, "sums array<double>").collect()]
        return np.array([math.fsum(each) for each in zip(*parts)])

    return _newton(sums, width, ridge, rounds)
