"""Toxicity: a linear classifier over character n-grams whose presence is scaled by naive Bayes log-count ratios.

1. Counts. Over all labelled rows: in how many texts of either class does each n-gram occur? N-grams are hashed into
   2**BITS cells; every task adds up its own texts and passes on one row per cell it met, so the shuffle is a sum over
   cells, however frequent an n-gram is.
2. Ratios. r = log((1 + with) / (2 + texts)) of class 1 minus the same of class 0: BITS bound the table's size.
3. Fit. Logistic regression on r times presence, over about FIT_ROWS labelled rows chosen by a hash of the id.
4. Score. One pass over the whole texts; the weights (a fixed 2 MB) go to every task.

Null texts count as empty; an empty text scores the intercept. Rows without a label, with a null label or a null id are
not learned from. Without rows of both classes every score is the share of class 1 (0.5 without any row).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled, sampled, text_of

BITS = 19
ORDERS = (3, 4, 5)
FIT_ROWS = 4000
PENALTY = 1.0
ROUNDS = 40


def cells(text: str) -> np.ndarray:
    """The distinct cells of a text's n-grams, ascending. Letters in lower case, blanks as one; ends count as blanks."""
    line = " " + " ".join(text.lower().split()) + " "
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    h, found = c, []
    for n in range(2, max(ORDERS) + 1):
        if len(c) < n:
            break
        h = h[:-1] * np.uint32(0x01000193) + c[n - 1:]
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32((0x85EBCA6B + 2 * n) & 0xFFFFFFFF)
            found.append(mixed >> np.uint32(32 - BITS))
    if not found:
        return np.empty(0, np.int32)
    every = np.sort(np.concatenate(found))
    return every[np.concatenate(([True], every[1:] != every[:-1]))].astype(np.int32)


def cell_counts(rows: DataFrame) -> DataFrame:
    """(cell, pos, neg): texts of either class with the cell, over all rows (text, y); cell -1 has the texts themselves."""
    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, texts = np.zeros((2, 1 << BITS), np.int32), [0, 0]
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[y, cells(text)] += 1
                texts[y] += 1
        met = np.flatnonzero(counts.any(axis=0)).astype(np.int32)
        for at in range(0, len(met), 1 << 16):
            part = met[at:at + (1 << 16)]
            yield pa.record_batch([pa.array(part), pa.array(counts[1, part].astype(np.int64)), pa.array(counts[0, part].astype(np.int64))], names=["cell", "pos", "neg"])
        if any(texts):
            yield pa.record_batch([pa.array([-1], pa.int32()), pa.array(texts[1:], pa.int64()), pa.array(texts[:1], pa.int64())], names=["cell", "pos", "neg"])

    parts = rows.select("text", "y").mapInArrow(per_task, "cell int, pos long, neg long")
    return parts.groupBy("cell").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def log_count_ratios(counts: DataFrame) -> tuple[np.ndarray, int, int]:
    """Ratios by cell, and the texts of class 1 and 0. At most 2**BITS + 1 rows reach the driver."""
    table = counts.toArrow()
    cell, pos, neg = (table.column(c).to_numpy() for c in ("cell", "pos", "neg"))
    n1, n0 = int(pos[cell == -1].sum()), int(neg[cell == -1].sum())
    ratio, real = np.zeros(1 << BITS, np.float32), cell >= 0
    ratio[cell[real]] = np.log((1 + pos[real]) / (2 + n1)) - np.log((1 + neg[real]) / (2 + n0))
    return ratio, n1, n0


def fit_linear(texts: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by cell and the intercept: accelerated gradient steps on the penalised log loss."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    index = np.concatenate(texts) if sizes.sum() else np.empty(0, np.int32)
    value = ratio[index]
    owner = np.repeat(np.arange(len(texts)), sizes)
    # the loss curves by a quarter of the longest row for each row alone; rows share few strong cells, so that their
    # number counts by its root only
    step = 32.0 / (np.bincount(owner, value * value, len(texts)).max(initial=0) + 1) / max(1.0, np.sqrt(len(y)))
    share = (y.sum() + 1) / (len(y) + 2)
    v = ahead = np.zeros(len(ratio))
    b = b_ahead = float(np.log(share / (1 - share)))
    for k in range(ROUNDS):
        z = np.bincount(owner, value * ahead[index], len(texts)) + b_ahead
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        grad = np.bincount(index, value * error[owner], len(ratio))
        v_next = (ahead - step * grad) / (1 + step * PENALTY)
        b_next = b_ahead - 4 * error.mean()
        momentum = k / (k + 3)
        ahead, b_ahead = v_next + momentum * (v_next - v), b_next + momentum * (b_next - b)
        v, b = v_next, b_next
    return (v * ratio).astype(np.float32), float(b)


class Toxicity:
    """A fitted model: weights by cell and the intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def probability(self, text: str) -> float:
        z = float(self.weights[cells(text)].sum(dtype=np.float64)) + self.intercept
        return float(1 / (1 + np.exp(-min(40.0, max(-40.0, z)))))

    def scored(self, docs: DataFrame, text: str = "text", name: str = "score") -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(self)

        def batch(texts: pa.Array) -> pa.Array:
            model = sent.value
            return pa.array([model.probability(t or "") for t in texts.to_pylist()], pa.float64())

        return docs.withColumn(name, F.arrow_udf(batch, "double")(text_of(text)))


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, fit_rows: int = FIT_ROWS) -> Toxicity:
    """learn: which rows may be learned from, by doc_id."""
    ratio, n1, n0 = log_count_ratios(cell_counts(labelled(docs, labels, label, learn)))
    if not n1 or not n0:
        share = n1 / (n1 + n0) if n1 + n0 else 0.5
        return Toxicity(np.zeros(1 << BITS, np.float32), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    ratios = docs.sparkSession.sparkContext.broadcast(ratio)
    sample = labelled(sampled(docs, fit_rows, n1 + n0, "doc_id"), sampled(labels, fit_rows, n1 + n0, "doc_id"), label, learn)

    def in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for batch in batches:
            texts += [np.frombuffer(x, np.int32) for x in batch.column(0).to_pylist()]
            y += batch.column(1).to_pylist()
        weights, intercept = fit_linear(texts, np.array(y, np.float64), ratios.value)
        yield pa.record_batch([pa.array([weights.tobytes()], pa.binary()), pa.array([intercept])], names=["weights", "intercept"])

    def featured(texts: pa.Array) -> pa.Array:
        return pa.array([cells(t).tobytes() for t in texts.to_pylist()], pa.binary())

    row = (sample.select("doc_id", F.arrow_udf(featured, "binary")("text").alias("cells"), "y").repartition(1).sortWithinPartitions("doc_id", "cells", "y")
           .select("cells", "y").mapInArrow(in_one_task, "weights binary, intercept double").first())
    return Toxicity(np.frombuffer(row.weights, np.float32), row.intercept)


def learnable(folds: int = 4, fold: int = 2) -> Column:
    return ~held_out("doc_id", folds, fold)


def scores(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, threshold: float = 0.3) -> DataFrame:
    """docs with held_out, score and predicted."""
    scored = fit(docs, labels, "toxic", learnable(folds, fold)).scored(docs)
    return scored.withColumn("held_out", held_out("doc_id", folds, fold)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
