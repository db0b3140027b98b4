"""Quality: how much better does a text compress with a dictionary of good texts than with one of bad texts?

Zstandard dictionaries are built from pieces of labelled texts of either class. A text is cut into pieces of PIECE
bytes, all of which are compressed with both dictionaries. From the summed sizes come the normalised difference
(bad - good) / (bad + good), near zero for texts that neither dictionary knows, and the smaller size by the text's
own, which repetition makes small under either dictionary. A logistic curve over both gives the score; it is fitted on
labelled rows that the dictionaries have not seen.

About SAMPLE_ROWS labelled rows of each class, chosen by a hash of the id, are gathered in one task, where both the
dictionaries (DICTIONARY bytes) and the curve are made; everything else is one pass over the texts.

Null texts count as empty. Empty texts have both at 0, like an endless repetition. Rows without a label or id are not
learned from. Without rows of both classes every score is the share of class 1 (0.5 without any row).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled, sampled, text_of

PIECE = 1024
DICTIONARY = 112 * 1024
SAMPLE_ROWS = 1500
LEVEL = 3


def pieces(text: str) -> list[bytes]:
    data = text.encode("utf-8", "replace")
    return [data[at:at + PIECE] for at in range(0, len(data), PIECE)]


def dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; the plain end of the texts where there is too little to train on."""
    samples = [p for t in texts for p in pieces(t) if p]
    if sum(map(len, samples)) < 8 * DICTIONARY:
        return b"".join(samples)[-DICTIONARY:]
    return zstandard.train_dictionary(DICTIONARY, samples, k=64, d=8).as_bytes()


class Pair:
    """Compressors for both dictionaries; the size without content is taken off."""

    def __init__(self, good: bytes, bad: bytes):
        self.compress, self.empty = [], []
        for d in (good, bad):
            known = zstandard.ZstdCompressionDict(d) if len(d) >= 8 else None
            if known:
                known.precompute_compress(level=LEVEL)
            own = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False)
            self.compress.append(own.compress)
            self.empty.append(len(own.compress(b"")))

    def evidence(self, text: str) -> tuple[float, float]:
        """The normalised difference, and the smaller size by the text's own."""
        every = pieces(text)
        good, bad = (max(0, sum([len(c(p)) for p in every]) - e * len(every)) for c, e in zip(self.compress, self.empty))
        return ((bad - good) / (bad + good) if bad + good else 0.0), min(good, bad) / max(1, sum(map(len, every)))


def curve(x: np.ndarray, y: np.ndarray) -> tuple[list[float], float]:
    """Slopes and intercept of the logistic curve, by damped Newton steps with a slight pull towards no slope."""
    x = np.column_stack([x, np.ones(len(x))])
    share = (y.sum() + 1) / (len(y) + 2)
    w, pull = np.zeros(x.shape[1]), np.array([1e-3] * (x.shape[1] - 1) + [1e-9])
    w[-1] = np.log(share / (1 - share))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + pull * w)
        w -= move * min(1.0, 40 / (np.abs(move).max() + 1e-12))
    return w[:-1].tolist(), float(w[-1])


class Quality:
    """Both dictionaries and the curve."""

    def __init__(self, good: bytes, bad: bytes, slopes: list[float], intercept: float):
        self.good, self.bad, self.slopes, self.intercept = good, bad, slopes, intercept
        self.pair: Pair | None = None

    def __getstate__(self):
        return {**self.__dict__, "pair": None}

    def probability(self, text: str) -> float:
        self.pair = self.pair or Pair(self.good, self.bad)
        z = sum(a * x for a, x in zip(self.slopes, self.pair.evidence(text))) + self.intercept
        return float(1 / (1 + np.exp(-min(40.0, max(-40.0, z)))))

    def scored(self, docs: DataFrame, text: str = "text", name: str = "score") -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(self)

        def batch(texts: pa.Array) -> pa.Array:
            model = sent.value
            return pa.array([model.probability(t or "") for t in texts.to_pylist()], pa.float64())

        return docs.withColumn(name, F.arrow_udf(batch, "double")(text_of(text)))


def learned(rows: list[tuple[str, int]], share: float) -> Quality:
    """From (text, label) rows: even ones make the dictionaries, odd ones the curve. share: of class 1 among all rows.

    Rows of the curve are weighted back to that share by moving the intercept.
    """
    by = {c: [t for t, y in rows if y == c] for c in (0, 1)}
    if not by[0] or not by[1]:
        return Quality(b"", b"", [0.0, 0.0], float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    good, bad = dictionary(by[1][::2]), dictionary(by[0][::2])
    pair = Pair(good, bad)
    rest = [(t, c) for c in (0, 1) for t in (by[c][1::2] or by[c])]
    x, y = np.array([pair.evidence(t) for t, _ in rest]), np.array([c for _, c in rest], float)
    slopes, intercept = curve(x, y)
    here = y.mean()
    return Quality(good, bad, slopes, intercept + float(np.log(share / (1 - share)) - np.log(here / (1 - here))))


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, sample_rows: int = SAMPLE_ROWS) -> Quality:
    """learn: which rows may be learned from, by doc_id."""
    clean = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias(label)).where(learn)
    n = {r.y: r.n for r in clean.groupBy(F.col(label).alias("y")).agg(F.count("*").alias("n")).collect()}
    share = n.get(1, 0) / sum(n.values()) if n else 0.5
    if not n.get(0) or not n.get(1):
        return learned([], share)
    chosen = sampled(clean.where(F.col(label) == 0), sample_rows, n[0], "doc_id").unionAll(sampled(clean.where(F.col(label) == 1), sample_rows, n[1], "doc_id"))
    # one filter that both classes' shares can pass, before the join; the exact one is in `chosen`
    wide = sampled(docs, sample_rows, min(n.values()), "doc_id")

    def in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(t, y) for batch in batches for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        m = learned(rows, share)
        yield pa.RecordBatch.from_pylist([{"good": m.good, "bad": m.bad, "slopes": m.slopes, "intercept": m.intercept}])

    rows = labelled(wide, chosen, label, learn).repartition(1).sortWithinPartitions("doc_id", "text", "y").select("text", "y")
    m = rows.mapInArrow(in_one_task, "good binary, bad binary, slopes array<double>, intercept double").first()
    if m is None:  # no labelled row is among the documents
        return learned([], share)
    return Quality(bytes(m.good), bytes(m.bad), list(m.slopes), m.intercept)


def scores(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, threshold: float = 0.3) -> DataFrame:
    """docs with held_out, score and predicted."""
    scored = fit(docs, labels, "quality", ~held_out("doc_id", folds, fold)).scored(docs)
    return scored.withColumn("held_out", held_out("doc_id", folds, fold)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
