"""Ranked lexical search by per-term geometric blocking.

Items are the queries. One pass over the documents keeps, for each, its number of terms and the counts of the terms that items
ask for; from these come the weights. A second pass takes the documents in segments of bounded size. A segment is
parted by likeness, and in each part the posting list of each term is clustered: documents of the list stand as centres, every
other goes to the centre its projected vector is nearest to. Each cluster is a block with a summary, the largest impact of every term over its documents, kept whole
and exact. The sum of weight times summary bounds the score of every document of the block. An item takes the blocks of its terms
by falling bound, scores their documents exactly, and stops at the first block whose bound is below its k-th best score so far,
which is carried from segment to segment of a task. Each task sends k rows per item; Spark ranks these.

Items are taken in groups of up to ITEM_TERMS terms, one group after the other, so what goes to the tasks is bounded; a
segment has CELLS / terms documents. Ids of documents are integers; a null id ranks after all others of its score. Null texts
have no terms; each row of items has its own ranking, also where ids or texts repeat, and none without a hit.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, text_of, written

ITEM_TERMS = 1 << 17
CELLS = 1 << 24
BLOCK = 64
PARTS = 6
DIMS = 16
GATHER = 2048
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(BYTES).split()


def vectors(docs: DataFrame, known: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """(id, n, terms, tfs): the number of terms of each document, the numbers of its known terms and how often they occur."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, terms, tfs, ends = [], [], [], [0]
            for t in batch.column("text"):
                words = terms_of(t.as_py())
                found = Counter(map(known.get, words))
                found.pop(None, None)
                n.append(len(words))
                terms += found.keys()
                tfs += found.values()
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.record_batch([batch.column("id"), pa.array(n, pa.int64()), *[pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (terms, tfs)]], names=["id", "n", "terms", "tfs"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), text_of(text).alias("text")).mapInArrow(rows, "id long, n long, terms array<int>, tfs array<int>")


class Segment:
    """Some documents with their posting lists in blocks; impact is a matrix of documents by terms."""

    def __init__(self, impact: np.ndarray, near: np.ndarray):
        self.impact = impact
        term, doc = np.nonzero(impact.T)
        ends = np.searchsorted(term, np.arange(impact.shape[1] + 1))
        block, self.first, total = np.zeros(len(doc), np.int64), np.zeros(impact.shape[1] + 1, np.int64), 0
        for t, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            self.first[t] = total
            if b - a > BLOCK:
                own = near[doc[a:b]]
                centres = own[::-(-(b - a) // -(-(b - a) // BLOCK))]
                _, block[a:b] = np.unique((own @ centres.T).argmax(axis=1), return_inverse=True)
                block[a:b] += total
                total = int(block[a:b].max()) + 1
            elif b > a:
                block[a:b] = total
                total += 1
        self.first[-1] = total
        order = np.argsort(block, kind="stable")
        self.members, self.ends = doc[order], np.searchsorted(block[order], np.arange(total + 1))
        self._summarise()

    def _summarise(self) -> None:
        """The largest impact per block and term, sorted by term."""
        blocks, terms, values, a = [], [], [], 0
        while a < len(self.ends) - 1:
            b = max(a + 1, int(np.searchsorted(self.ends, self.ends[a] + GATHER, side="right")) - 1)
            most = np.maximum.reduceat(self.impact[self.members[self.ends[a]:self.ends[b]]], self.ends[a:b] - self.ends[a], axis=0)
            x, y = np.nonzero(most)
            blocks.append((x + a).astype(np.int32))
            terms.append(y.astype(np.int32))
            values.append(most[x, y])
            a = b
        term = np.concatenate(terms) if terms else np.empty(0, np.int32)
        order = np.argsort(term, kind="stable")
        self.block, self.most = (np.concatenate(x)[order] if terms else np.empty(0, np.int32) for x in (blocks, values))
        self.column = np.searchsorted(term[order], np.arange(self.impact.shape[1] + 1))

    def search(self, terms: np.ndarray, weights: np.ndarray, best: tuple[np.ndarray, np.ndarray], ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """best, scores and ids of the documents found so far, improved by this segment."""
        bound = np.zeros(len(self.ends) - 1, np.int64)
        for t, w in zip(terms.tolist(), weights.tolist()):
            a, b = self.column[t], self.column[t + 1]
            bound[self.block[a:b]] += w * self.most[a:b].astype(np.int64)
        own = np.concatenate([np.arange(self.first[t], self.first[t + 1]) for t in terms.tolist()] or [np.empty(0, np.int64)])
        own = own[np.argsort(-bound[own], kind="stable")]
        seen, a, step = np.zeros(len(self.impact), bool), 0, 4
        while a < len(own):
            least = int(best[0][-1]) if len(best[0]) == top else 1
            now = own[a:a + step]
            now = now[bound[now] >= least]
            if not len(now):
                break
            docs = np.unique(np.concatenate([self.members[self.ends[b]:self.ends[b + 1]] for b in now.tolist()]))
            docs = docs[~seen[docs]]
            seen[docs] = True
            score = self.impact[np.ix_(docs, terms)].astype(np.int64) @ weights
            best = leading(np.concatenate([best[0], score]), np.concatenate([best[1], ids[docs]]), top)
            a, step = a + step, step * 2
        return best


def projected(impact: np.ndarray) -> np.ndarray:
    """Unit vectors of few dimensions in place of the documents; these choose the blocks only."""
    ways = np.random.default_rng(3).standard_normal((impact.shape[1], DIMS)).astype(np.float32)
    out = np.concatenate([impact[a:a + GATHER].astype(np.float32) @ ways for a in range(0, len(impact), GATHER)])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def parts(impact: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, Segment]]:
    """A segment in up to PARTS parts of like documents (of one language, say): their rows, their terms, and the part, whose
    summaries are as wide as its own terms."""
    near = projected(impact)
    likest, centres = np.full(len(near), -1, np.float32), []
    for _ in range(PARTS):
        centres.append(near[int(np.argmin(likest))])
        likest = np.maximum(likest, near @ centres[-1])
    part = (near @ np.array(centres).T).argmax(axis=1)
    for k in range(PARTS):
        rows = np.flatnonzero(part == k)
        terms = np.flatnonzero(impact[rows].any(axis=0)) if len(rows) else rows
        if len(terms):
            yield rows, terms, Segment(np.ascontiguousarray(impact[np.ix_(rows, terms)]), near[rows])


def leading(scores: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `top` by falling score above 0, then by id; null ids are the largest number."""
    scores, ids = scores[scores > 0], ids[scores > 0]
    order = np.lexsort((ids, -scores))[:top]
    return scores[order], ids[order]


NULL_ID = np.iinfo(np.int64).max


def found(rows: DataFrame, queries: list[list[int]], weight: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, id, score): the best of each task for each query, over rows of vectors()."""
    each = [np.array([t for t in q if weight[t] > 0], np.int64) for q in queries]
    size = max(BLOCK, CELLS // max(1, len(weight)))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in each]
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                lists = part.column("terms")
                term, tf = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "tfs"))
                doc = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy(zero_copy_only=False))
                m = 10 + np.array([90 * n * n_docs // n_terms for n in part.column("n").to_pylist()], np.int64)
                impact = np.zeros((len(part), len(weight)), np.int32)
                impact[doc, term] = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
                ids = part.column("id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                for rows, terms, segment in parts(impact):
                    place = np.full(len(weight), -1, np.int64)
                    place[terms] = np.arange(len(terms))
                    for i, q in enumerate(each):
                        own = place[q]
                        if (own >= 0).any():
                            best[i] = segment.search(own[own >= 0], weight[q[own >= 0]], best[i], ids[rows], top)
        item = np.repeat(np.arange(len(each)), [len(b[0]) for b in best])
        ids = np.concatenate([b[1] for b in best] or [np.empty(0, np.int64)])
        yield pa.record_batch([pa.array(item, pa.int64()), pa.array(ids, pa.int64(), mask=ids == NULL_ID), pa.array(np.concatenate([b[0] for b in best] or [np.empty(0, np.int64)]), pa.int64())],
                              names=["item", "id", "score"])

    return rows.mapInArrow(tasks, "item long, id long, score long")


def item_groups(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[object, list[bytes]]]]:
    group, size = [], 0
    for r in items.select(F.col(item_id).alias("i"), text_of(text).alias("t")).toLocalIterator():
        terms = sorted(set(terms_of(r.t)))
        if group and size + len(terms) > ITEM_TERMS:
            yield group
            group, size = [], 0
        group.append((r.i, terms))
        size += len(terms)
    if group:
        yield group


def ranked(docs: DataFrame, items: DataFrame, top: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of each row of items with a score above 0, equal ones by id.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), its impact 10^9 tf div (1000 tf + 8 m) with m = 10 + 90 n N div L, all
    in whole numbers; the score is the sum of weight times impact over the distinct terms of the item.
    """
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for group in item_groups(items, item_id, item_text):
        known = {t: i for i, t in enumerate(sorted({t for _, terms in group for t in terms}))}
        rows = written(vectors(docs, known, doc_id, text), "vectors")
        size = rows.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        if not size.docs or not known:
            forget(rows)
            continue
        weight = np.zeros(len(known), np.int64)
        for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most ITEM_TERMS rows
            weight[r.t] = math.floor(1000 * math.log((2 * size.docs + 2) / (2 * r["count"] + 1)))
        best = written(found(rows, [[known[t] for t in terms] for _, terms in group], weight, size.docs, size.terms, top), "found")
        forget(rows)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(group)], f"item long, item_id {kind}")
        ranks = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).join(names, "item")
        out = out.unionAll(ranks.select("item_id", "rank", F.col("id").alias("doc_id"), "score"))
    return out
