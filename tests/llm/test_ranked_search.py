"""Ranked search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np

from mnemoframe.llm import queries, ranked_search


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, top=10):
    own = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in own), sum(len(w) for _, w in own)
    df = Counter(t for _, w in own for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for i, w in own:
            tf, m = Counter(w), 10 + 90 * len(w) * n_docs // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in set(terms(text)) if tf[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scores)[:top], 1)]
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


def corpus():
    draw = random.Random(8)
    pool = [f"w{i}" for i in range(60)] + ["É", "é", "the", "THE", "of", "x_y", "a-b"]
    weights = [1 / (k + 1) for k in range(len(pool))]
    docs = [(i, " ".join(draw.choices(pool, weights, k=draw.choice([1, 5, 30, 80])))) for i in range(500)]
    docs += [(1000 + i, docs[3][1]) for i in range(200)] + [(7, docs[9][1]), (None, docs[3][1]), (None, docs[3][1]), (2000, None), (2001, ""), (2002, "..."), (2003, "w1 " * 5000)]
    items = [(i, " ".join(draw.choices(pool, k=draw.randint(1, 12)))) for i in range(25)] + [(50, docs[3][1]), (50, "w1"), (51, ""), (52, None), (53, "nowhere"), (None, "w5 w5 W5")]
    return docs, items


def test_equals_brute_force(spark, monkeypatch):
    docs, items = corpus()
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, score string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute(docs, items), key=key)
    assert sorted(map(tuple, ranked_search.ranked(d, b).collect()), key=key) == want
    monkeypatch.setattr(ranked_search, "ITEM_TERMS", 20)  # several groups of items
    assert sorted(map(tuple, ranked_search.ranked(d, b).collect()), key=key) == want


def test_blocks_are_skipped_and_lose_nothing():
    draw = np.random.default_rng(1)
    docs, n_terms = 3000, 40
    themes = draw.integers(0, 6, docs)
    impact = (draw.random((docs, n_terms)) * 1000 * ((np.arange(n_terms) % 6 == themes[:, None]) | (draw.random((docs, n_terms)) < .05))).astype(np.int32)
    segment = ranked_search.Segment(impact, ranked_search.projected(impact))
    for t in range(n_terms):  # every document of a list is in one of its blocks, and summaries are exact
        held = np.concatenate([segment.members[segment.ends[b]:segment.ends[b + 1]] for b in range(segment.first[t], segment.first[t + 1])])
        assert sorted(held) == np.flatnonzero(impact[:, t]).tolist()
    whole = np.zeros((len(segment.ends) - 1, n_terms), np.int64)
    for t in range(n_terms):
        whole[segment.block[segment.column[t]:segment.column[t + 1]], t] = segment.most[segment.column[t]:segment.column[t + 1]]
    for b in range(len(whole)):
        assert (whole[b] == impact[segment.members[segment.ends[b]:segment.ends[b + 1]]].max(axis=0)).all()
    scored, gather = 0, np.ix_
    none = (np.empty(0, np.int64), np.empty(0, np.int64))
    try:
        def counting(rows, columns):
            nonlocal scored
            scored += len(rows)
            return gather(rows, columns)
        ranked_search.np.ix_ = counting
        for theme in range(6):
            q = np.flatnonzero(np.arange(n_terms) % 6 == theme)
            got = segment.search(q, np.full(len(q), 7), none, np.arange(docs), 10)
            score = impact[:, q].astype(np.int64).sum(axis=1) * 7
            order = np.lexsort((np.arange(docs), -score))[:10]
            assert got[0].tolist() == score[order].tolist() and got[1].tolist() == order.tolist()
    finally:
        ranked_search.np.ix_ = gather
    assert scored < 6 * docs / 2


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.ranked(d.limit(0), b).count() == 0 and ranked_search.ranked(d, b.limit(0)).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert ranked_search.ranked(nulls, b).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()][:12]
    got = [tuple(r) for r in queries.op11_ranked_search(spark, sf).collect()]
    assert [r for r in sorted(got) if r[0] in {i for i, _ in items}] == sorted(brute(docs, items))
