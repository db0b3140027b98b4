"""Fingerprints, links and components against brute force."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from mnemoframe.llm import components, simhash

WORDS = [f"w{i}" for i in range(300)]


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = ([" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]) if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, ids, distance):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least[find(i)] = min(ids[i], least.get(find(i), ids[i]))
    return [least.get(find(i)) for i in range(len(ids))]


def corpus(draw):
    base = [draw.choice(WORDS) for _ in range(400)]
    texts = [" ".join(base)]
    for _ in range(60):  # near copies: many fingerprints within a few bits
        w = list(base)
        for _ in range(draw.randint(1, 3)):
            w[draw.randrange(len(w))] = draw.choice(WORDS)
        texts.append(" ".join(w))
    texts += [" ".join(draw.choice(WORDS) for _ in range(draw.randint(0, 40))) for _ in range(60)]
    return [*texts, None, "", " \n", "One", "one", "ONE two", "Äb c d e", texts[3], texts[3]]


def check(spark, crowded):
    texts = corpus(random.Random(4))
    ids = list(range(len(texts), 0, -1))
    ids[5] = None
    rows = list(zip(ids, texts))
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, id int, node string")
    got = simhash.grouped(docs, crowded=crowded).collect()
    prints = [brute_print(t) for t in texts]
    want = sorted((i or 0, p, c) for i, p, c in zip(ids, prints, brute_groups(prints, ids, 2)))
    assert sorted((r.id or 0, int(np.int64(r.fingerprint).astype(np.uint64)), r.component_id) for r in got) == want


def test_components_equal_brute_force(spark):
    check(spark, simhash.CROWDED)


def test_crowded_keys_lose_no_link(spark):
    check(spark, 2)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.grouped(docs).count() == 0 and simhash.representatives(docs).count() == 0


def test_one_row_of_each_group_stays(spark):
    docs = spark.createDataFrame([(3, "a b c d e f g", 1), (2, "a b c d e f g", 2), (2, "a b c d e f g", 2), (9, "x y z", 1), (None, "q r s t", 0), (None, "q r s t", 0), (4, None, 0), (5, "", 0)],
                                 "doc_id long, text string, n int")
    got = simhash.representatives(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text) for r in got.collect() if r.text) == [(0, "q r s t"), (2, "a b c d e f g"), (9, "x y z")]
    assert [r.doc_id for r in got.collect() if not r.text] == [4]



def test_long_chains_and_stars_become_one_component(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, k) for k in range(1001, 1400)]
    edges = spark.createDataFrame([*chain, *star, (5, 5), (None, 3), (2, 1)], "x long, y long")
    got = components.connected(edges).groupBy("root").agg(F.count("*").alias("n")).collect()
    assert {(r.root, r.n) for r in got} == {(0, 201), (1000, 400)}
    assert components.connected(edges.limit(0)).count() == 0
