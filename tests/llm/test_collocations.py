"""Collocations against brute force."""

import random
import re
from collections import Counter

from mnemoframe.llm import collocations

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(docs):
    f = {}
    for lang, text in docs:
        own = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(w[i:i + n]) for n in range(1, 5) for i in range(len(w) - n + 1))
    return f


def brute(docs, least, top=2000):
    out = []
    for lang, own in counts(docs).items():
        n, rows = sum(a for p, a in own.items() if len(p) == 1), []
        many = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        for p, a in many.items():
            score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) and 100 * b >= 80 * a for q, b in many.items()):
                rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, n, -s) for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def corpus():
    draw = random.Random(5)
    words = ["new", "york", "New", "the", "É", "é", "a-b", "x", "y", "z", " ", "\x1f", "漢字"]
    docs = []
    for _ in range(300):
        w = []
        while len(w) < 40:
            w += draw.choice([["san", "francisco", "bay", "area"], ["new", "york"], draw.choices(words, k=2)])
        joint = draw.choice([" ", "  ", "\t", " ", ", ", "\n"])
        docs.append((draw.choice(["en", "en", "de", None, "und"]), "".join(x + (joint if draw.random() < .1 else " ") for x in w)))
    return docs + [("en", None), ("en", ""), ("fr", "..."), ("en", "lone")] + [("en", "copy of a hot text, new york")] * 200


def got(spark, docs, **how):
    d = spark.createDataFrame([(i % 7, *r, 1) for i, r in enumerate(docs)], "doc_id long, lang string, text string, n int").repartition(3)
    return sorted(map(tuple, collocations.ranked(d, **how).collect()))


def test_equals_brute_force(spark, monkeypatch):
    docs = corpus()
    monkeypatch.setattr(collocations, "CHUNK", 500)
    monkeypatch.setattr(collocations, "HELD", 3000)
    assert got(spark, docs, least=30) == brute(docs, 30)
    assert got(spark, docs, least=3, top=50) == brute(docs, 3, 50)


def test_clashing_fingerprints_are_counted_by_text(spark):
    """Every fingerprint taken for a clashing one."""
    docs = spark.createDataFrame(corpus()[::4], "lang string, text string").selectExpr("coalesce(lang, 'und') AS lang", "coalesce(text, '') AS text")
    phrases, _ = collocations.frequent(docs, 20)
    rows = collocations.recounted(docs, spark.createDataFrame(fingerprints(docs), "fp long"), 20)
    assert sorted((r.lang, r.phrase, r.words, r.a) for r in rows.collect()) == sorted(map(tuple, phrases.collect()))


def fingerprints(text):
    """All fingerprints of the texts, as the clashing ones."""
    frames = [collocations.counted(text.selectExpr("xxhash64(lang, text) AS key", "lang", "text"), (n,), None, 1).where("level > 0").select("fp") for n in (1, 2, 3, 4)]
    return frames[0].unionAll(frames[1]).unionAll(frames[2]).unionAll(frames[3]).distinct().collect()


def test_empty_tables_and_long_texts(spark):
    assert got(spark, []) == []
    assert got(spark, [("en", None)]) == []
    docs = [("en", "word pair " * 50_000)]
    assert got(spark, docs) == brute(docs, 30)
