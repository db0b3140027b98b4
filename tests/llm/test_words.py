"""Decontamination and licences against brute force."""

import random
import re

from mnemoframe.llm import decontaminate, license_scan


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = {}
    for item, t in items:
        w = words(t)
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[j:j + n]), set()).add(item)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j:j + n]) in windows:
                    found |= windows[tuple(w[j:j + n])]
                    hit |= set(range(j, j + n))
        out.append((i or 0, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out)


def corpus():
    draw = random.Random(2)
    pool = ["É", "é", "a1", "b", "c", "d", "the", "x", "THE", "y9"]
    items = [(k, " ".join(draw.choice(pool) for _ in range(draw.choice([12, 15, 25])))) for k in range(20)]
    items += [(50, "just three words"), (51, "solo"), (52, ""), (53, None), (54, "--- !!"), (55, items[0][1]), (None, "null id item words one two three four five six seven")]
    docs = []
    for i in range(150):
        w = [draw.choice(pool) for _ in range(draw.randint(0, 40))]
        for _ in range(draw.randint(0, 2)):
            part = words(draw.choice(items)[1])
            at, n = draw.randint(0, max(0, len(part) - 10)), draw.choice([9, 10, 11, 30])
            w[len(w) // 2:len(w) // 2] = [p.upper() if draw.random() < .2 and p.isascii() else p for p in part[at:at + n]]
        docs.append((i, ", ".join(w)))
    docs += [(3, docs[3][1]), (3, "another text of a repeated id"), (None, docs[5][1]), (900, None), (901, ""), (902, "null id item words one two three four five six seven")]
    return docs, items


def test_hits_equal_brute_force(spark):
    docs, items = corpus()
    d, b = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_words int"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.id or 0, r.n_words, r.n_hit, r["items"]) for r in decontaminate.hits(d, b).collect())
    assert got == brute(docs, items)
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns and kept.count() == sum(r[2] == 0 for r in got)


def test_large_benchmarks_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    docs, items = corpus()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.id or 0, r.n_words, r.n_hit, r["items"]) for r in decontaminate.hits(d, b).collect()) == brute(docs, items)


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.hits(d.limit(0), b).count() == 0
    assert [r.n_hit for r in decontaminate.hits(d, b.limit(0)).collect()] == [0]
    assert license_scan.licences(d.limit(0)).count() == 0


def test_base_phrases_equal_brute_force(spark):
    draw = random.Random(9)
    pool = ["under", "the", "MIT", "License", "apache", "license,", "Version", "2", "cc-by-nc", "cc", "by", "nc", "É", "K"]
    texts = [" ".join(draw.choice(pool) for _ in range(draw.randint(0, 40))) for _ in range(400)] + [None, "", "under the mit license under the mit license"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    for r in license_scan.licences(docs).collect():
        w, places, labels = words(texts[r.id]), [], set()
        for p, label in license_scan.BASE:
            q = p.split(" ")
            at = [i for i in range(len(w)) if w[i:i + len(q)] == q]
            places += at
            labels |= {label} if at else set()
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), sorted(labels))
        assert set(r.base_labels) <= set(r["labels"]) and 0 <= r.score <= 1


def test_templates_are_found_at_their_place_only(spark):
    mit = license_scan.TEMPLATES[0][2]
    scattered = " ".join(sorted(mit.split(" ")))
    gpl = "This work is licensed under the GNU General Public License, version 3."
    docs = spark.createDataFrame([(1, "text. " + mit.upper()), (2, scattered), (3, "see " + gpl), (3, "see " + gpl), (4, "permission is hereby granted free of charge")], "doc_id long, text string")
    got = sorted((r.id, tuple(r["labels"])) for r in license_scan.licences(docs).collect())
    assert got[0] == (1, ("mit",)) and got[1] == (2, ()) and got[2] == got[3] and "gpl-3" in got[2][1] and got[4] == (4, ())
