"""Near texts against the exact Jaccard index of all pairs."""

import random

import corpus_pipeline
import pytest

from mnemoframe.llm import near_texts, simhash


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)}


def index(x, y):
    a, b = shingles(x), shingles(y)
    return len(a & b) / len(a | b)


def words(draw, n):
    return [f"w{draw.randrange(10 ** 6)}" for _ in range(n)]


def brute(texts):
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if index(texts[i], texts[j]) >= 0.8 and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return group


def crowd():
    """A chain in which only neighbours are near, a dense group, and odd texts."""
    draw = random.Random(11)
    line, base = words(draw, 700), words(draw, 150)
    chain = [" ".join(line[i * 10:i * 10 + 120]) for i in range(55)]
    dense = [" ".join([*base[:k], "x", *base[k + 1:]]) for k in range(0, 150, 3)]
    return [*chain, *dense, "One two", "one TWO", "one", None, "", " ", *[" ".join(words(draw, 60)) for _ in range(40)]]


@pytest.mark.parametrize("size", [{}, {"chunk": 4, "wide": 6}])
def test_crowded_groups_equal_all_pairs(spark, size):
    texts = crowd()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.id: r.component_id for r in near_texts.grouped(docs, **size).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_pipeline_keeps_no_member_of_a_crowd(spark):
    texts = crowd()
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == set(brute(texts))


def test_border_of_the_index(spark):
    """Pairs right above 0.8 are linked, pairs right below are not."""
    draw, texts, above = random.Random(12), [], []
    for i in range(80):
        n = draw.choice([200, 210, 220, 230])
        base = words(draw, n)
        other, at = list(base), 4
        while index(" ".join(base), " ".join(other)) >= (0.83 if i % 2 else 0.8):
            other[at] = "changed"
            at += 5
        texts += [" ".join(base), " ".join(other)]
        above.append(index(*texts[-2:]) >= 0.8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.component_id for r in near_texts.grouped(docs, **corpus_pipeline.NEAR).collect()}
    linked = [got[2 * i + 1] == 2 * i for i in range(80)]
    assert 20 <= sum(above) <= 60 and not any(x and not y for x, y in zip(linked, above))
    assert sum(linked) >= sum(above) - 1


def test_pipeline_links_what_simhash_links(spark):
    """Repeats of one passage prevail in the fingerprints, while the sets of shingles have an index below 0.8."""
    draw = random.Random(13)
    line = " ".join(words(draw, 13))
    tails = [" ".join(words(draw, 25)) for _ in range(2)]
    alike = [" ".join([line] * 300 + [tail]) for tail in tails]
    reach = " ".join([line] * 300 + [tails[1] + " end"])  # near the second one, by either kind of link
    texts = [*alike, reach, *[" ".join(words(draw, 60)) for _ in range(5)], "", None]
    assert index(*alike) < 0.8 <= index(alike[1], reach)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    by_print = {r.id: r.component_id for r in simhash.grouped(docs).collect()}
    assert by_print[1] == 0
    got = {r.id: r.component_id for r in near_texts.grouped(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8}
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {0, 3, 4, 5, 6, 7, 8}


def test_links_of_both_kinds_are_joined(spark):
    """The stage's groups hold each group of fingerprints as a whole, on the small table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    own = {r.id: r.component_id for r in near_texts.grouped(docs).collect()}
    assert all(own[r.id] == own[r.component_id] for r in simhash.grouped(docs).collect())
