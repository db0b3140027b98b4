"""Classifiers on held-out rows, and what they do with odd tables."""

import random

import pytest
from pyspark.sql import functions as F

from mnemoframe.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize(("scores", "label", "least"), [(toxicity.scores, "toxic", 0.9), (quality.scores, "quality", 0.9)])
def test_held_out_accuracy(tables, scores, label, least):
    docs, labels = tables
    rows = scores(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", F.col(label).alias("y"), "score").collect()
    assert len(rows) > 50 and sum(r.predicted == r.y for r in rows) / len(rows) >= least and all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("scores", [toxicity.scores, quality.scores])
def test_odd_tables(spark, scores):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 1), (2, "", 1), (None, "x", 0), (4, "word " * 20_000, 0)], "doc_id long, text string, score int")
    labels = "doc_id long, quality int, toxic int"
    one_class = spark.createDataFrame([(1, 1, 1), (4, 1, 1), (None, 0, 0), (2, None, None)], labels)
    both = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 0, 1), (2, 1, 0)], labels)
    for table in (one_class, both, one_class.limit(0)):
        got = scores(docs, table).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert scores(docs.limit(0), both).count() == 0


def test_log_count_ratios_count_every_row(spark):
    draw = random.Random(1)
    rows = [(i, " ".join(draw.choice(["aa", "bb", "cc", "idiot"]) for _ in range(5)), i % 2) for i in range(200)]
    counts = toxicity.cell_counts(spark.createDataFrame(rows, "doc_id long, text string, y int").repartition(7)).collect()
    got = {r.cell: (r.pos, r.neg) for r in counts}
    want = {-1: (100, 100)}
    for _, t, y in rows:
        for c in toxicity.cells(t).tolist():
            a, b = want.get(c, (0, 0))
            want[c] = (a + y, b + 1 - y)
    assert got == want
