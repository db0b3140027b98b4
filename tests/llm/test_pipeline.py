"""The pipeline's stages on the small tables and on planted rows."""

import corpus_pipeline
import pytest

from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_shrink(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.count() <= n, name
        n = docs.count()
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == columns, name
    assert n > 0 and {"doc_id", "ids", "n_tokens"} <= set(docs.columns)


def test_planted_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    own = " ".join(f"word{i}" for i in range(80))
    planted = spark.createDataFrame([(10_001, own, "en", "s", 1), (10_002, own, "en", "s", 1), (10_003, own + " end", "en", "s", 1), (10_004, "intro " + item, "en", "s", 1), (10_005, "write to jo@site.org today " + own[::-1], "en", "s", 1), (10_006, None, "en", "s", 0)], docs.schema)
    deduped = corpus_pipeline.drop_near_duplicates(spark, docs.unionAll(planted), SF)
    ids = {r.doc_id for r in deduped.where("doc_id > 10000").select("doc_id").collect()}
    assert {10_001, 10_004, 10_005} <= ids and not ids & {10_002, 10_003}
    clean = corpus_pipeline.drop_contaminated(spark, planted, SF)
    assert {r.doc_id for r in clean.collect()} == {10_001, 10_002, 10_003, 10_005, 10_006}
    masked = {r.doc_id: r.text for r in corpus_pipeline.mask_personal_data(spark, planted, SF).collect()}
    assert masked[10_005].startswith("write to <EMAIL> today") and masked[10_001] == own and masked[10_006] is None


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_empty_documents(spark, stage):
    assert stage(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(0), SF).count() == 0


def test_all_are_registered():
    assert {n.split("_")[0] for n in queries() if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in queries()
