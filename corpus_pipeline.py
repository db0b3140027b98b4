"""The corpus pipeline: each stage works on all rows that the one before kept, written as Parquet in between."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.llm import bpe, decontaminate, near_texts, pii, toxicity
from mnemoframe.llm.common import written

TOXIC = 0.3
# Near duplicates: SimHash fingerprints within two bits, as op4 links them, or distinct shingles of five words with a Jaccard index of
# 0.8 or more.
NEAR = {"width": 5, "tenths": 8}
TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below TOXIC, by a model of the labelled rows among them."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", toxicity.learnable())
    return model.scored(docs, name="_toxic").where(F.col("_toxic") < TOXIC).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest id."""
    return near_texts.representatives(docs, **NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no window of a benchmark item occurs."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by its kind; n_chars follows the text."""
    return pii.masked(docs, pii.fit(docs)).withColumn("n_chars", F.char_length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their token ids, in place of the text, and the digest of what the ids decode to."""
    path = public_tokenizers.path(TOKENIZER)
    return bpe.round_trip(docs, path, ids="ids").drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("personal_data", mask_personal_data), ("encoding", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
