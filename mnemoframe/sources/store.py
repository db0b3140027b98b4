"""Tables that grow load by load: upsert by key and append by batch, both safe to repeat.

A table is a Parquet folder with one partition column. A load writes only the partitions it touches (dynamic partition overwrite):
files of all others stay as they are. What is written is complete before it replaces anything, so a load that fails
half way leaves the table as it was, and the same load can run again. One load at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..session import scratch


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at path, an empty one of the columns of `like` where there is none yet. Columns the table lacks are missing."""
    try:
        old = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return like.limit(0)
    return old.select(*[(F.col(f"`{f.name}`") if f.name in old.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema])


def _replace(rows: DataFrame, path: str, part: str) -> None:
    """Write rows to a folder of their own first: they may come from the very files that are replaced."""
    spark = rows.sparkSession
    staged = scratch(spark, "staged")
    rows.write.parquet(staged)
    spark.read.schema(rows.schema).parquet(staged).repartition(part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def last_wins(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: that with the largest order; a null key is a key. Rows of one order: the largest by their other columns."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*[F.col(c) if c in keys else F.col("_best")[c].alias(c) for c in df.columns])


def upsert(new: DataFrame, path: str, keys, part: str, order) -> None:
    """Merge rows into the table by key: the row with the largest `order` columns stays, wherever it comes from. The partition of a key
    must follow from the key (its column is one of the keys or computed from them). Only partitions with new rows are read and
    written; loading the same rows again changes nothing."""
    keys = list(dict.fromkeys([*keys, part]))
    touched = new.select(F.col(part).alias("_part")).distinct()
    old = stored(new.sparkSession, path, new)
    old = old.join(touched, old[part].eqNullSafe(touched["_part"]), "left_semi")
    _replace(last_wins(new.unionByName(old), keys, list(order)), path, part)


def append_batch(rows: DataFrame, path: str, batch: str, name: str) -> None:
    """Append rows as one named batch; the same batch again takes the place of its first run, so nothing is stored twice."""
    _replace(rows.withColumn(batch, F.lit(name)), path, batch)
