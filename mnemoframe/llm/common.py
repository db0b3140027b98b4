"""What several operators share: the shared folder, written intermediate tables, and text handling rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where none is set and all tasks run on this machine."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: computed once, survives lost executors, cuts lineage."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the folder of a table made by written()."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """A name for a helper column that the table does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """True for the rows whose crc32 of the id, as text, leaves `fold` modulo `folds`. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(True))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Plain lower() says the same for ASCII texts and is much faster there."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


BROADCAST_LABELS = 2_000_000


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """(doc_id, text, y) of the rows that may be learned from. Several labels of one id: the largest counts.

    The labels are counted first: up to BROADCAST_LABELS of them (two numbers each) go to the texts, beyond that both
    sides are shuffled.
    """
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).where(learn)
    y = F.broadcast(y) if y.count() <= BROADCAST_LABELS else y
    return docs.select("doc_id", text_of().alias("text")).where(learn).join(y, "doc_id")


def sampled(df: DataFrame, rows: int, total: int, *keys: str) -> DataFrame:
    """About `rows` of `total` rows, chosen by a hash of the keys, so that every run takes the same ones."""
    share = min(1.0, rows / max(1, total))
    return df if share >= 1 else df.where(F.pmod(F.xxhash64(*keys, F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))


def with_words(df: DataFrame, lowered: Column, line: str = "_line", words: str = "_words") -> DataFrame:
    """df with the words of a lower-cased text, digits, a-z and all beyond ASCII, as a line and as an array."""
    df = df.withColumn(line, F.trim(F.regexp_replace(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")))
    return df.withColumn(words, F.when(F.col(line) != "", F.split(line, " ")).otherwise(F.array().cast("array<string>")))
