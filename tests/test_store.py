"""Loads that can be repeated."""

import os

from pyspark.sql import functions as F

from mnemoframe.sources import store

KIND = "path string, folder int, seen long, size long"


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def table(spark, root):
    return sorted(map(tuple, store.stored(spark, root, spark.createDataFrame([], KIND)).collect()), key=str)


def test_two_loads_equal_one_and_other_partitions_stay(spark, tmp_path):
    root = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 1, 1, 10), ("b", 1, 5, 20), ("c", 2, 1, 30), (None, 3, 1, 40)], KIND)
    store.upsert(first, root, ["path"], "folder", ["seen"])
    before = files(root)
    second = spark.createDataFrame([("a", 1, 2, 11), ("b", 1, 4, 99), ("d", 1, 1, 50), ("d", 1, 1, 50)], KIND)
    store.upsert(second, root, ["path"], "folder", ["seen"])
    want = sorted([("a", 1, 2, 11), ("b", 1, 5, 20), ("c", 2, 1, 30), (None, 3, 1, 40), ("d", 1, 1, 50)], key=str)
    assert table(spark, root) == want
    after = files(root)
    assert all(after[f] == t for f, t in before.items() if "folder=1" not in f) and not any(f in after for f in before if "folder=1" in f)
    for again in (second, first, second):
        store.upsert(again, root, ["path"], "folder", ["seen"])
        assert table(spark, root) == want
    other = str(tmp_path / "one")
    store.upsert(first.unionAll(second), other, ["path"], "folder", ["seen"])
    assert table(spark, other) == want


def test_empty_loads_and_new_columns(spark, tmp_path):
    root = str(tmp_path / "t")
    none = spark.createDataFrame([], KIND)
    assert table(spark, root) == []
    store.upsert(none, root, ["path"], "folder", ["seen"])
    assert table(spark, root) == []
    store.upsert(spark.createDataFrame([("a", 1, 1)], "path string, folder int, seen long"), root, ["path"], "folder", ["seen"])
    store.upsert(spark.createDataFrame([("b", 1, 1, 7)], KIND), root, ["path"], "folder", ["seen"])
    assert table(spark, root) == [("a", 1, 1, None), ("b", 1, 1, 7)]


def test_a_batch_is_stored_once(spark, tmp_path):
    root = str(tmp_path / "log")
    rows = spark.range(10).withColumn("x", F.col("id") * 2)
    for name, part in (("d1", rows.where("id < 4")), ("d2", rows.where("id >= 4")), ("d1", rows.where("id < 4"))):
        store.append_batch(part, root, "batch", name)
    assert sorted(r.id for r in store.stored(spark, root, rows).collect()) == list(range(10))
