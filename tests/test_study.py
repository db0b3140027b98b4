"""The study folder as a source and a sink."""

import gzip
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoframe.sources import files, study


@pytest.fixture()
def tree(tmp_path):
    for sub in range(1, 21):
        for ses in range(1, 11):
            folder = tmp_path / f"sub-{sub:02d}" / f"ses-{ses:02d}" / "beh"
            folder.mkdir(parents=True)
            for task in ("a", "b", "c", "d", "e", "f", "g", "h", "i", "j"):
                extra = "\tresp" if task == "b" else ""
                (folder / f"sub-{sub:02d}_ses-{ses:02d}_task-{task}_run-01_beh.tsv").write_text(f"onset\ttrial{extra}\n" + "".join(f"{k}.5\tn/a{extra and chr(9) + str(k)}\n" for k in range(3)))
    (tmp_path / "sub-01" / "_SUCCESS").write_text("")
    (tmp_path / "sub-01" / ".hidden.tsv").write_text("x\n1\n")
    (tmp_path / "participants.json").write_text("{}")
    return tmp_path


def test_thousands_of_small_files(spark, tree):
    found = study.study_files(spark, str(tree))
    assert found.count() == 2001 and 3 <= found.rdd.getNumPartitions() <= 40
    one = found.where("file_subject = '07' AND file_session = '03' AND file_task = 'b'").collect()
    assert len(one) == 1 and (one[0].file_run, one[0].file_suffix, one[0].file_datatype, one[0].file_extension, one[0].header) == ("01", "beh", "beh", ".tsv", "onset\ttrial\tresp")
    df = files.read_tsv(spark, f"{tree}/sub-*", T.StructType([T.StructField("onset", T.DoubleType()), T.StructField("resp", T.IntegerType()), T.StructField("absent", T.DateType())]))
    r = df.agg(F.count("*").alias("n"), F.sum("onset").alias("s"), F.count("trial").alias("t"), F.sum("resp").alias("r"), F.count("absent").alias("a"), F.countDistinct("source_file").alias("f")).first()
    assert (r.n, r.s, r.t, r.r, r.a, r.f) == (6000, 9000.0, 0, 600, 0, 2000)


def test_filters_choose_the_folders_that_are_opened(spark, tree, monkeypatch):
    asked = []
    whole = study.walk

    def walk(system, folder, pattern, wanted):
        asked.append(folder)
        return whole(system, folder, pattern, wanted)

    monkeypatch.setattr(study, "walk", walk)
    rows = list(study.listed([str(tree)], {"subject": {"03", "05"}, "session": {"02"}, "task": {"b"}}))
    assert len(rows) == 2 and len(asked) == 1 + 2 + 2 + 2  # root, subjects, sessions, beh
    df = files.read_tsv(spark, str(tree), where=F.col("file_subject").isin("03", "05") & (F.col("file_session") == "02") & (F.col("file_task") != "b"))
    assert df.count() == 2 * 9 * 3 and {r.subject for r in df.select("subject").distinct().collect()} == {"03", "05"}
    assert "resp" not in df.columns  # headers of the chosen files only
    plan = study.study_files(spark, str(tree), "file_subject = '03'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]


def test_odd_tables(spark, tmp_path):
    (tmp_path / "sub-1_empty.tsv").write_text("")
    (tmp_path / "sub-1_header.tsv").write_text("a\tb\n")
    (tmp_path / "sub-1_ragged.tsv").write_text("a\tb\n1\n2\t3\t4\n")
    (tmp_path / "sub-1_bom.tsv").write_text("﻿a\tc\r\n5\tx y\r\n")
    with gzip.open(tmp_path / "sub-1_zip.tsv.gz", "wt") as f:
        f.write("b\n" + "7\n" * 100_000)
    df = files.read_tsv(spark, str(tmp_path))
    got = {tuple(r) for r in df.select("a", "b", "c").where("b is null or b <> '7'").collect()}
    assert got == {("1", None, None), ("2", "3", None), ("5", None, "x y")} and df.where("b = '7'").count() == 100_000
    with pytest.raises(FileNotFoundError):
        files.read_tsv(spark, str(tmp_path / "nothing-*"))
    with pytest.raises(FileNotFoundError):
        files.read_tsv(spark, str(tmp_path / "sub-1_empty.tsv"))


def test_written_tables_come_back(spark, tmp_path):
    rows = [(f"sub-{k % 3}/sub-{k % 3}_task-x_beh.tsv{'.gz' if k % 3 == 2 else ''}", k, None if k % 5 == 0 else f"v\t{k}") for k in range(300)]
    df = spark.createDataFrame(rows, "source_file string, k int, v string").repartition(8)
    for _ in range(2):  # a second write replaces the same files
        study.write_study(df, str(tmp_path / "out"), ["k"])
    names = [os.path.join(d, f) for d, _, fs in os.walk(tmp_path / "out") for f in fs]
    assert len(names) == 3 and not any(os.path.basename(n).startswith(".") for n in names)
    back = files.read_tsv(spark, str(tmp_path / "out"), T.StructType([T.StructField("k", T.IntegerType())]))
    assert sorted((r.k, r.v, r.subject) for r in back.collect()) == [(k, v and v.replace("\t", " "), f"{k % 3:02d}") for _, k, v in rows]
