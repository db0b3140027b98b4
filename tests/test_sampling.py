"""Seeded samples."""

from pyspark.sql import functions as F

from mnemoframe.functions import sampling
from mnemoframe.functions.core import draw


def smallest(spark, ids, n, seed):
    rows = spark.createDataFrame([(i,) for i in ids], "id long").select("id", draw(seed, "id").alias("d")).collect()
    return sorted(r.id for r in sorted(rows, key=lambda r: (r.d, r.id))[:n])


def test_sample_is_the_smallest_draws(spark, monkeypatch):
    ids = list(range(3000))
    df = spark.range(3000).repartition(7).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)))
    want = {g: smallest(spark, [r.id for r in df.where(F.col("g") == g).collect()], 20, 9) for g in ("hot", "g1", "g7")}
    plans = []
    for direct in (1000, 5):  # kept per task, and by counted bins
        monkeypatch.setattr(sampling, "DIRECT", direct)
        rows = sampling.bottom_k(df, ["g"], "id", 20, 9)
        assert rows.columns == ["id", "g"]
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        got = {}
        for r in rows.collect():
            got.setdefault(r.g, []).append(r.id)
        assert all(sorted(got[g]) == want[g] for g in want) and len(got) == df.select("g").distinct().count()
        assert sorted(r.id for r in sampling.bottom_k(spark.range(3000), [], "id", 100, 2).collect()) == smallest(spark, ids, 100, 2)
    assert "WindowGroupLimit" in plans[0]


def test_samples_of_parts_merge(spark):
    parts = [sampling.bottom_k(spark.range(a, a + 500), [], "id", 30, 4) for a in (0, 500, 1000)]
    merged = sampling.bottom_k(parts[0].unionAll(parts[1]).unionAll(parts[2]), [], "id", 30, 4)
    assert sorted(r.id for r in merged.collect()) == sorted(r.id for r in sampling.bottom_k(spark.range(1500), [], "id", 30, 4).collect())


def test_small_groups_and_no_rows(spark):
    assert sampling.bottom_k(spark.range(5), [], "id", 30, 4).count() == 5
    assert sampling.bottom_k(spark.range(5), [], "id", 0, 4).count() == 0 and sampling.bottom_k(spark.range(0), [], "id", 3, 4).count() == 0
