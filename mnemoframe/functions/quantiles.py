"""Exact, linearly interpolated quantiles per group without gathering a group in one task.

First count, minimum and maximum per group. Then rows are counted in order-preserving value buckets, which combines
map-side, and only the rows of the buckets that hold the wanted ranks go on; they are dealt into finer buckets between
the smallest and largest value of their own bucket, so that far outliers cost no resolution. Of what is left, equal values
collapse and the ranks are read off a running count inside the buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINEAR = 4096
LOGIT = 64
LEVELS = 2


def _buckets(v: Column, lo: Column, hi: Column):
    """Two monotone bucket numbers: an even grid, and a log-odds grid that resolves values crowded at
    either end when outliers stretch the range."""
    f = F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(F.lit(0.0))
    f = F.least(F.greatest(f, F.lit(0.0)), F.lit(1.0))
    odds = F.log((f + 1e-30) / (1.0 - f + 1e-16))
    return F.floor(f * LINEAR).cast("int"), F.floor(odds * LOGIT).cast("int")


def exact_quantiles(df: DataFrame, keys, value, wanted: dict[str, float], upper: bool = False, few: bool = False) -> DataFrame:
    """One row per group with a column per wanted quantile. `upper` takes the element at floor(q*n)
    instead of interpolating (the upper median for q = .5). `few`: the groups are a declared list, such as metric names; what is
    known of each group is then sent to the rows, which are not dealt out by so few keys."""
    keys = list(keys)
    value = F.col(value) if isinstance(value, str) else value
    x = df.select(*keys, value.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if not keys:
        x, keys, few = x.withColumn("_all", F.lit(1)), ["_all"], True
    known = F.broadcast if few else lambda d: d
    span = x.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    def ranks(q):
        if upper:
            r = F.least(F.floor(F.col("_n") * q), F.col("_n") - 1)
            return r, r
        p = F.lit(q) * (F.col("_n") - 1)
        return F.floor(p), F.ceil(p)

    hit = F.lit(False)
    for q in wanted.values():
        for r in ranks(q):
            hit = hit | ((r >= F.col("_start")) & (r < F.col("_start") + F.col("_c")))
    rows, path = x.join(known(span), keys).withColumn("_base", F.lit(0).cast("long")), []
    for level in range(LEVELS):
        even, odds = (f"_b{level}{k}" for k in "eo")
        rows = rows.withColumns(dict(zip((even, odds), _buckets(F.col("_v"), F.col("_lo"), F.col("_hi")))))
        w = Window.partitionBy(*keys, *path).orderBy(even, odds).rowsBetween(Window.unboundedPreceding, -1)
        path = [*path, even, odds]
        hist = rows.groupBy(*keys, *path).agg(F.count("*").alias("_c"), F.max("_n").alias("_n"), F.max("_base").alias("_base"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        hist = hist.withColumn("_start", F.col("_base") + F.coalesce(F.sum("_c").over(w), F.lit(0)))
        target = hist.where(hit).select(*keys, *path, F.col("_start").alias("_base"), "_lo", "_hi")
        rows = rows.select(*keys, *path, "_v", "_n").join(known(target), keys + path)
    rows = rows.groupBy(*keys, *path, "_v").agg(F.count("*").alias("_c"), F.max("_base").alias("_start"), F.max("_n").alias("_n"))
    wi = Window.partitionBy(*keys, *path).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_s", F.col("_start") + F.coalesce(F.sum("_c").over(wi), F.lit(0)))
    rows = rows.withColumn("_e", F.col("_s") + F.col("_c"))
    aggs = [F.max("_n").alias("_n")]
    for i, q in enumerate(wanted.values()):
        for j, r in enumerate(ranks(q)):
            aggs.append(F.max(F.when((r >= F.col("_s")) & (r < F.col("_e")), F.col("_v"))).alias(f"_q{i}_{j}"))
    out = rows.groupBy(*keys).agg(*aggs)
    cols = []
    for i, (name, q) in enumerate(wanted.items()):
        frac = F.lit(0.0) if upper else F.lit(q) * (F.col("_n") - 1) - F.floor(F.lit(q) * (F.col("_n") - 1))
        cols.append((F.col(f"_q{i}_0") + (F.col(f"_q{i}_1") - F.col(f"_q{i}_0")) * frac).alias(name))
    return out.select(*[k for k in keys if k != "_all"], *cols)


def with_quantiles(summary: DataFrame, df: DataFrame, keys, value, wanted: dict[str, float]) -> DataFrame:
    """Add quantile columns to a table that has one row per group."""
    q = exact_quantiles(df, keys, value, wanted)
    return summary.join(q, list(keys), "left") if keys else summary.join(q, F.lit(True), "left")
