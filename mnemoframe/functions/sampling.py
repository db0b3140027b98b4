"""Seeded samples: the rows with the smallest draws, so that samples of parts merge into the sample of the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .core import _PRIME, draw, top_per_group

DIRECT = 1000
BINS = 4096


def bottom_k(df: DataFrame, keys, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each group (all rows if it has fewer): those with the smallest draw of their integer key, equal draws by the key.

    The choice depends on seed and keys alone, not on the order, the partitions or other groups. Up to DIRECT rows a group, each
    task keeps its n smallest before the shuffle. Beyond that, counted bins of the draws say up to which one a group reaches
    n, and only rows up to there are ordered: about n rows and one bin.
    """
    if n <= 0:
        return df.limit(0)
    d = df.withColumn("_draw", draw(seed, key))
    if n > DIRECT:
        width = -(-_PRIME // BINS)
        bins = d.groupBy(*keys, F.floor(F.col("_draw") / width).alias("_bin")).agg(F.count("*").alias("_c"))
        before = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_bin")) - F.col("_c")
        last = bins.withColumn("_before", before).where(F.col("_before") < n).groupBy(*keys).agg(F.max("_bin").alias("_last"))
        d = (d.join(last, list(keys)) if keys else d.crossJoin(F.broadcast(last))).where(F.floor(F.col("_draw") / width) <= F.col("_last")).drop("_last")
    return top_per_group(d, keys, ["_draw", key], n).select(*df.columns)
