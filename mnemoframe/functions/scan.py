"""Ordered operators that stay parallel when one group holds most of the rows.

A plain window puts a whole group into one task. Here each group is cut into blocks by a caller-given
expression that does not decrease along the order. Work inside a block is a bounded window; what one block
needs from earlier ones is a small table of block totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65536


def running_total(df: DataFrame, keys, order, block: Column, value: Column, out: str,
                  inclusive: bool = True) -> DataFrame:
    """Running sum of value per group in order; NULL values add nothing. Rows without a key form a group of their
    own, rows without an order come last."""
    keys = list(keys)
    b = df.withColumn("_blk", block).withColumn("_val", F.coalesce(value, F.lit(0)))
    totals = b.groupBy(*keys, "_blk").agg(F.sum("_val").alias("_tot"))
    before = Window.partitionBy(*keys).orderBy(F.col("_blk").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*keys, "_blk"])], F.coalesce(F.sum("_tot").over(before), F.lit(0)).alias("_carry"))
    end = 0 if inclusive else -1
    inside = Window.partitionBy(*keys, "_blk").orderBy(*[c if isinstance(c, Column) else F.col(c).asc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, end)
    local = b.withColumn("_loc", F.coalesce(F.sum("_val").over(inside), F.lit(0)))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*keys, "_blk"])]
    return (local.join(carry, same)
            .withColumn(out, F.col("_loc") + F.col("_carry"))
            .drop("_blk", "_val", "_loc", "_carry", *[f"_k{i}" for i in range(len(keys) + 1)]))


def row_index(df: DataFrame, keys, order, block: Column, out: str) -> DataFrame:
    """0-based position within the group."""
    return running_total(df, keys, order, block, F.lit(1).cast("long"), out, inclusive=False)


def id_block(col, width: int = BLOCK) -> Column:
    """Block of a non-negative unique integer: at most `width` rows each."""
    col = F.col(col) if isinstance(col, str) else col
    return F.floor(col / F.lit(width)).cast("long")


def neighbourhood(df: DataFrame, keys, idx: str, before: int, after: int, size: int = BLOCK) -> tuple[DataFrame, list]:
    """Cut groups into blocks of `size` consecutive positions and copy the rows a neighbour block needs.

    Returns the widened rows (`_home` marks the originals) and the window partition keys; apply any window
    that looks at most `before` rows back and `after` rows ahead, then finish with `home_rows`."""
    own = F.floor(F.col(idx) / size).cast("long")
    pos = F.pmod(F.col(idx), F.lit(size))
    copies = F.array_compact(F.array(
        own,
        F.when(pos >= size - before, own + 1) if before else F.lit(None).cast("long"),
        F.when((pos < after) & (own > 0), own - 1) if after else F.lit(None).cast("long")))
    wide = (df.withColumn("_own", own).withColumn("_blk", F.explode(copies))
            .withColumn("_home", F.col("_own") == F.col("_blk")).drop("_own"))
    return wide, [*keys, "_blk"]


def home_rows(df: DataFrame) -> DataFrame:
    return df.where("_home").drop("_home", "_blk")


def with_neighbours(df: DataFrame, keys, idx: str, before: int = 0, after: int = 0, **exprs) -> DataFrame:
    """Attach window expressions built by callables `w -> Column`, where w is the ordered window."""
    wide, part = neighbourhood(df, keys, idx, before, after)
    w = Window.partitionBy(*part).orderBy(idx)
    for name, fn in exprs.items():
        wide = wide.withColumn(name, fn(w))
    return home_rows(wide)


def ordered_neighbours(df: DataFrame, keys, order, block: Column, before: int = 0, after: int = 0,
                       idx: str = "_idx", **exprs) -> DataFrame:
    """row_index followed by with_neighbours."""
    return with_neighbours(row_index(df, keys, order, block, idx), keys, idx, before, after, **exprs)
