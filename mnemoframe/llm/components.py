"""Connected components of a graph too large for one machine, by alternating star contractions.

Large star: every node hangs its larger neighbours under its smallest one. Small star: every node hangs its smaller
neighbours under the smallest. Both keep connectivity; repeated, they end in stars around the smallest node of each
component, in a number of rounds that grows with the logarithm of the size, chains included. A round is joins and
minima over edges, written to the shared folder, so that no lineage grows and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _under_least(edges: DataFrame) -> DataFrame:
    """Edges (a > b): each node with its smallest neighbour or itself, joined back to its edges."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; edges has two columns of one orderable type.

    Null ends, loops and repeated edges are ignored; no edges give an empty table. root is the smallest node reachable.
    """
    left, right = edges.columns[:2]
    pairs = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
    current = written(pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("a") > F.col("b"))).distinct(), "edges")
    state = None
    while True:
        now = current.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if now.n == 0 or (now.n, now.x) == state:
            break
        state = (now.n, now.x)
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        stars = _under_least(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        down = _under_least(stars.where(F.col("a") > F.col("b")).distinct())
        after = down.select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") > F.col("b")).unionAll(down.select("a", F.col("m").alias("b")))
        following = written(after.distinct(), "edges")
        forget(current)
        current = following
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
