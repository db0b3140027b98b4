"""Array-column helpers and the blocked pair kernel.

Mean correlations over sets of pairs need no pairs: with centred unit vectors u, the sum of r over A x B is
(sum of u over A) . (sum of u over B), component by component. With missing components the same holds for the rows of two patterns
of missing ones, over what both have; few patterns are therefore summed too. Only statistics that are not sums (a nearest neighbour)
and tables with about as many patterns as rows go through blocks of bounded size, which send rows, never pairs, through the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def total(a) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def with_scale(df: DataFrame, vec: str, centre: bool = True) -> DataFrame:
    """Keep rows whose vector has a length, with its mean (0 for uncentred use) and the length about it."""
    n = F.size(vec).cast("double")
    df = df.withColumn("_mu", total(vec) / n if centre else F.lit(0.0)).withColumn("_sq", dot(vec, vec))
    df = df.withColumn("_len", F.sqrt(F.greatest(F.col("_sq") - n * F.col("_mu") * F.col("_mu"), F.lit(0.0))))
    return df.where(F.col("_len") > 1e-9 * F.greatest(F.sqrt("_sq"), F.lit(1e-300))).drop("_sq")


def explode_unit(df: DataFrame, keep, vec: str) -> DataFrame:
    """Components (keep, pos, x) of the unit vectors of a `with_scale` table. Explode last: joins then move arrays,
    and the components meet a partial aggregate in the same stage."""
    x = df.select(*keep, "_mu", "_len", F.posexplode(vec).alias("pos", "_x"))
    return x.select(*keep, "pos", ((F.col("_x").cast("double") - F.col("_mu")) / F.col("_len")).alias("x"))


def complete_vectors(df: DataFrame, keys, vec: str, out: str = "v") -> DataFrame:
    """Drop the components that are missing in any row of the group, for all its rows. The list of dropped
    components is no longer than a vector."""
    bad = df.select(*keys, F.posexplode(vec).alias("pos", "_x")).where(F.col("_x").isNull() | F.isnan("_x"))
    bad = bad.groupBy(*keys).agg(F.collect_set("pos").alias("_bad"))
    return df.join(bad, list(keys), "left").withColumn(out, F.when(F.col("_bad").isNull(), F.col(vec)).otherwise(
        F.filter(vec, lambda x, i: ~F.array_contains("_bad", i)))).drop("_bad")


def pearson_complete(a, b) -> tuple[Column, Column]:
    """(r, n) of two vectors over components both have; r is NULL below 3 or for a constant side."""
    z = F.filter(F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y")), lambda e: e["x"].isNotNull() & e["y"].isNotNull())
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("sx", "sy", "xx", "yy", "xy")])

    def add(s, e):
        x, y = e["x"].cast("double"), e["y"].cast("double")
        return F.struct((s["sx"] + x).alias("sx"), (s["sy"] + y).alias("sy"), (s["xx"] + x * x).alias("xx"), (s["yy"] + y * y).alias("yy"), (s["xy"] + x * y).alias("xy"))

    n = F.size(z).cast("long")

    def finish(s):
        vx, vy = s["xx"] - s["sx"] * s["sx"] / n, s["yy"] - s["sy"] * s["sy"] / n
        ok = (n >= 3) & (vx > s["xx"] * 1e-12) & (vy > s["yy"] * 1e-12)
        return F.when(ok, (s["xy"] - s["sx"] * s["sy"] / n) / F.sqrt(vx * vy))

    return F.aggregate(z, zero, add, finish), n


# Rows that a task multiplies at once; blocks on a side while they fit; bytes of values that a block may have.
TILE_ROWS = 1024
SIDE_BLOCKS = 8
BLOCK_BYTES = 64 << 20


def block_count(n_rows: int, dim: int) -> int:
    """Blocks of rows for a product with all rows. A row travels once per block of the other side, so the number does not
    grow before a block is full: up to then what is shuffled grows as the rows do."""
    full = max(TILE_ROWS, BLOCK_BYTES // (8 * max(1, dim)))
    return max(1, min(SIDE_BLOCKS, math.ceil(n_rows / TILE_ROWS)), math.ceil(n_rows / full))


def rows_and_dim(df: DataFrame, vec: str) -> tuple[int, int]:
    r = df.agg(F.count("*").alias("n"), F.max(F.size(vec)).alias("d")).first()
    return r.n, r.d or 1


def tiles(n: int) -> list[slice]:
    return [slice(i, i + TILE_ROWS) for i in range(0, n, TILE_ROWS)]


def block_pairs(df: DataFrame, key: str, n_blocks: int, reduce, schema, *columns) -> DataFrame:
    """Apply `reduce(left, right, same)` to every unordered pair of tiles of rows. Rows are hashed into blocks by
    a unique key, so blocks stay near n / n_blocks rows whatever the data's groups look like; each row travels
    n_blocks times, and the task of a pair of blocks goes through their tiles. What a pair of tiles yields is up to
    `reduce` (a maximum per row, sums per cell)."""
    b = F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")
    x = df.select(key, *columns).withColumn("_b", b).withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    x = x.withColumn("_lo", F.least("_b", "_p")).withColumn("_hi", F.greatest("_b", "_p"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(batches, ignore_index=True)
        lo, hi = int(pdf["_lo"].iloc[0]), int(pdf["_hi"].iloc[0])
        left, right = (pdf[pdf["_b"] == lo], pdf[pdf["_b"] == hi]) if lo < hi else (pdf, pdf)
        held = []
        for i in tiles(len(left)):
            for j in tiles(len(right)):
                if lo < hi or i.start <= j.start:
                    held.append(reduce(left[i], right[j], lo == hi and i.start == j.start))
                    if sum(map(len, held)) > 100_000:
                        yield pd.concat(held)
                        held = []
        if held:
            yield pd.concat(held)

    return x.groupBy("_lo", "_hi").applyInPandas(run, schema)


def cell_sums(df: DataFrame, key: str, vec: str, cell: str, n_blocks: int) -> DataFrame:
    """Over unordered pairs of rows, by unordered pair of cells: number of pairs with an r, sum of r, sum of joint
    component counts. r uses the components both rows have (at least 3)."""
    schema = "cell_a long, cell_b long, n_pairs long, sum_r double, sum_n double"

    def centred(side):
        x = np.vstack(side[vec].to_numpy()).astype("float64")
        there = np.isfinite(x)
        x = np.where(there, x, 0.0)
        own = x.sum(axis=1, keepdims=True) / np.maximum(there.sum(axis=1, keepdims=True), 1)
        return np.where(there, x - own, 0.0), there.astype("float64")

    def left_over(x, there, other, n):
        """Sum and variation of each left row over the components the right row has too; 0 where it is constant."""
        s, q = x @ other.T, (x * x) @ other.T
        rest = q - s * s / n
        scale = np.square(np.vstack([x.max(axis=1, initial=0), x.min(axis=1, initial=0)])).max(axis=0)[:, None]
        return s, np.where(rest > 1e-12 * np.maximum(q, scale), rest, 0.0)

    def reduce(left, right, same):
        (x, mx), (y, my) = centred(left), centred(right)
        n = mx @ my.T
        some = np.maximum(n, 1)
        sx, vx = left_over(x, mx, my, some)
        sy, vy = left_over(y, my, mx, some.T)
        both = vx * vy.T
        r = np.where(both > 0, (x @ y.T - sx * sy.T / some) / np.sqrt(np.where(both > 0, both, 1.0)), np.nan)
        ok = (n >= 3) & np.isfinite(r)
        if same:
            ok &= np.triu(np.ones_like(ok), 1).astype(bool)
        la, ia = np.unique(left[cell].to_numpy(), return_inverse=True)
        lb, ib = np.unique(right[cell].to_numpy(), return_inverse=True)
        ha, hb = np.eye(len(la))[ia], np.eye(len(lb))[ib]
        cnt, sr, sn = (ha.T @ np.where(ok, m, 0.0) @ hb for m in (np.ones_like(r), r, n))
        i, j = np.nonzero(cnt)
        return pd.DataFrame({"cell_a": la[i], "cell_b": lb[j], "n_pairs": cnt[i, j].astype("int64"), "sum_r": sr[i, j], "sum_n": sn[i, j]})

    pairs = block_pairs(df.where(F.col(vec).isNotNull()), key, n_blocks, reduce, schema, vec, cell)
    return pairs.groupBy(F.least("cell_a", "cell_b").alias("cell_a"), F.greatest("cell_a", "cell_b").alias("cell_b")).agg(
        F.sum("n_pairs").alias("n_pairs"), (F.sum("sum_r") / F.sum("n_pairs")).alias("mean_r"), (F.sum("sum_n") / F.sum("n_pairs")).alias("mean_n"))


# Patterns of missing components that may reach the driver; rows per sum from which on sums are less work than pairs.
PATTERNS = 1024
ROWS_PER_SUM = 8


def pattern(vec: str) -> Column:
    """The components that a vector has, as a text of 1 and 0."""
    finite = lambda x: F.abs(x.cast("double")) < F.lit(float("inf"))
    return F.array_join(F.transform(vec, lambda x: F.when(finite(x), "1").otherwise("0")), "")


def few_patterns(df: DataFrame, vec: str, cell: str) -> list[str] | None:
    """The patterns of a table; None if they and their cells are too many to be worth a sum each."""
    groups = df.where(F.col(vec).isNotNull()).groupBy(pattern(vec).alias("pattern"), cell).agg(F.count("*").alias("n"))
    found = groups.groupBy("pattern").agg(F.count("*").alias("cells"), F.sum("n").alias("n")).limit(PATTERNS + 1).collect()
    sums = len(found) * sum(r.cells for r in found)
    return [r.pattern for r in found] if len(found) <= PATTERNS and sums * ROWS_PER_SUM <= sum(r.n for r in found) else None


def pattern_cell_sums(df: DataFrame, vec: str, cell: str, patterns: list[str]) -> DataFrame:
    """`cell_sums` without pairs. The rows of a pattern p become unit vectors over the components that a
    pattern q has too, for each q; their sum in a cell, times the sum of the rows of q over those of p in another, adds up the r of
    all pairs of the two. Work grows with the rows times the patterns."""
    number = {p: i for i, p in enumerate(patterns)}
    dim = max(map(len, patterns), default=0)
    has = [np.array(list(p.ljust(dim, "0"))) == "1" for p in patterns]

    def unit(x):
        """Rows centred and of length 1; zeros for a constant row."""
        varies = x.max(axis=1) > x.min(axis=1)
        x = x - x.mean(axis=1, keepdims=True)
        x /= np.where(varies, np.abs(x).max(axis=1), 1.0)[:, None]
        return np.where(varies[:, None], x / np.where(varies, np.linalg.norm(x, axis=1), 1.0)[:, None], 0.0), varies

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for own, rows in pdf.groupby("_pattern"):
                p, rows = number[own], rows.sort_values(cell)
                x = np.vstack(rows[vec].to_numpy()).astype("float64")
                cells, first = np.unique(rows[cell].to_numpy(), return_index=True)
                found = []
                for q, other in enumerate(has):
                    both = np.flatnonzero(has[p] & other)
                    if len(both) >= 3:
                        u, varies = unit(x[:, both])
                        total = np.zeros((len(cells), 1 + dim))  # number of rows, sum of their vectors
                        total[:, 0] = np.add.reduceat(varies.astype("float64"), first)
                        total[:, 1 + both] = np.add.reduceat(u, first)
                        found.append(pd.DataFrame({"p": p, "q": q, "joint": len(both), "cell": cells, "total": list(total)}))
                if found:
                    yield pd.concat(found)

    x = df.where(F.col(vec).isNotNull()).select(F.col(cell).cast("long").alias(cell), vec, pattern(vec).alias("_pattern"))
    x = x.mapInPandas(sums, "p int, q int, joint int, cell long, total array<double>")
    x = x.select("p", "q", "joint", "cell", F.posexplode("total").alias("pos", "v")).groupBy("p", "q", "joint", "cell", "pos").agg(F.sum("v").alias("v"))
    left = x.select("p", "q", "pos", "joint", F.col("cell").alias("_a"), F.col("v").alias("_va"))
    right = x.select(F.col("q").alias("p"), F.col("p").alias("q"), "pos", F.col("cell").alias("_b"), F.col("v").alias("_vb"))
    # Each pair of rows is met from both sides, and each row meets itself, with r = 1.
    itself = F.when((F.col("p") == F.col("q")) & F.col("_a").eqNullSafe(F.col("_b")), F.col("_va")).otherwise(0.0)
    product, counts = F.col("_va") * F.col("_vb"), F.col("pos") == 0
    n = F.when(counts, product - itself).otherwise(0.0)
    g = left.join(right, ["p", "q", "pos"]).groupBy(F.least("_a", "_b").alias("cell_a"), F.greatest("_a", "_b").alias("cell_b")).agg(
        F.sum(n).alias("_n"), F.sum(F.when(counts, -itself).otherwise(product)).alias("_r"), F.sum(n * F.col("joint")).alias("_joint"))
    return g.where("_n > 0").select("cell_a", "cell_b", (F.col("_n") / 2).cast("long").alias("n_pairs"), (F.col("_r") / F.col("_n")).alias("mean_r"),
                                    (F.col("_joint") / F.col("_n")).alias("mean_n"))
