"""Cross products of columns, added up before they travel.

A task keeps, per group, its rows until they are as many numbers as their product, and from then on the product only. What it
sends is the smaller of both: a small group's rows meet in one task, a hot group arrives as one product per task, dealt to a
few adders, whose sums Spark adds. So no raw row of a large group is shuffled, and no fixed number of blocks limits it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .core import pearson_from_sums

_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
ADDERS = 16
HELD = 1 << 23


class _Sums:
    """Rows and products of some groups; never more numbers than HELD and one batch."""

    def __init__(self, product, width: int):
        self.product, self.width = product, width
        self.shape = product(np.zeros((0, width)))
        self.rows, self.done, self.held = {}, {}, 0

    def fold(self, key) -> None:
        parts = self.rows.pop(key)
        self.held -= sum(p.size for p in parts)
        self.held += 0 if key in self.done else self.shape.size
        self.done[key] = self.done.get(key, 0) + self.product(np.concatenate(parts))

    def add_rows(self, key, m: np.ndarray) -> None:
        parts = self.rows.setdefault(key, [])
        parts.append(m)
        self.held += m.size
        if key in self.done or sum(p.size for p in parts) >= self.shape.size:
            self.fold(key)

    def add_product(self, key, flat: np.ndarray) -> None:
        self.held += 0 if key in self.done else self.shape.size
        self.done[key] = self.done.get(key, 0) + flat.reshape(self.shape.shape)

    def taken(self, fold: bool):
        """(key, rows, product) of all groups, which are then forgotten; fold: products only."""
        for key in list(self.rows) if fold else ():
            self.fold(key)
        for key, parts in self.rows.items():
            yield key, np.concatenate(parts).ravel(), None
        for key, total in self.done.items():
            yield key, None, total.ravel()
        self.rows, self.done, self.held = {}, {}, 0


def _frame(keys, found, salt: int) -> pd.DataFrame:
    rows = [[*key, 0 if product is None else salt, raw, product] for key, raw, product in found]
    return pd.DataFrame(rows, columns=[*keys, "_salt", "_raw", "_products"]).astype({"_raw": object, "_products": object})


def summed_products(df: DataFrame, keys, columns, product) -> DataFrame:
    """(keys, pos, v): `product` of all rows of a group, flattened. product takes a matrix of the columns and returns an
    array of fixed shape that may be added."""
    keys, columns = list(keys), list(columns)
    array = T.ArrayType(T.DoubleType())
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("_salt", T.IntegerType()), T.StructField("_raw", array), T.StructField("_products", array)])
    plain = lambda key: tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))

    def partial(batches):
        sums, salt = _Sums(product, len(columns)), 0
        for pdf in batches:
            if not len(pdf):
                continue
            salt = int(pdf["_salt"].iloc[0])
            for key, g in pdf.groupby(keys, sort=False, dropna=False) if keys else [((), pdf)]:
                sums.add_rows(plain(key), g[columns].to_numpy(dtype="float64"))
            if sums.held > HELD:
                yield _frame(keys, sums.taken(False), salt)
        yield _frame(keys, sums.taken(not keys), salt)

    def total(batches):
        sums, group = _Sums(product, len(columns)), None
        for pdf in batches:
            for *key, _, raw, flat in pdf[[*keys, "_salt", "_raw", "_products"]].itertuples(index=False, name=None):
                key = plain(tuple(key))
                if key != group:
                    yield _frame(keys, sums.taken(True), 0)
                    group = key
                if raw is not None:
                    sums.add_rows(key, np.asarray(raw, float).reshape(-1, len(columns)))
                else:
                    sums.add_product(key, np.asarray(flat, float))
        yield _frame(keys, sums.taken(True), 0)

    x = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns], F.pmod(F.spark_partition_id(), F.lit(ADDERS)).alias("_salt"))
    x = x.mapInPandas(partial, schema)
    if keys:
        x = x.repartition(*keys, "_salt").sortWithinPartitions(*keys, "_salt").mapInPandas(total, schema)
    return x.select(*keys, F.posexplode("_products").alias("pos", "v")).groupBy(*keys, "pos").agg(F.sum("v").alias("v"))


def pair_sums(wide: DataFrame, keys, members) -> DataFrame:
    """Six sums for every pair a < b of the member columns, over rows where both are present. `members` is a
    declared roster, so the matrix has a fixed size."""
    keys, members = list(keys), list(members)
    first, second = np.triu_indices(len(members), 1)

    def product(x):
        there = np.isfinite(x)
        x = np.where(there, x, 0.0)
        both = there[:, first] & there[:, second]
        u, v = np.where(both, x[:, first], 0.0), np.where(both, x[:, second], 0.0)
        return np.stack([both.sum(axis=0), u.sum(axis=0), v.sum(axis=0), (u * u).sum(axis=0), (v * v).sum(axis=0), (u * v).sum(axis=0)])

    n = len(first)
    flat = summed_products(wide, keys, members, product)
    named = [F.sum(F.when(F.floor(F.col("pos") / n) == i, F.col("v"))).alias(s) for i, s in enumerate(_SUMS)]
    sums = flat.groupBy(*keys, (F.col("pos") % n).alias("pair")).agg(*named)
    at = lambda xs: F.get(F.array(*[F.lit(int(i)) for i in xs]), F.col("pair"))
    return sums.select(*keys, at(first).alias("a"), at(second).alias("b"), *_SUMS)


def pair_correlations(long: DataFrame, keys, at, member: str, value: str, roster, min_n: int = 2) -> DataFrame:
    """Pearson r between members, over the `at` positions both have: (keys, member_a, member_b, n, r).
    Constant sides give no row; a member outside the roster is an error."""
    roster = [str(m) for m in roster]
    at = [at] if isinstance(at, str) else list(at)
    known = F.col(member).cast("string").isin(*roster)
    checked = F.when(known, F.col(member).cast("string")).otherwise(F.raise_error(F.concat(F.lit("not in the roster: "), F.coalesce(F.col(member).cast("string"), F.lit("NULL")))))
    wide = long.withColumn(member, checked).groupBy(*keys, *at).pivot(member, roster).agg(F.avg(value))
    sums = pair_sums(wide, keys, roster)
    names = F.array(*[F.lit(m) for m in roster])
    r = pearson_from_sums("n", "sx", "sy", "sxx", "syy", "sxy")
    return (sums.where(F.col("n") >= min_n).select(*keys, F.get(names, F.col("a")).alias("member_a"), F.get(names, F.col("b")).alias("member_b"),
                                                   F.col("n").cast("long").alias("n"), r.alias("r")).where("r is not null"))


def normal_equations(df: DataFrame, keys, x, y) -> DataFrame:
    """Sums X'X and X'Y (first column 1) per key as rows (keys, pos, v); missing x is 0, rows without y drop."""
    x, y = list(x), list(y)

    def product(m):
        full = np.column_stack([np.ones(len(m)), np.nan_to_num(m[:, : len(x)], nan=0.0), m[:, len(x):]])
        full = full[np.isfinite(full).all(axis=1)]
        return full.T @ full

    return summed_products(df, keys, [*x, *y], product)


def least_squares(df: DataFrame, keys, x, y) -> DataFrame:
    """OLS coefficients per key: array `beta` of 1 + len(x) values for one y. The grouped step sees one small
    matrix per key, never the rows."""
    keys, p = list(keys), len(x) + 2
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("beta", T.ArrayType(T.DoubleType()))])

    def solve(pdf):
        g = np.zeros(p * p)
        g[pdf["pos"].to_numpy()] = pdf["v"].to_numpy()
        g = g.reshape(p, p)
        scale = np.sqrt(np.where(np.diag(g)[:-1] > 0, np.diag(g)[:-1], 1.0))
        a, b = g[:-1, :-1] / np.outer(scale, scale), g[:-1, -1] / scale
        beta = np.linalg.lstsq(a, b, rcond=1e-12)[0] / scale
        out = {k: pdf[k].iloc[0] for k in keys}
        out["beta"] = beta
        return pd.DataFrame([out], columns=keys + ["beta"])

    return normal_equations(df, keys, x, [y]).groupBy(*keys).applyInPandas(solve, schema)
