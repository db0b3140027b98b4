"""Feature vectors: assembly, neighbours, projection, ridge encoding, identification and alignment."""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sampling import bottom_k
from ..functions.core import div, draw, with_group_stats
from ..functions.quantiles import exact_quantiles
from ..functions.scan import id_block, row_index, with_neighbours
from ..functions.vectors import block_count, dot, explode_unit, rows_and_dim, tiles, with_scale
from ..session import scratch
from .series import lag_similarity

# Penalties tried (11, log-spaced from 10 to 10^6), embedding column prefixes.
ALPHAS = tuple(float(10.0 ** (1 + 0.5 * i)) for i in range(11))
HIGH_DIM_PREFIXES = ("clip_", "resnet_", "dinov2_", "gist_", "ebind_", "emb_")


def prefixed_columns(df: DataFrame, prefix: str) -> list[str]:
    """Columns named `prefix` and a number, by number."""
    numbered = {int(m[1]): m[0] for m in (re.fullmatch(f"{re.escape(prefix)}([0-9]+)", c) for c in df.columns) if m}
    return [numbered[i] for i in sorted(numbered)]


def unit_vectors(df: DataFrame, vec: str, out: str = "u", guard: bool = True) -> DataFrame:
    """Unit length; a zero vector stays zero under the guard, else becomes NULL."""
    n = F.sqrt(dot(vec, vec))
    d = df.withColumn("_n", n)
    scale = F.when(F.col("_n") > 0, F.col("_n"))
    scale = F.coalesce(scale, F.lit(1.0)) if guard else scale
    return d.withColumn("_n", scale).withColumn(out, F.transform(vec, lambda x: x.cast("double") / F.col("_n"))).drop("_n")


def assemble(df: DataFrame, keep, prefix: str) -> DataFrame:
    cols = prefixed_columns(df, prefix)
    if not cols:
        raise KeyError(f"no columns {prefix}<number>")
    return df.select(*keep, F.array(*[F.col(c).cast("double") for c in cols]).alias("vec"))


def nearest_cosine(a: DataFrame, b: DataFrame, key: str, vec: str, group: str | None = None, relation: str = "any", block_rows: int | None = None) -> DataFrame:
    """Largest cosine of each row of `a` with rows of `b`: any other row, a row of the same group, or a row of a
    different group; a row never meets itself (equal keys). Exact: every admissible pair is compared, as products
    of row blocks of bounded size, tile by tile; one number per row and block leaves a task. A row travels once per block
    of the other side: SIDE_BLOCKS times at most while the blocks hold all rows. Rows without a partner are absent."""
    cols = [key, vec] + ([group] if group else [])
    aa, bb = a.select(*cols), b.select(*cols)
    (rows_a, dim), (rows_b, _) = rows_and_dim(aa, vec), rows_and_dim(bb, vec)
    if relation == "same":  # pair inside groups; a large group gets many blocks
        full = block_rows or math.ceil(max(rows_a, rows_b, 1) / block_count(max(rows_a, rows_b), dim))

        def sized(d, s):
            j = with_group_stats(d, [group], _c=F.count("*")).withColumn("_g", F.col(group).cast("long"))
            return j.withColumn(f"_n{s}", F.ceil(F.col("_c") / full).cast("int")).drop("_c")
        aa, bb = sized(aa, "a"), sized(bb, "b")
        size = aa.groupBy("_g").agg(F.max("_na").alias("_na")).join(bb.groupBy("_g").agg(F.max("_nb").alias("_nb")), "_g")
        aa, bb = aa.drop("_na").join(size, "_g"), bb.drop("_nb").join(size, "_g")
    else:
        na, nb = (F.lit(max(1, math.ceil(n / block_rows)) if block_rows else block_count(n, dim)) for n in (rows_a, rows_b))
        aa, bb = (d.withColumns({"_g": F.lit(0).cast("long"), "_na": na, "_nb": nb}) for d in (aa, bb))
    mine = lambda d, s: F.pmod(F.xxhash64(key), F.col(f"_n{s}")).cast("int")
    spread = lambda d, s: F.explode(F.sequence(F.lit(0), F.col(f"_n{s}") - 1))
    aa = aa.withColumn("_ia", mine(aa, "a")).withColumn("_ib", spread(aa, "b")).withColumn("_s", F.lit(0))
    bb = bb.withColumn("_ib", mine(bb, "b")).withColumn("_ia", spread(bb, "a")).withColumn("_s", F.lit(1))
    keep = [*cols, "_g", "_ia", "_ib", "_s"]
    other = relation == "different"

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["_s"] == 0], pdf[pdf["_s"] == 1]
        if x.empty or y.empty:
            return pd.DataFrame({key: [], "best": []})
        own, theirs = (np.vstack(d[vec].to_numpy()).astype("float64") for d in (x, y))
        same = [(x[c].to_numpy(), y[c].to_numpy()) for c in ([key, group] if other else [key])]
        m = np.full(len(x), -np.inf)
        for i in tiles(len(x)):
            for j in tiles(len(y)):
                s = own[i] @ theirs[j].T
                for p, q in same:
                    s[p[i, None] == q[None, j]] = -np.inf
                m[i] = np.maximum(m[i], s.max(axis=1))
        ok = np.isfinite(m)
        return pd.DataFrame({key: x[key].to_numpy()[ok], "best": m[ok]})

    part = aa.select(*keep).unionByName(bb.select(*keep)).groupBy("_g", "_ia", "_ib").applyInPandas(best, f"{key} long, best double")
    return part.groupBy(key).agg(F.max("best").alias("nn_cosine"))


def relation_summary(parts: dict[str, DataFrame]) -> DataFrame:
    """P10, median and P90 of each neighbour relation."""
    long = reduce(DataFrame.unionByName, [d.select(F.lit(n).alias("relation"), "nn_cosine") for n, d in parts.items()])
    n = long.groupBy("relation").agg(F.count("*").alias("n"))
    return n.join(exact_quantiles(long, ["relation"], "nn_cosine", {"p10": .1, "median": .5, "p90": .9}, few=True), "relation")


def cosine_matrix(vectors: DataFrame, key: str) -> DataFrame:
    """Cosine of all pairs of a small table of unit vectors, such as the centroids of groups, given as components
    (key, pos, x): (i, j, cosine)."""
    i, j = vectors.select(F.col(key).alias("i"), "pos", F.col("x").alias("_x")), vectors.select(F.col(key).alias("j"), "pos", F.col("x").alias("_y"))
    return i.join(j, "pos").groupBy("i", "j").agg(F.sum(F.col("_x") * F.col("_y")).alias("cosine"))


def sample_cosine_matrix(df: DataFrame, key: str, vec: str, n: int, seed: int) -> DataFrame:
    """Cosine of all pairs of a seeded sample of n rows, numbered in the order of their key: (i, j, key_i, key_j, cosine). A vector
    without length has cosine 0 with all. n is what a figure has room for; its n * n pairs are the result."""
    s = bottom_k(df.select(key, vec), [], key, n, seed)
    s = s.withColumn("i", F.row_number().over(Window.orderBy(key)) - 1)  # n rows
    x = components(s, [key, "i"], vec).withColumn("x", F.coalesce("x", F.lit(0.0)))
    norm = x.groupBy("i").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_norm"))
    x = x.join(norm, "i").withColumn("x", F.when(F.col("_norm") > 0, F.col("x") / F.col("_norm")).otherwise(0.0))
    a, b = x.select("i", F.col(key).alias("key_i"), "pos", "x"), x.select(F.col("i").alias("j"), F.col(key).alias("key_j"), "pos", F.col("x").alias("_y"))
    return a.join(b, "pos").groupBy("i", "j", "key_i", "key_j").agg(F.sum(F.col("x") * F.col("_y")).alias("cosine"))


def components(df: DataFrame, keep, vec: str) -> DataFrame:
    return df.select(*keep, F.posexplode(vec).alias("pos", "_x")).select(*keep, "pos", F.col("_x").cast("double").alias("x"))


def centroids(df: DataFrame, group: str, vec: str) -> DataFrame:
    """Mean of unit vectors per group, brought back to unit length, as components (group, pos, x)."""
    u = explode_unit(with_scale(df, vec, centre=False), [group], vec)
    m = u.groupBy(group, "pos").agg(F.avg("x").alias("_m"))
    m = with_group_stats(m, [group], _n=F.sqrt(F.sum(F.col("_m") * F.col("_m"))))
    return m.select(group, "pos", div("_m", "_n").alias("x"))


def centre_blocks(df: DataFrame, modality: str, keep, vec: str) -> DataFrame:
    """Components with the mean of their modality taken off."""
    x = components(df, [modality, *keep], vec)
    return with_group_stats(x, [modality, "pos"], _m=F.avg("x")).withColumn("x", F.col("x") - F.col("_m")).drop("_m")


def project_pca(df: DataFrame, key: str, vec: str, k: int = 2) -> DataFrame:
    """First k principal components of all rows (signs are free)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    dim = df.select(F.size(vec)).first()[0]
    means = df.agg(F.array(*[F.avg(F.get(F.col(vec), F.lit(i)).cast("double")) for i in range(dim)]).alias("_m"))
    c = df.crossJoin(F.broadcast(means))  # one row
    c = c.select(key, array_to_vector(F.zip_with(vec, "_m", lambda x, m: x.cast("double") - m)).alias("_v"))
    out = PCA(k=k, inputCol="_v", outputCol="_p").fit(c).transform(c).withColumn("_p", vector_to_array("_p"))
    return out.select(key, *[F.col("_p")[i].alias(f"pc{i + 1}") for i in range(k)])


def to_wide(long: DataFrame, keys, feature: str, value: str, features) -> DataFrame:
    """One column per declared feature."""
    return long.groupBy(*keys).pivot(feature, list(features)).agg(F.first(value))


def grid_check(frames: DataFrame, movie: str, idx: str, time: str, step: float) -> DataFrame:
    """Movies whose frame times are not evenly `step` apart; frames are numbered 0,1,2,.. in time order."""
    d = with_neighbours(frames, [movie], idx, before=1, _d=lambda w: F.col(time) - F.lag(time).over(w))
    return d.groupBy(movie).agg(F.count("*").alias("n_frames"), F.count(F.when(F.abs(F.col("_d") - step) > 1e-8 + 1e-5 * abs(step), 1)).alias("n_uneven"))


def scalar_columns(df: DataFrame, vectors, time: str = "time") -> list[str]:
    """Numeric columns that belong to none of the vector families named by prefix and are not the time (schema only)."""
    family = re.compile("|".join(map(re.escape, vectors)) or r"(?!)")
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != time and not family.match(f.name)]


def feature_timeline(df: DataFrame, features=None, start=None, end=None, time: str = "time", vectors=HIGH_DIM_PREFIXES) -> DataFrame:
    if start is not None:
        df = df.where(F.col(time) >= start)
    if end is not None:
        df = df.where(F.col(time) <= end)
    return df.select(time, *(features or scalar_columns(df, vectors, time)))


def pick_movie(df: DataFrame, name: str, movie: str = "movie") -> DataFrame:
    """Rows of the exact name if there are any, else of the name in any case."""
    exact = df.where(F.col(movie) == name)
    return df.where(F.lower(movie) == name.lower()) if exact.isEmpty() else exact


def split_caption_id(df: DataFrame, c: str) -> DataFrame:
    """movie@time split at the last '@'."""
    p = r"^(.*)@([^@]+)$"
    return df.withColumn("movie", F.regexp_extract(c, p, 1)).withColumn("time", F.regexp_extract(c, p, 2).try_cast("double"))


# -- ridge -------------------------------------------------------------------------------------------------------------

def moments(df: DataFrame, x: str, y: str) -> tuple[int, np.ndarray, int, int]:
    """(n, cross products of [1, x, y], dim x, dim y). Each task adds up one matrix over all its batches and Spark adds
    those; the final (1 + dx + dy)^2 numbers reach the driver, where they are solved."""
    dx, dy = df.select(F.size(x), F.size(y)).first()
    p = 1 + dx + dy

    def run(batches):
        total = np.zeros((p, p))
        for pdf in batches:
            if len(pdf):
                m = np.column_stack([np.ones(len(pdf)), np.vstack(pdf[x].to_numpy()), np.vstack(pdf[y].to_numpy())]).astype("float64")
                total += m.T @ m
        yield pd.DataFrame({"g": [total.ravel()]})

    part = df.select(x, y).mapInPandas(run, "g array<double>").select(F.posexplode("g").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("v"))
    rows = part.toPandas()
    g = np.zeros(p * p)
    g[rows["pos"].to_numpy()] = rows["v"].to_numpy()
    g = g.reshape(p, p)
    return int(round(g[0, 0])), g, dx, dy


class Ridge:
    """Coefficients on centred and scaled inputs: predict with `transform`."""

    def __init__(self, mean, scale, beta, intercept, alpha):
        self.mean, self.scale, self.beta, self.intercept, self.alpha = mean, scale, beta, intercept, alpha

    def transform(self, df: DataFrame, x: str, out: str) -> DataFrame:
        mean, scale, beta, intercept = self.mean, self.scale, self.beta, self.intercept

        @F.pandas_udf("array<double>")
        def predict(v: pd.Series) -> pd.Series:
            return pd.Series(list(((np.vstack(v.to_numpy()) - mean) / scale) @ beta + intercept))

        return df.withColumn(out, predict(F.col(x).cast("array<double>")))


def _centred(n, g, dx):
    mu = g[0, 1:] / n
    c = g[1:, 1:] - n * np.outer(mu, mu)
    return mu, c[:dx, :dx], c[:dx, dx:]


def ridge_path(df: DataFrame, x: str, y: str, alphas=ALPHAS, standardise: bool = True):
    """Leave-one-out error per penalty, and the fit at the best one. One pass for the cross products, one for the
    errors (with the eigenvectors as a small constant of the task)."""
    d = df.select(F.col(x).cast("array<double>").alias(x), F.col(y).cast("array<double>").alias(y))
    n, g, dx, dy = moments(d, x, y)
    mu, cxx, cxy = _centred(n, g, dx)
    scale = np.sqrt(np.where(np.diag(cxx) > 0, np.diag(cxx) / n, 1.0)) if standardise else np.ones(dx)
    cxx, cxy = cxx / np.outer(scale, scale), cxy / scale[:, None]
    w, v = np.linalg.eigh(cxx)
    w = np.maximum(w, 0.0)
    mx, my, q = mu[:dx], mu[dx:], v.T @ cxy
    betas = [v @ (q / (w + a)[:, None]) for a in alphas]

    def errors(batches):
        for pdf in batches:
            xs = (np.vstack(pdf[x].to_numpy()) - mx) / scale
            ys = np.vstack(pdf[y].to_numpy()) - my
            z = (xs @ v) ** 2
            sse = [float((((ys - xs @ b) / (1 - 1 / n - z @ (1 / (w + a)))[:, None]) ** 2).sum()) for a, b in zip(alphas, betas)]
            yield pd.DataFrame({"alpha": list(alphas), "sse": sse})

    path = d.mapInPandas(errors, "alpha double, sse double").groupBy("alpha").agg((F.sum("sse") / (n * dy)).alias("loo_mse"))
    table = path.toPandas().sort_values("alpha").reset_index(drop=True)  # one row per penalty
    i = int(table["loo_mse"].to_numpy().argmin())
    alpha = float(table["alpha"][i])
    fit = Ridge(mx, scale, betas[list(alphas).index(alpha)], my, alpha)
    return path.withColumn("chosen", F.col("alpha") == alpha), fit


# -- identification ----------------------------------------------------------------------------------------------------

def cross_correlations(pred: DataFrame, actual: DataFrame, item: str) -> DataFrame:
    """r between the predicted pattern of item a and the actual pattern of item b over components (item, pos, x). The
    items are the declared stimuli."""
    def z(d, name, out):
        s = with_group_stats(d, [item], _m=F.avg("x"), _sd=F.stddev_pop("x"), _n=F.count("*"))
        return s.select(F.col(item).alias(name), "pos", div(F.col("x") - F.col("_m"), F.col("_sd") * F.sqrt("_n")).alias(out))
    return z(pred, "a", "_x").join(z(actual, "b", "_y"), "pos").groupBy("a", "b").agg(F.sum(F.col("_x") * F.col("_y")).alias("r"))


def rank_table(corr: DataFrame) -> DataFrame:
    """For each predicted item and candidate, how many candidates correlate at least as much (ties count)."""
    w = Window.partitionBy("a").orderBy(F.col("r").desc())
    return corr.withColumn("rank", F.rank().over(w) + F.count("*").over(Window.partitionBy("a", "r")) - 1)


def identification(corr: DataFrame, seed: int, n_perm: int) -> DataFrame:
    """Rank accuracy and its label-permutation p = (1 + #null >= observed) / (1 + n). Permutations are rows: the order
    of seeded draws, one small group per permutation."""
    ranks = rank_table(corr)
    n = corr.select("a").distinct().agg(F.count("*").cast("double").alias("n_items"))
    acc = lambda d, keys: d.groupBy(*keys).agg(F.avg("rank").alias("_mr"))
    obs = acc(ranks.where("a = b"), []).crossJoin(n).select(((F.col("n_items") - F.col("_mr")) / (F.col("n_items") - 1)).alias("rank_accuracy"), "n_items")
    items = corr.select("a").distinct()
    order = items.select(F.col("a").alias("b"), F.row_number().over(Window.orderBy("a")).alias("_i"))
    perms = items.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_perm))))
    perms = perms.withColumn("_i", F.row_number().over(Window.partitionBy("perm").orderBy(draw(seed, "perm", "a"), "a"))).join(order, "_i")
    null = acc(perms.join(ranks, ["a", "b"]), ["perm"]).crossJoin(F.broadcast(obs))  # one row
    beat = null.agg(F.count(F.when((F.col("n_items") - F.col("_mr")) / (F.col("n_items") - 1) >= F.col("rank_accuracy") - 1e-12, 1)).alias("_b"))
    return obs.crossJoin(beat).select("rank_accuracy", F.col("n_items").cast("long").alias("n_items"), ((1 + F.col("_b")) / (1 + F.lit(n_perm))).alias("p"))


# -- alignment ---------------------------------------------------------------------------------------------------------

def procrustes(train: DataFrame, x: str, y: str, ranks=()) -> dict[str, np.ndarray]:
    """Rotations from z-scored x to y components: full and rank-limited, from the SVD of their cross products."""
    d = train.select(F.col(x).cast("array<double>").alias(x), F.col(y).cast("array<double>").alias(y))
    n, g, dx, _ = moments(d, x, y)
    mu = g[0, 1:] / n
    c = g[1:, 1:] - n * np.outer(mu, mu)
    sd = np.sqrt(np.where(np.diag(c) > 0, np.diag(c), 1.0))
    u, _, vt = np.linalg.svd((c / np.outer(sd, sd))[:dx, dx:], full_matrices=False)
    out = {"procrustes": u @ vt}
    out.update({f"procrustes_k{k}": u[:, :k] @ vt[:k] for k in ranks})
    return out


def _mapped(df: DataFrame, x: str, m: np.ndarray, out: str) -> DataFrame:
    @F.pandas_udf("array<double>")
    def apply(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.vstack(v.to_numpy()) @ m))
    return df.withColumn(out, apply(F.col(x).cast("array<double>")))


def align_and_evaluate(train: DataFrame, series: DataFrame, x: str, y: str, movie: str, seed: int, features: str | None = None, ranks=(),
                       n_perm: int = 1000, n_boot: int = 1000) -> DataFrame:
    """Similarity of mapped source and target patterns per route (as they are, rotated, through the features), tested
    against circular shifts shared by all routes, with a bootstrap over movies of the gain. `series` holds (movie, t,
    x, y) with t from 0 to the end of each movie."""
    routes = {"anatomical": series.withColumn("_a", F.col(x).cast("array<double>"))}
    routes.update({name: _mapped(series, x, m, "_a") for name, m in procrustes(train, x, y, ranks).items()})
    if features:
        dec, enc = ridge_path(train, x, features)[1], ridge_path(train, features, y)[1]
        routes["stimulus"] = enc.transform(dec.transform(series, x, "_f"), "_f", "_a")
    long = reduce(DataFrame.unionByName, [d.select(F.lit(n).alias("route"), movie, "t", F.posexplode(F.arrays_zip(F.col("_a").alias("a"), F.col(y).cast("array<double>").alias("b"))).alias("voxel", "_e"))
                                          for n, d in routes.items()])
    lags = lag_similarity(long.select("route", movie, "t", "voxel", F.col("_e.a").alias("a"), F.col("_e.b").alias("b")), ["route", movie], "voxel")
    # one row per route, movie and lag, read several times: written, so that the plan of the routes is not repeated in each use
    path = scratch(series.sparkSession, "lags")
    lags.write.parquet(path)
    return _test_routes(series.sparkSession.read.schema(lags.schema).parquet(path), movie, seed, n_perm, n_boot)


def _test_routes(lags: DataFrame, movie: str, seed: int, n_perm: int, n_boot: int) -> DataFrame:
    """`lags` has one row per route, movie and lag; shifts are drawn within the length of each movie."""
    base = lags.where("route = 'anatomical'").select(movie, "lag", F.col("median_r").alias("_base"))
    x = lags.join(base, [movie, "lag"]).withColumn("d", F.col("median_r") - F.col("_base"))
    obs = x.where("lag = 0")
    o = obs.groupBy("route").agg(F.avg("median_r").alias("isc"), F.avg("d").alias("delta"), F.count("*").alias("n_movies"))
    sizes = lags.groupBy(movie).agg((F.max("lag") + 1).alias("_len"))
    order = sizes.withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(movie)) - 1)  # one row per movie
    shift = order.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_perm)))).withColumn("lag", (draw(seed, "perm", "_i") % F.greatest(F.col("_len") - 1, F.lit(1)) + 1).cast("int"))
    null = shift.drop("_len").join(x, [movie, "lag"]).groupBy("route", "perm").agg(F.avg("median_r").alias("_r"), F.avg("d").alias("_d")).join(o, "route")
    p = null.groupBy("route").agg(((1 + F.count(F.when(F.col("_r") >= F.col("isc"), 1))) / (1 + F.lit(n_perm))).alias("p"),
                                  ((1 + F.count(F.when(F.col("_d") >= F.col("delta"), 1))) / (1 + F.lit(n_perm))).alias("p_delta"))
    size = order.agg(F.count("*").alias("_n"))
    pick = order.select(F.col("_i").alias("_slot")).crossJoin(F.broadcast(size)).withColumn("boot", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))  # one row each
    pick = pick.withColumn("_i", (draw(seed + 1, "boot", "_slot") % F.col("_n")).cast("int"))
    boots = pick.join(order, "_i").join(obs, movie).groupBy("route", "boot").agg(F.avg("d").alias("_d"))
    # n_boot values per route
    ci = boots.groupBy("route").agg(F.percentile("_d", F.lit(.025)).alias("ci_low"), F.percentile("_d", F.lit(.975)).alias("ci_high"))
    return o.join(p, "route").join(ci, "route")
