"""Time-series operators on long tables (keys, t, value)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import div, fisher_z, r_agg, rint_long, significant, with_group_stats
from ..functions.gram import least_squares, pair_correlations
from ..functions.quantiles import exact_quantiles
from ..functions.statistics import correlation_p
from ..functions.scan import neighbourhood, running_total, with_neighbours

# Shift of the response (volumes, seconds), feature frame spacing, chunk length, kernel length (seconds).
SHIFT_VOLUMES, SHIFT_S, FRAME_S, CHUNK_S, KERNEL_S = 3, 4.5, 0.5, 4.5, 32.0


def roi_mean(series: DataFrame, members: DataFrame, unit: str, roi: str, keys, value: str = "value") -> DataFrame:
    return series.join(members.select(unit, roi).distinct(), unit).groupBy(roi, *keys).agg(F.avg(value).alias(value), F.count(value).alias("n_units"))


def model_columns(df: DataFrame, columns=(), prefixes=(), first: dict[str, int] | None = None) -> list[str]:
    """Confound columns of a model, which the table must have: named ones, all with one of the prefixes, and the
    first n (by name) of each prefix in `first`. Works on the schema only."""
    chosen = list(columns)
    for p in prefixes:
        chosen += [c for c in df.columns if c.startswith(p)]
    for p, n in (first or {}).items():
        chosen += sorted(c for c in df.columns if c.startswith(p))[:n]
    absent = set(chosen) - set(df.columns)
    if absent:
        raise KeyError(f"columns not found: {sorted(absent)}")
    return chosen


def residuals(df: DataFrame, keys, confounds, value: str = "value", out: str = "residual") -> DataFrame:
    """What ordinary least squares with an intercept leaves of a series; missing confounds count as 0."""
    if not confounds:
        return df.withColumn(out, F.col(value))
    beta = least_squares(df, keys, confounds, value)
    fit = F.get("beta", F.lit(0))
    for i, c in enumerate(confounds):
        x = F.col(c).cast("double")
        fit = fit + F.get("beta", F.lit(i + 1)) * F.coalesce(F.when(~F.isnan(x), x), F.lit(0.0))
    return df.join(beta, list(keys)).withColumn(out, F.col(value) - fit).drop("beta")


def z_score(df: DataFrame, keys, value: str, out: str = "z", missing_if_constant: bool = False) -> DataFrame:
    """Population z-score per group; a constant group keeps its values, or becomes missing."""
    j = with_group_stats(df, keys, _m=F.avg(value), _sd=F.stddev_pop(value))
    z = (F.col(value) - F.col("_m")) / F.when(F.col("_sd") > 0, F.col("_sd"))
    return j.withColumn(out, z if missing_if_constant else F.coalesce(z, F.col(value))).drop("_m", "_sd")


def segments(series: DataFrame, events: DataFrame, run, segment: str, tr: float, shift: int = 0, value: str = "value") -> DataFrame:
    """Cut runs at events: volumes rint(onset/TR) + shift up to rint(duration/TR) more, as far as the run goes.
    Each event lists its volumes, so the range join is an equi-join. The planner takes the list to be as small as the events,
    so the join is told to send neither side through the driver."""
    start, length = rint_long(F.col("onset") / tr) + shift, rint_long(F.col("duration") / tr)
    e = events.select(*run, segment, start.alias("_s"), length.alias("_l")).where("_l > 0")
    e = e.select(*run, segment, "_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_l") - 1)).alias("pos"))
    return e.withColumn("t", F.col("_s") + F.col("pos")).drop("_s").join(series.select(*run, "t", value).hint("merge"), [*run, "t"])


def movie_segments(series: DataFrame, events: DataFrame, run, segment: str, tr: float, value: str = "value") -> DataFrame:
    return z_score(segments(series, events, run, segment, tr, value=value), [*run, segment], value)


def truncate_to_shortest(df: DataFrame, keys, member: str, t: str = "t") -> DataFrame:
    """Keep positions every member of the group reaches."""
    longest = df.groupBy(*keys, member).agg(F.max(t).alias("_e"))
    return df.join(longest.groupBy(*keys).agg(F.min("_e").alias("_e")), list(keys)).where(F.col(t) <= F.col("_e")).drop("_e")


def pairwise(df: DataFrame, keys, member: str, roster, value: str = "value", t: str = "t", min_len: int = 2) -> DataFrame:
    """Correlations over all pairs of a declared roster (subjects for ISC, sessions for WSC)."""
    return pair_correlations(truncate_to_shortest(df, keys, member, t), keys, t, member, value, roster, min_len)


def fisher_summary(pairs: DataFrame, keys, r: str = "r") -> DataFrame:
    z = fisher_z(F.col(r))
    return pairs.groupBy(*keys).agg(F.tanh(F.avg(z)).alias("mean_r"), F.stddev_pop(z).alias("sd_z"), F.count(r).alias("n_obs"))


def mid_ranks(df: DataFrame, keys, value: str, out: str) -> DataFrame:
    """Ranks with ties averaged: values are counted first, then ranked by a running count over value blocks. Values
    that agree in nine significant digits are tied, as rounding noise has no rank."""
    v = df.withColumn("_v", significant(F.col(value)))
    c = v.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    r = running_total(c, keys, ["_v"], F.floor(F.col("_v") * 1024).cast("long"), F.col("_c"), "_below", inclusive=False)
    return v.join(r.withColumn(out, F.col("_below") + (F.col("_c") + 1) / 2).drop("_below", "_c"), [*keys, "_v"]).drop("_v")


def spearman(df: DataFrame, keys, x: str, y: str, min_n: int = 3) -> DataFrame:
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    r = mid_ranks(mid_ranks(d, keys, x, "_rx"), keys, y, "_ry")
    return r.groupBy(*keys).agg(r_agg("_rx", "_ry").alias("rho"), F.count("*").alias("n")).where(F.col("n") >= min_n).withColumn("p", correlation_p(F.col("rho"), F.col("n")))


def mean_r_per_member(pairs: DataFrame, keys) -> DataFrame:
    """Fisher mean of all pairs a member takes part in."""
    x = pairs.withColumn("member", F.explode(F.array("member_a", "member_b")))
    return x.groupBy(*keys, "member").agg(F.tanh(F.avg(fisher_z(F.col("r")))).alias("mean_r"))


def correlation_against_motion(pairs: DataFrame, motion: DataFrame, keys, session: str) -> DataFrame:
    """Spearman rho between each member-session's mean r and its mean displacement. `motion` holds
    (member, session, mean_fd)."""
    m = mean_r_per_member(pairs, [*keys, session]).join(motion, ["member", session])
    return spearman(m, keys, "mean_r", "mean_fd")


def centre_crop(df: DataFrame, keys, n: int, t: str = "t") -> DataFrame:
    size = df.groupBy(*keys).agg((F.max(t) + 1).alias("_n"))
    s = F.floor((F.col("_n") - n) / 2)
    return df.join(size, list(keys)).where((F.col(t) >= s) & (F.col(t) < s + n)).withColumn(t, F.col(t) - s).drop("_n")


def triple_means(pairs: DataFrame, keys) -> DataFrame:
    """Mean of the three correlations in every triple of a declared roster, from pair correlations."""
    p = lambda a, b, r: pairs.select(*keys, F.col("member_a").alias(a), F.col("member_b").alias(b), F.col("r").alias(r))
    j = p("m1", "m2", "_x").join(p("m2", "m3", "_y"), [*keys, "m2"]).join(p("m1", "m3", "_z"), [*keys, "m1", "m3"])
    return j.select(*keys, F.concat_ws("|", "m1", "m2", "m3").alias("triple"), ((F.col("_x") + F.col("_y") + F.col("_z")) / 3).alias("mean_r"))


def label_repeats(df: DataFrame, movie: str, session_no: str, repeated) -> DataFrame:
    return df.withColumn(movie, F.when(F.col(movie).isin(*repeated), F.concat_ws(" ", F.col(movie), F.col(session_no).cast("string"))).otherwise(F.col(movie)))


def average_repetitions(df: DataFrame, keys, repetition: str, value: str = "value", t: str = "t") -> DataFrame:
    """Mean series over repetitions cut to the shortest, z-scored again."""
    a = truncate_to_shortest(df, keys, repetition, t).groupBy(*keys, t).agg(F.avg(value).alias("_a"))
    return z_score(a, keys, "_a", value).drop("_a")


def mean_similarity(pairs: DataFrame, keys) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.avg("r").alias("mean_r"), F.count("r").alias("n_pairs"))


def tsnr(df: DataFrame, keys, value: str) -> DataFrame:
    """Mean over standard deviation per unit, where the deviation is above 0."""
    return df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s")).where("_s > 0").select(*keys, (F.col("_m") / F.col("_s")).alias("tsnr"))


def tsnr_ratio(units: DataFrame, roi: str, version: str, base: str, other: str) -> DataFrame:
    g = units.groupBy(roi).agg(*[F.avg(F.when(F.col(version) == v, F.col("tsnr"))).alias(n) for v, n in ((base, "tsnr_base"), (other, "tsnr_other"))])
    return g.withColumn("ratio", div("tsnr_other", "tsnr_base"))


def autocorrelation(df: DataFrame, unit: str, t: str, value: str, max_lag: int = 5) -> DataFrame:
    """Autocorrelation at lags 1..max_lag per unit, averaged over units; t counts 0,1,2,.. within a unit. Constant
    units count as 0."""
    c = with_group_stats(df, [unit], _m=F.avg(value)).withColumn("_c", F.col(value) - F.col("_m"))
    w = with_neighbours(c, [unit], t, after=max_lag, **{f"_l{k}": (lambda w, k=k: F.lead("_c", k).over(w)) for k in range(1, max_lag + 1)})
    g = w.groupBy(unit).agg(F.sum(F.col("_c") * F.col("_c")).alias("_v"), *[F.coalesce(F.sum(F.col("_c") * F.col(f"_l{k}")), F.lit(0.0)).alias(f"_s{k}") for k in range(1, max_lag + 1)])
    v = F.when(F.col("_v") > 1e-12, F.col("_v")).otherwise(1.0)
    m = g.agg(*[F.avg(F.col(f"_s{k}") / v).alias(f"_a{k}") for k in range(1, max_lag + 1)])
    rows = F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.col(f"_a{k}").alias("acf")) for k in range(1, max_lag + 1)])
    return m.select(F.explode(rows).alias("x")).select("x.*")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _circular(at: pd.Series, first: pd.Series, second: pd.Series, end: pd.Series) -> pd.Series:
    """Correlation of two series at every circular shift of the second; 0 where one is constant. Their values stand at the
    positions `at` of 0 .. end, elsewhere they are 0."""
    def one(t, p, q, last):
        line = np.zeros((2, last + 1))
        line[:, np.asarray(t, int)] = np.nan_to_num([np.asarray(p, float), np.asarray(q, float)])
        p, q = line - line.mean(axis=1, keepdims=True)
        size = np.sqrt((p @ p) * (q @ q))
        if size < 1e-24:
            return np.zeros(len(p))
        spectrum = np.fft.rfft(q) * np.fft.rfft(p).conj()
        return np.fft.irfft(spectrum, n=len(p)) / size

    return pd.Series([one(*row) for row in zip(at, first, second, end)])


FEW_UNITS = 10_000


def lag_similarity(df: DataFrame, keys, unit, t: str = "t", a: str = "a", b: str = "b") -> DataFrame:
    """r between two series at every circular lag, per unit, then the median over units; lag 0 is observed, the
    rest its null. The series of a group (keys) run from 0 to the last position any of its units has; positions
    without a value count as 0. A task holds the series of one unit.

    Units are counted first: the values of one lag are kept as they are up to FEW_UNITS, beyond that the median comes from
    exact_quantiles, which gathers none."""
    keys = list(keys)
    full = [*keys, *([unit] if isinstance(unit, str) else unit)]
    g = df.groupBy(*full, F.col(t).cast("int").alias("_t")).agg(F.avg(a).alias("_a"), F.avg(b).alias("_b")).where("_t is not null")
    end = df.groupBy(*keys).agg(F.max(t).cast("int").alias("_end"))
    g = g.groupBy(*full).agg(F.collect_list(F.struct("_t", "_a", "_b")).alias("_s")).join(end, keys)
    r = g.select(*full, F.posexplode(_circular(F.col("_s._t"), F.col("_s._a"), F.col("_s._b"), F.col("_end"))).alias("lag", "r"))
    most = df.select(*full).distinct().groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most > FEW_UNITS:
        return exact_quantiles(r, [*keys, "lag"], "r", {"median_r": .5})
    return r.groupBy(*keys, "lag").agg(F.percentile("r", F.lit(0.5)).alias("median_r"))


def response_kernel() -> list[float]:
    """Double-gamma response (peak 6 s, undershoot 16 s, ratio 1/6) on the frame grid, summing to 1."""
    t = np.arange(0, KERNEL_S + FRAME_S, FRAME_S)
    h = t ** 5 * np.exp(-t) / math.factorial(5) - t ** 15 * np.exp(-t) / math.factorial(15) / 6.0
    return [float(x) for x in h / h.sum()]


def _weighted(queries: DataFrame, frames: DataFrame, movie: str, value: str) -> DataFrame:
    """queries (movie, j, w: array of (idx, weight)) against frames (movie, idx, value)."""
    q = queries.select(movie, "j", F.explode("w").alias("x")).select(movie, "j", F.col("x.idx").alias("idx"), F.col("x.weight").alias("_w"))
    hit = q.join(frames.select(movie, "idx", value), [movie, "idx"])
    return hit.groupBy(movie, "j").agg(F.sum(F.col("_w") * F.col(value)).alias(value))


def convolved(frames: DataFrame, movie: str, kernel, value: str = "value", block: int = 4096) -> DataFrame:
    """(movie, idx, value) convolved with a kernel that starts at 0, up to its end beyond the last frame. Movies are cut
    into blocks that get the few frames before them too, so that a group has at most block + len(kernel) rows."""
    kernel = np.asarray(kernel, float)
    wide, _ = neighbourhood(frames.select(movie, F.col("idx").cast("long").alias("idx"), F.col(value).cast("double").alias(value)), [movie], "idx", len(kernel) - 1, 0, block)
    schema = T.StructType([frames.schema[movie], T.StructField("idx", T.LongType()), T.StructField(value, T.DoubleType())])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        start, home = int(pdf["idx"].min()), int(pdf["_blk"].iloc[0]) * block
        line = np.zeros(int(pdf["idx"].max()) - start + 1)
        line[pdf["idx"].to_numpy() - start] = np.nan_to_num(pdf[value].to_numpy())
        out = np.convolve(line, kernel)
        at = start + np.arange(len(out))
        own = (at >= home) & (at < home + block)
        return pd.DataFrame({movie: pdf[movie].iloc[0], "idx": at[own], value: out[own]})

    return wide.groupBy(movie, "_blk").applyInPandas(one, schema)


def features_at(frames: DataFrame, queries: DataFrame, movie: str, model: str, tr: float = 1.5, value: str = "value") -> DataFrame:
    """Feature values for response samples j: `hrf` (convolved, linear interpolation), `fixed` (linear
    interpolation), `chunkmean` (mean of a chunk, last frame when it is empty)."""
    n = frames.groupBy(movie).agg((F.max("idx") + 1).alias("_n"), F.max_by(value, "idx").alias("_last"))
    q = queries.join(n, movie)
    if model == "chunkmean":
        c = frames.groupBy(movie, F.floor(F.col("idx") * FRAME_S / CHUNK_S).alias("j")).agg(F.avg(value).alias("_v"))
        return q.join(c, [movie, "j"], "left").select(movie, "j", F.coalesce("_v", "_last").alias(value))
    h = response_kernel() if model == "hrf" else [1.0]
    at = (F.col("j") * tr + (SHIFT_S if model == "hrf" else 0.0)) / FRAME_S
    p = F.least(F.greatest(at, F.lit(0.0)), F.col("_n") + len(h) - 2)
    q = q.withColumn("_lo", F.floor(p)).withColumn("_f", p - F.floor(p))
    w = F.array(F.struct(F.col("_lo").alias("idx"), (1 - F.col("_f")).alias("weight")), F.struct((F.col("_lo") + 1).alias("idx"), F.col("_f").alias("weight")))
    got = _weighted(q.withColumn("w", w), convolved(frames, movie, h, value) if len(h) > 1 else frames, movie, value)
    return queries.join(got, [movie, "j"], "left").select(movie, "j", F.coalesce(value, F.lit(0.0)).alias(value))


def trial_patterns(series: DataFrame, trials: DataFrame, run, trial: str, keys=(), value: str = "value") -> DataFrame:
    """Mean of the two samples that follow the onset volume by the response shift."""
    c = F.col("onset_tr") + SHIFT_VOLUMES
    x = trials.select(*run, trial, F.explode(F.array(c, c + 1)).alias("t"))
    return x.join(series, [*run, "t"]).groupBy(*run, trial, *keys).agg(F.avg(value).alias(value), F.count(value).alias("n"))


def movie_patterns(series: DataFrame, events: DataFrame, run, segment: str, tr: float, value: str = "value") -> DataFrame:
    return segments(series, events, run, segment, tr, SHIFT_VOLUMES, value)


def residual_correlation(res: DataFrame, keys, confound: str, value: str = "value", residual: str = "residual") -> DataFrame:
    """|r| between residual and confound per run; it must vanish. Runs with nothing left (as many regressors as
    samples) count as 0."""
    x = F.coalesce(F.col(confound).cast("double"), F.lit(0.0))
    left = F.stddev_pop(residual) > 1e-9 * F.stddev_pop(value)
    return res.groupBy(*keys).agg(F.coalesce(F.when(left, F.abs(r_agg(residual, x))), F.lit(0.0)).alias("abs_r"))


def pair_correlation_against_motion(pairs: DataFrame, motion: DataFrame, keys, member: str) -> DataFrame:
    """Spearman rho between the r of a pair of sessions and the mean displacement of both. `pairs` carries the member
    in a column, `motion` holds (member, session, mean_fd)."""
    m = lambda c, n: motion.select(member, F.col("session").cast("string").alias(c), F.col("mean_fd").alias(n))
    j = pairs.join(m("member_a", "_a"), [member, "member_a"]).join(m("member_b", "_b"), [member, "member_b"])
    return spearman(j.withColumn("mean_fd", (F.col("_a") + F.col("_b")) / 2), keys, "r", "mean_fd")


def length_check(found: DataFrame, expected: DataFrame, keys, slack: int = SHIFT_VOLUMES) -> DataFrame:
    """Sample counts between expected - slack and expected."""
    j = expected.join(found, list(keys), "left")
    ok = F.col("n_found").between(F.col("n_expected") - slack, F.col("n_expected"))
    return j.withColumn("ok", F.coalesce(ok, F.lit(False)))
