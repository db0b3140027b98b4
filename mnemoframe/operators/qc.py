"""Quality metrics: summaries, fences, motion, review decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sampling import bottom_k
from ..functions.core import div, half_even, num, with_group_stats
from ..functions.quantiles import exact_quantiles

# Decision vocabulary and the reviewer names that stand for tooling.
DECISIONS = ("keep", "exclude", "investigate", "pending")
FINAL_DECISIONS = ("keep", "exclude", "investigate")
AUTOMATION_NAMES = ("auto-stub", "auto", "automated", "")


def long_metrics(df: DataFrame, keys, metrics) -> DataFrame:
    """One row per key and metric; non-numbers are NULL."""
    items = F.array(*[F.struct(F.lit(m).alias("metric"), num(m).alias("value")) for m in metrics])
    return df.select(*keys, F.explode(items).alias("_m")).select(*keys, "_m.metric", "_m.value")


def metric_summary(df: DataFrame, metrics, group_by=None) -> DataFrame:
    """Per group and metric: n_runs, mean, std, min, quartiles, max, rounded half-even to 6 digits."""
    keys = [group_by] if group_by else []
    x = long_metrics(df, keys, metrics)
    keys = [*keys, "metric"]
    s = x.groupBy(*keys).agg(F.count("*").alias("n_runs"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                             F.min("value").alias("min"), F.max("value").alias("max"))
    q = exact_quantiles(x, keys, "value", {"p25": .25, "p50": .5, "p75": .75}, few=keys == ["metric"])
    out = s.join(q, keys, "left")
    for c in ("mean", "std", "min", "p25", "p50", "p75", "max"):
        out = out.withColumn(c, half_even(c, 6))
    return out


def fences(x: DataFrame, keys, k: float) -> DataFrame:
    q = exact_quantiles(x, keys, "value", {"q1": .25, "q3": .75}, few=list(keys) == ["metric"])
    iqr = F.col("q3") - F.col("q1")
    return q.withColumn("lower", F.col("q1") - k * iqr).withColumn("upper", F.col("q3") + k * iqr)


def outlier_flags(df: DataFrame, run_keys, metrics, scope: str = "global", k: float = 1.5) -> DataFrame:
    """Values outside the fence, one row per run and metric. The global scope compares with thresholds
    rounded to 6 digits, the within-subject scope with unrounded ones."""
    x = long_metrics(df, run_keys, metrics).where("value is not null")
    keys = ["metric"] if scope == "global" else ["subject", "metric"]
    f = fences(x, keys, k)
    lo6, hi6 = half_even("lower", 6), half_even("upper", 6)
    lo, hi = (lo6, hi6) if scope == "global" else (F.col("lower"), F.col("upper"))
    f = f.select(*keys, lo.alias("_lo"), hi.alias("_hi"), lo6.alias("_lo6"), hi6.alias("_hi6"))
    f = F.broadcast(f) if scope == "global" else f  # one row per metric
    j = x.join(f, keys).withColumn("direction", F.when(F.col("value") < F.col("_lo"), "low").when(F.col("value") > F.col("_hi"), "high"))
    return (j.where("direction is not null")
            .select(*run_keys, "metric", half_even("value", 6).alias("value"), "direction",
                    F.when(F.col("direction") == "low", F.col("_lo6")).otherwise(F.col("_hi6")).alias("threshold")))


def outlier_runs(flags: DataFrame, run_keys) -> DataFrame:
    """One row per flagged run with its map of flagged metrics (as many entries as declared metrics)."""
    entry = F.struct("metric", F.struct("value", "direction", "threshold"))
    return flags.groupBy(*run_keys).agg(F.map_from_entries(F.collect_list(entry)).alias("flagged_metrics"), F.count("*").alias("n_flags"))


def outlier_subjects(df: DataFrame, flags: DataFrame, run_keys) -> DataFrame:
    n = df.groupBy("subject").agg(F.count("*").alias("n_runs"))
    o = flags.select(*run_keys).distinct().groupBy("subject").agg(F.count("*").alias("n_outlier_runs"))
    return (n.join(o, "subject", "left").fillna(0, ["n_outlier_runs"])
            .withColumn("pct_outlier", half_even(100 * F.col("n_outlier_runs") / F.col("n_runs"), 1)))


def motion_runs(df: DataFrame, keys, threshold: float = 0.5) -> DataFrame:
    """Per run: volumes, displacement mean, median and maximum, high-motion count and share of the
    non-missing volumes, mean dvars and rmsd."""
    fd = num("framewise_displacement")
    n_high = F.count(F.when(fd > threshold, 1))
    s = df.groupBy(*keys).agg(
        F.count("*").alias("n_volumes"), half_even(F.avg(fd), 6).alias("mean_fd"), half_even(F.max(fd), 6).alias("max_fd"),
        n_high.alias("n_high_motion"), F.coalesce(half_even(div(100 * n_high, F.count(fd)), 1), F.lit(0.0)).alias("pct_high_motion"),
        half_even(F.avg(num("dvars")), 6).alias("mean_dvars"), half_even(F.avg(num("rmsd")), 6).alias("mean_rmsd"))
    q = exact_quantiles(df, keys, fd, {"median_fd": .5})
    return s.join(q, list(keys), "left").withColumn("median_fd", half_even("median_fd", 6))


def motion_subjects(runs: DataFrame) -> DataFrame:
    return runs.groupBy("subject").agg(F.count("*").alias("n_runs"), half_even(F.avg("mean_fd"), 6).alias("mean_fd_across_runs"),
                                       half_even(F.avg("pct_high_motion"), 1).alias("mean_high_motion_pct"))


def run_details(df: DataFrame, keys, iqms: DataFrame, loose_keys, thresholds=(0.2, 0.5, 0.9)) -> DataFrame:
    """Motion at several thresholds joined to the run's quality metrics: the exact key first, else the first
    record that agrees on the loose keys. `iqms` holds keys and `iqm` (a struct or map)."""
    fd, dv = num("framewise_displacement"), num("dvars")
    s = df.groupBy(*keys).agg(
        F.count("*").alias("n_volumes"), F.avg(fd).alias("mean_fd"), F.max(fd).alias("max_fd"), F.stddev_samp(fd).alias("std_fd"),
        *[F.coalesce(half_even(div(100 * F.count(F.when(fd > x, 1)), F.count(fd)), 1), F.lit(0.0)).alias(f"pct_fd_above_{str(x).replace('.', '_')}")
          for x in thresholds], F.avg(dv).alias("mean_dvars"), F.max(dv).alias("max_dvars"), F.avg(num("rmsd")).alias("mean_rmsd"))
    s = s.join(exact_quantiles(df, keys, fd, {"median_fd": .5}), list(keys), "left")
    exact = iqms.select(*keys, F.col("iqm").alias("_exact"))
    rest = [k for k in keys if k not in loose_keys]
    loose = iqms.groupBy(*loose_keys).agg(F.min_by("iqm", F.struct(*rest)).alias("_loose"))
    j = s.join(exact, list(keys), "left").join(loose, list(loose_keys), "left")
    return j.withColumn("iqm", F.coalesce("_exact", "_loose")).withColumn("iqm_exact", F.col("_exact").isNotNull()).drop("_exact", "_loose")


def processing_status(raw: DataFrame, done: DataFrame, keys, subject: str = "subject") -> DataFrame:
    """Raw and derivative runs per subject, missing count and share complete (derivative over raw)."""
    r, d = raw.select(*keys).distinct(), done.select(*keys).distinct()
    nr = r.groupBy(subject).agg(F.count("*").alias("n_raw"))
    nd = d.groupBy(subject).agg(F.count("*").alias("n_done"))
    nm = r.join(d, list(keys), "left_anti").groupBy(subject).agg(F.count("*").alias("n_missing"))
    return (nr.join(nd, subject, "left").join(nm, subject, "left").fillna(0, ["n_done", "n_missing"])
            .withColumn("pct_complete", half_even(100 * F.col("n_done") / F.col("n_raw"), 1)))


def missing_runs(raw: DataFrame, done: DataFrame, keys, subject: str = "subject") -> DataFrame:
    """Every missing run with its position within its subject; counts come from processing_status."""
    gone = raw.select(*keys).distinct().join(done.select(*keys).distinct(), list(keys), "left_anti")
    w = Window.partitionBy(subject).orderBy(*[k for k in keys if k != subject])
    return gone.select(*keys, F.row_number().over(w).cast("long").alias("position"))


def review_problem() -> Column:
    """Why a decision may not be recorded; NULL when it may."""
    name = F.lower(F.trim(F.coalesce("reviewer", F.lit(""))))
    return (F.when(F.col("decision").isNull() | ~F.col("decision").isin(*DECISIONS), "invalid decision")
            .when(F.col("automated") & F.col("decision").isin(*FINAL_DECISIONS), "automation may only record pending")
            .when(~F.col("automated") & name.isin(*AUTOMATION_NAMES), "a sign-off needs a named reviewer")
            .when(F.col("recommendation").isNotNull() & ~F.col("recommendation").isin(*DECISIONS), "invalid recommendation"))


def judge_decisions(requests: DataFrame) -> DataFrame:
    return requests.withColumn("problem", review_problem())


def append_decisions(history: DataFrame, requests: DataFrame) -> DataFrame:
    """History plus the accepted requests, stamped with the current UTC time. History is append-only rows
    (run_key, decision, reason, reviewer, automated, recommendation, timestamp)."""
    ok = judge_decisions(requests).where("problem is null").withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    return history.unionByName(ok.select(*history.columns))


def latest_decisions(records: DataFrame, subject: str | None = None) -> DataFrame:
    """Last entry of each run's history over all roots in order. `records` holds (run_key, root_order,
    decisions array); the latest is found with max_by, so a long history combines map-side."""
    if subject:
        records = records.where(F.col("run_key").startswith(f"sub-{subject}_"))
    x = records.select("run_key", "root_order", F.posexplode("decisions").alias("position", "entry"))
    return x.groupBy("run_key").agg(F.max_by("entry", F.struct("root_order", "position")).alias("latest"), F.count("*").alias("n_entries"))


def signed_off(prefix: str = "") -> Column:
    """True for a final decision by a named person."""
    c = lambda n: F.col(prefix + n)
    name = F.lower(F.trim(F.coalesce(c("reviewer"), F.lit(""))))
    return F.coalesce(~F.coalesce(c("automated"), F.lit(False)) & c("decision").isin(*FINAL_DECISIONS) & ~name.isin(*AUTOMATION_NAMES), F.lit(False))


class MissingDecisions(LookupError):
    """Runs without a valid recorded decision; undecided() lists them."""


def _decided() -> Column:
    return F.col("_has").isNotNull() & F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False))


def _with_latest(runs: DataFrame, latest: DataFrame) -> DataFrame:
    return runs.join(latest.withColumn("_has", F.lit(True)), "run_key", "left")


def undecided(runs: DataFrame, latest: DataFrame) -> DataFrame:
    """Runs whose latest decision is missing or outside the vocabulary."""
    return _with_latest(runs, latest).where(~_decided()).select(*runs.columns, "decision")


def gate(runs: DataFrame, latest: DataFrame, investigate: str = "exclude", pending: str = "exclude", strict: bool = True) -> DataFrame:
    """Runs cleared for analysis. Under `strict` runs without a valid decision are an error with their number, and
    undecided() has their rows; otherwise they are just not included."""
    for v in (investigate, pending):
        if v not in ("keep", "exclude"):
            raise ValueError(f"expected keep or exclude, got {v!r}")
    if strict and (n := undecided(runs, latest).count()):
        raise MissingDecisions(f"{n} runs lack a valid decision")
    ok = F.when(~signed_off(), F.lit(pending == "keep")).when(F.col("decision") == "exclude", F.lit(False)).when(
        F.col("decision") == "investigate", F.lit(investigate == "keep")).otherwise(F.lit(True))
    return _with_latest(runs, latest).where(_decided() & ok).drop("_has")


def decision_counts(latest: DataFrame) -> DataFrame:
    return latest.agg(*[F.count(F.when(F.col("decision") == d, 1)).alias(d) for d in DECISIONS],
                      F.count(F.when(signed_off(), 1)).alias("signed_off"), F.count(F.when(~signed_off(), 1)).alias("awaiting_signoff"),
                      F.count("*").alias("total"))


def subject_summary(outliers: DataFrame, motion: DataFrame, latest: DataFrame) -> DataFrame:
    """Full outer join of outlier, motion and decision aggregates by subject."""
    m = motion.groupBy("subject").agg(half_even(F.avg("mean_fd"), 3).alias("mean_fd"), half_even(F.avg("pct_high_motion"), 1).alias("mean_high_motion_pct"))
    d = latest.groupBy("subject").agg(F.count(F.when(signed_off(), 1)).alias("n_reviewed"), F.count(F.when(~signed_off(), 1)).alias("n_auto"),
                                      F.count(F.when(signed_off() & (F.col("decision") == "exclude"), 1)).alias("n_exclude"))
    o = outliers.select("subject", "n_runs", F.col("n_outlier_runs").alias("n_outliers"), "pct_outlier")
    j = o.join(m, "subject", "full_outer").join(d, "subject", "full_outer")
    j = j.fillna(0, ["n_runs", "n_outliers", "pct_outlier", "n_reviewed", "n_auto", "n_exclude"])
    return j.withColumn("n_pending", F.col("n_runs") - F.col("n_reviewed"))


def merge_runs(iqms: DataFrame, outliers: DataFrame, motion: DataFrame, latest: DataFrame, reports: DataFrame, key: str = "run_key") -> DataFrame:
    """Everything known per run; all inputs are keyed by the same run key, so the joins share one shuffle."""
    o = outliers.select(key, "n_flags").withColumn("is_outlier", F.lit(True))
    j = iqms.join(o, key, "left").join(motion, key, "left").join(latest, key, "left").join(reports, key, "left")
    return (j.withColumn("is_outlier", F.coalesce("is_outlier", F.lit(False))).withColumn("n_flags", F.coalesce("n_flags", F.lit(0)))
            .withColumn("signed_off", signed_off()))


def review_stubs(runs: DataFrame, decided: DataFrame, volumes: DataFrame, key: str = "run_key", threshold: float = 0.5, investigate: float = 0.5) -> DataFrame:
    """Pending entries for runs nobody decided on, with a recommendation from the mean displacement."""
    todo = runs.select(key).distinct().join(decided.select(key).distinct(), key, "left_anti")
    fd = num("framewise_displacement")
    n_high = F.count(F.when(fd > threshold, 1))
    m = volumes.groupBy(key).agg(F.avg(fd).alias("mean_fd"), F.max(fd).alias("max_fd"), half_even(div(100 * n_high, F.count(fd)), 1).alias("pct_high_motion"))
    j = todo.join(m, key, "left")
    high = F.coalesce(F.col("mean_fd") > investigate, F.lit(False))
    reason = F.concat_ws("; ", F.when(F.col("mean_fd").isNull(), "displacement unavailable").otherwise("from confounds"),
                         F.when(high, "mean displacement above limit"), F.lit("awaiting human sign-off"))
    return (j.withColumn("decision", F.lit("pending")).withColumn("automated", F.lit(True)).withColumn("reviewer", F.lit("auto-stub"))
            .withColumn("recommendation", F.when(high, "investigate").otherwise("keep")).withColumn("reason", reason))


def fill_displacement(df: DataFrame) -> DataFrame:
    return df.withColumn("framewise_displacement", F.coalesce(num("framewise_displacement"), F.lit(0.0)))


def series_heatmap(df: DataFrame, series: str, value: str) -> DataFrame:
    """Every series z-scored over its own points, with its mean to sort by; a figure takes the rows it has room for."""
    stats = df.groupBy(series).agg(F.avg(value).alias("mean_value"), F.stddev_pop(value).alias("_sd"))
    return df.join(stats, series).withColumn("z", div(F.col(value) - F.col("mean_value"), "_sd")).drop("_sd")


def sampled_heatmap(df: DataFrame, series: str, value: str, n: int, seed: int = 42) -> DataFrame:
    """series_heatmap of a seeded sample of at most n series, with `row`, their place by falling mean (ties by series, no mean last)."""
    chosen = bottom_k(df.select(series).where(F.col(series).isNotNull()).distinct(), [], series, n, seed)
    z = series_heatmap(df.join(F.broadcast(chosen), series), series, value)
    order = z.select(series, "mean_value").distinct().withColumn("row", F.row_number().over(Window.orderBy(F.desc_nulls_last("mean_value"), series)))  # n rows
    return z.join(order.select(series, "row"), series)


def mean_series(df: DataFrame, t: str, value: str) -> DataFrame:
    return df.groupBy(t).agg(F.avg(value).alias("mean_value"), F.count(value).alias("n"))
