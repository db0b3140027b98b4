"""Grouped behavioural measures over a trial table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import (adjusted_skew, div, first_by, half_even, norm_ppf, num, sem, top_per_group,
                              with_group_stats)
from ..functions.quantiles import with_quantiles
from ..functions.scan import running_total, id_block, ordered_neighbours
from .cleaning import session_order


def _known(df: DataFrame, keys) -> DataFrame:
    """Group keys that are missing drop the row, as in pandas."""
    for k in keys or []:
        df = df.where(F.col(k).isNotNull())
    return df


def accuracy_by_condition(df: DataFrame, group_cols=None, accuracy: str = "trial_accuracy") -> DataFrame:
    a = num(accuracy)
    return _known(df, group_cols).groupBy(*(group_cols or [])).agg(
        F.count(a).alias("n_trials"), F.coalesce(F.sum(a), F.lit(0.0)).cast("long").alias("n_correct"),
        F.avg(a).alias("accuracy"), sem(a).alias("se"))


def mean_sem(df: DataFrame, metric: str, group_cols, mean: str = "mean", se: str = "se", n: str = "n") -> DataFrame:
    x = num(metric)
    return _known(df, group_cols).groupBy(*group_cols).agg(
        F.avg(x).alias(mean), sem(x).alias(se), F.count(x).alias(n))


def corrected_rates(hr: Column, far: Column, n_signal: Column | None, n_noise: Column | None, correction: str):
    """Hit and false-alarm rates kept away from 0 and 1."""
    if n_signal is None or n_noise is None:
        return tuple(F.least(F.greatest(r, F.lit(0.001)), F.lit(0.999)) for r in (hr, far))
    if correction == "loglinear":
        return (hr * n_signal + 0.5) / (n_signal + 1), (far * n_noise + 0.5) / (n_noise + 1)
    if correction == "clip":
        return tuple(F.least(F.greatest(r, 1 / (2 * n)), 1 - 1 / (2 * n)) for r, n in ((hr, n_signal), (far, n_noise)))
    return hr, far


def signal_detection(df: DataFrame, signal: Column, response: Column, group_cols=None,
                     correction: str = "loglinear") -> DataFrame:
    """Yes/no counts, rates, d' and criterion per group."""
    g = df.groupBy(*(group_cols or [])).agg(
        F.count(F.when(signal, 1)).alias("n_signal"), F.count(F.when(~signal, 1)).alias("n_noise"),
        F.count(F.when(signal & response, 1)).alias("hits"), F.count(F.when(~signal & response, 1)).alias("fas"))
    g = (g.withColumn("hit_rate", div("hits", "n_signal")).withColumn("fa_rate", div("fas", "n_noise")))
    hr, far = corrected_rates(F.col("hit_rate"), F.col("fa_rate"), F.nullif("n_signal", F.lit(0)).cast("double"),
                              F.nullif("n_noise", F.lit(0)).cast("double"), correction)
    g = g.withColumn("_h", hr).withColumn("_f", far)
    g = g.withColumn("_zh", norm_ppf("_h")).withColumn("_zf", norm_ppf("_f"))
    return (g.withColumn("dprime", F.col("_zh") - F.col("_zf"))
            .withColumn("criterion", -0.5 * (F.col("_zh") + F.col("_zf"))).drop("_h", "_f", "_zh", "_zf"))


def _choice_dprime(df: DataFrame, p: str = "accuracy") -> DataFrame:
    df = df.withColumn("_p", F.least(F.greatest(F.col(p), F.lit(0.001)), F.lit(0.999)))
    return df.withColumn("dprime_2afc", F.sqrt(F.lit(2.0)) * norm_ppf("_p")).drop("_p")


def choice_sdt(df: DataFrame, group_cols=None, accuracy: str = "trial_accuracy") -> DataFrame:
    """Two-alternative forced choice: d' from proportion correct, hit and false-alarm rates from the
    position chosen when `recog` and `correct_resp` are there."""
    a = num(accuracy)
    aggs = [F.count(a).alias("n_trials"), F.avg(a).alias("accuracy")]
    both = "recog" in df.columns and "correct_resp" in df.columns
    if both:
        r, c = num("recog"), num("correct_resp")
        aggs.append(F.avg(F.when(r.isNotNull() & c.isNotNull(), (r == c).cast("double"))).alias("hit_rate"))
    g = _known(df, group_cols).groupBy(*(group_cols or [])).agg(*aggs).where(F.col("n_trials") > 0)
    if both:
        g = g.withColumn("fa_rate", 1 - F.col("hit_rate"))
    return _choice_dprime(g)


def confidence_accuracy(df: DataFrame, group_cols=None, resp: str = "resp", accuracy: str = "trial_accuracy") -> DataFrame:
    """Level 2 for sure responses (1, 4), level 1 for everything else including a missing response."""
    lv = df.withColumn("confidence_level", F.when(num(resp).isin(1, 4), 2).otherwise(1))
    return accuracy_by_condition(lv, [*(group_cols or []), "confidence_level"], accuracy).drop("n_correct")


def rating_distribution(df: DataFrame, rating: str, group_cols=None) -> DataFrame:
    keys = list(group_cols or [])
    c = (_known(df, keys).withColumn("rating", num(rating)).where("rating is not null")
         .groupBy(*keys, "rating").agg(F.count("*").alias("count")))
    return with_group_stats(c, keys, _t=F.sum("count")).withColumn("proportion", div("count", "_t")).drop("_t")


def subsequent_memory(encoding: DataFrame, recognition: DataFrame, merge_on, rating: str = "resp",
                      accuracy: str = "trial_accuracy", group_cols=None) -> DataFrame:
    """Recognition accuracy by the item's mean encoding rating (rounded half to even). The recognition side is
    aggregated to sums per item first, so the join is one row per item on each side whatever the key skew."""
    keys, extra = list(merge_on), list(group_cols or [])
    if set(extra) - set(keys):
        raise ValueError("group columns must be among the merge columns")
    item = (_known(encoding, keys).groupBy(*keys).agg(F.avg(num(rating)).alias("_r")).where("_r is not null")
            .select(*keys, F.rint("_r").cast("long").alias("encoding_rating")))
    a = num(accuracy)
    rec = _known(recognition, keys).groupBy(*keys).agg(F.count(a).alias("_n"), F.sum(a).alias("_s"), F.sum(a * a).alias("_q"))
    g = item.join(rec, keys).groupBy(*extra, "encoding_rating").agg(
        F.sum("_n").alias("n_trials"), F.sum("_s").alias("_s"), F.sum("_q").alias("_q"))
    return _finish_moments(g, "n_trials", "accuracy", "se")


def _finish_moments(g: DataFrame, n: str, mean: str, se: str) -> DataFrame:
    nn = F.col(n).cast("double")
    var = (F.col("_q") - F.col("_s") * F.col("_s") / F.nullif(nn, F.lit(0.0))) / F.when(nn > 1, nn - 1)
    return (g.withColumn(mean, F.col("_s") / F.nullif(nn, F.lit(0.0)))
            .withColumn(se, F.sqrt(F.greatest(var, F.lit(0.0)) / nn)).withColumn(se, F.when(nn > 1, F.col(se)))
            .drop("_s", "_q"))


def final_vs_session_accuracy(sessions: DataFrame, final: DataFrame, group_cols=None, accuracy: str = "trial_accuracy",
                              final_session: str = "30") -> DataFrame:
    g = list(group_cols or [])
    tb = (mean_sem(sessions, accuracy, ["subject", "session", *g], "accuracy", "se", "n")
          .withColumn("source", F.concat(F.lit("TB-ses-"), F.col("session"))))
    fin = (mean_sem(final, accuracy, ["subject", *g], "accuracy", "se", "n")
           .withColumn("source", F.lit(f"FIN-ses-{final_session}")).withColumn("session", F.lit(final_session)))
    cols = ["subject", "source", "session", *g, "accuracy", "se", "n"]
    return tb.select(*cols).unionByName(fin.select(*cols))


def timeline(df: DataFrame, group_cols=None, resp: str = "timeline_resp", accuracy: str = "trial_accuracy") -> DataFrame:
    r = num(resp)
    return _known(df, group_cols).groupBy(*(group_cols or [])).agg(
        F.avg(r).alias("mean_resp"), F.stddev_samp(r).alias("sd_resp"), F.avg(num(accuracy)).alias("accuracy"),
        F.count(r).alias("n"))


def retention(sessions: DataFrame, final: DataFrame, accuracy: str = "trial_accuracy", item: str = "pairId",
              tie: str = "trial_id") -> DataFrame:
    """First non-missing session accuracy per item against each final trial of the item."""
    keys = ["subject", item]
    first = _known(sessions, keys).groupBy(*keys).agg(
        F.min("session").alias("initial_session"),
        first_by(num(accuracy), F.struct("session", tie).alias("o")).alias("initial_accuracy"))
    fin = _known(final, keys).select(*keys, tie, num(accuracy).alias("final_accuracy"))
    return first.join(fin, keys).withColumn("retention_delta", F.col("final_accuracy") - F.col("initial_accuracy"))


def learning_curve(df: DataFrame, metric: str = "trial_accuracy", group_cols=None) -> DataFrame:
    return mean_sem(df, metric, ["session", *(group_cols or [])]).withColumn("session_order", session_order())


def dprime_curve(df: DataFrame, group_cols=None, accuracy: str = "trial_accuracy") -> DataFrame:
    g = choice_sdt(df.drop("recog"), ["session", *(group_cols or [])], accuracy)
    return g.withColumnRenamed("n_trials", "n").withColumn("session_order", session_order())


def conditions_over_sessions(df: DataFrame, condition: str = "enCon", metric: str = "trial_accuracy") -> DataFrame:
    return learning_curve(df, metric, ["subject", condition]).withColumnRenamed(condition, "condition")


def rt_summary(df: DataFrame, rt: str = "resp_RT", group_cols=None) -> DataFrame:
    x, keys = num(rt), list(group_cols or [])
    base = _known(df, keys).withColumn("_x", x)
    s = base.groupBy(*keys).agg(F.avg("_x").alias("mean_rt"), F.stddev_samp("_x").alias("sd_rt"), F.min("_x").alias("min_rt"),
                                F.max("_x").alias("max_rt"), adjusted_skew("_x").alias("skew"), F.count("_x").alias("n_trials"))
    return with_quantiles(s, base, keys, "_x", {"median_rt": .5})


def rt_by_accuracy(df: DataFrame, rt: str = "resp_RT", accuracy: str = "trial_accuracy", group_cols=None) -> DataFrame:
    """A missing accuracy counts as accurate, as a cast of NaN to boolean does."""
    acc = df.withColumn("accurate", F.coalesce(num(accuracy) != 0, F.lit(True)))
    keys, x = [*(group_cols or []), "accurate"], num(rt)
    base = _known(acc, keys).withColumn("_x", x)
    s = base.groupBy(*keys).agg(F.avg("_x").alias("mean_rt"), F.stddev_samp("_x").alias("sd_rt"), F.count("_x").alias("n_trials"))
    return with_quantiles(s, base, keys, "_x", {"median_rt": .5})


def rt_sequential(df: DataFrame, rt: str = "resp_RT", trial: str = "trial_id", group_cols=None, window: int = 5) -> DataFrame:
    x = num(rt)
    return ordered_neighbours(df, group_cols or [], [trial], id_block(trial), before=window - 1,
                              rt_rolling_mean=lambda w: F.avg(x).over(w.rowsBetween(-(window - 1), 0))).drop("_idx")


def group_mean_over_subjects(df: DataFrame, metric: str, group_cols, subject: str = "subject") -> DataFrame:
    """Mean and standard error over per-subject means."""
    per = _known(df, [subject, *group_cols]).groupBy(subject, *group_cols).agg(F.avg(num(metric)).alias("_m"))
    return per.groupBy(*group_cols).agg(F.avg("_m").alias("mean"), sem("_m").alias("se"), F.count("_m").alias("n_subjects"))


def coverage(df: DataFrame) -> DataFrame:
    """Trials per subject and session with the tasks seen."""
    t = df.groupBy("subject", "session", "task").agg(F.count("*").alias("n"))
    return t.groupBy("subject", "session").agg(F.sum("n").alias("n_trials"), F.count("*").alias("n_tasks"),
                                               F.max_by("task", F.struct("n", "task")).alias("main_task"))


class EmptyReport(ValueError):
    """A report found no rows after its filters."""


def report(df: DataFrame, build, subjects=None, sessions=None) -> DataFrame:
    """Filter, fail on an empty selection (one row is looked at), aggregate."""
    if subjects:
        df = df.where(F.col("subject").isin(*subjects))
    if sessions:
        df = df.where(F.col("session").isin(*sessions))
    if df.isEmpty():
        raise EmptyReport("no rows for the given filters")
    return build(df)


# The data behind each named report.
REPORTS = {
    "accuracy": lambda d: accuracy_by_condition(d, ["subject", "enCon"]),
    "learning_curve": lambda d: learning_curve(d, "trial_accuracy", ["subject"]),
    "dprime_curve": lambda d: dprime_curve(d, ["subject"]),
    "rt_distribution": lambda d: histogram(d, "resp_RT", 40, ["subject"]),
    "confidence": lambda d: confidence_accuracy(d, ["subject"]),
    "ratings": lambda d: rating_distribution(d, "resp", ["subject", "enCon"]),
    "vividness": lambda d: mean_sem(d, "resp", ["subject", "reCon"], "mean_vividness"),
    "timeline": lambda d: timeline(d, ["subject", "enCon", "reCon"]),
}


def named_report(name: str, df: DataFrame, subjects=None, sessions=None) -> DataFrame:
    return report(df, REPORTS[name], subjects, sessions)


def ranking(df: DataFrame, feature: str, tie: str) -> DataFrame:
    """All rows that have the feature, ranked by it from the largest. Values are counted first: the rank is the number
    of rows with larger values, found over blocks of values, plus the place among equals."""
    x = df.where(num(feature).isNotNull()).withColumn("_v", -num(feature))
    c = x.groupBy("_v").agg(F.count("*").alias("_c"))
    above = running_total(c, [], ["_v"], F.floor(F.col("_v") / 16).cast("long"), F.col("_c"), "_above", inclusive=False).select("_v", "_above")
    w = Window.partitionBy("_v").orderBy(tie)
    return x.withColumn("_at", F.row_number().over(w)).join(above, "_v").withColumn("rank", (F.col("_above") + F.col("_at")).cast("long")).drop("_v", "_at", "_above")


def histogram(df: DataFrame, feature: str, bins: int = 40, group_cols=None) -> DataFrame:
    """Equal-width counts between the overall minimum and maximum; the last bin is closed."""
    keys = list(group_cols or [])
    x = df.select(*keys, num(feature).alias("_x")).where("_x is not null")
    x = with_group_stats(x, [], _lo=F.min("_x"), _hi=F.max("_x"))
    f = div(F.col("_x") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    b = F.least(F.floor(F.coalesce(f, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("long")
    return x.withColumn("bin", b).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
