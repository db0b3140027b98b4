"""Quality control (Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import draw_sql, pad2
from ..operators import qc as Q
from ..session import scratch
from ..sources import store
from .registry import query
from .views import DECISIONS, IQMS, SIGNED, VOLUMES

RUN = ["subject", "session", "acq"]
STATS = """count(*) AS n_runs, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75"""
LONG = """x AS (SELECT printf('%02d', l_suppkey % 20) AS subject, 'l_quantity' AS metric, l_quantity AS v FROM lineitem UNION ALL
  SELECT printf('%02d', l_suppkey % 20), 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT printf('%02d', l_suppkey % 20), 'l_discount', l_discount FROM lineitem)"""
Q6 = {"mean": 6, "std": 6, "min": 6, "max": 6, "p25": 6, "p50": 6, "p75": 6}


@query("q01_metric_summary_by_subject", f"WITH {LONG} SELECT subject, metric, {STATS} FROM x GROUP BY ALL", Q6)
def _(t):
    return Q.metric_summary(t.lineitem.withColumn("subject", pad2(F.col("l_suppkey") % 20)), ["l_quantity", "l_extendedprice", "l_discount"], "subject")


@query("q01_metric_summary_global", f"WITH {LONG} SELECT metric, {STATS} FROM x GROUP BY ALL", Q6)
def _(t):
    return Q.metric_summary(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])


FLAGS = """l AS (SELECT run_id, subject, 'fd_mean' AS metric, fd_mean AS value FROM iqms UNION ALL SELECT run_id, subject, 'tsnr', tsnr FROM iqms WHERE tsnr IS NOT NULL),
  f0 AS (SELECT {k}, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM l GROUP BY ALL),
  f AS (SELECT {k}, q1 - {m} * (q3 - q1) AS lo, q3 + {m} * (q3 - q1) AS hi FROM f0),
  flags AS (SELECT run_id, subject, metric, value, CASE WHEN value < lo THEN 'low' ELSE 'high' END AS direction, CASE WHEN value < lo THEN round(lo, 6) ELSE round(hi, 6) END AS threshold
  FROM l JOIN f USING ({k}) WHERE value < {lo} OR value > {hi})"""
GLOBAL = f"WITH {IQMS}, " + FLAGS.format(k="metric", m="1.5", lo="round(lo, 6)", hi="round(hi, 6)")
WITHIN = f"WITH {IQMS}, " + FLAGS.format(k="subject, metric", m="1.0", lo="lo", hi="hi")
IQ = ["run_id", "subject"]


def _flags(t, scope="global"):
    return Q.outlier_flags(t.iqms, IQ, ["fd_mean", "tsnr"], scope, 1.5 if scope == "global" else 1.0)


@query("q02_outlier_flags_global", GLOBAL + " SELECT * FROM flags", ("value", "threshold"))
def _(t):
    return _flags(t)


@query("q02_outlier_runs_within_subject", WITHIN + " SELECT run_id, subject, count(*) AS n_flags, list_sort(list(metric)) AS metrics FROM flags GROUP BY ALL")
def _(t):
    r = Q.outlier_runs(_flags(t, "within_subject"), IQ)
    return r.select(*IQ, "n_flags", F.array_sort(F.map_keys("flagged_metrics")).alias("metrics"))


SUBJ = """, subj AS (SELECT subject, count(*) AS n_runs, count(fr) AS n_outlier_runs, round_even(100 * count(fr) / count(*), 1) AS pct_outlier
  FROM iqms LEFT JOIN (SELECT DISTINCT run_id AS fr FROM flags) ON fr = run_id GROUP BY subject)"""


@query("q02_outlier_subjects", GLOBAL + SUBJ + " SELECT * FROM subj", {"pct_outlier": 1})
def _(t):
    return Q.outlier_subjects(t.iqms, _flags(t), IQ)


MOTION = """motion AS (SELECT subject, session, acq, count(*) AS n_volumes, round(avg(fd), 6) AS mean_fd, round(max(fd), 6) AS max_fd, count(*) FILTER (fd > 0.5) AS n_high_motion,
  coalesce(round_even(100 * count(*) FILTER (fd > 0.5) / nullif(count(fd), 0), 1), 0) AS pct_high_motion, round(avg(dvars), 6) AS mean_dvars, round(avg(rmsd), 6) AS mean_rmsd,
  round(quantile_cont(fd, 0.5), 6) AS median_fd FROM volumes GROUP BY ALL)"""
M6 = ("mean_fd", "max_fd", "mean_dvars", "mean_rmsd", "median_fd")


@query("q03_motion_runs", f"WITH {VOLUMES}, {MOTION} SELECT * FROM motion", M6)
def _(t):
    return Q.motion_runs(t.volumes, RUN)


@query("q03_motion_subjects", f"WITH {VOLUMES}, {MOTION} SELECT subject, count(*) AS n_runs, avg(mean_fd) AS mean_fd_across_runs, avg(pct_high_motion) AS mean_high_motion_pct FROM motion GROUP BY ALL",
       {"mean_fd_across_runs": 6, "mean_high_motion_pct": 1})
def _(t):
    return Q.motion_subjects(Q.motion_runs(t.volumes, RUN))


PCT = "coalesce(round_even(100 * count(*) FILTER (fd > {0}) / nullif(count(fd), 0), 1), 0) AS pct_fd_above_{1}"


@query("q04_run_details", f"""WITH {VOLUMES}, d AS (SELECT subject, session, acq, count(*) AS n_volumes, avg(fd) AS mean_fd, max(fd) AS max_fd, stddev_samp(fd) AS std_fd,
  {PCT.format('0.2', '0_2')}, {PCT.format('0.5', '0_5')}, {PCT.format('0.9', '0_9')}, avg(dvars) AS mean_dvars, max(dvars) AS max_dvars, avg(rmsd) AS mean_rmsd, quantile_cont(fd, 0.5) AS median_fd FROM volumes GROUP BY ALL),
  i AS (SELECT subject, session, acq, max(volume) AS iqm FROM volumes WHERE dvars > 60 GROUP BY ALL)
  SELECT d.*, coalesce(e.iqm, (SELECT arg_min(iqm, acq) FROM i WHERE i.subject = d.subject AND i.session = d.session)) AS iqm, e.iqm IS NOT NULL AS iqm_exact
  FROM d LEFT JOIN i e ON e.subject = d.subject AND e.session = d.session AND e.acq = d.acq""",
       ("mean_fd", "max_fd", "std_fd", "mean_dvars", "mean_rmsd", "median_fd"))
def _(t):
    i = t.volumes.where("dvars > 60").groupBy(*RUN).agg(F.max("volume").alias("iqm"))
    return Q.run_details(t.volumes, RUN, i, ["subject", "session"])


KEYS_SQL = """WITH r AS (SELECT DISTINCT printf('%02d', o_custkey % 20) AS subject, o_orderkey AS run FROM orders), d AS (SELECT DISTINCT printf('%02d', o_custkey % 20) AS subject, o_orderkey AS run
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'A') """


def _raw_done(t):
    raw = t.orders.select(pad2(F.col("o_custkey") % 20).alias("subject"), F.col("o_orderkey").alias("run"))
    done = raw.join(t.lineitem.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("run")), "run", "left_semi")
    return raw, done, ["subject", "run"]


@query("q05_processing_status", KEYS_SQL + """SELECT subject, count(*) AS n_raw, count(d.run) AS n_done, count(*) - count(d.run) AS n_missing, round_even(100 * count(d.run) / count(*), 1) AS pct_complete
  FROM r LEFT JOIN d USING (subject, run) GROUP BY subject""", {"pct_complete": 1})
def _(t):
    return Q.processing_status(*_raw_done(t))


@query("q05_missing_runs", KEYS_SQL + "SELECT subject, run, row_number() OVER (PARTITION BY subject ORDER BY run) AS position FROM (SELECT * FROM r EXCEPT SELECT * FROM d)")
def _(t):
    return Q.missing_runs(*_raw_done(t))


REQ = """req AS (SELECT 'sub-' || printf('%02d', conv_id % 20) || '_run-' || conv_id AS run_key, conv_id, turn, (['keep', 'exclude', 'investigate', 'pending', 'perhaps'])[(conv_id + turn) % 5 + 1] AS decision,
  CASE role WHEN 'user' THEN 'Ann' WHEN 'assistant' THEN ' Auto ' END AS reviewer, CASE WHEN turn % 4 <> 3 THEN conv_id % 2 = 0 AND role = 'assistant' END AS automated,
  CASE WHEN turn % 3 = 0 THEN 'keep' WHEN turn % 7 = 1 THEN 'drop' END AS recommendation FROM conversations)"""


def _requests(t):
    i, n = F.col("conv_id"), F.col("turn")
    return t.conversations.select(
        F.concat(F.lit("sub-"), pad2(i % 20), F.lit("_run-"), i.cast("string")).alias("run_key"), "conv_id", "turn",
        F.element_at(F.array(*[F.lit(d) for d in ("keep", "exclude", "investigate", "pending", "perhaps")]), ((i + n) % 5 + 1).cast("int")).alias("decision"),
        F.when(F.col("role") == "user", "Ann").when(F.col("role") == "assistant", " Auto ").alias("reviewer"),
        F.when(n % 4 != 3, (i % 2 == 0) & (F.col("role") == "assistant")).alias("automated"),
        F.when(n % 3 == 0, "keep").when(n % 7 == 1, "drop").alias("recommendation"))


@query("q06_decision_rules", f"""WITH {REQ}, r AS (SELECT * REPLACE (coalesce(automated, false) AS automated) FROM req) SELECT run_key, turn, CASE WHEN decision NOT IN ('keep', 'exclude', 'investigate', 'pending') THEN 'invalid decision'
  WHEN automated AND decision <> 'pending' THEN 'automation may only record pending' WHEN NOT automated AND lower(trim(coalesce(reviewer, ''))) IN ('auto', '') THEN 'a sign-off needs a named reviewer'
  WHEN recommendation = 'drop' THEN 'invalid recommendation' END AS problem FROM r""")
def _(t):
    return Q.judge_decisions(_requests(t).fillna(False, ["automated"])).select("run_key", "turn", "problem")


@query("q06_decision_log", f"""WITH {REQ}, r AS (SELECT * REPLACE (coalesce(automated, false) AS automated) FROM req), ok AS (SELECT * FROM r WHERE decision IN ('keep', 'exclude', 'investigate', 'pending') AND NOT (automated AND decision <> 'pending')
  AND NOT (NOT automated AND lower(trim(coalesce(reviewer, ''))) IN ('auto', '')) AND coalesce(recommendation, '') <> 'drop') SELECT run_key, count(*) AS n_entries, arg_max(decision, turn) AS decision FROM ok GROUP BY run_key""")
def _(t):
    """Accepted requests of every day appended as a batch of a log, one batch twice; then the last decision of each run."""
    ok = Q.judge_decisions(_requests(t).fillna(False, ["automated"])).where("problem is null").select("run_key", "turn", "decision", "conv_id")
    root = scratch(t.spark, "decisions")
    for day in (0, 1, 2, 1):
        store.append_batch(ok.where(F.col("conv_id") % 3 == day), root, "batch", f"day-{day}")
    log = store.stored(t.spark, root, ok)
    return log.groupBy("run_key").agg(F.count("*").alias("n_entries"), F.max_by("decision", "turn").alias("decision"))


def _latest(t):
    first = F.struct("decision", "reviewer", "automated")
    second = F.struct(F.when(F.col("turn") % 2 == 0, "pending").otherwise(F.col("decision")).alias("decision"), "reviewer", "automated")
    rec = _requests(t).select("run_key", F.col("turn").alias("root_order"), F.array(first, second).alias("decisions"))
    return Q.latest_decisions(rec).select("run_key", "n_entries", "latest.*")


LAST = """last AS (SELECT run_key, arg_max(CASE WHEN turn % 2 = 0 THEN 'pending' ELSE decision END, turn) AS decision, first(reviewer ORDER BY turn DESC) AS reviewer, first(automated ORDER BY turn DESC) AS automated,
  2 * count(*) AS n_entries FROM req GROUP BY run_key)"""


@query("q07_latest_decisions", f"WITH {REQ}, {LAST} SELECT * FROM last")
def _(t):
    return _latest(t)


@query("q08_signed_off", f"WITH {REQ} SELECT run_key, turn, {SIGNED} AS signed_off FROM req")
def _(t):
    return _requests(t).select("run_key", "turn", Q.signed_off().alias("signed_off"))


@query("q09_gate", f"""WITH d AS (SELECT doc_id, (['keep', 'exclude', 'investigate', 'pending'])[quality * 2 + toxic + 1] AS decision, CASE WHEN doc_id % 4 = 0 THEN 'auto' ELSE 'Lee' END AS reviewer, doc_id % 9 = 0 AS automated FROM labels),
  j AS (SELECT d.*, {SIGNED} AS s FROM documents JOIN d USING (doc_id)) SELECT doc_id AS run_key, decision, reviewer FROM j WHERE s AND decision <> 'exclude'""")
def _(t):
    d = t.labels.select(F.col("doc_id").alias("run_key"), F.element_at(F.array(*[F.lit(x) for x in Q.DECISIONS]), F.col("quality") * 2 + F.col("toxic") + 1).alias("decision"),
                        F.when(F.col("doc_id") % 4 == 0, "auto").otherwise("Lee").alias("reviewer"), (F.col("doc_id") % 9 == 0).alias("automated"))
    return Q.gate(t.documents.select(F.col("doc_id").alias("run_key")), d, investigate="keep", strict=False).select("run_key", "decision", "reviewer")


@query("q10_decision_counts", f"""WITH {DECISIONS} SELECT count(*) FILTER (decision = 'keep') AS keep, count(*) FILTER (decision = 'exclude') AS exclude, count(*) FILTER (decision = 'investigate') AS investigate,
  count(*) FILTER (decision = 'pending') AS pending, count(*) FILTER ({SIGNED}) AS signed_off, count(*) FILTER (NOT {SIGNED}) AS awaiting_signoff, count(*) AS total FROM decisions""")
def _(t):
    return Q.decision_counts(t.decisions)


@query("q11_subject_summary", GLOBAL + SUBJ + f""", {VOLUMES}, {MOTION}, {DECISIONS}, m AS (SELECT subject, round(avg(mean_fd), 3) AS mean_fd, round_even(avg(pct_high_motion), 1) AS mean_high_motion_pct FROM motion GROUP BY 1),
  d AS (SELECT subject, count(*) FILTER ({SIGNED}) AS n_reviewed, count(*) FILTER (NOT {SIGNED}) AS n_auto, count(*) FILTER ({SIGNED} AND decision = 'exclude') AS n_exclude FROM decisions GROUP BY 1)
  SELECT subject, coalesce(n_runs, 0) AS n_runs, coalesce(n_outlier_runs, 0) AS n_outliers, coalesce(pct_outlier, 0) AS pct_outlier, mean_fd, mean_high_motion_pct, coalesce(n_reviewed, 0) AS n_reviewed,
  coalesce(n_auto, 0) AS n_auto, coalesce(n_exclude, 0) AS n_exclude, coalesce(n_runs, 0) - coalesce(n_reviewed, 0) AS n_pending FROM subj FULL JOIN m USING (subject) FULL JOIN d USING (subject)""",
       {"pct_outlier": 1, "mean_fd": 3, "mean_high_motion_pct": 1})
def _(t):
    return Q.subject_summary(Q.outlier_subjects(t.iqms, _flags(t), IQ), Q.motion_runs(t.volumes, RUN), t.decisions)


@query("q12_merged_runs", f"""WITH {VOLUMES}, {MOTION}, {DECISIONS}, i AS (SELECT run_key, max(dvars) AS dvars_max FROM volumes GROUP BY 1), o AS (SELECT run_key, count(*) AS n_flags FROM volumes WHERE rmsd > 0.15 GROUP BY 1),
  mk AS (SELECT *, 'sub-' || subject || '_ses-' || session || '_acq-' || acq AS run_key FROM motion), rep AS (SELECT run_key, min(volume) AS report FROM volumes WHERE dvars < 20 GROUP BY 1)
  SELECT run_key, dvars_max, coalesce(n_flags, 0) AS n_flags, n_flags IS NOT NULL AS is_outlier, mean_fd, pct_high_motion, decision, {SIGNED} AS signed_off, report
  FROM i LEFT JOIN o USING (run_key) LEFT JOIN mk USING (run_key) LEFT JOIN decisions d USING (run_key) LEFT JOIN rep USING (run_key)""", ("mean_fd", "pct_high_motion"))
def _(t):
    v = t.volumes
    i = v.groupBy("run_key").agg(F.max("dvars").alias("dvars_max"))
    o = v.where("rmsd > 0.15").groupBy("run_key").agg(F.count("*").alias("n_flags"))
    rep = v.where("dvars < 20").groupBy("run_key").agg(F.min("volume").alias("report"))
    m = Q.motion_runs(v, ["run_key"]).select("run_key", "mean_fd", "pct_high_motion")
    return Q.merge_runs(i, o, m, t.decisions.drop("subject"), rep).select(
        "run_key", "dvars_max", "n_flags", "is_outlier", "mean_fd", "pct_high_motion", "decision", "signed_off", "report")


@query("q13_review_stubs", f"""WITH {VOLUMES}, {DECISIONS}, todo AS (SELECT run_key, avg(fd) AS mean_fd, max(fd) AS max_fd, round_even(100 * count(*) FILTER (fd > 0.5) / nullif(count(fd), 0), 1) AS pct_high_motion
  FROM volumes WHERE run_key NOT IN (SELECT run_key FROM decisions) GROUP BY 1)
  SELECT *, 'pending' AS decision, CASE WHEN mean_fd > 0.5 THEN 'investigate' ELSE 'keep' END AS recommendation,
  CASE WHEN mean_fd IS NULL THEN 'displacement unavailable' ELSE 'from confounds' END || CASE WHEN mean_fd > 0.5 THEN '; mean displacement above limit' ELSE '' END || '; awaiting human sign-off' AS reason FROM todo""",
       ("mean_fd", "max_fd", "pct_high_motion"))
def _(t):
    return Q.review_stubs(t.volumes, t.decisions, t.volumes).select("run_key", "mean_fd", "max_fd", "pct_high_motion", "decision", "recommendation", "reason")


DAILY = """d AS (SELECT user_id, day(ts) AS day, avg(value) AS v FROM events GROUP BY ALL)"""


def _daily(t):
    return t.events.groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(F.avg("value").alias("v"))


@query("q14_series_heatmap", f"""WITH {DAILY}, s AS (SELECT user_id, avg(v) AS mean_value, stddev_pop(v) AS sd FROM d GROUP BY 1) SELECT user_id, day, mean_value, (v - mean_value) / nullif(sd, 0) AS z FROM d JOIN s USING (user_id)""", ("mean_value", "z"))
def _(t):
    return Q.series_heatmap(_daily(t), "user_id", "v").select("user_id", F.col("day").cast("long").alias("day"), "mean_value", "z")


@query("q14_heatmap_sample", f"""WITH {DAILY}, c AS (SELECT user_id FROM (SELECT DISTINCT user_id FROM d) ORDER BY {draw_sql(42, "user_id")}, user_id LIMIT 40), s AS (SELECT user_id, round(avg(v), 9) AS mean_value, avg(v) AS m, stddev_pop(v) AS sd FROM d JOIN c USING (user_id) GROUP BY 1),
  o AS (SELECT *, row_number() OVER (ORDER BY m DESC, user_id) AS row FROM s) SELECT user_id, day, mean_value, (v - m) / nullif(sd, 0) AS z, row FROM d JOIN o USING (user_id)""", ("mean_value", "z"))
def _(t):
    return Q.sampled_heatmap(_daily(t), "user_id", "v", 40).select("user_id", F.col("day").cast("long").alias("day"), "mean_value", "z", F.col("row").cast("long").alias("row"))


@query("q14_mean_series", f"WITH {DAILY} SELECT CAST(day AS BIGINT) AS day, avg(v) AS mean_value, count(v) AS n FROM d GROUP BY ALL", ("mean_value",))
def _(t):
    return Q.mean_series(_daily(t), "day", "v").withColumn("day", F.col("day").cast("long"))


@query("q14_filled_displacement", f"WITH {VOLUMES} SELECT run_key, volume, coalesce(fd, 0) AS framewise_displacement FROM volumes", ("framewise_displacement",))
def _(t):
    return Q.fill_displacement(t.volumes).select("run_key", "volume", "framewise_displacement")
