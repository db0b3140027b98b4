"""Trial cleaning (T) and behavioural aggregation (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import norm_ppf_sql, pad2
from ..operators import behaviour as B
from ..operators import cleaning as C
from .registry import query
from .views import TRIALS

W = f"WITH {TRIALS} "
SEM = "stddev_samp({0}) / sqrt(nullif(count({0}), 0))"
CLIP = "least(greatest({0}, 0.001e0), 0.999e0)"
ORDER = "CASE WHEN CAST(session AS INTEGER) BETWEEN 4 AND 18 THEN CAST(CAST(session AS INTEGER) - 4 AS BIGINT) END"


@query("t01_button_remap", W + "SELECT trial_id, CAST(resp AS DOUBLE) - 5 AS rating FROM trials")
def _(t):
    return C.remap_buttons(t.trials).select("trial_id", "rating")


@query("t02_choice_decomposition", W + """SELECT trial_id, CASE WHEN resp IN (1, 2) THEN 1 ELSE 2 END AS recog,
  CASE WHEN resp IN (1, 4) THEN 'sure' ELSE 'maybe' END AS confidence,
  (CASE WHEN resp IN (1, 2) THEN 1 ELSE 2 END) = correct_resp AS is_correct FROM trials""")
def _(t):
    return C.decompose_choice(t.trials).select("trial_id", "recog", "confidence", "is_correct")


@query("t03_filter_rt_by_group", W + """, kept AS (SELECT * FROM trials WHERE resp_RT >= 0.2 AND resp_RT <= 4.5),
  s AS (SELECT subject, session, avg(resp_RT) AS m, stddev_samp(resp_RT) AS sd FROM kept GROUP BY ALL)
  SELECT trial_id, subject, session, resp_RT FROM kept JOIN s USING (subject, session)
  WHERE sd IS NULL OR abs(resp_RT - m) <= 2.5 * sd""")
def _(t):
    return C.filter_rt(t.trials, max_rt=4.5, max_sd=2.5, by=["subject", "session"]).select(
        "trial_id", "subject", "session", "resp_RT")


@query("t03_filter_rt_global", W + """, kept AS (SELECT * FROM trials WHERE resp_RT >= 0.2),
  s AS (SELECT avg(resp_RT) AS m, stddev_samp(resp_RT) AS sd FROM kept)
  SELECT trial_id, resp_RT FROM kept, s WHERE abs(resp_RT - m) <= 3 * sd""")
def _(t):
    return C.filter_rt(t.trials).select("trial_id", "resp_RT")


@query("t04_session_order", W + f"SELECT trial_id, session, {ORDER} AS session_order FROM trials")
def _(t):
    return C.add_session_order(t.trials).select("trial_id", "session", "session_order")


@query("t05_condition_labels", W + """SELECT enCon_label, reCon_label, confidence_label, count(*) AS n FROM (SELECT
  CASE enCon WHEN 1 THEN 'single' WHEN 2 THEN 'repeats' WHEN 3 THEN 'triplets' END AS enCon_label,
  CASE reCon WHEN 1 THEN 'within' WHEN 2 THEN 'across' END AS reCon_label,
  CASE WHEN resp IN (1, 4) THEN 'sure' WHEN resp IN (2, 3) THEN 'maybe' END AS confidence_label FROM trials) GROUP BY ALL""")
def _(t):
    return C.add_condition_labels(t.trials).groupBy("enCon_label", "reCon_label", "confidence_label").agg(F.count("*").alias("n"))


@query("t06_image_trials", W + """SELECT trial_id, subject, session, run, CAST(round_even(resp_RT * 10 / 1.5, 0) AS BIGINT) AS onset_tr
  FROM trials WHERE trial_type NOT IN ('rest', 'fixation')""")
def _(t):
    return C.image_trials(t.trials.withColumn("onset", F.col("resp_RT") * 10), 1.5).select(
        "trial_id", "subject", "session", "run", "onset_tr")


@query("t07_table_validation", W + """SELECT 'unexpected value' AS problem, c AS "column", v AS value, count(*) AS n FROM (
  SELECT 'enCon' AS c, CAST(enCon + pairId // 350 AS DOUBLE) AS v FROM trials UNION ALL
  SELECT 'reCon', CAST(reCon AS DOUBLE) FROM trials UNION ALL SELECT 'trial_accuracy', trial_accuracy * 2 FROM trials)
  WHERE v IS NOT NULL AND NOT ((c = 'enCon' AND v IN (1, 2, 3)) OR (c = 'reCon' AND v IN (1, 2)) OR (c = 'trial_accuracy' AND v IN (0, 1)))
  GROUP BY ALL UNION ALL SELECT 'missing column', 'word', NULL, 0""")
def _(t):
    bad = (t.trials.withColumn("enCon", F.col("enCon") + F.floor(F.col("pairId") / 350))
           .withColumn("trial_accuracy", F.col("trial_accuracy") * 2))
    return C.validate_trials(bad, ["resp", "resp_RT", "word", "trial_id"])


@query("t08_task_routing", W + """SELECT CASE task WHEN 'click' THEN 'naturalistic' WHEN 'view' THEN 'trial' WHEN 'purchase' THEN 'trial'
  WHEN 'signup' THEN 'localizer' END AS stream, task, count(*) AS n FROM trials GROUP BY ALL""")
def _(t):
    routes = {"click": "naturalistic", "view": "trial", "purchase": "trial", "signup": "localizer"}
    return C.route_tasks(t.trials, routes).groupBy("stream", "task").agg(F.count("*").alias("n"))


ACC = f"""count(trial_accuracy) AS n_trials, CAST(coalesce(sum(trial_accuracy), 0) AS BIGINT) AS n_correct,
  avg(trial_accuracy) AS accuracy, {SEM.format('trial_accuracy')} AS se"""


@query("a01_accuracy_by_condition", W + f"SELECT subject, enCon, reCon, {ACC} FROM trials GROUP BY ALL", ("accuracy", "se"))
def _(t):
    return B.accuracy_by_condition(t.trials, ["subject", "enCon", "reCon"])


@query("a01_accuracy_overall", W + f"SELECT {ACC} FROM trials", ("accuracy", "se"))
def _(t):
    return B.accuracy_by_condition(t.trials)


SDT = """, c AS (SELECT CAST({g} AS BIGINT) AS block, count(*) FILTER (quality = 1) AS n_signal, count(*) FILTER (quality = 0) AS n_noise,
  count(*) FILTER (quality = 1 AND toxic = 1) AS hits, count(*) FILTER (quality = 0 AND toxic = 1) AS fas FROM labels GROUP BY 1),
  r AS (SELECT *, hits / nullif(n_signal, 0) AS hit_rate, fas / nullif(n_noise, 0) AS fa_rate FROM c), """
LOGLIN = W + SDT.format(g="doc_id % 5") + """z AS (SELECT *, (hit_rate * n_signal + 0.5) / (n_signal + 1) AS h,
  (fa_rate * n_noise + 0.5) / (n_noise + 1) AS f FROM r) """
CLIPPED = W + SDT.format(g="doc_id % 5") + """z AS (SELECT *, least(greatest(hit_rate, 1 / (2 * n_signal)), 1 - 1 / (2 * n_signal)) AS h,
  least(greatest(fa_rate, 1 / (2 * n_noise)), 1 - 1 / (2 * n_noise)) AS f FROM r) """


def _sdt(t, correction):
    df = t.labels.withColumn("block", F.col("doc_id") % 5)
    return B.signal_detection(df, F.col("quality") == 1, F.col("toxic") == 1, ["block"], correction)


@query("a02_dprime_loglinear", LOGLIN + f"""SELECT block, n_signal, n_noise, hits, fas, hit_rate, fa_rate,
  {norm_ppf_sql('h')} - {norm_ppf_sql('f')} AS dprime FROM z""", ("hit_rate", "fa_rate", "dprime"))
def _(t):
    return _sdt(t, "loglinear").drop("criterion")


@query("a02_dprime_clip", CLIPPED + f"SELECT block, {norm_ppf_sql('h')} - {norm_ppf_sql('f')} AS dprime FROM z", ("dprime",))
def _(t):
    return _sdt(t, "clip").select("block", "dprime")


@query("a03_criterion", LOGLIN + f"SELECT block, -0.5 * ({norm_ppf_sql('h')} + {norm_ppf_sql('f')}) AS criterion FROM z", ("criterion",))
def _(t):
    return _sdt(t, "loglinear").select("block", "criterion")


@query("a04_choice_sdt", W + f""", g AS (SELECT subject, enCon, count(trial_accuracy) AS n_trials, avg(trial_accuracy) AS accuracy,
  avg(CAST((CASE WHEN resp IN (1, 2) THEN 1 ELSE 2 END) = correct_resp AS DOUBLE)) AS hit_rate FROM trials GROUP BY ALL
  HAVING count(trial_accuracy) > 0)
  SELECT *, 1 - hit_rate AS fa_rate, sqrt(2.0) * {norm_ppf_sql(CLIP.format('accuracy'))} AS dprime_2afc FROM g""",
       ("accuracy", "hit_rate", "fa_rate", "dprime_2afc"))
def _(t):
    return B.choice_sdt(C.decompose_choice(t.trials), ["subject", "enCon"])


@query("a05_confidence_accuracy", W + f"""SELECT subject, CASE WHEN resp IN (1, 4) THEN 2 ELSE 1 END AS confidence_level,
  count(trial_accuracy) AS n_trials, avg(trial_accuracy) AS accuracy, {SEM.format('trial_accuracy')} AS se FROM trials GROUP BY ALL""",
       ("accuracy", "se"))
def _(t):
    return B.confidence_accuracy(t.trials, ["subject"])


@query("a06_rating_distribution", W + """, c AS (SELECT subject, enCon, CAST(resp AS DOUBLE) AS rating, count(*) AS count FROM trials
  WHERE resp IS NOT NULL GROUP BY ALL) SELECT *, count / sum(count) OVER (PARTITION BY subject, enCon) AS proportion FROM c""", ("proportion",))
def _(t):
    return B.rating_distribution(t.trials, "resp", ["subject", "enCon"])


@query("a07_subsequent_memory", W + f""", i AS (SELECT subject, pairId, CAST(round_even(avg(resp), 0) AS BIGINT) AS encoding_rating FROM trials
  WHERE task = 'view' GROUP BY ALL HAVING avg(resp) IS NOT NULL), m AS (SELECT i.subject, encoding_rating, trial_accuracy FROM i
  JOIN trials r ON i.subject = r.subject AND i.pairId = r.pairId AND r.task = 'purchase')
  SELECT subject, encoding_rating, count(trial_accuracy) AS n_trials, avg(trial_accuracy) AS accuracy, {SEM.format('trial_accuracy')} AS se
  FROM m GROUP BY ALL""", ("accuracy", "se"))
def _(t):
    return B.subsequent_memory(t.trials.where("task = 'view'"), t.trials.where("task = 'purchase'"), ["subject", "pairId"],
                               group_cols=["subject"])


@query("a08_retrieval_vividness", W + f"""SELECT subject, reCon, avg(CAST(resp AS DOUBLE)) AS mean_vividness, {SEM.format('resp')} AS se, count(resp) AS n
  FROM trials WHERE task <> 'error' GROUP BY ALL""", ("mean_vividness", "se"))
def _(t):
    return B.mean_sem(t.trials.where("task <> 'error'"), "resp", ["subject", "reCon"], "mean_vividness")


@query("a09_final_vs_session", W + f""", s AS (SELECT subject, 'TB-ses-' || session AS source, session, enCon, avg(trial_accuracy) AS accuracy,
  {SEM.format('trial_accuracy')} AS se, count(trial_accuracy) AS n FROM trials WHERE ts < TIMESTAMP '2024-01-20' GROUP BY ALL)
  SELECT * FROM s UNION ALL SELECT subject, 'FIN-ses-30', '30', enCon, avg(trial_accuracy), {SEM.format('trial_accuracy')}, count(trial_accuracy)
  FROM trials WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY subject, enCon""", ("accuracy", "se"))
def _(t):
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    return B.final_vs_session_accuracy(t.trials.where(F.col("ts") < cut), t.trials.where(F.col("ts") >= cut), ["enCon"])


@query("a10_timeline", W + """SELECT subject, enCon, reCon, avg(r) AS mean_resp, stddev_samp(r) AS sd_resp, avg(trial_accuracy) AS accuracy, count(r) AS n
  FROM (SELECT *, CASE WHEN pairId % 9 <> 0 THEN (pairId + trial_id % 100) / 500 END AS r FROM trials) GROUP BY ALL""",
       ("mean_resp", "sd_resp", "accuracy"))
def _(t):
    r = F.when(F.col("pairId") % 9 != 0, (F.col("pairId") + F.col("trial_id") % 100) / 500)
    return B.timeline(t.trials.withColumn("timeline_resp", r), ["subject", "enCon", "reCon"])


@query("a11_retention", W + """, f AS (SELECT subject, pairId, min(session) AS initial_session,
  arg_min(trial_accuracy, session || printf('%012d', trial_id)) AS initial_accuracy FROM trials WHERE ts < TIMESTAMP '2024-01-20' GROUP BY ALL)
  SELECT subject, pairId, initial_session, initial_accuracy, trial_id, trial_accuracy AS final_accuracy, trial_accuracy - initial_accuracy AS retention_delta
  FROM f JOIN trials USING (subject, pairId) WHERE ts >= TIMESTAMP '2024-01-20'""")
def _(t):
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    return B.retention(t.trials.where(F.col("ts") < cut), t.trials.where(F.col("ts") >= cut))


@query("a12_learning_curve", W + f"""SELECT session, subject, avg(trial_accuracy) AS mean, {SEM.format('trial_accuracy')} AS se,
  count(trial_accuracy) AS n, {ORDER} AS session_order FROM trials GROUP BY subject, session""", ("mean", "se"))
def _(t):
    return B.learning_curve(t.trials, group_cols=["subject"])


@query("a13_dprime_curve", W + f""", g AS (SELECT session, subject, count(trial_accuracy) AS n, avg(trial_accuracy) AS accuracy FROM trials
  GROUP BY ALL HAVING count(trial_accuracy) > 0)
  SELECT *, sqrt(2.0) * {norm_ppf_sql(CLIP.format('accuracy'))} AS dprime_2afc, {ORDER} AS session_order FROM g""", ("accuracy", "dprime_2afc"))
def _(t):
    return B.dprime_curve(t.trials, ["subject"])


@query("a14_conditions_over_sessions", W + f"""SELECT session, subject, enCon AS condition, avg(trial_accuracy) AS mean,
  {SEM.format('trial_accuracy')} AS se, count(trial_accuracy) AS n, {ORDER} AS session_order FROM trials GROUP BY subject, session, enCon""", ("mean", "se"))
def _(t):
    return B.conditions_over_sessions(t.trials)


@query("a15_rt_summary", W + """SELECT subject, enCon, avg(resp_RT) AS mean_rt, stddev_samp(resp_RT) AS sd_rt, min(resp_RT) AS min_rt, max(resp_RT) AS max_rt,
  CASE WHEN count(resp_RT) >= 3 THEN CASE WHEN var_pop(resp_RT) = 0 THEN 0 ELSE skewness(resp_RT) END END AS skew,
  count(resp_RT) AS n_trials, quantile_cont(resp_RT, 0.5) AS median_rt FROM trials GROUP BY ALL""",
       ("mean_rt", "sd_rt", "skew", "median_rt"))
def _(t):
    return B.rt_summary(t.trials, group_cols=["subject", "enCon"])


@query("a16_rt_by_accuracy", W + """SELECT subject, coalesce(trial_accuracy <> 0, true) AS accurate, avg(resp_RT) AS mean_rt, stddev_samp(resp_RT) AS sd_rt,
  count(resp_RT) AS n_trials, quantile_cont(resp_RT, 0.5) AS median_rt FROM trials GROUP BY ALL""", ("mean_rt", "sd_rt", "median_rt"))
def _(t):
    return B.rt_by_accuracy(t.trials, group_cols=["subject"])


@query("a17_rt_sequential", W + """SELECT trial_id, subject, session, avg(resp_RT) OVER (PARTITION BY subject, session ORDER BY trial_id
  ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rt_rolling_mean FROM trials""", ("rt_rolling_mean",))
def _(t):
    return B.rt_sequential(t.trials, group_cols=["subject", "session"]).select("trial_id", "subject", "session", "rt_rolling_mean")


@query("a18_group_mean_over_subjects", W + f""", p AS (SELECT subject, session, enCon, avg(trial_accuracy) AS m FROM trials GROUP BY ALL)
  SELECT session, enCon, avg(m) AS mean, {SEM.format('m')} AS se, count(m) AS n_subjects FROM p GROUP BY ALL""", ("mean", "se"))
def _(t):
    return B.group_mean_over_subjects(t.trials, "trial_accuracy", ["session", "enCon"])


@query("a19_report_learning_curve", W + f"""SELECT session, subject, enCon, avg(resp_RT) AS mean, {SEM.format('resp_RT')} AS se, count(resp_RT) AS n,
  {ORDER} AS session_order FROM trials WHERE subject IN ('03', '04', '05') GROUP BY ALL""", ("mean", "se"))
def _(t):
    return B.report(t.trials, lambda d: B.learning_curve(d, "resp_RT", ["subject", "enCon"]), subjects=["03", "04", "05"])


@query("a19_report_rt_distribution", W + """, f AS (SELECT * FROM trials WHERE session IN ('04', '05', '06')), l AS (SELECT min(resp_RT) AS lo, max(resp_RT) AS hi FROM f)
  SELECT subject, CAST(least(floor((resp_RT - lo) / (hi - lo) * 40), 39) AS BIGINT) AS bin, count(*) AS n FROM f, l GROUP BY ALL""")
def _(t):
    return B.named_report("rt_distribution", t.trials, sessions=["04", "05", "06"])


@query("a20_coverage", W + """, c AS (SELECT subject, session, task, count(*) AS n FROM trials GROUP BY ALL)
  SELECT subject, session, CAST(sum(n) AS BIGINT) AS n_trials, count(*) AS n_tasks, arg_max(task, printf('%012d', n) || task) AS main_task FROM c GROUP BY ALL""")
def _(t):
    return B.coverage(t.trials)


@query("a21_feature_ranking", """SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part""")
def _(t):
    return B.ranking(t.part, "p_retailprice", "p_partkey").select("p_partkey", "p_retailprice", "rank")


@query("a21_feature_histogram", """SELECT p_type, CAST(least(floor((p_retailprice - lo) / (hi - lo) * 40), 39) AS BIGINT) AS bin, count(*) AS n
  FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) GROUP BY ALL""")
def _(t):
    return B.histogram(t.part, "p_retailprice", 40, ["p_type"])
