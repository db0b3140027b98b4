"""Log-to-event conversion (E). A log file is the event history of one user."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import pad2
from ..operators import conversion as V
from .registry import query

U = ["user_id"]

BT = """b AS (SELECT user_id, event_id AS trial, CASE WHEN event_id % 7 <> 0 THEN event_type END AS word, event_id % 12 AS pairId, CASE WHEN event_id % 9 = 0 THEN ' ' WHEN event_id % 10 <> 0 THEN CAST(event_id % 2 + 1 AS VARCHAR) END AS cueId,
  event_id % 3 + 1 AS resp FROM events WHERE event_id % 31 <> 0),
  w AS (SELECT user_id, event_id AS trial, CASE WHEN event_id % 2 = 0 OR event_id % 5 = 0 THEN CAST(event_id AS DOUBLE) END AS image_start, CASE WHEN event_id % 2 = 0 OR event_id % 5 = 0 THEN event_id + value / 127 END AS image_end,
  CASE WHEN event_id % 2 = 1 OR event_id % 6 = 0 THEN event_id + 0.5 END AS word_start, CASE WHEN event_id % 2 = 1 OR event_id % 6 = 0 THEN event_id + 0.5 + value / 251 END AS word_end, event_id + value / 61 AS fixation_end
  FROM events WHERE event_id % 37 <> 0),
  m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY trial) - 1 AS i, lag(fixation_end) OVER (PARTITION BY user_id ORDER BY trial) AS prev FROM b JOIN w USING (user_id, trial))"""


def _logs(t):
    e, v = F.col("event_id"), F.col("value")
    b = t.events.where(e % 31 != 0).select(
        "user_id", e.alias("trial"), F.when(e % 7 != 0, F.col("event_type")).alias("word"), (e % 12).alias("pairId"),
        F.when(e % 9 == 0, " ").when(e % 10 != 0, (e % 2 + 1).cast("string")).alias("cueId"), (e % 3 + 1).alias("resp"))
    im, wo = (e % 2 == 0) | (e % 5 == 0), (e % 2 == 1) | (e % 6 == 0)
    w = t.events.where(e % 37 != 0).select(
        "user_id", e.alias("trial"), F.when(im, e.cast("double")).alias("image_start"), F.when(im, e + v / 127).alias("image_end"),
        F.when(wo, e + 0.5).alias("word_start"), F.when(wo, e + 0.5 + v / 251).alias("word_end"), (e + v / 61).alias("fixation_end"))
    return b, w


D = ("duration", "onset_actual", "duration_actual")


@query("e01_encoding_events", f"""WITH {BT}, r AS (SELECT *, word IS NULL OR pairId = 0 AS rest FROM m)
  SELECT user_id, trial, NULL AS word, NULL AS resp, 9.0e0 + 4.5e0 * i AS onset, 3.0e0 AS duration, 'rest' AS trial_type, CAST(NULL AS VARCHAR) AS modality, CASE WHEN i = 0 THEN image_start ELSE prev END AS onset_actual, 3.0e0 AS duration_actual FROM r WHERE rest
  UNION ALL SELECT user_id, trial, word, resp, 9.0e0 + 4.5e0 * i, 3.0e0, 'image', 'visual', image_start, image_end - image_start FROM r WHERE NOT rest
  UNION ALL SELECT user_id, trial, word, resp, 9.0e0 + 4.5e0 * i, word_end - word_start, 'word', 'auditory', word_start, word_end - word_start FROM r WHERE NOT rest""", D)
def _(t):
    return V.encoding_events(*_logs(t), U, "trial", ["word", "resp"])


@query("e02_math_events", f"""WITH {BT} SELECT user_id, trial, 'math' AS trial_type, 6.0e0 + 4.5e0 * i AS onset, 3.0e0 AS duration, image_start AS onset_actual, image_end - image_start AS duration_actual FROM m""", D)
def _(t):
    return V.math_events(*_logs(t), U, "trial")


RETR = """SELECT user_id, trial, CASE WHEN NOT rest THEN word END AS word, CASE WHEN NOT rest THEN resp END AS resp, 9.0e0 + 4.5e0 * i AS onset, CASE WHEN rest THEN {s} WHEN image_start IS NOT NULL THEN 3.0e0 ELSE 0.54e0 END AS duration,
  CASE WHEN rest THEN prev WHEN image_start IS NOT NULL THEN image_start ELSE word_start END AS onset_actual, CASE WHEN rest THEN {s} WHEN image_start IS NOT NULL THEN image_end - image_start ELSE word_end - word_start END AS duration_actual,
  CASE WHEN rest THEN 'rest' WHEN image_start IS NOT NULL THEN 'image' ELSE 'word' END AS trial_type, CASE WHEN rest THEN NULL WHEN image_start IS NOT NULL THEN 'visual' ELSE 'auditory' END AS modality FROM r"""


@query("e03_retrieval_events", f"WITH {BT}, r AS (SELECT *, cueId IS NULL OR trim(cueId) = '' AS rest FROM m) " + RETR.format(s="3.0e0"), D)
def _(t):
    return V.retrieval_events(*_logs(t), U, "trial", ["word", "resp"])


@query("e04_final_retrieval_events", f"""WITH {BT}, r0 AS (SELECT * REPLACE (CASE WHEN user_id % 2 = 0 THEN image_start END AS image_start), cueId IS NULL OR trim(cueId) = '' AS rest FROM m),
  r AS (SELECT *, max(CAST(NOT rest AND image_start IS NOT NULL AS INTEGER)) OVER (PARTITION BY user_id) AS any_image FROM r0) """
       + RETR.format(s="CASE WHEN any_image = 1 THEN 3.0e0 ELSE 0.54e0 END"), D)
def _(t):
    b, w = _logs(t)
    w = w.withColumn("image_start", F.when(F.col("user_id") % 2 == 0, F.col("image_start")))
    return V.retrieval_events(b, w, U, "trial", ["word", "resp"], final=True)


NAMES = """n AS (SELECT event_id, 'sub' || (user_id % 20) || '_ses' || (event_id % 9 + 1) || '_run' || (event_id % 4 + 1) || CASE event_type WHEN 'click' THEN '_cuedrecall_encoding' WHEN 'view' THEN '_cuedrecall_retrieval'
  WHEN 'error' THEN '_freerecall_math' ELSE '_other' END || '.csv' AS file_name FROM events)"""
RULES = ((r"freerecall.*math", "FRmath"), (r"encoding", "TBencoding"), (r"retrieval", "TBretrieval"))


@query("e05_log_names", f"""WITH {NAMES}, p AS (SELECT event_id, CAST(regexp_extract(file_name, 'sub-?([0-9]+)', 1) AS INTEGER) AS subject_no, CAST(regexp_extract(file_name, 'ses(?:s|sion)?-?([0-9]+)', 1) AS INTEGER) AS session_no,
  CAST(regexp_extract(file_name, 'run-?([0-9]+)', 1) AS INTEGER) AS run_no, CASE WHEN file_name LIKE '%math%' THEN 'FRmath' WHEN file_name LIKE '%encoding%' THEN 'TBencoding' WHEN file_name LIKE '%retrieval%' THEN 'TBretrieval' END AS task FROM n)
  SELECT *, session_no + CASE task WHEN 'TBencoding' THEN 3 WHEN 'TBretrieval' THEN 3 WHEN 'FRmath' THEN 18 ELSE 0 END AS bids_session FROM p""")
def _(t):
    kind = (F.when(F.col("event_type") == "click", "_cuedrecall_encoding").when(F.col("event_type") == "view", "_cuedrecall_retrieval")
            .when(F.col("event_type") == "error", "_freerecall_math").otherwise("_other"))
    s = lambda c: c.cast("string")
    n = t.events.select("event_id", F.concat(F.lit("sub"), s(F.col("user_id") % 20), F.lit("_ses"), s(F.col("event_id") % 9 + 1), F.lit("_run"),
                                             s(F.col("event_id") % 4 + 1), kind, F.lit(".csv")).alias("file_name"))
    return V.renumber_sessions(V.parse_log_name(n, rules=RULES), {"TBencoding": 3, "TBretrieval": 3, "FRmath": 18}, session="session_no").drop("file_name")


@query("e05_timing_pairs", """WITH l AS (SELECT DISTINCT user_id, event_type FROM events), f AS (SELECT user_id, event_type, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 2 END AS priority, 'timing_' || printf('%09d', event_id) AS timing_name FROM events)
  SELECT user_id, event_type, timing_name FROM l LEFT JOIN (SELECT user_id, event_type, timing_name FROM f QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY priority, timing_name) = 1) USING (user_id, event_type)""")
def _(t):
    e = F.col("event_id")
    logs = t.events.select("user_id", "event_type").distinct()
    timing = t.events.select("user_id", "event_type", F.when(e % 4 == 0, 1).otherwise(2).alias("priority"),
                                              F.concat(F.lit("timing_"), F.format_string("%09d", e)).alias("timing_name"))
    return V.pair_timing(logs, timing, ["user_id", "event_type"])


LOG = """g AS (SELECT user_id, event_id, CASE WHEN event_type IN ('click', 'view') THEN event_id % 100 END AS trial_n, CASE WHEN event_id % 6 = 0 THEN value END AS wait_started, event_id + 1.25 AS title_started, event_id + 3.5 AS title_stopped,
  CASE WHEN event_id % 3 <> 0 THEN event_id + 4.0 END AS fixation_started, CASE WHEN event_id % 4 <> 0 THEN event_id + 5.5 END AS fixation_stopped, event_id + 6.0 AS movie_started, event_id + 6.0 + value / 4 AS movie_stopped, event_type AS movie_name,
  CASE WHEN event_id % 13 = 0 THEN event_id + 9.5 END AS blank_started, CASE WHEN event_id % 11 = 0 THEN event_id + 9.75 END AS stop_stopped FROM events WHERE user_id % 25 <> 3 OR event_type = 'error')"""


def _movie_log(t):
    e, v = F.col("event_id"), F.col("value")
    return t.events.where((F.col("user_id") % 25 != 3) | (F.col("event_type") == "error")).select(
        "user_id", "event_id", F.when(F.col("event_type").isin("click", "view"), e % 100).alias("trial_n"), F.when(e % 6 == 0, v).alias("wait_started"),
        (e + 1.25).alias("title_started"), (e + 3.5).alias("title_stopped"), F.when(e % 3 != 0, e + 4.0).alias("fixation_started"),
        F.when(e % 4 != 0, e + 5.5).alias("fixation_stopped"), (e + 6.0).alias("movie_started"), (e + 6.0 + v / 4).alias("movie_stopped"),
        F.col("event_type").alias("movie_name"), F.when(e % 13 == 0, e + 9.5).alias("blank_started"), F.when(e % 11 == 0, e + 9.75).alias("stop_stopped"))


@query("e06_movie_events", f"""WITH {LOG}, z AS (SELECT user_id, arg_max(wait_started, event_id) AS z FROM g WHERE wait_started IS NOT NULL GROUP BY 1), r AS (SELECT * FROM g JOIN z USING (user_id) WHERE trial_n IS NOT NULL)
  SELECT user_id, trial_n + 1 AS trial_num, 'title' AS trial_type, title_started - z AS onset, title_stopped - title_started AS duration, CAST(NULL AS VARCHAR) AS movie_name FROM r
  UNION ALL SELECT user_id, trial_n + 1, 'fixation', fixation_started - z, fixation_stopped - fixation_started, NULL FROM r WHERE fixation_started IS NOT NULL AND fixation_stopped IS NOT NULL
  UNION ALL SELECT user_id, trial_n + 1, 'movie', movie_started - z, movie_stopped - movie_started, movie_name FROM r
  UNION ALL SELECT user_id, NULL, 'blank', b - z, s - b, NULL FROM (SELECT user_id, arg_min(blank_started, event_id) AS b, arg_min(stop_stopped, event_id) AS s, bool_or(trial_n IS NOT NULL) AS a FROM g GROUP BY 1) JOIN z USING (user_id) WHERE a AND b IS NOT NULL AND s IS NOT NULL""",
       ("onset", "duration"))
def _(t):
    return V.movie_events(_movie_log(t), U, "event_id")


RLOG = """g AS (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN event_id % 100 END AS trial_n, CASE WHEN event_id % 6 = 0 THEN value END AS wait_started, event_id + 0.25 AS recall_started, event_id + 0.75 AS prompt_started, event_id + 2.0 AS prompt_stopped,
  event_id + 2.5 AS plus_started, CASE WHEN event_id % 5 <> 0 THEN event_id + 2.5 + value END AS recall_stopped, CASE WHEN event_id % 4 = 0 THEN event_id + 2.25 END AS image_started, CASE WHEN event_id % 4 = 0 THEN event_id + 2.25 + CASE WHEN event_id % 8 = 0 THEN 0.0625 ELSE 1.5 END END AS image_stopped,
  CASE event_id % 6 WHEN 0 THEN '6.0' WHEN 1 THEN 'None' WHEN 2 THEN 'apostrophe' WHEN 3 THEN ' 6 ' WHEN 4 THEN '3.0' END AS key_main, CASE WHEN event_id % 7 <> 0 THEN '7' ELSE 'x' END AS key_other FROM events)"""


@query("e07_recall_events", f"""WITH {RLOG}, z AS (SELECT user_id, arg_max(wait_started, event_id) AS z FROM g WHERE wait_started IS NOT NULL GROUP BY 1),
  r AS (SELECT *, coalesce(image_stopped - image_started > 0.1, false) AS shown, trim(CASE WHEN key_main IS NOT NULL AND trim(key_main) NOT IN ('', 'None') THEN key_main ELSE key_other END) AS k FROM g JOIN z USING (user_id) WHERE trial_n IS NOT NULL),
  a AS (SELECT *, CAST(CASE WHEN shown OR k IN ('7', '7.0', 'apostrophe') THEN 7 WHEN k IN ('6', '6.0') THEN 6 ELSE trunc(TRY_CAST(k AS DOUBLE)) END AS INTEGER) AS answer FROM r)
  SELECT user_id, trial_n + 1 AS trial_num, 'blank' AS trial_type, recall_started - z AS onset, prompt_started - recall_started AS duration, CAST(NULL AS INTEGER) AS cue_response FROM a
  UNION ALL SELECT user_id, trial_n + 1, 'prompt', prompt_started - z, prompt_stopped - prompt_started, NULL FROM a
  UNION ALL SELECT user_id, trial_n + 1, 'cue', CASE WHEN shown THEN image_started ELSE plus_started END - z, CASE WHEN shown THEN image_stopped - image_started ELSE 0 END, answer FROM a
  UNION ALL SELECT user_id, trial_n + 1, 'recall', plus_started - z, recall_stopped - plus_started, answer FROM a""", ("onset", "duration"))
def _(t):
    e, v = F.col("event_id"), F.col("value")
    k = e % 6
    g = t.events.select(
        "user_id", "event_id", F.when(F.col("event_type") != "error", e % 100).alias("trial_n"), F.when(k == 0, v).alias("wait_started"), (e + 0.25).alias("recall_started"),
        (e + 0.75).alias("prompt_started"), (e + 2.0).alias("prompt_stopped"), (e + 2.5).alias("plus_started"), F.when(e % 5 != 0, e + 2.5 + v).alias("recall_stopped"),
        F.when(e % 4 == 0, e + 2.25).alias("image_started"), F.when(e % 4 == 0, e + 2.25 + F.when(e % 8 == 0, 0.0625).otherwise(1.5)).alias("image_stopped"),
        F.when(k == 0, "6.0").when(k == 1, "None").when(k == 2, "apostrophe").when(k == 3, " 6 ").when(k == 4, "3.0").alias("key_main"),
        F.when(e % 7 != 0, "7").otherwise("x").alias("key_other"))
    return V.recall_events(g, U, "event_id")


@query("e08_two_phase_events", """SELECT l_orderkey, l_partkey, 'tone' AS trial_type, l_quantity AS onset, l_tax AS duration FROM lineitem
  UNION ALL SELECT l_orderkey, l_partkey, 'fixation', l_quantity + l_tax, l_discount FROM lineitem""", ("onset", "duration"))
def _(t):
    x = t.lineitem.withColumn("e", F.col("l_quantity") + F.col("l_tax")).withColumn("f", F.col("l_quantity") + F.col("l_tax") + F.col("l_discount"))
    return V.two_phase_events(x, ["l_orderkey", "l_partkey"], "l_quantity", "e", "f", "tone")


@query("e08_motor_events", "SELECT l_orderkey, l_partkey, l_quantity AS onset, l_extendedprice - l_quantity AS duration FROM lineitem", {"duration": 4})
def _(t):
    return V.motor_events(t.lineitem, ["l_orderkey", "l_partkey"], "l_quantity", "l_extendedprice")


CAL = """c AS (SELECT user_id * 31 + day(ts) AS file, CASE event_type WHEN 'click' THEN 'movie' WHEN 'view' THEN 'sync' ELSE 'other' END AS event, CASE WHEN event_type = 'view' AND event_id % 4 <> 0 THEN 0 ELSE value END AS onset_s, value + 10 AS offset_s FROM events)"""


@query("e09_calibration_events", f"""WITH {CAL}, g AS (SELECT file, count(*) FILTER (event = 'movie') AS nm, count(*) FILTER (event = 'sync') AS ns, min(onset_s) FILTER (event = 'movie') AS o, min(offset_s) FILTER (event = 'movie') AS f, min(onset_s) FILTER (event = 'sync') AS s FROM c GROUP BY 1),
  p AS (SELECT *, CASE WHEN nm <> 1 THEN 'movie rows' WHEN ns <> 1 OR s <> 0 THEN 'sync marker' END AS problem FROM g) SELECT file, problem, CASE WHEN problem IS NULL THEN o END AS onset, CASE WHEN problem IS NULL THEN f - o END AS duration FROM p""", ("onset", "duration"))
def _(t):
    ev = F.when(F.col("event_type") == "click", "movie").when(F.col("event_type") == "view", "sync").otherwise("other")
    on = F.when((F.col("event_type") == "view") & (F.col("event_id") % 4 != 0), 0.0).otherwise(F.col("value"))
    return V.calibration_events(t.events.select((F.col("user_id") * 31 + F.dayofmonth("ts")).alias("file"), ev.alias("event"), on.alias("onset_s"), (F.col("value") + 10).alias("offset_s")), ["file"])


TON = """t AS (SELECT user_id, event_id, value * 2 AS onset, value / 3 AS duration FROM events), n AS (SELECT user_id, 300.0e0 + user_id AS run_s FROM events WHERE user_id % 5 <> 0 GROUP BY 1)"""


def _tones(t):
    ev = t.events.select("user_id", "event_id", (F.col("value") * 2).alias("onset"), (F.col("value") / 3).alias("duration"))
    return ev, t.events.where("user_id % 5 <> 0").groupBy("user_id").agg((F.lit(300.0) + F.max("user_id")).alias("run_s"))


@query("e10_truncated_events", f"""WITH {TON} SELECT user_id, event_id, onset, coalesce(onset + duration > run_s + 1e-3, false) AS clipped, CASE WHEN onset + duration > run_s + 1e-3 THEN run_s - onset ELSE duration END AS duration
  FROM t LEFT JOIN n USING (user_id) WHERE run_s IS NULL OR onset < run_s - 1e-3""", ("duration",))
def _(t):
    return V.truncate_events(*_tones(t), U)


@query("e10_truncation_counts", f"""WITH {TON} SELECT user_id, count(*) FILTER (onset >= run_s - 1e-3) AS n_dropped, count(*) FILTER (onset < run_s - 1e-3 AND onset + duration > run_s + 1e-3) AS n_clipped FROM t JOIN n USING (user_id) GROUP BY 1""")
def _(t):
    return V.truncation_counts(*_tones(t), U)


@query("e11_block_events", """WITH x AS (SELECT user_id % 10 AS file, (day(ts) * 24 + hour(ts)) // 6 AS block, CASE WHEN event_id % 97 = 0 THEN 2 ELSE (day(ts) * 24 + hour(ts)) // 6 % 5 END AS condition, event_id * 0.75 AS onset, event_id % 5 = 0 AS odd, event_id % 7 = 0 AS resp FROM events),
  b AS (SELECT file, block, count(*) AS n, count(DISTINCT condition) AS nc, min(condition) AS condition, min(onset) AS s, count(*) FILTER (odd) AS n_oddball, count(*) FILTER (resp) AS n_response FROM x GROUP BY ALL),
  t AS (SELECT file, max(onset) + 3 AS total FROM x GROUP BY 1) SELECT file, block, round_even(s * 1000, 0) / 1000 AS onset, round_even((coalesce(lead(s) OVER (PARTITION BY file ORDER BY block), total) - s) * 1000, 0) / 1000 AS duration, condition, n_oddball, n_response,
  n = 8 AND nc = 1 AS valid FROM b JOIN t USING (file)""", ("onset", "duration"))
def _(t):
    blk = F.floor((F.dayofmonth("ts") * 24 + F.hour("ts")) / 6)
    e = F.col("event_id")
    x = t.events.select((F.col("user_id") % 10).alias("file"), blk.alias("block"), F.when(e % 97 == 0, F.lit(2).cast("long")).otherwise(blk % 5).alias("condition"), (e * 0.75).alias("onset"),
                        (e % 5 == 0).cast("long").alias("oddball"), (e % 7 == 0).cast("long").alias("response"))
    return V.block_events(x, ["file"], x.groupBy("file").agg((F.max("onset") + 3).alias("total_time")), 8)


@query("e12_run_completeness", """SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS n_distinct, CAST(min(l_linenumber) AS BIGINT) AS first, CAST(max(l_linenumber) AS BIGINT) AS last, list_sort(list(l_linenumber)) = list_transform(range(1, count(*) + 1), lambda x: CAST(x AS INTEGER)) AS complete
  FROM lineitem GROUP BY 1""")
def _(t):
    return V.run_completeness(t.lineitem.withColumn("l_linenumber", F.col("l_linenumber").cast("long")), ["l_orderkey"], "l_linenumber")


@query("e13_self_paced_events", """SELECT user_id, event_id, coalesce(sum(value / 61) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS onset, value / 61 AS duration FROM events""", ("onset", "duration"))
def _(t):
    x = t.events.withColumn("resp_RT", F.col("value") / 61)
    return V.self_paced_events(x, U, "event_id").select("user_id", "event_id", "onset", "duration")


@query("e14_word_events", """WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM conversations), x AS (SELECT conv_id, turn, pos, CASE WHEN pos % 9 = 0 THEN '"Um,' WHEN pos % 10 = 3 THEN 'mhm...' ELSE word END AS word FROM w)
  SELECT conv_id, turn, pos, word, round_even(pos * 0.37 * 1000, 0) / 1000 AS onset, round_even((pos * 0.37 + length(word) * 0.07 - pos * 0.37) * 1000, 0) / 1000 AS duration, CAST(lower(trim(word, '.,!?…''"')) IN ('um', 'uh', 'hmm', 'mm', 'mhm') AS INTEGER) AS filler FROM x""", {"onset": 3, "duration": 3})
def _(t):
    w = t.conversations.select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    p = F.col("pos")
    x = w.withColumn("word", F.when(p % 9 == 0, '"Um,').when(p % 10 == 3, "mhm...").otherwise(F.col("word"))).withColumn("onset", p * F.lit(0.37))
    x = x.withColumn("offset", p * F.lit(0.37) + F.length("word") * 0.07)
    return V.word_events(x).select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "word", "onset", "duration", "filler")



def _tick():
    return (F.dayofyear("ts") - 1) * 1440 + F.hour("ts") * 60 + F.minute("ts")


@query("e15_regular_grid", """WITH s AS (SELECT user_id, event_id, CAST((dayofyear(ts) - 1) * 1440 + hour(ts) * 60 + minute(ts) AS BIGINT) AS tick, value FROM events), p AS (SELECT user_id, min(tick) AS a, max(tick) AS b FROM s GROUP BY 1),
  g AS (SELECT user_id, a, unnest(range(CAST(round_even((b - a) / 400.0, 0) AS BIGINT) + 1)) AS sample FROM p)
  SELECT g.user_id, sample, CAST(a + sample * 400 AS DOUBLE) AS tick, (SELECT arg_max(value, tick * 1000000000 + event_id) FROM s WHERE s.user_id = g.user_id AND s.tick <= a + sample * 400) AS value FROM g""")
def _(t):
    s = t.events.select("user_id", "event_id", _tick().cast("long").alias("tick"), "value")
    return V.regular_grid(s, U, "tick", "value", "event_id", 1000.0)


@query("e15_start_times", """WITH s AS (SELECT user_id, min(event_id) AS first_tick FROM events GROUP BY 1) SELECT user_id, first_tick, coalesce((first_tick - v) * 2.5 / 1000, 0) AS start_time
  FROM s LEFT JOIN (SELECT user_id, min(event_id) AS v FROM events WHERE event_type = 'signup' GROUP BY 1) USING (user_id)""", ("start_time",))
def _(t):
    v = t.events.where("event_type = 'signup'").groupBy("user_id").agg(F.min("event_id").alias("vol0_tick"))
    return V.start_times(t.events, v, U, "event_id").drop("vol0_tick")


EYE = """s AS (SELECT user_id * 31 + day(ts) AS file, event_id, epoch(ts) AS t, CASE WHEN event_id % 4 <> 0 THEN value END AS x, CASE WHEN event_id % 3 = 0 THEN 0 ELSE CAST(json_extract(props, '$.k') AS DOUBLE) END AS pupil FROM events),
  w AS (SELECT user_id * 31 + day(ts) AS file, count(*) FILTER (event_type IN ('signup', 'click')) AS n_triggers, min(epoch(ts)) FILTER (event_type IN ('signup', 'click')) AS a, max(epoch(ts)) FILTER (event_type IN ('signup', 'click')) AS b FROM events WHERE event_id % 23 <> 0 GROUP BY 1)"""


def _eye(t):
    f, e = (F.col("user_id") * 31 + F.dayofmonth("ts")).alias("file"), F.col("event_id")
    at = F.expr("cast(unix_micros(cast(ts as timestamp)) as double) / 1000000").alias("t")
    s = t.events.select(f, "event_id", at, F.when(e % 4 != 0, F.col("value")).otherwise(float("nan")).alias("x"), F.lit(1.0).alias("y"),
                        F.when(e % 3 == 0, 0.0).otherwise(F.get_json_object("props", "$.k").cast("double")).alias("pupil"))
    g = t.events.where(e % 23 != 0).select(f, at, F.when(F.col("event_type").isin("signup", "click"), 255).otherwise(0).alias("code"))
    return s, V.trigger_windows(g, ["file"])


@query("e16_scan_window_trim", f"WITH {EYE} SELECT file, event_id, x, nullif(pupil, 0) AS pupil FROM s JOIN w USING (file) WHERE n_triggers >= 2 AND t BETWEEN a AND b")
def _(t):
    return V.trim_to_scan(*_eye(t), ["file"]).select("file", "event_id", "x", "pupil")


@query("e17_eye_triage", f"""WITH {EYE}, g AS (SELECT file, coalesce(max(n_triggers), 0) AS n_triggers, count(*) AS n_samples, count(*) FILTER (coalesce(n_triggers, 0) < 2 OR t BETWEEN a AND b) AS n, count(x) FILTER (coalesce(n_triggers, 0) < 2 OR t BETWEEN a AND b) AS g,
  count(*) FILTER (pupil > 0 AND (coalesce(n_triggers, 0) < 2 OR t BETWEEN a AND b)) AS p FROM s LEFT JOIN w USING (file) GROUP BY 1), v AS (SELECT *, coalesce(g / nullif(n, 0), 0) AS gv, coalesce(p / nullif(n, 0), 0) AS pv FROM g)
  SELECT file, n_triggers, n_samples, gv >= 0.6 AS gaze_viable, pv >= 0.6 AS pupil_viable, round_even(100 * gv, 1) AS gaze_valid_pct, round_even(100 * pv, 1) AS pupil_valid_pct, CASE WHEN gv >= 0.6 OR pv >= 0.6 THEN 'include' ELSE 'exclude' END AS decision,
  CASE WHEN gv >= 0.6 AND pv >= 0.6 THEN 'gaze+pupil' WHEN gv >= 0.6 THEN 'gaze_only' WHEN pv >= 0.6 THEN 'pupil_only' ELSE '' END AS channels, CASE WHEN n_triggers < 2 THEN 'insufficient triggers' ELSE '' END AS note FROM v""", {"gaze_valid_pct": 1, "pupil_valid_pct": 1})
def _(t):
    return V.eye_triage(*_eye(t), ["file"])


@query("e18_physio_triage", """WITH g AS (SELECT user_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - event_id AS gap FROM events), v AS (SELECT user_id, count(*) AS num_volumes, coalesce(round_even(quantile_cont(CAST(gap AS DOUBLE), 0.5) * 2.5, 1), 0) AS tr_ms FROM g GROUP BY 1),
  r AS (SELECT user_id, CASE WHEN user_id % 13 <> 0 THEN count(*) * 7 END AS n_samples, CAST(user_id % 40 + 1 AS BIGINT) AS sample_ticks FROM events GROUP BY 1),
  d AS (SELECT *, round_even(n_samples * sample_ticks * 2.5 / 1000, 1) AS rec_dur, round_even(num_volumes * tr_ms / 1000, 1) AS expected_dur FROM r LEFT JOIN v USING (user_id)), q AS (SELECT *, coalesce(round_even(rec_dur / nullif(expected_dur, 0), 3), 0) AS ratio FROM d)
  SELECT *, CASE WHEN n_samples IS NULL THEN 'INFO_ONLY' WHEN ratio >= 0.9 THEN 'COMPLETE' WHEN ratio >= 0.5 THEN 'PARTIAL' ELSE 'TRUNCATED' END AS status FROM q""", {"tr_ms": 1, "rec_dur": 1, "expected_dur": 1, "ratio": 3})
def _(t):
    rec = t.events.groupBy("user_id").agg((F.count("*") * 7).alias("n")).select(
        "user_id", F.when(F.col("user_id") % 13 != 0, F.col("n")).alias("n_samples"), (F.col("user_id") % 40 + 1).alias("sample_ticks"))
    return V.physio_triage(t.events.select("user_id", "event_id"), rec, U, "event_id")
