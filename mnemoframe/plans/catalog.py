"""Catalog and validation (C), processing status (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import pad2
from ..operators import catalog as C
from ..operators import status as S
from .registry import query
from .views import EVENT_FILES, EXPECTED, RUNS

R = f"WITH {RUNS} "
RE = f"WITH {RUNS}, {EVENT_FILES} "
RX = f"WITH {RUNS}, {EXPECTED} "
KEYS = ["subject", "session", "task"]
UNIT = ["subject", "session", "task"]


@query("c01_read_only_select", """SELECT o_orderstatus, count(*) AS n, CAST(sum(o_totalprice) AS DOUBLE) AS total FROM orders
  WHERE o_totalprice >= 250000 GROUP BY o_orderstatus""", {"total": 2})
def _(t):
    return C.run_select(t.spark, "SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM {orders} "
                        "WHERE o_totalprice >= :least GROUP BY o_orderstatus", {"least": 250000}, orders=t.orders)


RES = """, seen AS (SELECT subject, session, task, count(*) AS n FROM runs GROUP BY ALL), res AS (
  SELECT subject, session, task, runs_min, runs_max, coalesce(n, 0) AS observed_n,
  CASE WHEN runs_min IS NULL OR coalesce(n, 0) > runs_max THEN 'surplus' WHEN coalesce(n, 0) >= runs_min THEN 'present'
  WHEN x.disposition IS NOT NULL THEN 'excepted' ELSE 'missing' END AS status, x.disposition AS d
  FROM expected_units FULL JOIN seen USING (subject, session, task) LEFT JOIN exceptions x USING (subject, session, task)),
  resolution AS (SELECT * EXCLUDE d, CASE WHEN status = 'excepted' THEN d END AS disposition FROM res) """


def _res(t):
    return C.resolution(t.runs, t.expected_units, t.exceptions, UNIT)


@query("c02_session_summary", RX + RES + """SELECT subject, session, 'raw' AS section, suffix AS name, count(*) AS n FROM runs GROUP BY ALL
  UNION ALL SELECT subject, session, 'resolution', status, count(*) FROM resolution GROUP BY ALL
  UNION ALL SELECT subject, session, 'derivatives', l_returnflag, count(*) FROM lineitem JOIN runs ON l_orderkey = run_id GROUP BY ALL""")
def _(t):
    der = t.lineitem.join(t.runs, F.col("l_orderkey") == F.col("run_id"))
    return C.summary_sections({"raw": (t.runs, "suffix"), "resolution": (_res(t), "status"), "derivatives": (der, "l_returnflag")})


@query("c03_resolution", RX + RES + "SELECT * FROM resolution")
def _(t):
    return _res(t)


@query("c04_resolution_report", RX + RES + """SELECT *, CASE status WHEN 'missing' THEN 0 WHEN 'surplus' THEN 1 WHEN 'excepted' THEN 2 ELSE 3 END AS severity
  FROM resolution WHERE subject IN ('03', '07', '21') AND (status IN ('missing', 'surplus') OR (status = 'excepted' AND disposition = 'pending'))""")
def _(t):
    return C.resolution_report(_res(t), subjects=["sub-03", "07", "21"])


@query("c04_resolution_counts", RX + RES + """SELECT CASE WHEN disposition IS NULL THEN status ELSE status || '-' || disposition END AS state, count(*) AS n
  FROM resolution GROUP BY ALL""")
def _(t):
    return C.resolution_counts(_res(t))


UNITS = "WITH units AS (SELECT printf('%02d', s_suppkey % 20) AS subject, printf('%02d', s_suppkey % 12 + 1) AS session, n_name AS task, n_regionkey AS dataset FROM supplier JOIN nation ON s_nationkey = n_nationkey) "


def _units(t):
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        pad2(F.col("s_suppkey") % 20).alias("subject"), pad2(F.col("s_suppkey") % 12 + 1).alias("session"),
        F.col("n_name").alias("task"), F.col("n_regionkey").alias("dataset"))


@query("c05_expectations_for_task", UNITS + """SELECT dataset, count(DISTINCT subject) AS n_subjects, list_sort(list(DISTINCT session)) AS sessions
  FROM units WHERE task = 'NATION_3' GROUP BY dataset""")
def _(t):
    return C.expectations_for_task(_units(t), "NATION_3", ["dataset"])


@query("c05_expectations_for_session_type", UNITS + """SELECT dataset, task, count(*) AS n_units FROM units WHERE (subject, session) IN
  (SELECT (printf('%02d', o_custkey % 20), printf('%02d', month(o_orderdate))) FROM orders WHERE o_orderstatus = 'P') GROUP BY ALL""")
def _(t):
    s = t.orders.select(pad2(F.col("o_custkey") % 20).alias("subject"), pad2(F.month("o_orderdate")).alias("session"),
                        F.col("o_orderstatus").alias("session_type"))
    return C.expectations_for_session_type(_units(t), s, "P", ["dataset", "task"])


@query("c05_expectations_overview", UNITS + """SELECT count(DISTINCT task) AS n_tasks, count(DISTINCT subject) AS n_subjects,
  count(DISTINCT session) AS n_sessions, count(*) AS n_units FROM units""")
def _(t):
    return C.expectations_overview(_units(t))


@query("c06_validation_report", """WITH r AS (SELECT printf('%02d', doc_id % 20) AS subject, doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'pass'
  WHEN quality = 1 THEN 'warn' ELSE 'fail' END AS status FROM labels) SELECT *, CASE status WHEN 'fail' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END AS severity FROM r
  WHERE status <> 'pass'""")
def _(t):
    status = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "pass").when(F.col("quality") == 1, "warn").otherwise("fail")
    r = t.labels.select(pad2(F.col("doc_id") % 20).alias("subject"), F.lit("01").alias("session"), "doc_id", status.alias("status"))
    return C.validation_report(r).drop("session")


PRESENCE = """SELECT 'file_presence' AS check_name, subject, session, task, CAST(NULL AS INTEGER) AS run,
  CASE WHEN n < runs_min THEN 'fail' WHEN n > runs_max THEN 'warn' ELSE 'pass' END AS status, runs_min || '-' || runs_max AS expected, CAST(n AS VARCHAR) AS actual
  FROM (SELECT e.*, (SELECT count(*) FROM runs r WHERE r.subject = e.subject AND r.session = e.session AND r.task = e.task AND suffix = 'bold') AS n FROM expected_units e)"""


def _presence(t):
    return C.check_file_presence(t.runs.where("suffix = 'bold'"), t.expected_units)


@query("c08_file_presence", RX + PRESENCE)
def _(t):
    return _presence(t)


@query("c09_total_runs", RX + """, e AS (SELECT subject, task, CAST(sum(runs_max) AS BIGINT) AS total FROM expected_units GROUP BY ALL), n AS
  (SELECT subject, task, count(*) AS n FROM runs GROUP BY ALL) SELECT 'total_runs' AS check_name, subject, CAST(NULL AS VARCHAR) AS session, task, CAST(NULL AS INTEGER) AS run,
  CASE WHEN coalesce(n, 0) = total THEN 'pass' ELSE 'fail' END AS status, CAST(total AS VARCHAR) AS expected, CAST(coalesce(n, 0) AS VARCHAR) AS actual
  FROM e LEFT JOIN n USING (subject, task)""")
def _(t):
    return C.check_total_runs(t.runs, t.expected_units.groupBy("subject", "task").agg(F.sum("runs_max").alias("total")))


VOLS = """, v(task, vol_min, vol_max) AS (VALUES ('encoding', 100, 300), ('retrieval', 50, 450), ('math', 200, 200)),
  i AS (SELECT r.*, n_volumes AS nt, vol_min, vol_max FROM runs r LEFT JOIN v USING (task) WHERE n_volumes IS NOT NULL) """
VOLUMES = """SELECT 'volume_count' AS check_name, subject, session, task, run, 'fail' AS status, '96x96x60' AS expected, nx || 'x' || ny || 'x' || nz AS actual FROM i WHERE nx <> 96
  UNION ALL SELECT 'volume_count', subject, session, task, run, 'fail', '1', CAST(nt AS VARCHAR) FROM i WHERE suffix = 'sbref' AND nt <> 1
  UNION ALL SELECT 'volume_count', subject, session, task, run, CASE WHEN nt BETWEEN vol_min AND vol_max THEN 'pass' ELSE 'fail' END,
  CASE WHEN vol_min = vol_max THEN CAST(vol_min AS VARCHAR) ELSE vol_min || '-' || vol_max END, CAST(nt AS VARCHAR) FROM i WHERE suffix = 'bold' AND vol_min IS NOT NULL"""


def _volumes(t):
    v = t.spark.createDataFrame([("encoding", 100, 300), ("retrieval", 50, 450), ("math", 200, 200)], "task string, vol_min int, vol_max int")
    return C.check_volumes(t.runs.where("n_volumes is not null").withColumn("nt", F.col("n_volumes")), v)


@query("c10_volume_count", R + VOLS + VOLUMES)
def _(t):
    return _volumes(t)


EVP = """SELECT 'events_presence' AS check_name, subject, session, task, run, CASE WHEN hit THEN 'pass' ELSE 'fail' END AS status, '1' AS expected,
  CASE WHEN hit THEN '1' ELSE '0' END AS actual FROM (SELECT r.*, EXISTS (SELECT 1 FROM event_files e WHERE e.run_id = r.run_id AND e.run IS NOT DISTINCT FROM r.run) AS hit
  FROM runs r WHERE suffix = 'bold')"""


def _presence_of_events(t):
    return C.check_events_presence(t.runs.where("suffix = 'bold'"), t.event_files, ["run_id"])


@query("c11_events_presence", RE + EVP)
def _(t):
    return _presence_of_events(t)


@query("c12_events_row_count", RE + """, x(task, rows_min, rows_max) AS (VALUES ('encoding', 4, 4), ('movie', 2, 5)) SELECT 'events_row_count' AS check_name, subject, session, task, run,
  CASE WHEN n_rows BETWEEN rows_min AND rows_max THEN 'pass' ELSE 'fail' END AS status, rows_min || '-' || rows_max AS expected, CAST(n_rows AS VARCHAR) AS actual
  FROM event_files JOIN x USING (task)""")
def _(t):
    x = t.spark.createDataFrame([("encoding", 4, 4), ("movie", 2, 5)], "task string, rows_min int, rows_max int")
    return C.check_row_counts(t.event_files, x)


@query("c13_events_columns", """WITH e AS (SELECT event_id, event_type AS task, list_distinct(list_concat(json_keys(props), [CASE WHEN event_id % 3 = 0 THEN 'onset' ELSE 'extra' END])) AS cols
  FROM events), d AS (SELECT *, CASE WHEN task = 'click' THEN ['k'] ELSE ['k', 'onset'] END AS want FROM e WHERE task IN ('click', 'view', 'error')),
  c AS (SELECT event_id, task, len(list_filter(want, lambda x: NOT list_contains(cols, x))) AS n_missing, len(list_filter(cols, lambda x: NOT list_contains(want, x))) AS n_extra FROM d)
  SELECT *, CASE WHEN n_missing > 0 THEN 'fail' WHEN n_extra > 0 THEN 'warn' ELSE 'pass' END AS status FROM c""")
def _(t):
    keys = F.json_object_keys("props")
    e = t.events.select("event_id", F.col("event_type").alias("task"), F.array_distinct(F.concat(keys, F.array(
        F.when(F.col("event_id") % 3 == 0, "onset").otherwise("extra")))).alias("columns"))
    want = t.spark.createDataFrame([("click", ["k"]), ("view", ["k", "onset"]), ("error", ["k", "onset"])], "task string, expected_columns array<string>")
    return C.check_columns(e, want).select("event_id", "task", F.col("n_missing").cast("long").alias("n_missing"), F.col("n_extra").cast("long").alias("n_extra"), "status")


TIMING = """SELECT 'events_timing' AS check_name, subject, session, task, run, 'warn' AS status, 'within the scan' AS expected, 'onset' AS actual FROM event_files WHERE onset_min < 0
  UNION ALL SELECT 'events_timing', subject, session, task, run, CASE WHEN o > tr THEN 'fail' WHEN o > 0 THEN 'warn' ELSE 'pass' END, 'within the scan', 'end' FROM (
  SELECT e.*, coalesce(r.tr, 1.5e0) AS tr, coalesce(end_max, onset_max) - n_volumes * coalesce(r.tr, 1.5e0) AS o FROM event_files e JOIN runs r ON e.run_id = r.run_id AND e.run IS NOT DISTINCT FROM r.run
  AND r.suffix = 'bold') WHERE o IS NOT NULL"""


def _timing(t):
    return C.check_timing(t.event_files, t.runs.where("suffix = 'bold'"), ["run_id"])


@query("c14_events_timing", RE + TIMING)
def _(t):
    return _timing(t)


ABSENT = "SELECT '{0}' AS check_name, subject, session, task, run, '{1}' AS status, '{2}' AS expected, 'none' AS actual FROM runs r WHERE suffix = 'bold' AND NOT EXISTS ({3})"
SBREF = ABSENT.format("sbref_presence", "warn", "sbref", "SELECT 1 FROM runs s WHERE s.suffix = 'sbref' AND s.subject = r.subject AND s.session = r.session AND s.task = r.task AND s.run IS NOT DISTINCT FROM r.run")
SIDECAR = ABSENT.format("json_sidecar", "fail", "sidecar", "SELECT 1 FROM runs s JOIN lineitem ON l_orderkey = s.run_id AND l_linestatus = 'O' WHERE replace(s.path, '.nii.gz', '.json') = replace(r.path, '.nii.gz', '.json')")


def _sbref(t):
    return C.missing_companions(t.runs.where("suffix = 'bold'"), t.runs.where("suffix = 'sbref'"), "sbref_presence", "warn", "sbref", KEYS)


def _sidecar(t):
    side = F.regexp_replace("path", r"\.nii\.gz$", ".json").alias("json_path")
    listed = t.runs.join(t.lineitem.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("run_id")), "run_id", "left_semi").select(side)
    return C.missing_companions(t.runs.where("suffix = 'bold'").withColumn("json_path", side), listed, "json_sidecar", "fail", "sidecar", ["json_path"], ())


@query("c15_sbref_presence", R + SBREF)
def _(t):
    return _sbref(t)


@query("c15_json_sidecar", R + SIDECAR)
def _(t):
    return _sidecar(t)


REC = """rec AS (SELECT CAST(user_id AS VARCHAR) AS subject, printf('%02d', 4 + (day(ts) - 1) % 15) AS session, event_type AS recording FROM events) """
RECMISS = """SELECT '{0}' AS check_name, subject, session, CAST(NULL AS VARCHAR) AS task, CAST(NULL AS INTEGER) AS run, 'warn' AS status, r AS expected, 'none' AS actual FROM
  (SELECT DISTINCT subject, session FROM rec WHERE recording = 'click' AND session <> '08') s, (SELECT unnest([{1}]) AS r) k
  WHERE NOT EXISTS (SELECT 1 FROM rec x WHERE x.subject = s.subject AND x.session = s.session AND x.recording = r)"""


def _rec(t):
    return t.events.select(F.col("user_id").cast("string").alias("subject"), pad2(F.lit(4) + (F.dayofmonth("ts") - 1) % 15).alias("session"),
                           F.col("event_type").alias("recording"))


@query("c16_physio_presence", "WITH " + REC + RECMISS.format("physio_presence", "'view', 'purchase', 'signup'"))
def _(t):
    return C.check_recordings(_rec(t).where("recording = 'click'"), _rec(t), ["view", "purchase", "signup"], ["08"], "physio_presence")


@query("c16_eyetracking_presence", "WITH " + REC + RECMISS.format("eyetracking_presence", "'error'"))
def _(t):
    return C.check_recordings(_rec(t).where("recording = 'click'"), _rec(t), ["error"], ["08"], "eyetracking_presence")


@query("c17_derivative_coverage", """SELECT 'derivative_coverage' AS check_name, CAST(c_custkey AS VARCHAR) AS subject, CAST(NULL AS VARCHAR) AS session, CAST(NULL AS VARCHAR) AS task,
  CAST(NULL AS INTEGER) AS run, 'warn' AS status, s AS expected, 'none' AS actual FROM customer, (SELECT unnest(['F', 'O', 'P']) AS s)
  WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = s)""")
def _(t):
    return C.check_derivative_coverage(t.customer.select(F.col("c_custkey").cast("string").alias("subject")),
                                       t.orders.select(F.col("o_custkey").cast("string").alias("subject"), F.col("o_orderstatus").alias("name")), ["F", "O", "P"])


METADATA = """SELECT 'session_metadata' AS check_name, subject, session, CAST(NULL AS VARCHAR) AS task, CAST(NULL AS INTEGER) AS run, 'warn' AS status, 'metadata row' AS expected, 'none' AS actual
  FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS subject, session FROM runs) r WHERE NOT EXISTS (SELECT 1 FROM runs x WHERE CAST(x.o_custkey AS VARCHAR) = r.subject AND x.session = r.session AND x.suffix = 'sbref')"""


def _metadata(t):
    s = t.runs.withColumn("subject", F.col("o_custkey").cast("string"))
    return C.check_session_metadata(s, s.where("suffix = 'sbref'"))


@query("c17_session_metadata", RX + METADATA)
def _(t):
    return _metadata(t)


ALL = f"""all_checks AS ({PRESENCE} UNION ALL {VOLUMES} UNION ALL {EVP} UNION ALL {TIMING} UNION ALL {SBREF} UNION ALL {SIDECAR} UNION ALL {METADATA})"""


def _all(t):
    return C.union_results([_presence(t), _volumes(t), _presence_of_events(t), _timing(t), _sbref(t), _sidecar(t), _metadata(t)])


@query("c18_all_checks", f"WITH {RUNS}, {EVENT_FILES}, {EXPECTED} {VOLS}, {ALL} SELECT * FROM all_checks")
def _(t):
    return _all(t)


@query("c07_validation_counts", f"WITH {RUNS}, {EVENT_FILES}, {EXPECTED} {VOLS}, {ALL} SELECT check_name, status, count(*) AS n FROM all_checks GROUP BY ALL")
def _(t):
    return C.result_counts(_all(t))


@query("c19_overview", """SELECT 'all' AS section, 'rows' AS name, count(*) AS n FROM documents UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY lang
  UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source""")
def _(t):
    return C.overview(t.documents, ["lang", "source"])


@query("c20_task_matrix", R + """SELECT subject, session, count(*) FILTER (task = 'encoding') AS encoding, count(*) FILTER (task = 'retrieval') AS retrieval,
  count(*) FILTER (task = 'movie') AS movie, count(*) FILTER (task = 'rest') AS rest, count(*) FILTER (task = 'math') AS math FROM runs GROUP BY ALL""")
def _(t):
    return C.task_matrix(t.runs, ["encoding", "retrieval", "movie", "rest", "math"])


@query("c20_recording_coverage", "WITH " + REC + """, b AS (SELECT subject, session, count(*) AS n_bold FROM rec WHERE recording = 'click' GROUP BY ALL),
  r AS (SELECT subject, session, count(*) FILTER (recording = 'view') AS n_view, count(*) FILTER (recording = 'error') AS n_error FROM rec GROUP BY ALL)
  SELECT subject, session, n_bold, coalesce(n_view, 0) AS n_view, coalesce(n_error, 0) AS n_error FROM b LEFT JOIN r USING (subject, session)""")
def _(t):
    return C.recording_coverage(_rec(t).where("recording = 'click'"), _rec(t), ["view", "error"])


@query("c20_typical_row_count", RE + """SELECT subject, session, task, count(*) AS n_files, list_sort(list(n_rows))[count(*) // 2 + 1] AS typical FROM event_files GROUP BY ALL""")
def _(t):
    return C.typical_row_count(t.event_files, KEYS)


@query("c21_conversion_counts", """SELECT lang, source, count(*) AS n_source, count(l.doc_id) AS n_converted, count(*) - count(l.doc_id) AS n_pending
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL""")
def _(t):
    return C.conversion_counts(t.documents, t.labels, "doc_id", ["lang", "source"])


@query("c21_pending_report", """SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS position FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(t):
    return C.pending_report(t.documents, t.labels, "doc_id", ["lang", "source"])


@query("c22_truncated_runs", R + """SELECT path, n_volumes, CASE WHEN n_volumes IS NULL THEN 'unreadable' ELSE 'truncated' END AS problem FROM runs
  WHERE n_volumes IS NULL OR n_volumes < 40""")
def _(t):
    return C.truncated_runs(t.runs, 40).select("path", "n_volumes", "problem")


FOLD = """, folders AS (SELECT subject, CASE WHEN run_id % 2 = 0 THEN 'Series_' || printf('%02d', run_id) ELSE 'Series_' || run_id END AS folder, count(*) AS n_files
  FROM lineitem JOIN runs ON l_orderkey = run_id WHERE run_id < 50 OR run_id % 4 <> 0 GROUP BY ALL), s AS (SELECT *, CAST(n_volumes % 6 AS BIGINT) AS nv FROM runs WHERE n_volumes IS NOT NULL) """


@query("c23_series_alignment", R + FOLD + """SELECT run_id, s.subject, n_files, CASE WHEN n_files IS NULL THEN 'missing_source' ELSE 'volume_mismatch' END AS category FROM (
  SELECT s.*, coalesce(a.n_files, b.n_files) AS n_files FROM s LEFT JOIN folders a ON a.subject = s.subject AND a.folder = 'Series_' || printf('%02d', run_id)
  LEFT JOIN folders b ON b.subject = s.subject AND b.folder = 'Series_' || run_id) s WHERE n_files IS NULL OR n_files <> nv""")
def _(t):
    n, two = F.col("run_id").cast("string"), pad2("run_id")
    folders = (t.lineitem.join(t.runs, F.col("l_orderkey") == F.col("run_id")).where("run_id < 50 or run_id % 4 <> 0")
               .groupBy("subject", F.concat(F.lit("Series_"), F.when(F.col("run_id") % 2 == 0, two).otherwise(n)).alias("folder"))
               .agg(F.count("*").alias("n_files")))
    side = t.runs.where("n_volumes is not null").select("run_id", "subject", F.col("run_id").alias("series_number"),
                                                        (F.col("n_volumes") % 6).cast("long").alias("n_volumes"))
    return C.series_alignment(side, folders).select("run_id", "subject", "n_files", "category")


@query("c24_mixed_coverage", R + """SELECT subject, session, task, count(*) AS n_runs, count(n_volumes) AS n_with FROM runs GROUP BY ALL HAVING count(n_volumes) BETWEEN 1 AND count(*) - 1""")
def _(t):
    return C.mixed_coverage(t.runs, F.col("n_volumes").isNotNull(), KEYS)


@query("c25_events_in_neither", R + """SELECT run_id, subject, session, task, 'info' AS level FROM runs WHERE suffix = 'bold' AND task IN ('encoding', 'movie')
  AND run_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') AND run_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')""")
def _(t):
    k = F.col("l_orderkey").alias("run_id")
    return C.events_in_neither(t.runs.where("suffix = 'bold'"), t.lineitem.where("l_returnflag = 'A'").select(k),
                               t.lineitem.where("l_linestatus = 'O'").select(k), "run_id", ["encoding", "movie"]).select(
        "run_id", "subject", "session", "task", "level")


@query("c25_session_rollup", R + """SELECT subject, session, count(*) AS n_issues FROM runs WHERE suffix = 'bold' AND task IN ('encoding', 'movie')
  AND run_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') GROUP BY ALL""")
def _(t):
    k = t.lineitem.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("run_id"))
    return C.events_in_neither(t.runs.where("suffix = 'bold'"), k, k, "run_id", ["encoding", "movie"]).groupBy("subject", "session").agg(F.count("*").alias("n_issues"))


@query("c26_duplicate_protocols", """SELECT l_suppkey, l_returnflag, l_linenumber, count(*) AS n_series, min(l_orderkey) AS first_series, max(l_orderkey) AS last_series
  FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def _(t):
    return C.duplicate_protocols(t.lineitem.withColumn("series_number", F.col("l_orderkey")), ["l_suppkey", "l_returnflag", "l_linenumber"])


@query("c26_truncated_series", "SELECT l_orderkey, l_partkey, l_quantity, 'truncated' AS problem FROM lineitem WHERE l_quantity < 5")
def _(t):
    return C.truncated_runs(t.lineitem, 5, "l_quantity").select("l_orderkey", "l_partkey", "l_quantity", "problem")


FMAP = """WITH s AS (SELECT user_id, event_id AS series_number, CASE WHEN event_type = 'click' THEN 'ap' ELSE 'pa' END AS direction,
  CASE WHEN user_id % 3 = 0 THEN CASE WHEN event_id % 5 = 0 THEN 'encoding' WHEN event_id % 5 = 1 THEN 'retrieval' ELSE '' END ELSE '' END AS suffix
  FROM events),
  p AS (SELECT user_id, bool_or(suffix <> '') AS bs, count(*) FILTER (direction = 'ap') AS na, count(*) FILTER (direction = 'pa') AS np FROM s GROUP BY 1),
  named AS (SELECT user_id, suffix AS pair, count(*) FILTER (direction = 'ap') AS a, count(*) FILTER (direction = 'pa') AS b,
  min(series_number) FILTER (direction = 'ap') AS ap, min(series_number) FILTER (direction = 'pa') AS pa FROM s JOIN p USING (user_id) WHERE bs AND suffix <> '' GROUP BY ALL),
  r AS (SELECT s.*, na, np, row_number() OVER (PARTITION BY user_id, direction ORDER BY series_number) AS rn FROM s JOIN p USING (user_id) WHERE NOT bs),
  o AS (SELECT user_id, na, np, rn, min(series_number) FILTER (direction = 'ap') AS ap, min(series_number) FILTER (direction = 'pa') AS pa FROM r GROUP BY ALL),
  u AS (SELECT *, (na = 2 AND np = 2) OR (na = 1 AND np = 1) AS regular FROM o), v AS (SELECT *, regular OR ((na > 2 OR np > 2) AND na >= 2 AND np >= 2) AS usable FROM u)
  SELECT user_id, 'series_description' AS strategy, pair, CASE WHEN a = 1 AND b = 1 THEN ap END AS ap, CASE WHEN a = 1 AND b = 1 THEN pa END AS pa, a > 1 OR b > 1 AS warning
  FROM named WHERE a > 1 OR b > 1 OR (a = 1 AND b = 1)
  UNION ALL SELECT DISTINCT user_id, 'series_number', CASE WHEN usable THEN CASE rn WHEN 1 THEN 'encoding' WHEN 2 THEN 'retrieval' ELSE 'pair ' || rn END END,
  CASE WHEN usable THEN ap END, CASE WHEN usable THEN pa END, NOT regular FROM v"""


@query("c27_fieldmap_pairs", FMAP)
def _(t):
    e = F.col("event_id") % 5
    s = t.events.select(
        "user_id", F.col("event_id").alias("series_number"), F.when(F.col("event_type") == "click", "ap").otherwise("pa").alias("direction"),
        F.when(F.col("user_id") % 3 == 0, F.when(e == 0, "encoding").when(e == 1, "retrieval")).alias("suffix"))
    return C.fieldmap_pairs(s, "user_id")


# Processing status: orders are the runs, order lines are the outputs, return flags are the step markers.
STEPS = [("convert", "A", None, False), ("clean", "N", None, True), ("fit", "R", "trial", False), ("series", "R", "movie", False)]
EDGES = [("clean", "convert"), ("fit", "convert"), ("fit", "clean"), ("series", "clean")]
STEP_SQL = """, steps(step, marker, stream, sib) AS (VALUES ('convert', 'A', NULL, false), ('clean', 'N', NULL, true), ('fit', 'R', 'trial', false), ('series', 'R', 'movie', false)),
  edges(step, needs) AS (VALUES ('clean', 'convert'), ('fit', 'convert'), ('fit', 'clean'), ('series', 'clean')),
  rr AS (SELECT run_id, CAST(o_custkey AS VARCHAR) AS subject, CAST(year(o_orderdate) AS VARCHAR) AS session, CASE WHEN task IN ('encoding', 'retrieval') THEN 'trial' WHEN task = 'movie' THEN 'movie' END AS stream FROM runs),
  outs AS (SELECT l_orderkey AS run_id, l_returnflag AS marker, bool_or(l_quantity > 2) AS s FROM lineitem GROUP BY ALL),
  want AS (SELECT rr.*, step, marker, sib FROM rr JOIN steps ON steps.stream IS NULL OR steps.stream = rr.stream),
  comp0 AS (SELECT subject, session, step, count(*) AS expected, count(s) AS found, count(*) FILTER (sib AND NOT s) AS n_incomplete FROM want LEFT JOIN outs USING (run_id, marker) GROUP BY ALL),
  comp AS (SELECT *, CASE WHEN n_incomplete > 0 THEN 'error' WHEN expected = 0 THEN 'skipped' WHEN found = 0 THEN 'missing' WHEN found < expected THEN 'partial' ELSE 'complete' END AS status FROM comp0),
  tab AS (SELECT g.subject, g.session, g.step, coalesce(expected, 0) AS expected, coalesce(found, 0) AS found, coalesce(status, 'skipped') AS status
  FROM (SELECT * FROM (SELECT DISTINCT subject, session FROM rr), (SELECT step FROM steps)) g LEFT JOIN comp c ON g.subject = c.subject AND g.session = c.session AND g.step = c.step) """


def _status_inputs(t):
    runs = t.runs.select("run_id", F.col("o_custkey").cast("string").alias("subject"), F.year("o_orderdate").cast("string").alias("session"),
                         F.when(F.col("task").isin("encoding", "retrieval"), "trial").when(F.col("task") == "movie", "movie").alias("stream"))
    outputs = t.lineitem.select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("marker"), (F.col("l_quantity") > 2).alias("has_sibling"))
    return runs, outputs, STEPS


def _table(t):
    runs, outputs, steps = _status_inputs(t)
    return S.status_table(runs, S.step_completeness(runs, outputs, steps), steps)


@query("p01_state_from_counts", R + """, n AS (SELECT l_orderkey, count(*) AS found, max(l_linenumber) - 2 AS e FROM lineitem GROUP BY 1), m AS (SELECT l_orderkey, CAST(greatest(e, 0) AS BIGINT) AS expected, CASE WHEN l_orderkey % 6 = 0 THEN 0 ELSE found END AS found FROM n)
  SELECT *, CASE WHEN expected = 0 THEN 'skipped' WHEN found = 0 THEN 'missing' WHEN found < expected THEN 'partial' ELSE 'complete' END AS status,
  CASE WHEN found > expected AND expected > 0 THEN 'Found ' || found || ' outputs; only ' || expected || ' expected.' END AS note FROM m""")
def _(t):
    n = t.lineitem.groupBy("l_orderkey").agg(F.greatest(F.max("l_linenumber") - 2, F.lit(0)).cast("long").alias("expected"), F.count("*").alias("found"))
    return S.with_state(n.withColumn("found", F.when(F.col("l_orderkey") % 6 == 0, F.lit(0).cast("long")).otherwise(F.col("found"))))


@query("p02_step_completeness", R + STEP_SQL + "SELECT * FROM comp")
def _(t):
    return S.step_completeness(*_status_inputs(t)).drop("note")


@query("p02_missing_details", R + STEP_SQL + """SELECT subject, session, step, run_id, count(*) OVER (PARTITION BY subject, session, step) AS n_missing FROM want ANTI JOIN outs USING (run_id, marker)""")
def _(t):
    return S.missing_details(*_status_inputs(t))


@query("p03_status_table", R + STEP_SQL + "SELECT * FROM tab")
def _(t):
    return _table(t)


@query("p04_runnable", R + STEP_SQL + """SELECT subject, session, step FROM tab a WHERE status NOT IN ('complete', 'skipped') AND NOT EXISTS (
  SELECT 1 FROM edges e JOIN tab b ON b.step = e.needs WHERE e.step = a.step AND b.subject = a.subject AND b.session = a.session AND b.status <> 'complete')""")
def _(t):
    return S.runnable(_table(t), t.spark.createDataFrame(EDGES, "step string, needs string"))


@query("p05_status_matrix", R + STEP_SQL + """SELECT step, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'partial') AS "partial",
  count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'error') AS error FROM tab GROUP BY step""")
def _(t):
    return S.status_matrix(_table(t))
