"""Study-shaped views over the test tables, once in Spark and once as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import pad2


def trials(t):
    e = F.col("event_id")
    return t.events.select(
        e.alias("trial_id"), pad2(F.col("user_id") % 20).alias("subject"),
        pad2(F.lit(4) + (F.dayofmonth("ts") - 1) % 15).alias("session"),
        pad2(F.floor(e / 5) % 3 + 1).alias("run"),
        F.when(e % 11 == 0, "rest").otherwise(F.col("event_type")).alias("trial_type"),
        F.col("event_type").alias("task"), "ts", (F.col("value") / 100).alias("resp_RT"),
        (e % 3 + 1).cast("int").alias("enCon"), (e % 2 + 1).cast("int").alias("reCon"),
        (e % 400).alias("pairId"), (F.floor(e / 2) % 2 + 1).cast("int").alias("correct_resp"),
        F.when(e % 17 != 0, ((e * 7 + F.col("user_id")) % 4 + 1)).cast("int").alias("resp"),
        F.when(e % 13 != 0, ((((e * 7 + F.col("user_id")) % 4 + 1) <= 2) == (F.floor(e / 2) % 2 == 0)).cast("double"))
        .alias("trial_accuracy"))


VIEWS = {"trials": trials}

TRIALS = """trials AS (SELECT event_id AS trial_id, printf('%02d', user_id % 20) AS subject,
  printf('%02d', 4 + (day(ts) - 1) % 15) AS session, printf('%02d', (event_id // 5) % 3 + 1) AS run,
  CASE WHEN event_id % 11 = 0 THEN 'rest' ELSE event_type END AS trial_type, event_type AS task, ts,
  value / 100 AS resp_RT, CAST(event_id % 3 + 1 AS INTEGER) AS enCon, CAST(event_id % 2 + 1 AS INTEGER) AS reCon,
  event_id % 400 AS pairId, CAST((event_id // 2) % 2 + 1 AS INTEGER) AS correct_resp,
  CASE WHEN event_id % 17 <> 0 THEN CAST((event_id * 7 + user_id) % 4 + 1 AS INTEGER) END AS resp,
  CASE WHEN event_id % 13 <> 0 THEN CAST((((event_id * 7 + user_id) % 4 + 1) <= 2) = ((event_id // 2) % 2 = 0) AS DOUBLE) END AS trial_accuracy
  FROM events)"""


def _task5(c):
    return (F.when(c == "1", "encoding").when(c == "2", "retrieval").when(c == "3", "movie").when(c == "4", "rest").otherwise("math"))


def runs(t):
    """Scan runs from orders."""
    k = F.col("o_orderkey")
    r = t.orders.select(
        k.alias("run_id"), pad2(F.col("o_custkey") % 20).alias("subject"), pad2(F.month("o_orderdate")).alias("session"),
        _task5(F.substring("o_orderpriority", 1, 1)).alias("task"), F.when(k % 9 != 0, k % 6 + 1).cast("int").alias("run"),
        F.when(F.col("o_orderstatus") == "P", "sbref").otherwise("bold").alias("suffix"),
        F.when(k % 23 != 0, F.floor(F.col("o_totalprice") / 1000)).cast("int").alias("n_volumes"),
        F.when(k % 7 != 0, F.lit(1.5)).alias("tr"), (F.lit(96) + F.when(k % 50 == 0, 1).otherwise(0)).alias("nx"),
        F.lit(96).alias("ny"), F.lit(60).alias("nz"), "o_custkey", "o_orderdate")
    stem = F.concat(F.lit("sub-"), F.col("subject"), F.lit("_ses-"), F.col("session"), F.lit("_task-"), F.col("task"),
                    F.lit("_acq-"), F.col("run_id").cast("string"),
                    F.when(F.col("run").isNotNull(), F.concat(F.lit("_run-"), pad2("run"))).otherwise(""))
    r = r.withColumn("base", F.concat(F.lit("sub-"), F.col("subject"), F.lit("/ses-"), F.col("session"), F.lit("/func/"), stem))
    return r.withColumn("path", F.concat("base", F.lit("_"), F.col("suffix"), F.lit(".nii.gz")))


def event_files(t):
    """One row per event file from the order lines, with the keys of its run."""
    q = F.col("l_quantity")
    e = t.lineitem.where(F.col("l_orderkey") % 5 != 0).groupBy(F.col("l_orderkey").alias("run_id")).agg(
        F.count("*").alias("n_rows"), (F.min(q) - 3).alias("onset_min"), F.max(q * 6).alias("onset_max"),
        F.max(F.when(F.col("l_orderkey") % 8 != 0, q * 6 + F.col("l_tax") * 100)).alias("end_max"))
    return e.join(runs(t).select("run_id", "subject", "session", "task", "run"), "run_id")


def expected_units(t):
    i = F.col("id")
    return t.spark.range(1440).select(
        pad2(i % 24).alias("subject"), pad2(F.floor(i / 24) % 12 + 1).alias("session"),
        _task5((F.floor(i / 288) % 5 + 1).cast("string")).alias("task"),
        (i % 5 + 8).alias("runs_min"), (i % 5 + 12 + i % 3).alias("runs_max"))


def exceptions(t):
    i = F.col("id")
    return t.spark.range(1440).where(i % 5 == 0).select(
        pad2(i % 24).alias("subject"), pad2(F.floor(i / 24) % 12 + 1).alias("session"),
        _task5((F.floor(i / 288) % 5 + 1).cast("string")).alias("task"),
        F.when(i % 2 == 0, "accepted").otherwise("pending").alias("disposition"))


VIEWS.update(runs=runs, event_files=event_files, expected_units=expected_units, exceptions=exceptions)

_T5 = "CASE {0} WHEN '1' THEN 'encoding' WHEN '2' THEN 'retrieval' WHEN '3' THEN 'movie' WHEN '4' THEN 'rest' ELSE 'math' END"
RUNS = f"""runs0 AS (SELECT o_orderkey AS run_id, printf('%02d', o_custkey % 20) AS subject, printf('%02d', month(o_orderdate)) AS session,
  {_T5.format('substring(o_orderpriority, 1, 1)')} AS task, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderkey % 6 + 1 AS INTEGER) END AS run,
  CASE WHEN o_orderstatus = 'P' THEN 'sbref' ELSE 'bold' END AS suffix,
  CASE WHEN o_orderkey % 23 <> 0 THEN CAST(floor(o_totalprice / 1000) AS INTEGER) END AS n_volumes,
  CASE WHEN o_orderkey % 7 <> 0 THEN 1.5e0 END AS tr, 96 + CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS nx, 96 AS ny, 60 AS nz,
  o_custkey, o_orderdate FROM orders),
  runs AS (SELECT *, 'sub-' || subject || '/ses-' || session || '/func/sub-' || subject || '_ses-' || session || '_task-' || task || '_acq-' || run_id
  || CASE WHEN run IS NOT NULL THEN '_run-' || printf('%02d', run) ELSE '' END || '_' || suffix || '.nii.gz' AS path FROM runs0)"""
EVENT_FILES = """event_files AS (SELECT e.*, subject, session, task, run FROM (SELECT l_orderkey AS run_id, count(*) AS n_rows,
  min(l_quantity) - 3 AS onset_min, max(l_quantity * 6) AS onset_max, max(CASE WHEN l_orderkey % 8 <> 0 THEN l_quantity * 6 + l_tax * 100 END) AS end_max
  FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1) e JOIN runs USING (run_id))"""
EXPECTED = f"""expected_units AS (SELECT printf('%02d', i % 24) AS subject, printf('%02d', (i // 24) % 12 + 1) AS session,
  {_T5.format('CAST((i // 288) % 5 + 1 AS VARCHAR)')} AS task, i % 5 + 8 AS runs_min, i % 5 + 12 + i % 3 AS runs_max FROM range(1440) r(i)),
  exceptions AS (SELECT printf('%02d', i % 24) AS subject, printf('%02d', (i // 24) % 12 + 1) AS session,
  {_T5.format('CAST((i // 288) % 5 + 1 AS VARCHAR)')} AS task, CASE WHEN i % 2 = 0 THEN 'accepted' ELSE 'pending' END AS disposition
  FROM range(1440) r(i) WHERE i % 5 = 0)"""


def _k(c="props"):
    return F.get_json_object(c, "$.k").cast("long")


def volumes(t):
    """Motion confounds per scan volume from events; some displacements are missing."""
    e = F.col("event_id")
    return t.events.select(
        pad2(F.col("user_id") % 20).alias("subject"), pad2(F.lit(4) + (F.dayofmonth("ts") - 1) % 15).alias("session"), F.col("user_id").alias("acq"),
        e.alias("volume"), F.when(e % 29 != 0, F.col("value") / 97).alias("framewise_displacement"), _k().cast("double").alias("dvars"),
        (F.col("value") / 997).alias("rmsd")).withColumn(
        "run_key", F.concat(F.lit("sub-"), F.col("subject"), F.lit("_ses-"), F.col("session"), F.lit("_acq-"), F.col("acq").cast("string")))


def iqms(t):
    """Quality metrics per run, one record per event with its number as the run."""
    return t.events.select(F.col("event_id").alias("run_id"), pad2(F.col("user_id") % 20).alias("subject"),
                           F.col("value").alias("fd_mean"), F.when(F.col("event_id") % 19 != 0, _k().cast("double") * _k()).alias("tsnr"))


def decisions(t):
    """Latest review decision per run of `volumes`, from signups."""
    e = F.col("event_id")
    x = t.events.where("event_type = 'signup'").select(
        pad2(F.col("user_id") % 20).alias("subject"),
        F.concat(F.lit("sub-"), pad2(F.col("user_id") % 20), F.lit("_ses-"), pad2(F.lit(4) + (F.dayofmonth("ts") - 1) % 15), F.lit("_acq-"),
                 F.col("user_id").cast("string")).alias("run_key"),
        e.alias("at"), F.element_at(F.array(*[F.lit(d) for d in ("keep", "exclude", "investigate", "pending")]), (e % 4 + 1).cast("int")).alias("decision"),
        F.when(e % 3 == 0, " Auto-Stub ").when(e % 7 == 0, "").otherwise("Kim").alias("reviewer"), F.when(e % 5 != 0, e % 10 == 1).alias("automated"))
    last = x.groupBy("subject", "run_key").agg(F.max_by(F.struct("decision", "reviewer", "automated"), "at").alias("l"))
    return last.select("subject", "run_key", "l.*")


VIEWS.update(volumes=volumes, iqms=iqms, decisions=decisions)

VOLUMES = """volumes AS (SELECT *, 'sub-' || subject || '_ses-' || session || '_acq-' || acq AS run_key FROM (SELECT printf('%02d', user_id % 20) AS subject,
  printf('%02d', 4 + (day(ts) - 1) % 15) AS session, user_id AS acq, event_id AS volume, CASE WHEN event_id % 29 <> 0 THEN value / 97 END AS fd,
  CAST(json_extract(props, '$.k') AS DOUBLE) AS dvars, value / 997 AS rmsd FROM events))"""
IQMS = """iqms AS (SELECT event_id AS run_id, printf('%02d', user_id % 20) AS subject, value AS fd_mean,
  CASE WHEN event_id % 19 <> 0 THEN CAST(json_extract(props, '$.k') AS DOUBLE) * CAST(json_extract(props, '$.k') AS DOUBLE) END AS tsnr FROM events)"""
DECISIONS = """decisions AS (SELECT subject, run_key, decision, reviewer, automated FROM (SELECT printf('%02d', user_id % 20) AS subject,
  'sub-' || printf('%02d', user_id % 20) || '_ses-' || printf('%02d', 4 + (day(ts) - 1) % 15) || '_acq-' || user_id AS run_key, event_id,
  (['keep', 'exclude', 'investigate', 'pending'])[event_id % 4 + 1] AS decision, CASE WHEN event_id % 3 = 0 THEN ' Auto-Stub ' WHEN event_id % 7 = 0 THEN '' ELSE 'Kim' END AS reviewer,
  CASE WHEN event_id % 5 <> 0 THEN event_id % 10 = 1 END AS automated FROM events WHERE event_type = 'signup')
  QUALIFY row_number() OVER (PARTITION BY run_key ORDER BY event_id DESC) = 1)"""
SIGNED = """coalesce(NOT coalesce(automated, false) AND decision IN ('keep', 'exclude', 'investigate') AND lower(trim(coalesce(reviewer, ''))) NOT IN ('auto-stub', 'auto', 'automated', ''), false)"""


def listing(t):
    """File paths: for each run its image and the companions it has."""
    k = F.col("run_id")
    base = F.col("base")
    kinds = F.array_compact(F.array(
        F.struct(F.lit("image").alias("kind"), F.col("path").alias("p")),
        F.when(k % 3 != 0, F.struct(F.lit("sidecar").alias("kind"), F.concat(base, F.lit("_"), F.col("suffix"), F.lit(".json")).alias("p"))),
        F.when(k % 5 != 0, F.struct(F.lit("events").alias("kind"), F.concat(base, F.lit("_events.tsv")).alias("p"))),
        F.when(k % 4 != 0, F.struct(F.lit("physio").alias("kind"), F.concat(base, F.lit("_recording-pulse_physio.tsv.gz")).alias("p"))),
        F.when(k % 11 == 0, F.struct(F.lit("report").alias("kind"), F.concat(base, F.lit("_desc-qc_func.html")).alias("p")))))
    return (runs(t).select("run_id", base.alias("stem"), F.explode(kinds).alias("x")).select("run_id", "stem", "x.kind", F.col("x.p").alias("path")))


VIEWS.update(listing=listing)

LISTING = r"""listing0 AS (SELECT *, regexp_replace(path, '_(bold|sbref)\.nii\.gz$', '') AS stem FROM runs),
  listing AS (SELECT run_id, stem, 'image' AS kind, path FROM listing0 UNION ALL SELECT run_id, stem, 'sidecar', stem || '_' || suffix || '.json' FROM listing0 WHERE run_id % 3 <> 0
  UNION ALL SELECT run_id, stem, 'events', stem || '_events.tsv' FROM listing0 WHERE run_id % 5 <> 0 UNION ALL SELECT run_id, stem, 'physio', stem || '_recording-pulse_physio.tsv.gz' FROM listing0 WHERE run_id % 4 <> 0
  UNION ALL SELECT run_id, stem, 'report', stem || '_desc-qc_func.html' FROM listing0 WHERE run_id % 11 = 0)"""


def series(t):
    """A signal per region, subject, session and movie; positions count the events in order."""
    from ..functions.scan import id_block, row_index
    d = F.dayofmonth("ts") - 1
    x = t.events.select(
        F.when(F.col("event_type").isin("click", "view"), "A").otherwise("B").alias("roi"), pad2(F.col("user_id") % 4).alias("subject"),
        F.floor(d / 10).alias("session"), F.concat(F.lit("m"), (d % 10).cast("string")).alias("movie"), "event_id", "value",
        F.when(F.col("event_id") % 31 != 0, _k().cast("double")).alias("motion"))
    return row_index(x, ["roi", "subject", "session", "movie"], ["event_id"], id_block("event_id"), "t")


def user_series(t):
    """A signal per user; positions count the events in order."""
    from ..functions.scan import id_block, row_index
    return row_index(t.events.select("user_id", "event_id", "value"), ["user_id"], ["event_id"], id_block("event_id"), "t")


VIEWS.update(series=series, user_series=user_series)

SERIES = """series AS (SELECT *, row_number() OVER (PARTITION BY roi, subject, session, movie ORDER BY event_id) - 1 AS t FROM (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'A' ELSE 'B' END AS roi, printf('%02d', user_id % 4) AS subject,
  (day(ts) - 1) // 10 AS session, 'm' || ((day(ts) - 1) % 10) AS movie, event_id, value, CASE WHEN event_id % 31 <> 0 THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS motion FROM events))"""
USER_SERIES = "user_series AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS t FROM events)"


def patterns(t):
    """Presentations with a 64-component pattern, from embeddings."""
    from ..functions.scan import id_block, row_index
    v = F.col("vec_id")
    x = t.embeddings.select("vec_id", pad2(v % 3).alias("subject"), (F.floor(v / 3) % 5).alias("session"), (F.floor(v / 15) % 2).alias("run"),
                            F.col("label").cast("long").alias("item"), F.col("embedding").cast("array<double>").alias("vec"))
    return row_index(x, ["subject", "session", "run"], ["vec_id"], id_block("vec_id"), "pos")


def cells(t):
    """Similarity cells per region, data version, unit and item, from order lines."""
    k, u = F.col("l_orderkey") % 4, F.col("l_suppkey") % 6
    cell = F.when(k == 0, "within_same").when(k == 1, "within_diff").when(k == 2, "across_same").otherwise("across_diff")
    unit = F.when(k < 2, F.concat(F.lit("s"), u.cast("string"))).otherwise(F.concat(F.lit("s"), u.cast("string"), F.lit("+s"), ((u + 1) % 6).cast("string")))
    p = F.col("l_partkey")
    x = t.lineitem.select((p % 4).alias("roi"), F.col("l_linestatus").alias("version"), cell.alias("cell"), unit.alias("unit"), (p % 9).alias("item"),
                          F.when(p % 3 == 0, "mixed").otherwise("single-single").alias("context_match"), (F.col("l_extendedprice") / 105013).alias("x"), "l_linenumber")
    return x.groupBy("roi", "version", "cell", "unit", "item", "context_match").agg(F.avg("x").alias("r"), F.count("*").alias("n_pairs"), F.avg("l_linenumber").alias("n_voxels"))


VIEWS.update(patterns=patterns, cells=cells)

PATTERNS = """patterns AS (SELECT *, row_number() OVER (PARTITION BY subject, session, run ORDER BY vec_id) - 1 AS pos FROM (SELECT vec_id, printf('%02d', vec_id % 3) AS subject, (vec_id // 3) % 5 AS session, (vec_id // 15) % 2 AS run,
  CAST(label AS BIGINT) AS item, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)), un AS (SELECT *, list_transform(vec, lambda x: x - list_avg(vec)) AS c FROM patterns),
  up AS (SELECT * EXCLUDE c, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS u FROM un)"""
CELLS = """cells AS (SELECT l_partkey % 4 AS roi, l_linestatus AS version, CASE l_orderkey % 4 WHEN 0 THEN 'within_same' WHEN 1 THEN 'within_diff' WHEN 2 THEN 'across_same' ELSE 'across_diff' END AS cell,
  CASE WHEN l_orderkey % 4 < 2 THEN 's' || l_suppkey % 6 ELSE 's' || l_suppkey % 6 || '+s' || (l_suppkey % 6 + 1) % 6 END AS unit, l_partkey % 9 AS item, CASE WHEN l_partkey % 3 = 0 THEN 'mixed' ELSE 'single-single' END AS context_match,
  avg(l_extendedprice / 105013) AS r, count(*) AS n_pairs, avg(l_linenumber) AS n_voxels FROM lineitem GROUP BY ALL)"""
