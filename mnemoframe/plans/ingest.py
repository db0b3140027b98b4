"""Ingest and normalise (I)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.series import model_columns
from ..sources import files as S
from ..sources import inventory as N
from ..session import scratch
from ..sources import store
from ..sources.study import study_files, write_study
from .registry import query
from .views import LISTING, RUNS, TRIALS

W = f"WITH {TRIALS} "
L = f"WITH {RUNS}, {LISTING} "
ENT = ", ".join(f"nullif(regexp_extract(path, '(?:^|[_/]){k}-([^_/.]+)[^/]*$', 1), '') AS {n}" for n, k in S.ENTITIES.items())
SUF = r"nullif(regexp_extract(path, '_([a-zA-Z0-9]+)(?:\.[^/]*)?$', 1), '')"
EXT = r"CASE WHEN path LIKE '%.nii.gz' THEN '.nii.gz' WHEN path LIKE '%.tsv.gz' THEN '.tsv.gz' ELSE regexp_extract(path, '[^/](\.[^./]*)$', 1) END"


@query("i01_identity_from_path", W + """SELECT trial_id, CASE WHEN trial_id % 3 = 0 THEN subject ELSE '0' || trial_id % 10 END AS subject, session FROM trials""")
def _(t):
    k = F.col("trial_id")
    name = F.concat(F.lit("/data/x/"), F.when(k % 3 == 0, "beh").otherwise(F.concat(F.lit("sub-0"), (k % 10).cast("string"))),
                    F.lit("_ses-"), F.col("session"), F.lit("_task-TB2AFC_beh.tsv"))
    x = t.trials.withColumn("source_file", name).withColumn("session", F.lit("99"))
    x = t.trials.select("trial_id", "subject", F.lit("99").alias("session"), name.alias("source_file"))
    return S.identity_from_path(x).select("trial_id", "subject", "session")


def _study(t):
    """The trials as a study folder, a table per subject, session and task; click tables have no pairId, the others no resp."""
    name = F.concat(F.lit("sub-"), F.col("subject"), F.lit("/ses-"), F.col("session"), F.lit("/beh/sub-"), F.col("subject"), F.lit("_ses-"), F.col("session"), F.lit("_task-"), F.col("task"), F.lit("_beh.tsv"))
    x = t.trials.withColumn("trial_type", F.when(F.col("trial_id") % 19 != 0, F.col("trial_type"))).withColumn("source_file", name)
    root = scratch(t.spark, "study")
    write_study(x.where("task = 'click'").select("trial_id", "trial_type", "resp", F.lit("99").alias("session"), "source_file"), root, ["trial_id"])
    write_study(x.where("task <> 'click'").select("trial_id", "trial_type", "pairId", "source_file"), root, ["trial_id"])
    return root


TYPES = T.StructType([T.StructField("trial_id", T.LongType()), T.StructField("resp", T.IntegerType()), T.StructField("pairId", T.LongType())])


@query("i01_study_tables", W + "SELECT trial_id, subject, session, CASE WHEN trial_id % 19 <> 0 THEN trial_type END AS trial_type FROM trials")
def _(t):
    return S.read_tsv(t.spark, _study(t), TYPES).select("trial_id", "subject", "session", "trial_type")


@query("i03_study_stacked", W + """SELECT trial_id, trial_type, CASE WHEN task = 'click' THEN resp END AS resp, CASE WHEN task <> 'click' THEN pairId END AS pairId FROM (SELECT * REPLACE (CASE WHEN trial_id % 19 <> 0 THEN trial_type END AS trial_type) FROM trials)
  WHERE task IS NOT NULL AND (trial_type IS NULL OR trial_type <> 'rest')""")
def _(t):
    return S.stack_tables([S.read_tsv(t.spark, _study(t), TYPES).select("trial_id", "trial_type", "resp", "pairId")], drop_rest=True)


@query("i04_study_files", W + """SELECT DISTINCT 'sub-' || subject || '/ses-' || session || '/beh/sub-' || subject || '_ses-' || session || '_task-' || task || '_beh.tsv' AS path, subject, session, task, 'beh' AS suffix, 'beh' AS datatype, '.tsv' AS extension,
  CASE WHEN task = 'click' THEN 4 ELSE 3 END AS n_columns FROM trials WHERE subject IN ('03', '07', '11') AND session <> '08'""")
def _(t):
    found = study_files(t.spark, _study(t), F.col("file_subject").isin("03", "07", "11") & (F.col("file_session") != "08"))
    return found.select(F.regexp_extract("source_file", "(sub-[^/]*/.*)$", 1).alias("path"), *[F.col(f"file_{c}").alias(c) for c in ("subject", "session", "task", "suffix", "datatype", "extension")],
                        F.size(F.split("header", "\t")).alias("n_columns"))


@query("i04_study_subject", W + "SELECT trial_id, subject, session FROM trials WHERE subject IN ('03', '07') AND task = 'view'")
def _(t):
    return S.read_tsv(t.spark, _study(t), TYPES, F.col("file_subject").isin("03", "07") & (F.col("file_task") == "view")).select("trial_id", "subject", "session")


@query("i02_normalised_columns", W + """SELECT trial_id, subject, printf('%02d', CAST(run AS INTEGER)) AS run, printf('%02d', CAST(session AS INTEGER)) AS session FROM trials""")
def _(t):
    x = t.trials.select("trial_id", "subject", F.lit(5).alias("subj_num"), F.col("session").cast("double").alias("ses_num"), F.col("run").cast("int").alias("run_idx"))
    return S.normalise_columns(x)


@query("i03_stacked_tables", W + """SELECT trial_id, trial_type, CASE WHEN task = 'click' THEN resp END AS resp, CASE WHEN task <> 'click' THEN pairId END AS pairId FROM (SELECT * REPLACE (CASE WHEN trial_id % 19 <> 0 THEN trial_type END AS trial_type) FROM trials)
  WHERE task IS NOT NULL AND (trial_type IS NULL OR trial_type <> 'rest')""")
def _(t):
    x = t.trials.withColumn("trial_type", F.when(F.col("trial_id") % 19 != 0, F.col("trial_type")))
    return S.stack_tables([x.where("task = 'click'").select("trial_id", "trial_type", "resp"), x.where("task <> 'click'").select("trial_id", "trial_type", "pairId")], drop_rest=True)


@query("i04_found_files", """SELECT page_id, url FROM pages WHERE split_part(url, '/', 4) || split_part(url, '/', 3) IN (SELECT split_part(url, '/', 4) || split_part(url, '/', 3) FROM pages WHERE page_id % 7 = 0)""")
def _(t):
    k = {"lang": F.split("url", "/")[3], "host": F.split("url", "/")[2]}
    p = t.pages.withColumns(k)
    return S.find_files(p, p.where("page_id % 7 = 0"), ["lang", "host"]).select("page_id", "url")


@query("i05_entities", L + f"SELECT path, {ENT}, {SUF} AS suffix FROM listing")
def _(t):
    return S.with_entities(t.listing.select("path"))


@query("i06_extension_and_datatype", L + f"""SELECT path, {EXT} AS format, CASE WHEN split_part(p, '/', 1) IN ('anat', 'func', 'dwi', 'fmap', 'beh', 'perf') THEN split_part(p, '/', 1) ELSE 'unknown' END AS datatype
  FROM (SELECT path, CASE WHEN run_id % 6 = 0 THEN 'extra/' ELSE '' END || substr(path, 15) AS p FROM listing)""")
def _(t):
    rel = F.concat(F.when(F.col("run_id") % 6 == 0, "extra/").otherwise(""), F.expr("substr(path, 15)"))
    return t.listing.select("path", S.extension("path").alias("format"), S.datatype(rel).alias("datatype"))


@query("i07_run_key", W + """SELECT trial_id, 'sub-' || subject || '_ses-' || session || '_task-' || task || CASE WHEN trial_id % 4 = 0 THEN '' ELSE '_run-' || run END || '_bold' AS run_key FROM trials""")
def _(t):
    c = F.col
    return t.trials.select("trial_id", S.run_key(F.concat(F.lit("sub-"), c("subject")), F.concat(F.lit("ses-"), c("session")), F.concat(F.lit("task-"), c("task")),
                                                 F.when(c("trial_id") % 4 != 0, F.concat(F.lit("run-"), c("run"))), F.lit("bold")).alias("run_key"))


@query("i08_bare_label", W + "SELECT trial_id, subject AS label FROM trials")
def _(t):
    from ..operators.catalog import strip_label
    x = t.trials.withColumn("s", F.when(F.col("trial_id") % 2 == 0, F.concat(F.lit("sub-"), F.col("subject"))).otherwise(F.col("subject")))
    return x.select("trial_id", strip_label("s", "sub-").alias("label"))


@query("i09_metric_records", """SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CASE WHEN event_id % 2 = 1 THEN CAST(user_id AS DOUBLE) END AS snr, CAST(NULL AS DOUBLE) AS provenance FROM events""")
def _(t):
    extra = F.concat(F.lit(', "provenance": {"v": 1}, "snr": '), F.col("user_id").cast("string"), F.lit("}"))
    x = t.events.select("event_id", F.when(F.col("event_id") % 2 == 1, F.regexp_replace("props", r"\}$", "")).otherwise(F.col("props")).alias("p"), extra.alias("e"))
    x = x.withColumn("value", F.when(F.col("event_id") % 2 == 1, F.concat("p", "e")).otherwise(F.col("p")))
    return S.metric_table(x, ["event_id"], ["k", "snr", "provenance"])


@query("i10_confounds", """SELECT event_id, CASE WHEN event_id % 5 > 2 THEN CAST(event_id AS DOUBLE) END AS framewise_displacement, value AS dvars FROM events""")
def _(t):
    e = F.col("event_id")
    x = t.events.select("event_id", F.when(e % 5 == 0, "n/a").when(e % 5 == 1, "N/A").when(e % 5 == 2, "").otherwise(e.cast("string")).alias("framewise_displacement"),
                        F.col("value").alias("dvars"), "props")
    return S.null_missing(S.require_columns(x, ["event_id", "framewise_displacement", "dvars"]), ["framewise_displacement"])


@query("i11_confound_columns", "SELECT event_id, value AS cosine00, value * 2 AS cosine01, " + ", ".join(f"value + {i} AS a_comp_cor_{i:02d}" for i in range(6)) + " FROM events", {"cosine01": 4, **{f"a_comp_cor_{i:02d}": 4 for i in range(6)}})
def _(t):
    v = F.col("value")
    x = t.events.select("event_id", v.alias("cosine00"), (v * 2).alias("cosine01"), v.alias("trans_x"), *[(v + i).alias(f"a_comp_cor_{i:02d}") for i in range(8)])
    return x.select("event_id", *model_columns(x, prefixes=["cosine"], first={"a_comp_cor_": 6}))


@query("i12_run_catalog", L + """SELECT stem, min(path) FILTER (kind = 'physio') AS physio, min(path) FILTER (kind = 'image') AS image, min(path) FILTER (kind = 'events') AS events FROM listing GROUP BY stem HAVING min(path) FILTER (kind = 'physio') IS NOT NULL""")
def _(t):
    return N.run_catalog(t.listing, "physio", ["image", "events"])


@query("i13_manifest", """WITH s AS (SELECT 'p' || page_id % 150 AS path, page_id, length(url) AS size FROM pages), c AS (SELECT 'p' || page_id % 170 AS path, page_id, length(html) AS size FROM pages),
  a AS (SELECT path, arg_max(size, page_id) AS size FROM s GROUP BY 1), b AS (SELECT path, arg_max(size, page_id) AS size FROM c GROUP BY 1) SELECT * FROM a UNION ALL SELECT * FROM b WHERE path NOT IN (SELECT path FROM a)""")
def _(t):
    p = F.col("page_id")
    mk = lambda m, src: (F.concat(F.lit("p"), (p % m).cast("string")).alias("path"), "page_id", F.length(src).cast("long").alias("size"))
    return N.manifest(t.pages.select(*mk(150, "url")), t.pages.select(*mk(170, "html")), "page_id")


@query("i13_manifest_loads", """SELECT 'p' || page_id % 150 AS path, page_id % 15 AS folder, max(page_id) AS seen, arg_max(length(url), page_id) AS size FROM pages GROUP BY ALL""")
def _(t):
    """The manifest of all pages, loaded in halves, one of them twice and out of order."""
    p, root = F.col("page_id"), scratch(t.spark, "manifest")
    rows = t.pages.select(F.concat(F.lit("p"), (p % 150).cast("string")).alias("path"), (p % 15).alias("folder"), p.alias("seen"), F.length("url").cast("long").alias("size"))
    for half in (1, 0, 1):
        store.upsert(rows.where(F.col("seen") % 2 == half), root, ["path"], "folder", ["seen"])
    return store.stored(t.spark, root, rows)


@query("i14_event_metadata", """SELECT user_id, count(*) AS n_rows, min(o) AS onset_min, max(o) AS onset_max, min(d) AS duration_min, max(d) AS duration_max, max(o + d) AS end_max FROM (SELECT user_id, CASE WHEN event_id % 6 <> 0 THEN CAST(event_id AS DOUBLE) END AS o, value AS d FROM events) GROUP BY 1""", ("end_max",))
def _(t):
    x = t.events.select("user_id", F.when(F.col("event_id") % 6 == 0, "start").otherwise(F.col("event_id").cast("string")).alias("onset"), F.col("value").alias("duration"))
    return N.event_metadata(x, "user_id")


@query("i15_physio_metadata", """SELECT 'sub-' || user_id || '_n-' || event_id || '_recording-' || event_type || '_physio.tsv.gz' AS path, event_type AS recording, CAST(json_extract(props, '$.k') AS DOUBLE) AS sampling_rate, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS n_columns FROM events""")
def _(t):
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('{"SamplingFrequency": '), k, F.when(F.col("event_id") % 2 == 0, ', "Columns": ["a", "b"]}').otherwise("}"))
    s = lambda c: F.col(c).cast("string")
    path = F.concat(F.lit("sub-"), s("user_id"), F.lit("_n-"), s("event_id"), F.lit("_recording-"), F.col("event_type"), F.lit("_physio.json"))
    return N.physio_metadata(t.events.select(path.alias("path"), text.alias("value")))


@query("i16_category_counts", """SELECT lang, CASE WHEN source IN ('src1', 'src2', 'src3') THEN source ELSE 'other' END AS category, count(*) AS n_files FROM documents GROUP BY ALL""")
def _(t):
    return N.category_counts(t.documents, ["lang"], "source", ["src1", "src2", "src3"])


@query("i16_series_counts", "SELECT l_suppkey, count(DISTINCT l_orderkey) AS n_series, count(*) AS n_files FROM lineitem GROUP BY 1")
def _(t):
    return N.series_counts(t.lineitem, ["l_suppkey"], "l_orderkey")


@query("i17_derivative_catalog", L + rf"""SELECT path, split_part(path, '/', 1) AS source, nullif(regexp_extract(path, '(?:^|[_/])sub-([^_/.]+)[^/]*$', 1), '') AS subject, nullif(regexp_extract(path, '(?:^|[_/])ses-([^_/.]+)[^/]*$', 1), '') AS session, {SUF} AS source_suffix,
  nullif(regexp_extract(path, '(?:^|[_/])desc-([^_/.]+)[^/]*$', 1), '') AS description FROM listing WHERE split_part(path, '/', 1) IN ('sub-03', 'sub-04')""")
def _(t):
    return N.derivative_catalog(t.listing, ["sub-03", "sub-04"])


@query("i18_session_metadata", """SELECT c_custkey, CASE WHEN c_custkey % 6 NOT IN (0, 1) THEN c_mktsegment END AS mood, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey AS DOUBLE) END AS sleep_hours FROM customer""")
def _(t):
    k = F.col("c_custkey")
    x = t.customer.select("c_custkey", F.when(k % 6 == 0, "n/a").when(k % 6 == 1, "").otherwise(F.col("c_mktsegment")).alias("mood"), F.when(k % 5 == 0, "about six").otherwise(k.cast("string")).alias("sleep_hours"))
    return N.session_metadata(x, ["mood"], ["sleep_hours"])


@query("i19_count_by_extension", r"""SELECT CASE WHEN e = '' THEN '(no extension)' ELSE e END AS extension, count(*) AS n FROM (SELECT lower(regexp_extract(url, '[^/](\.[^./]+)$', 1)) AS e FROM pages) GROUP BY 1""")
def _(t):
    return N.count_by_extension(t.pages, "url")


@query("i20_scan_rows", f"""WITH {RUNS}, {LISTING}, e AS (SELECT l_orderkey AS run_id, count(*) AS n FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1) SELECT run_id, path, round_even(coalesce(CASE WHEN run_id % 4 = 0 THEN run_id / 7 END, CASE WHEN n_volumes > 1 THEN tr * n_volumes END), 2) AS duration_s,
  CASE WHEN suffix = 'bold' THEN n END AS n_events, CASE WHEN suffix = 'bold' THEN EXISTS (SELECT 1 FROM listing x WHERE x.run_id = r.run_id AND kind = 'sidecar') END AS has_sidecar, CASE WHEN suffix = 'bold' THEN EXISTS (SELECT 1 FROM listing x WHERE x.run_id = r.run_id AND kind = 'physio') END AS has_physio
  FROM runs r LEFT JOIN e USING (run_id)""", {"duration_s": 2})
def _(t):
    im = t.runs.withColumn("acquisition_duration", F.when(F.col("run_id") % 4 == 0, F.col("run_id") / 7))
    ev = t.lineitem.where("l_orderkey % 5 <> 0").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count("*").alias("n_rows"))
    return N.scan_rows(im, ev, t.listing, ["run_id"], ["sidecar", "physio"]).select("run_id", "path", "duration_s", "n_events", "has_sidecar", "has_physio")


RAW = """raw AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'cued_recall_encoding_subj3_sess' || day(ts) || '_run1.csv' WHEN 1 THEN 'cued_recall_math_subj3_sess' || day(ts) || '_run2_timing.csv' WHEN 2 THEN '3_2_1_mem_search_recall_2025-01-0' || user_id % 9 || '_10h.log'
  WHEN 3 THEN 's3s' || day(ts) || 'r1m_2025_01_02.EDF' WHEN 4 THEN 's4s4s1r_' || event_id || '.EDF' WHEN 5 THEN 'TRIAL_00' || user_id || '_ROUTINE_01.ias' WHEN 6 THEN 'final_timeline_subj4_sess30_run1.csv' WHEN 7 THEN 'localizer_motor_sub5_sess1_run1_x_timing.csv' ELSE 'notes_' || user_id || '.txt' END AS name FROM events)"""
KIND = "CASE event_id % 9 WHEN 0 THEN 'timed_events' WHEN 1 THEN 'timing_input' WHEN 3 THEN 'edf_to_physio' WHEN 4 THEN 'edf_to_physio' WHEN 5 THEN 'supplementary' WHEN 6 THEN 'behavioral_to_beh' WHEN 7 THEN 'localizer_events' ELSE 'no_conversion' END"


def _raw(t):
    r, d, u = F.col("event_id") % 9, F.dayofmonth("ts").cast("string"), F.col("user_id").cast("string")
    name = (F.when(r == 0, F.concat(F.lit("cued_recall_encoding_subj3_sess"), d, F.lit("_run1.csv"))).when(r == 1, F.concat(F.lit("cued_recall_math_subj3_sess"), d, F.lit("_run2_timing.csv")))
            .when(r == 2, F.concat(F.lit("3_2_1_mem_search_recall_2025-01-0"), (F.col("user_id") % 9).cast("string"), F.lit("_10h.log"))).when(r == 3, F.concat(F.lit("s3s"), d, F.lit("r1m_2025_01_02.EDF")))
            .when(r == 4, F.concat(F.lit("s4s4s1r_"), F.col("event_id").cast("string"), F.lit(".EDF"))).when(r == 5, F.concat(F.lit("TRIAL_00"), u, F.lit("_ROUTINE_01.ias")))
            .when(r == 6, "final_timeline_subj4_sess30_run1.csv").when(r == 7, "localizer_motor_sub5_sess1_run1_x_timing.csv").otherwise(F.concat(F.lit("notes_"), u, F.lit(".txt"))))
    return t.events.select("event_id", name.alias("name"))


# Example rules over the names above: pattern, conversion, where the result belongs.
RULES = [(r"^cued_recall_encoding_subj(\d+)_sess(\d+)_run(\d+)\.csv$", "timed_events", "sub-$1/ses-$2/func/run-$3_events.tsv"),
         (r"^cued_recall_math_subj(\d+)_sess(\d+)_run(\d+)_timing\.csv$", "timing_input", None),
         (r"^s(\d+)s(\d+)r(\d+)m_[0-9_]+\.EDF$", "edf_to_physio", "sub-$1/ses-$2/func/run-$3_physio.tsv.gz"),
         (r"^TRIAL_\d+_ROUTINE_\d+\.ias$", "supplementary", None),
         (r"^final_timeline_subj(\d+)_sess(\d+)_run(\d+)\.csv$", "behavioral_to_beh", "sub-$1/ses-$2/beh/run-$3_beh.tsv"),
         (r"^localizer_motor_sub(\d+)_sess(\d+)_run(\d+)_\w+_timing\.csv$", "localizer_events", "sub-$1/ses-$2/func/run-$3_events.tsv")]
ODD = ["s4s4s1r_"]
PLACE = "CASE " + " ".join(f"WHEN regexp_matches(name, '{p}') THEN regexp_replace(name, '{p}', '{d.replace('$', chr(92))}')" for p, _, d in RULES if d) + " END"


def _classified(t):
    return N.classify(_raw(t), "name", RULES, ODD, "edf_to_physio")


@query("i21_classified_files", f"WITH {RAW} SELECT event_id, name, {KIND} AS conversion_type, {PLACE} AS destination FROM raw")
def _(t):
    return _classified(t)


@query("i22_series_to_task", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'TBencoding' WHEN 1 THEN 'NATretrieval' WHEN 2 THEN 'tone' WHEN 3 THEN 'FINresting' END AS task, CASE event_id % 5 WHEN 0 THEN CAST(user_id % 6 + 1 AS INTEGER) WHEN 1 THEN 2 END AS run FROM events WHERE event_type IN ('click', 'view') AND event_id % 5 < 4""")
def _(t):
    r = F.col("event_id") % 5
    s = (F.when(r == 0, F.concat(F.lit("Series_12_cued_recall_encoding_run0"), (F.col("user_id") % 6 + 1).cast("string"))).when(r == 1, "Series_3_free_recall_retrieval_run02_attempt2")
         .when(r == 2, "Series_4_localizer_tone").when(r == 3, "Series_9_Resting").otherwise("Series_1_scout"))
    st = F.when(F.col("event_type") == "click", "COMPLETE").when(F.col("event_type") == "view", "PARTIAL").otherwise("TRUNCATED")
    return N.series_to_task(t.events.select("event_id", F.concat(s, F.lit("_PhysioLog")).alias("series"), st.alias("status")), "series").select("event_id", "task", "run")


@query("i23_applied_triage", f"""WITH {RAW}, t AS (SELECT doc_id AS event_id, CASE WHEN quality = 1 THEN 'include' ELSE 'exclude' END AS decision, CASE WHEN toxic = 0 THEN 'pupil_only' ELSE 'gaze_only' END AS channels, doc_id % 101 AS g, doc_id % 97 AS p FROM labels)
  SELECT event_id, CASE WHEN k = 'edf_to_physio' AND decision = 'exclude' THEN 'edf_excluded' ELSE k END AS conversion_type, name || CASE WHEN k = 'edf_to_physio' AND decision = 'exclude' THEN ' [EXCLUDED: gaze ' || g || '% pupil ' || p || '% valid in scan window]'
  WHEN k = 'edf_to_physio' AND channels = 'pupil_only' THEN ' [pupil_only: gaze ' || g || '% valid]' ELSE '' END AS description FROM (SELECT *, {KIND} AS k FROM raw) LEFT JOIN t USING (event_id)""")
def _(t):
    k = F.col("doc_id")
    tri = t.labels.select(k.alias("event_id"), F.when(F.col("quality") == 1, "include").otherwise("exclude").alias("decision"), F.when(F.col("toxic") == 0, "pupil_only").otherwise("gaze_only").alias("channels"),
                          (k % 101).alias("gaze_pct"), (k % 97).alias("pupil_pct"))
    return N.apply_triage(_classified(t).drop("destination").withColumnRenamed("name", "description"), tri, "event_id")


@query("i24_route_counts", f"""WITH {RAW}, k AS (SELECT *, {KIND} AS conversion_type FROM raw WHERE event_id % 10 <> 0) SELECT conversion_type, CASE WHEN conversion_type IN ('no_conversion', 'timing_input') THEN 'skip' WHEN conversion_type IN ('timed_events', 'edf_to_physio') THEN 'process' ELSE 'unknown' END AS route, count(*) AS n FROM k GROUP BY ALL""")
def _(t):
    return N.route_counts(_classified(t), ["timed_events", "edf_to_physio"], keep=F.col("event_id") % 10 != 0)


@query("i25_formatted_cells", W + "SELECT trial_id, coalesce(CAST(resp AS VARCHAR), 'n/a') AS resp, CASE WHEN trial_id % 2 = 0 THEN 'n/a' ELSE CAST(pairId AS VARCHAR) END AS pair FROM trials")
def _(t):
    x = t.trials.withColumn("p", F.when(F.col("trial_id") % 2 == 0, "none").otherwise(F.concat(F.col("pairId").cast("string"), F.lit(".0"))))
    return x.select("trial_id", S.int_or_na("resp").alias("resp"), S.int_or_na("p").alias("pair"))


@query("i26_report_counts", L + r"""SELECT coalesce(nullif(regexp_extract(path, '(?:^|[_/])sub-([^_/.]+)[^/]*$', 1), ''), 'unknown') AS subject, CASE WHEN path LIKE '%anat%' THEN 'anat' WHEN path LIKE '%func%' THEN 'func' ELSE 'other' END AS modality, count(*) AS n FROM listing WHERE path LIKE '%.html' GROUP BY ALL""")
def _(t):
    return N.report_counts(t.listing, "path")


@query("i27_dataset_summary", L + r"""SELECT count(DISTINCT substr(path, 5, 2)) AS n_subjects, count(DISTINCT substr(path, 1, 13)) AS n_sessions, count(DISTINCT regexp_extract(path, '_task-([^_/.]+)', 1)) AS n_tasks, count(*) AS n_files FROM listing""")
def _(t):
    return N.dataset_summary(N.describe_files(t.listing))


@query("i27_subject_listing", L + r"""SELECT substr(path, 12, 2) AS session, 'func' AS datatype, count(*) AS n_files, count(DISTINCT regexp_extract(path, '_task-([^_/.]+)', 1)) AS n_tasks FROM listing WHERE path LIKE 'sub-03%' GROUP BY ALL""")
def _(t):
    return N.datatype_counts(N.describe_files(t.listing), "03")
