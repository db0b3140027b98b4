"""File catalog: session summaries, expectations against observations, and the check suite.

Checks are anti joins, counts and comparisons over whole tables, never a lookup per row. Declared
expectations are small by nature, but no operator forces a broadcast: Spark picks one from their size.
"""

from __future__ import annotations

import re

from py4j.java_gateway import is_instance_of
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import pad2
from ..functions.quantiles import exact_quantiles
from ..functions.scan import id_block, row_index

RESULT = ["check_name", "subject", "session", "task", "run", "status", "expected", "actual"]


COMMANDS = ("org.apache.spark.sql.catalyst.plans.logical.Command", "org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")
READING = ("Show", "Describe")


def _plan_nodes(plan):
    """All nodes of a parsed statement."""
    yield plan
    children = plan.children().iterator()
    while children.hasNext():
        yield from _plan_nodes(children.next())


def run_select(spark: SparkSession, sql: str, params: dict | None = None, **tables: DataFrame) -> DataFrame:
    """Read-only SQL over named tables ({name} in the text) with bound parameters (:name). The statement is parsed
    first and refused if any part of it is a command other than SHOW or DESCRIBE. SUMMARIZE gives a summary of a query or table."""
    summary = re.match(r"(?is)^\s*summarize\s+(.*)$", sql)
    if summary:
        body = summary.group(1)
        return run_select(spark, body if re.match(r"(?is)^\s*(select|with)\b", body) else f"SELECT * FROM {body}", params, **tables).summary()
    if not re.match(r"(?is)^\s*(select|with|describe|show)\b", sql):
        raise ValueError("only SELECT, WITH, DESCRIBE, SHOW and SUMMARIZE are allowed")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(re.sub(r"\{(\w+)\}", r"\1", sql))
    for node in _plan_nodes(plan):  # relational nodes are no commands; of the commands only those that describe are allowed
        name = node.getClass().getSimpleName()
        if any(is_instance_of(spark.sparkContext._gateway, node, c) for c in COMMANDS) and not name.startswith(READING):
            raise ValueError(f"not a read-only statement: {name}")
    return spark.sql(sql, args=params or {}, **tables)


def summary_sections(sections: dict[str, tuple[DataFrame, str]], keys=("subject", "session")) -> DataFrame:
    """Counts per key from several tables as (keys, section, name, n): files by datatype, derivatives by
    dataset, decisions, resolution states. Filter on the keys for one session's summary."""
    parts = [df.groupBy(*keys, F.col(by).alias("name")).agg(F.count("*").alias("n")).withColumn("section", F.lit(s))
             for s, (df, by) in sections.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*keys, "section", "name", "n")


def resolution(files: DataFrame, expected: DataFrame, exceptions: DataFrame, keys) -> DataFrame:
    """Every declared unit and every observed group: present, missing, excepted or surplus."""
    keys = list(keys)
    seen = files.groupBy(*keys).agg(F.count("*").alias("_n"))
    j = expected.join(seen, keys, "full_outer").join(exceptions.select(*keys, "disposition", F.lit(True).alias("_ex")), keys, "left")
    n = F.coalesce("_n", F.lit(0))
    status = (F.when(F.col("runs_min").isNull() | (n > F.col("runs_max")), "surplus")
              .when(n >= F.col("runs_min"), "present")
              .when(F.col("_ex"), "excepted").otherwise("missing"))
    return (j.withColumn("observed_n", n).withColumn("status", status)
            .withColumn("disposition", F.when(F.col("status") == "excepted", F.col("disposition"))).drop("_n", "_ex"))


def bare_label(value: str, prefix: str) -> str:
    return value[len(prefix):] if value.startswith(prefix) else value


def strip_label(c, prefix: str) -> Column:
    return F.regexp_replace(c, f"^{prefix}", "")


def in_scope(df: DataFrame, subjects=None, sessions=None) -> DataFrame:
    if subjects:
        df = df.where(F.col("subject").isin([bare_label(s, "sub-") for s in subjects]))
    if sessions:
        df = df.where(F.col("session").isin([bare_label(s, "ses-") for s in sessions]))
    return df


def severity(order: dict[str, int], status: str = "status", other: int = 3) -> Column:
    c = F.lit(other)
    for s, k in order.items():
        c = F.when(F.col(status) == s, k).otherwise(c)
    return c


def resolution_report(res: DataFrame, subjects=None, sessions=None, statuses=None, include_all: bool = False) -> DataFrame:
    """Rows worth attention, worst first. Default: missing, surplus, and excepted but still pending."""
    r = in_scope(res, subjects, sessions)
    if statuses:
        r = r.where(F.col("status").isin(*statuses))
    elif not include_all:
        r = r.where(F.col("status").isin("missing", "surplus")
                    | ((F.col("status") == "excepted") & (F.col("disposition") == "pending")))
    return (r.withColumn("severity", severity({"missing": 0, "surplus": 1, "excepted": 2}))
            .orderBy("severity", "subject", "session", "task"))


def resolution_counts(res: DataFrame, subjects=None, sessions=None) -> DataFrame:
    key = F.concat_ws("-", F.col("status"), F.nullif("disposition", F.lit("")))
    return in_scope(res, subjects, sessions).groupBy(key.alias("state")).agg(F.count("*").alias("n"))


def expectations_for_task(units: DataFrame, task: str, shape) -> DataFrame:
    """Unit shapes of a task with the sessions and the number of subjects they hold for. The session list
    is a set of declared labels, so its length does not grow with the data."""
    return (units.where(F.col("task") == task).groupBy(*shape)
            .agg(F.countDistinct("subject").alias("n_subjects"), F.array_sort(F.collect_set("session")).alias("sessions")))


def expectations_for_session_type(units: DataFrame, sessions: DataFrame, kind: str, shape) -> DataFrame:
    of_kind = sessions.where(F.col("session_type") == kind).select("subject", "session")
    return units.join(of_kind, ["subject", "session"], "left_semi").groupBy(*shape).agg(F.count("*").alias("n_units"))


def expectations_overview(units: DataFrame) -> DataFrame:
    return units.agg(F.countDistinct("task").alias("n_tasks"), F.countDistinct("subject").alias("n_subjects"),
                     F.countDistinct("session").alias("n_sessions"), F.count("*").alias("n_units"))


def _result(df: DataFrame, check: str, status: Column, expected: Column, actual: Column) -> DataFrame:
    for k, t in (("session", "string"), ("task", "string"), ("run", "int")):
        if k not in df.columns:
            df = df.withColumn(k, F.lit(None).cast(t))
    return (df.withColumn("status", status).where(F.col("status").isNotNull())
            .select(F.lit(check).alias("check_name"), "subject", "session", "task", F.col("run").cast("int").alias("run"),
                    "status", expected.cast("string").alias("expected"), actual.cast("string").alias("actual")))


def check_file_presence(files: DataFrame, expected: DataFrame, keys=("subject", "session", "task")) -> DataFrame:
    seen = files.groupBy(*keys).agg(F.count("*").alias("_n"))
    j = expected.join(seen, list(keys), "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    status = F.when(F.col("_n") < F.col("runs_min"), "fail").when(F.col("_n") > F.col("runs_max"), "warn").otherwise("pass")
    return _result(j, "file_presence", status, F.concat_ws("-", F.col("runs_min").cast("string"), F.col("runs_max").cast("string")), F.col("_n"))


def check_total_runs(files: DataFrame, expected: DataFrame) -> DataFrame:
    """`expected` holds (subject, task, total)."""
    seen = files.groupBy("subject", "task").agg(F.count("*").alias("_n"))
    j = expected.join(seen, ["subject", "task"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return _result(j, "total_runs", F.when(F.col("_n") == F.col("total"), "pass").otherwise("fail"), F.col("total"), F.col("_n"))


def check_volumes(images: DataFrame, expected: DataFrame, dims=(96, 96, 60)) -> DataFrame:
    """Grid size of every image, one volume for reference images, and the task's volume count, exact or
    range. `expected` holds (task, vol_min, vol_max)."""
    bold, ref = F.col("suffix") == "bold", F.col("suffix") == "sbref"
    bad_dims = ~((F.col("nx") == dims[0]) & (F.col("ny") == dims[1]) & (F.col("nz") == dims[2]))
    ok = F.col("nt").between(F.col("vol_min"), F.col("vol_max"))
    rng = F.when(F.col("vol_min") == F.col("vol_max"), F.col("vol_min").cast("string")).otherwise(
        F.concat_ws("-", F.col("vol_min").cast("string"), F.col("vol_max").cast("string")))

    def finding(cond, status, exp, act):
        return F.when(cond, F.struct(status.alias("status"), exp.alias("expected"), act.cast("string").alias("actual")))

    found = F.array_compact(F.array(
        finding(bad_dims & (bold | ref), F.lit("fail"), F.lit("x".join(map(str, dims))),
                F.concat_ws("x", F.col("nx").cast("string"), F.col("ny").cast("string"), F.col("nz").cast("string"))),
        finding(ref & (F.col("nt") != 1), F.lit("fail"), F.lit("1"), F.col("nt")),
        finding(bold & F.col("vol_min").isNotNull(), F.when(ok, "pass").otherwise("fail"), rng, F.col("nt"))))
    x = (images.where(bold | ref).join(expected, "task", "left")
         .select("subject", "session", "task", "run", F.explode(found).alias("f")))
    return _result(x.select("subject", "session", "task", "run", F.col("f.status").alias("_s"), F.col("f.expected").alias("_e"),
                            F.col("f.actual").alias("_a")), "volume_count", F.col("_s"), F.col("_e"), F.col("_a"))


def null_safe(a: DataFrame, b: DataFrame, keys, nullable) -> Column:
    """Join condition: plain equality on keys, null-safe equality on columns that may be absent."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & (a[k] == b[k])
    for k in nullable:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def missing_companions(anchor: DataFrame, companions: DataFrame, check: str, status: str, expected: str, keys,
                       nullable=("run",)) -> DataFrame:
    """Anchor rows without a companion on the same keys (events, reference images, sidecars by path)."""
    c = companions.select(*keys, *nullable).distinct()
    gone = anchor.join(c, null_safe(anchor, c, keys, nullable), "left_anti")
    return _result(gone, check, F.lit(status), F.lit(expected), F.lit("none"))


def check_events_presence(bold: DataFrame, events: DataFrame, keys, nullable=("run",)) -> DataFrame:
    """Pass or fail for every run, with the run number matched null-safely."""
    e = events.select(*keys, *nullable).distinct().withColumn("_hit", F.lit(True))
    cond = null_safe(bold, e, keys, nullable)
    j = bold.join(e, cond, "left").select(bold["*"], "_hit")
    return _result(j, "events_presence", F.when(F.col("_hit"), "pass").otherwise("fail"), F.lit("1"),
                   F.when(F.col("_hit"), "1").otherwise("0"))


def check_row_counts(events: DataFrame, expected: DataFrame) -> DataFrame:
    """`expected` holds (task, rows_min, rows_max); tasks without an entry are not judged."""
    j = events.join(expected, "task")
    return _result(j, "events_row_count", F.when(F.col("n_rows").between(F.col("rows_min"), F.col("rows_max")), "pass").otherwise("fail"),
                   F.concat_ws("-", F.col("rows_min").cast("string"), F.col("rows_max").cast("string")), F.col("n_rows"))


def check_columns(events: DataFrame, expected: DataFrame) -> DataFrame:
    """Column sets against the task's declared set: a missing one fails, an extra one warns."""
    j = (events.join(expected, "task").withColumn("n_missing", F.size(F.array_except("expected_columns", "columns")))
         .withColumn("n_extra", F.size(F.array_except("columns", "expected_columns"))))
    status = F.when(F.col("n_missing") > 0, "fail").when(F.col("n_extra") > 0, "warn").otherwise("pass")
    return j.withColumn("status", status)


def check_timing(events: DataFrame, bold: DataFrame, keys, nullable=("run",), default_tr: float = 1.5) -> DataFrame:
    """Negative onsets warn. The end of the last event beyond the scan warns up to one TR and fails beyond."""
    b = bold.select(*keys, *nullable, "n_volumes", F.coalesce("tr", F.lit(default_tr)).alias("_tr"))
    j = events.join(b, null_safe(events, b, keys, nullable), "left").select(events["*"], "n_volumes", "_tr")
    dur, end = F.col("n_volumes") * F.col("_tr"), F.coalesce("end_max", "onset_max")
    over = end - dur
    timed = F.when(over > F.col("_tr"), "fail").when(over > 0, "warn").when(over.isNotNull(), "pass")
    both = F.array_compact(F.array(
        F.when(F.col("onset_min") < 0, F.struct(F.lit("onset").alias("part"), F.lit("warn").alias("status"))),
        F.when(timed.isNotNull(), F.struct(F.lit("end").alias("part"), timed.alias("status")))))
    x = j.select("subject", "session", "task", "run", F.explode(both).alias("f"))
    return _result(x, "events_timing", F.col("f.status"), F.lit("within the scan"), F.col("f.part"))


def check_recordings(sessions: DataFrame, recordings: DataFrame, types, exclude=(), check: str = "recording_presence") -> DataFrame:
    """Sessions lacking an expected recording type. The type list is declared and short."""
    want = sessions.select("subject", "session").distinct()
    if exclude:
        want = want.where(~F.col("session").isin(*exclude))
    want = want.withColumn("recording", F.explode(F.array(*[F.lit(x) for x in types])))
    gone = want.join(recordings.select("subject", "session", "recording").distinct(), ["subject", "session", "recording"], "left_anti")
    return _result(gone, check, F.lit("warn"), F.col("recording"), F.lit("none"))


def check_derivative_coverage(subjects: DataFrame, derivatives: DataFrame, names) -> DataFrame:
    want = subjects.select("subject").distinct().withColumn("name", F.explode(F.array(*[F.lit(x) for x in names])))
    gone = want.join(derivatives.select("subject", "name").distinct(), ["subject", "name"], "left_anti")
    return _result(gone, "derivative_coverage", F.lit("warn"), F.col("name"), F.lit("none"))


def check_session_metadata(sessions: DataFrame, metadata: DataFrame) -> DataFrame:
    gone = sessions.select("subject", "session").distinct().join(metadata.select("subject", "session").distinct(), ["subject", "session"], "left_anti")
    return _result(gone, "session_metadata", F.lit("warn"), F.lit("metadata row"), F.lit("none"))


def union_results(parts) -> DataFrame:
    out = parts[0].select(*RESULT)
    for p in parts[1:]:
        out = out.unionByName(p.select(*RESULT))
    return out


def result_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("check_name", "status").agg(F.count("*").alias("n"))


def validation_report(results: DataFrame, subject: str | None = None, status: str | None = None) -> DataFrame:
    r = in_scope(results, [subject] if subject else None)
    r = r.where(F.col("status") == status) if status else r.where(F.col("status") != "pass")
    return r.withColumn("severity", severity({"fail": 0, "warn": 1}, other=2)).orderBy("severity", "subject", "session")


def overview(df: DataFrame, by) -> DataFrame:
    """Row counts by several attributes in one pass, as (section, name, n)."""
    items = F.array(F.struct(F.lit("all").alias("section"), F.lit("rows").alias("name")),
                    *[F.struct(F.lit(c).alias("section"), F.col(c).cast("string").alias("name")) for c in by])
    return df.select(F.explode(items).alias("x")).groupBy("x.section", "x.name").agg(F.count("*").alias("n"))


def task_matrix(files: DataFrame, tasks) -> DataFrame:
    """Session by task counts; the declared task list fixes the columns."""
    return files.groupBy("subject", "session").pivot("task", list(tasks)).agg(F.count(F.lit(1))).fillna(0)


def recording_coverage(bold: DataFrame, recordings: DataFrame, types) -> DataFrame:
    b = bold.groupBy("subject", "session").agg(F.count("*").alias("n_bold"))
    r = recordings.groupBy("subject", "session").agg(*[F.count(F.when(F.col("recording") == x, 1)).alias(f"n_{x}") for x in types])
    return b.join(r, ["subject", "session"], "left").fillna(0)


def typical_row_count(events: DataFrame, keys) -> DataFrame:
    """Files per group and the upper median of their row counts."""
    n = events.groupBy(*keys).agg(F.count("*").alias("n_files"))
    q = exact_quantiles(events, keys, "n_rows", {"typical": .5}, upper=True)
    return n.join(q, list(keys), "left").withColumn("typical", F.col("typical").cast("long"))


def _converted(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    d = done.select(key).distinct().withColumn("_hit", F.lit(True))
    return source.join(d, key, "left").withColumn("converted", F.coalesce("_hit", F.lit(False))).drop("_hit")


def conversion_counts(source: DataFrame, done: DataFrame, key: str, by) -> DataFrame:
    return _converted(source, done, key).groupBy(*by).agg(
        F.count("*").alias("n_source"), F.count(F.when(F.col("converted"), 1)).alias("n_converted"),
        F.count(F.when(~F.col("converted"), 1)).alias("n_pending"))


def pending_report(source: DataFrame, done: DataFrame, key: str, by) -> DataFrame:
    """Every pending item with its position in its group; a listing cuts where it likes. The key is an integer."""
    left = source.join(done.select(key).distinct(), key, "left_anti").select(*by, key)
    return row_index(left, by, [key], id_block(key), "position").withColumn("position", F.col("position") + 1)


def truncated_runs(images: DataFrame, minimum: int, volumes: str = "n_volumes") -> DataFrame:
    status = F.when(F.col(volumes).isNull(), "unreadable").when(F.col(volumes) < minimum, "truncated")
    return images.withColumn("problem", status).where("problem is not null")


def series_alignment(sidecars: DataFrame, folders: DataFrame) -> DataFrame:
    """Sidecars whose series has no source folder, or a folder with another number of files. A folder is
    looked up under the zero-padded number first, then under the plain one."""
    f = folders.groupBy("subject", "folder").agg(F.max("n_files").alias("n_files"))
    s = (sidecars.where("series_number is not null")
         .withColumn("_p", F.concat(F.lit("Series_"), pad2("series_number")))
         .withColumn("_u", F.concat(F.lit("Series_"), F.col("series_number").cast("string"))))
    a = f.select("subject", F.col("folder").alias("_p"), F.col("n_files").alias("_na"))
    b = f.select("subject", F.col("folder").alias("_u"), F.col("n_files").alias("_nb"))
    j = s.join(a, ["subject", "_p"], "left").join(b, ["subject", "_u"], "left").withColumn("n_files", F.coalesce("_na", "_nb"))
    issue = F.when(F.col("n_files").isNull(), "missing_source").when(F.col("n_files") != F.col("n_volumes"), "volume_mismatch")
    return j.withColumn("category", issue).where("category is not null").drop("_p", "_u", "_na", "_nb")


def mixed_coverage(runs: DataFrame, has: Column, keys) -> DataFrame:
    """Groups where some but not all runs have the companion."""
    return (runs.groupBy(*keys).agg(F.count("*").alias("n_runs"), F.count(F.when(has, 1)).alias("n_with"))
            .where((F.col("n_with") > 0) & (F.col("n_with") < F.col("n_runs"))))


def events_in_neither(bold: DataFrame, first: DataFrame, second: DataFrame, key: str, tasks) -> DataFrame:
    """Runs of tasks that need events but have them in neither location."""
    have = first.select(key).union(second.select(key)).distinct()
    return bold.where(F.col("task").isin(*tasks)).join(have, key, "left_anti").withColumn("level", F.lit("info"))


def duplicate_protocols(series: DataFrame, keys) -> DataFrame:
    return series.groupBy(*keys).agg(F.count("*").alias("n_series"), F.min("series_number").alias("first_series"),
                                     F.max("series_number").alias("last_series")).where("n_series > 1")


def fieldmap_pairs(series: DataFrame, key: str) -> DataFrame:
    """Pair the two phase directions per session: by suffix when any series carries one (exactly one of
    each), else by order: the k-th of one direction with the k-th of the other, with a warning unless there are one or two
    of each. The first two pairs have names, later ones are numbered."""
    s = series.withColumn("suffix", F.coalesce("suffix", F.lit("")))
    ap, pa = F.col("direction") == "ap", F.col("direction") == "pa"
    per = s.groupBy(key).agg(F.max(F.col("suffix") != "").alias("by_suffix"), F.count(F.when(ap, 1)).alias("n_ap"),
                             F.count(F.when(pa, 1)).alias("n_pa"))
    named = (s.join(per.where("by_suffix"), key).where(F.col("suffix").isin("encoding", "retrieval"))
             .groupBy(key, F.col("suffix").alias("pair"))
             .agg(F.count(F.when(ap, 1)).alias("_a"), F.count(F.when(pa, 1)).alias("_p"),
                  F.min(F.when(ap, F.col("series_number"))).alias("ap"), F.min(F.when(pa, F.col("series_number"))).alias("pa"))
             .withColumn("warning", (F.col("_a") > 1) | (F.col("_p") > 1))
             .where("warning or (_a = 1 and _p = 1)")
             .withColumn("ap", F.when(~F.col("warning"), F.col("ap"))).withColumn("pa", F.when(~F.col("warning"), F.col("pa")))
             .select(key, F.lit("series_description").alias("strategy"), "pair", "ap", "pa", "warning"))
    first = row_index(s.join(per.where("not by_suffix"), key), [key, "direction"], ["series_number"], id_block("series_number"), "_k").withColumn("_rn", F.col("_k") + 1)
    order = (first.groupBy(key, "n_ap", "n_pa", "_rn")
             .agg(F.min(F.when(ap, F.col("series_number"))).alias("ap"), F.min(F.when(pa, F.col("series_number"))).alias("pa")))
    na, np_ = F.col("n_ap"), F.col("n_pa")
    regular = ((na == 2) & (np_ == 2)) | ((na == 1) & (np_ == 1))
    usable = regular | (((na > 2) | (np_ > 2)) & (na >= 2) & (np_ >= 2))
    numbered = order.select(key, F.lit("series_number").alias("strategy"),
                            F.when(usable, F.when(F.col("_rn") == 1, "encoding").when(F.col("_rn") == 2, "retrieval").otherwise(F.concat(F.lit("pair "), F.col("_rn").cast("string")))).alias("pair"),
                            F.when(usable, F.col("ap")).alias("ap"), F.when(usable, F.col("pa")).alias("pa"),
                            (~regular).alias("warning"))
    return named.unionByName(numbered.distinct())
