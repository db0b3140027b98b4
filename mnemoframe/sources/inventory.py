"""Tables about files: manifest, metadata per file, classification of raw files, dataset summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import num
from .files import datatype, entity, extension, suffix, with_entities

# Scanner series names in the order they are tried, the task, and whether group 1 is the run.
SERIES_RULES = (
    (r"^cued_recall_encoding_run(\d+)$", "TBencoding", True), (r"^cued_recall_retrieval_run(\d+)$", "TBretrieval", True),
    (r"^cued_recall_math$", "TBmath", False), (r"^cued_recall_resting$", "TBresting", False),
    (r"^free_recall_encoding_run(\d+)$", "NATencoding", True), (r"^free_recall_retrieval_run(\d+)(_attempt\d+)?$", "NATretrieval", True),
    (r"^free_recall_math$", "NATmath", False), (r"^free_recall_resting$", "NATresting", False),
    (r"^final_cued_recall_run(\d+)$", "FINretrieval", True), (r"^Resting_baseline$", "INITresting", False), (r"^Resting$", "FINresting", False),
    (r"^fixation_calibration$", "fixation", False), (r"^localizer_prf_run(\d+)$", "prf", True), (r"^localizer_floc_run(\d+)$", "floc", True),
    (r"^localizer_tone(?:_run(\d+))?$", "tone", True), (r"^localizer_auditory(?:_run(\d+))?$", "auditory", True),
    (r"^localizer_motor(?:_run(\d+))?$", "motor", True),
)


def run_catalog(listing: DataFrame, anchor: str, kinds, stem: str = "stem") -> DataFrame:
    """One row per stem that has the anchor file, with its sibling files as nullable columns."""
    g = listing.groupBy(stem).agg(*[F.min(F.when(F.col("kind") == k, F.col("path"))).alias(k) for k in (anchor, *kinds)])
    return g.where(F.col(anchor).isNotNull())


def manifest(scans: DataFrame, companions: DataFrame, order: str) -> DataFrame:
    """Scan rows by path, the last one winning, then companions whose path is not there yet."""
    cols = [c for c in scans.columns if c not in ("path", order)]
    last = lambda df: df.groupBy("path").agg(F.max_by(F.struct(*cols), order).alias("_r")).select("path", "_r.*")
    first = last(scans)
    return first.unionByName(last(companions).join(first.select("path"), "path", "left_anti"))


def describe_files(df: DataFrame, path: str = "path") -> DataFrame:
    return with_entities(df, path).withColumn("format", extension(path)).withColumn("datatype", datatype(
        F.regexp_replace(path, r"^(sub-[^/]+/)?(ses-[^/]+/)?", "")))


def event_metadata(rows: DataFrame, file: str, onset: str = "onset", duration: str = "duration") -> DataFrame:
    """Row count and time limits per event file; text that is no number is ignored."""
    o, d = num(onset), num(duration)
    return rows.groupBy(file).agg(F.count("*").alias("n_rows"), F.min(o).alias("onset_min"), F.max(o).alias("onset_max"),
                                  F.min(d).alias("duration_min"), F.max(d).alias("duration_max"), F.max(o + d).alias("end_max"))


def physio_metadata(records: DataFrame, path: str = "path", text: str = "value") -> DataFrame:
    """Recording entity, rate and column count from a sidecar, keyed by the data file."""
    schema = T.StructType([T.StructField("SamplingFrequency", T.DoubleType()), T.StructField("Columns", T.ArrayType(T.StringType()))])
    j = F.from_json(text, schema)
    return records.select(F.regexp_replace(path, r"\.json$", ".tsv.gz").alias("path"), entity(path, "recording").alias("recording"),
                          j["SamplingFrequency"].alias("sampling_rate"), F.coalesce(F.size(j["Columns"]), F.lit(0)).cast("long").alias("n_columns"))


def category_counts(files: DataFrame, keys, category: str, known, other: str = "other") -> DataFrame:
    c = F.when(F.col(category).isin(*known), F.col(category)).otherwise(other)
    return files.groupBy(*keys, c.alias("category")).agg(F.count("*").alias("n_files"))


def series_counts(files: DataFrame, keys, series: str) -> DataFrame:
    """Image folders count series, not files."""
    return files.groupBy(*keys).agg(F.countDistinct(series).alias("n_series"), F.count("*").alias("n_files"))


def derivative_catalog(listing: DataFrame, roots, path: str = "path") -> DataFrame:
    root = F.split(path, "/")[0]
    return listing.where(root.isin(*roots)).select(path, root.alias("source"), entity(path, "sub").alias("subject"),
                                                   entity(path, "ses").alias("session"), suffix(path).alias("source_suffix"), entity(path, "desc").alias("description"))


def session_metadata(rows: DataFrame, text, numbers) -> DataFrame:
    """'n/a' and '' to NULL in text columns, numeric coercion of the others."""
    out = rows.withColumns({c: F.when(~F.trim(F.col(c)).isin("n/a", ""), F.col(c)) for c in text})
    return out.withColumns({c: num(c) for c in numbers})


def count_by_extension(df: DataFrame, name: str) -> DataFrame:
    e = F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1))
    return (df.groupBy(F.when(e == "", "(no extension)").otherwise(e).alias("extension")).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "extension"))


def scan_rows(images: DataFrame, events: DataFrame, companions: DataFrame, keys, kinds) -> DataFrame:
    """A scans table: duration from the sidecar, else TR times volumes (more than one volume); event rows and
    companion flags for functional images only. `companions` holds keys and `kind`."""
    flags = companions.groupBy(*keys).agg(*[F.max(F.col("kind") == k).alias(f"has_{k}") for k in kinds])
    j = images.join(events.select(*keys, "n_rows"), list(keys), "left").join(flags, list(keys), "left")
    bold = F.col("suffix") == "bold"
    dur = F.coalesce("acquisition_duration", F.when(F.col("n_volumes") > 1, F.col("tr") * F.col("n_volumes")))
    j = j.withColumn("duration_s", F.bround(dur, 2)).withColumn("n_events", F.when(bold, F.col("n_rows")))
    return j.withColumns({f"has_{k}": F.when(bold, F.coalesce(f"has_{k}", F.lit(False))) for k in kinds}).drop("n_rows")


def classify(df: DataFrame, name: str, rules, odd_names=(), odd_type: str | None = None, default: str = "no_conversion") -> DataFrame:
    """conversion_type and destination of raw files. `rules` is an ordered table of (pattern, type, destination or
    None), the destination with $1.. for the pattern's groups; the first that matches decides. Names that start with one
    of `odd_names` have `odd_type` before all rules, and no destination."""
    kind, place = F.lit(default), F.lit(None).cast("string")
    for pattern, t, target in reversed(list(rules)):
        hit = F.col(name).rlike(pattern)
        kind = F.when(hit, t).otherwise(kind)
        place = F.when(hit, F.regexp_replace(name, pattern, target) if target else F.lit(None)).otherwise(place)
    odd = F.lit(False)
    for start in odd_names:
        odd = odd | F.col(name).startswith(start)
    return df.withColumn("conversion_type", F.when(odd, odd_type).otherwise(kind)).withColumn("destination", F.when(~odd, place))


def series_to_task(df: DataFrame, series: str, status: str = "status", usable=("COMPLETE", "PARTIAL"), rules=SERIES_RULES) -> DataFrame:
    """Task and run of usable scanner series; names no rule knows are left out."""
    body = F.regexp_extract(series, r"^Series_\d+_(.+?)_PhysioLog$", 1)
    task, run = F.lit(None).cast("string"), F.lit(None).cast("int")
    for pattern, t, has_run in reversed(rules):
        hit = body.rlike(pattern)
        task = F.when(hit, t).otherwise(task)
        run = F.when(hit, F.regexp_extract(body, pattern, 1).try_cast("int") if has_run else F.lit(None).cast("int")).otherwise(run)
    return df.where(F.col(status).isin(*usable)).withColumn("task", task).withColumn("run", run).where("task is not null")


def apply_triage(rows: DataFrame, triage: DataFrame, key: str) -> DataFrame:
    """Excluded eye recordings are reclassified, pupil-only ones annotated; other types pass unchanged."""
    j = rows.join(triage.select(key, "decision", "channels", "gaze_pct", "pupil_pct"), key, "left")
    mine = (F.col("conversion_type") == "edf_to_physio") & F.col("decision").isNotNull()
    out, only = mine & (F.col("decision") == "exclude"), mine & (F.col("decision") != "exclude") & (F.col("channels") == "pupil_only")
    g, p = F.col("gaze_pct").cast("string"), F.col("pupil_pct").cast("string")
    note = (F.when(out, F.concat(F.lit(" [EXCLUDED: gaze "), g, F.lit("% pupil "), p, F.lit("% valid in scan window]")))
            .when(only, F.concat(F.lit(" [pupil_only: gaze "), g, F.lit("% valid]"))).otherwise(""))
    return (j.withColumn("description", F.concat("description", note))
            .withColumn("conversion_type", F.when(out, "edf_excluded").otherwise(F.col("conversion_type")))
            .drop("decision", "channels", "gaze_pct", "pupil_pct"))


def route_counts(rows: DataFrame, handlers, skipped=("no_conversion", "timing_input"), kind: str = "conversion_type", keep: Column | None = None) -> DataFrame:
    rows = rows.where(keep) if keep is not None else rows
    route = F.when(F.col(kind).isin(*skipped), "skip").when(F.col(kind).isin(*handlers), "process").otherwise("unknown")
    return rows.groupBy(kind, route.alias("route")).agg(F.count("*").alias("n"))


def report_counts(listing: DataFrame, name: str) -> DataFrame:
    """HTML reports by subject and modality; without a suffix the name decides between anat and func."""
    r = listing.where(F.col(name).endswith(".html"))
    s = F.regexp_extract(name, r"_(bold|T1w|T2w|dwi)\.html$", 1)
    modality = F.when(s != "", s).when(F.col(name).contains("anat"), "anat").when(F.col(name).contains("func"), "func").otherwise("other")
    return r.groupBy(F.coalesce(entity(name, "sub"), F.lit("unknown")).alias("subject"), modality.alias("modality")).agg(F.count("*").alias("n"))


def dataset_summary(files: DataFrame) -> DataFrame:
    return files.agg(F.countDistinct("subject").alias("n_subjects"), F.countDistinct("subject", "session").alias("n_sessions"),
                     F.countDistinct("task").alias("n_tasks"), F.count("*").alias("n_files"))


def datatype_counts(files: DataFrame, subject: str | None = None) -> DataFrame:
    f = files.where(F.col("subject") == subject) if subject else files
    keys = ["session"] if subject else []
    return f.groupBy(*keys, "datatype").agg(F.count("*").alias("n_files"), F.countDistinct("task").alias("n_tasks"))
