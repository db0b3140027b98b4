"""Reading and writing study files: TSV with n/a, JSON records, file names that carry identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import num, pad2, whole

# The key-value entities of a file name, and the data-type folders.
ENTITIES = {"subject": "sub", "session": "ses", "task": "task", "acq": "acq", "dir": "dir", "run": "run",
            "recording": "recording", "desc": "desc"}
DATATYPES = ("anat", "func", "dwi", "fmap", "beh", "perf")
MISSING = ("n/a", "N/A", "")
MOTION = ("trans_x", "trans_y", "trans_z", "rot_x", "rot_y", "rot_z")
MOTION_FORMS = ("", "_derivative1", "_power2", "_derivative1_power2")
N_COMPCOR = 6
TEXT_METADATA = ("bids_meta", "provenance")
REST_TYPES = ("rest",)


def base_name(path) -> Column:
    return F.substring_index(path, "/", -1)


def entity(path, key: str) -> Column:
    """Value of `key-value` in a file name, NULL when absent."""
    return F.nullif(F.regexp_extract(base_name(path), f"(?:^|_){key}-([^_.]+)", 1), F.lit(""))


def suffix(path) -> Column:
    stem = F.substring_index(base_name(path), ".", 1)
    last = F.substring_index(stem, "_", -1)
    return F.when(F.contains(stem, F.lit("_")) & last.rlike("^[a-zA-Z0-9]+$"), last)


def with_entities(df: DataFrame, path: str = "path", prefix: str = "") -> DataFrame:
    return df.withColumns({**{prefix + n: entity(path, k) for n, k in ENTITIES.items()}, prefix + "suffix": suffix(path)})


def extension(path) -> Column:
    """Last extension, with .nii.gz and .tsv.gz kept whole; '' when there is none."""
    p = F.col(path) if isinstance(path, str) else path
    return (F.when(p.endswith(".nii.gz"), ".nii.gz").when(p.endswith(".tsv.gz"), ".tsv.gz")
            .otherwise(F.regexp_extract(base_name(p), r"^.+(\.[^.]*)$", 1)))


def datatype(relative) -> Column:
    first = F.split(relative, "/")[0]
    return F.when(first.isin(*DATATYPES), first).otherwise("unknown")


def run_key(*parts) -> Column:
    """Parts joined by '_', missing ones left out."""
    return F.concat_ws("_", *parts)


def identity_from_path(df: DataFrame, path: str = "source_file") -> DataFrame:
    """Subject and session from the file name; the name wins over columns of the table."""
    out = df
    for name, key in (("subject", "sub"), ("session", "ses")):
        e = entity(path, key)
        out = out.withColumn(name, F.coalesce(e, F.col(name).cast("string")) if name in df.columns else e)
    return out


def normalise_columns(df: DataFrame) -> DataFrame:
    """Drop numeric ids shadowed by text ids, rename the rest, zero-pad."""
    for old, new in (("subj_num", "subject"), ("ses_num", "session"), ("run_idx", "run")):
        if old in df.columns:
            df = df.drop(old) if new in df.columns else df.withColumnRenamed(old, new)
    for c in ("subject", "session", "run"):
        if c in df.columns:
            n = whole(c)
            df = df.withColumn(c, F.when(n.isNotNull(), pad2(n)).otherwise(F.col(c).cast("string")))
    return df


def read_tsv(spark: SparkSession, paths, schema: T.StructType | None = None, where: Column | str | None = None) -> DataFrame:
    """Tab-separated files, plain or compressed, 'n/a' as missing, identity from the file name. Columns are united by
    name, absent ones are missing. All columns are text unless a schema names their types. Accepts files, directories
    and globs; `where` filters on the entities of the names (file_subject, ...) before any file is opened."""
    from .study import study_tables
    return study_tables(spark, paths, schema, where)


def stack_tables(tables, drop_rest: bool = False, kind: str = "trial_type", rest=REST_TYPES) -> DataFrame:
    """Union by name with missing columns filled; rest rows dropped on request, unknown types kept."""
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out.where(F.col(kind).isNull() | ~F.col(kind).isin(*rest)) if drop_rest else out


def find_files(listing: DataFrame, wanted: DataFrame, keys) -> DataFrame:
    """Listed files of the wanted subjects and sessions (a semi join, so `wanted` may be any size)."""
    return listing.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def null_missing(df: DataFrame, columns) -> DataFrame:
    """'n/a', 'N/A' and '' to NULL, then to numbers."""
    return df.withColumns({c: num(F.when(~F.trim(F.col(c)).isin(*MISSING), F.col(c))) for c in columns})


def require_columns(df: DataFrame, columns) -> DataFrame:
    gone = [c for c in columns if c not in df.columns]
    if gone:
        raise KeyError(f"columns not found: {gone}")
    return df.select(*columns)


def read_metric_records(spark: SparkSession, paths) -> DataFrame:
    """One JSON record per file as text with its path, time-series files left out."""
    return (spark.read.text(paths, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
            .where(~F.col("path").contains("_timeseries")))


def metric_map(json_text, metadata=TEXT_METADATA) -> Column:
    """Numeric metrics of a JSON record, metadata keys removed."""
    m = F.from_json(json_text, T.MapType(T.StringType(), T.StringType()))
    numbers = F.transform_values(m, lambda k, v: v.try_cast("double"))
    return F.map_filter(numbers, lambda k, v: ~k.isin(*metadata))


def metric_table(df: DataFrame, keep, metrics, json_text: str = "value") -> DataFrame:
    """A fixed subset of metrics as columns, NULL where a record lacks one."""
    return df.withColumn("_m", metric_map(json_text)).select(*keep, *[F.try_element_at("_m", F.lit(m)).alias(m) for m in metrics])


def int_or_na(c) -> Column:
    """Whole part of a number as text, 'n/a' for anything that is none."""
    return F.coalesce(num(c).cast("long").cast("string"), F.lit("n/a"))


def float_or_na(c) -> Column:
    return F.coalesce(num(c).cast("string"), F.lit("n/a"))


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tab-separated with a header and 'n/a' for missing values; one file per task, no funnel."""
    df.write.mode(mode).option("sep", "\t").option("header", True).option("nullValue", "n/a").option("emptyValue", "n/a").csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
