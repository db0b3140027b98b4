"""Trial cleaning: button codes, two-alternative responses, reaction-time limits, labels, table checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import num, rint_long, with_group_stats

# Condition codes, response codes and session keys of the study design.
ENCODING_LABELS = {1: "single", 2: "repeats", 3: "triplets"}
RETRIEVAL_LABELS = {1: "within", 2: "across"}
CONFIDENCE_LABELS = {1: "sure", 2: "maybe", 3: "maybe", 4: "sure"}
FIRST_TRAINING_SESSION, LAST_TRAINING_SESSION = 4, 18
BUTTON_OFFSET = 5
ALLOWED_VALUES = {"trial_accuracy": (0, 1), "enCon": (1, 2, 3), "reCon": (1, 2)}


def label_map(mapping: dict, key: Column) -> Column:
    items = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*items), key)


def remap_buttons(df: DataFrame, resp: str = "resp", offset: int = BUTTON_OFFSET, out: str = "rating") -> DataFrame:
    return df.withColumn(out, num(resp) - offset)


def decompose_choice(df: DataFrame, resp: str = "resp", correct: str = "correct_resp") -> DataFrame:
    """Position chosen, sure/maybe and correctness. A missing response is position 2 and 'maybe'."""
    r = num(resp)
    position = F.when(r.isin(1, 2), 1).otherwise(2)
    return (df.withColumn("recog", position)
            .withColumn("confidence", F.when(r.isin(1, 4), "sure").otherwise("maybe"))
            .withColumn("is_correct", F.coalesce(position == num(correct), F.lit(False))))


def filter_rt(df: DataFrame, rt: str = "resp_RT", min_rt: float = 0.2, max_rt: float | None = None,
              max_sd: float | None = 3.0, by: list[str] | None = None) -> DataFrame:
    """Absolute limits first, then a limit on the distance from the mean in standard deviations of what is
    left. Single-trial groups are kept; without groups an undefined deviation drops the row."""
    x = num(rt)
    kept = df.where(x >= min_rt)
    if max_rt is not None:
        kept = kept.where(x <= max_rt)
    if max_sd is None:
        return kept
    stats = with_group_stats(kept, by, _mean=F.avg(x), _sd=F.stddev_samp(x))
    near = F.abs(x - F.col("_mean")) <= max_sd * F.col("_sd")
    if by:
        near = near | F.col("_sd").isNull()
    return stats.where(near).drop("_mean", "_sd")


def session_order(session: str = "session") -> Column:
    n = F.col(session).try_cast("int")
    known = n.between(FIRST_TRAINING_SESSION, LAST_TRAINING_SESSION) & (F.col(session) == F.lpad(n.cast("string"), 2, "0"))
    return F.when(known, (n - FIRST_TRAINING_SESSION).cast("long"))


def add_session_order(df: DataFrame, session: str = "session") -> DataFrame:
    return df.withColumn("session_order", session_order(session))


def add_condition_labels(df: DataFrame) -> DataFrame:
    return (df.withColumn("enCon_label", label_map(ENCODING_LABELS, F.col("enCon").cast("int")))
            .withColumn("reCon_label", label_map(RETRIEVAL_LABELS, F.col("reCon").cast("int")))
            .withColumn("confidence_label", label_map(CONFIDENCE_LABELS, F.col("resp").cast("int"))))


def image_trials(df: DataFrame, tr: float, onset: str = "onset", kind: str = "trial_type",
                 rest=("rest", "fixation"), modality: str | None = None) -> DataFrame:
    """Drop rest rows and unknown types, optionally keep image trials only, and give each trial its scan volume."""
    kept = df.where(F.col(kind).isNotNull() & ~F.col(kind).isin(*rest))
    if modality:
        kept = kept.where(F.col(modality) == "image")
    return kept.withColumn("onset_tr", rint_long(F.col(onset) / tr))


def unexpected_values(df: DataFrame, allowed: dict = ALLOWED_VALUES) -> DataFrame:
    """One row per column and unexpected value with its count."""
    checked = [c for c in allowed if c in df.columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), num(c).alias("value"),
                                         num(c).isin(*allowed[c]).alias("ok")) for c in checked]))
    return (df.select(pairs.alias("x")).select("x.*").where(F.col("value").isNotNull() & ~F.col("ok"))
            .groupBy("column", "value").agg(F.count("*").alias("n")))


def missing_columns(df: DataFrame, expected: list[str]) -> list[str]:
    """Schema check on the driver; reads no rows."""
    return sorted(set(expected) - set(df.columns))


def validate_trials(df: DataFrame, expected: list[str], allowed: dict = ALLOWED_VALUES) -> DataFrame:
    """Warning rows: (problem, column, value, n)."""
    found = unexpected_values(df, allowed).select(F.lit("unexpected value").alias("problem"), "column", "value", "n")
    absent = missing_columns(df, expected)
    if not absent:
        return found
    rows = df.sparkSession.createDataFrame([("missing column", c, None, 0) for c in absent],
                                           "problem string, column string, value double, n long")
    return found.unionByName(rows)


def route_tasks(df: DataFrame, routes: dict[str, str], task: str = "task") -> DataFrame:
    """Attach the processing stream of a task; unknown tasks get NULL."""
    return df.withColumn("stream", label_map(routes, F.col(task)))
