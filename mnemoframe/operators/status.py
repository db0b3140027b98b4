"""Completeness of processing steps per session, and what can run next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import with_group_stats

STATES = ["complete", "partial", "missing", "skipped", "error"]


def state_from_counts(expected: Column, found: Column) -> Column:
    return (F.when(expected == 0, "skipped").when(found == 0, "missing").when(found < expected, "partial").otherwise("complete"))


def with_state(df: DataFrame, expected: str = "expected", found: str = "found") -> DataFrame:
    over = F.col(found) > F.col(expected)
    return (df.withColumn("status", state_from_counts(F.col(expected), F.col(found)))
            .withColumn("note", F.when(over & (F.col(expected) > 0), F.concat(
                F.lit("Found "), F.col(found).cast("string"), F.lit(" outputs; only "), F.col(expected).cast("string"), F.lit(" expected.")))))


def _wanted(runs: DataFrame, steps) -> DataFrame:
    """Each run with each step it is routed to. `steps` is the declared list of (step, marker, stream, needs_sibling);
    stream None takes every run. The list becomes an array of constants, so nothing is joined."""
    item = lambda s, m, sib: F.struct(F.lit(s).alias("step"), F.lit(m).alias("marker"), F.lit(sib).alias("needs_sibling"))
    some = F.array_compact(F.array(*[item(s, m, sib) if stream is None else F.when(F.col("stream") == stream, item(s, m, sib)) for s, m, stream, sib in steps]))
    return runs.withColumn("_s", F.explode(some)).select(*runs.columns, "_s.*")


def step_completeness(runs: DataFrame, outputs: DataFrame, steps, keys=("subject", "session")) -> DataFrame:
    """Expected runs against outputs carrying the step's marker; an output without its sibling makes the
    step an error. `outputs` holds (run_id, marker, has_sibling)."""
    keys = list(keys)
    out = outputs.groupBy("run_id", "marker").agg(F.max("has_sibling").alias("_sib"))
    j = _wanted(runs, steps).join(out, ["run_id", "marker"], "left").withColumn("_hit", F.col("_sib").isNotNull())
    g = j.groupBy(*keys, "step").agg(
        F.count("*").alias("expected"), F.count(F.when(F.col("_hit"), 1)).alias("found"),
        F.count(F.when(F.col("needs_sibling") & F.col("_hit") & ~F.col("_sib"), 1)).alias("n_incomplete"))
    return with_state(g).withColumn("status", F.when(F.col("n_incomplete") > 0, "error").otherwise(F.col("status")))


def missing_details(runs: DataFrame, outputs: DataFrame, steps, keys=("subject", "session")) -> DataFrame:
    """Every missing run of a session and step, with the number of them."""
    gone = _wanted(runs, steps).join(outputs.select("run_id", "marker").distinct(), ["run_id", "marker"], "left_anti").select(*keys, "step", "run_id")
    return with_group_stats(gone, [*keys, "step"], n_missing=F.count("*"))


def status_table(sessions: DataFrame, completeness: DataFrame, steps, keys=("subject", "session")) -> DataFrame:
    """One row per session and declared step; a step with nothing expected is skipped."""
    grid = sessions.select(*keys).distinct().withColumn("step", F.explode(F.array(*[F.lit(x[0]) for x in steps])))
    j = grid.join(completeness.select(*keys, "step", "expected", "found", "status"), [*keys, "step"], "left")
    return (j.withColumn("status", F.coalesce("status", F.lit("skipped"))).fillna(0, ["expected", "found"]))


def runnable(table: DataFrame, edges: DataFrame, keys=("subject", "session")) -> DataFrame:
    """Sessions where every prerequisite is complete and the step itself is neither complete nor skipped.
    `edges` holds (step, needs)."""
    open_ = table.where(~F.col("status").isin("complete", "skipped")).select(*keys, "step")
    blocked = (open_.join(edges, "step").join(table.where(F.col("status") != "complete").select(*keys, F.col("step").alias("needs")), [*keys, "needs"])
               .select(*keys, "step").distinct())
    return open_.join(blocked, [*keys, "step"], "left_anti")


def status_matrix(table: DataFrame, states=STATES) -> DataFrame:
    return table.groupBy("step").pivot("status", list(states)).agg(F.count(F.lit(1))).fillna(0)
