"""Stimulus registries, reference checks, annotations, session tables and design tables."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import div, half_even, num, rint_long, whole
from ..functions.scan import id_block, row_index

# Words left out of a title, chunk length in seconds and volumes.
STOP_WORDS = ("the", "a", "an", "of")
CHUNK_S, CHUNK_VOLUMES = 4.5, 3


@F.pandas_udf(T.StringType())
def _decomposed(titles: pd.Series) -> pd.Series:
    """Compatibility decomposition, for which there is no built-in function: letters apart from their accents."""
    return titles.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


def norm_tokens(title) -> Column:
    """Comparable tokens of a title: decomposed, plain lower-case letters and digits (a decomposed accent is no letter,
    so it ends the token), '&' as 'and', quotes dropped, a lone 's' joined to the word before it, stop words
    dropped."""
    s = F.lower(_decomposed(title))
    s = F.regexp_replace(F.regexp_replace(s, "&", " and "), "[’']", "")
    s = F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))
    s = F.regexp_replace(F.regexp_replace(s, rf"\b({'|'.join(STOP_WORDS)})\b", ""), r"\s+", " ")
    s = F.regexp_replace(F.trim(s), r"(?<=\S) s(?= |$)", "s")
    return F.filter(F.split(F.trim(s), " "), lambda x: x != "")


def slug(title) -> Column:
    return F.array_join(norm_tokens(title), "-")


def match_titles(titles: DataFrame, files: DataFrame) -> DataFrame:
    """Best file per title: equal token lists (3), one a prefix of the other (2), one a subset of the other (1).
    A tie at the best score leaves the file NULL. Candidates come from equi-joins: whole lists, list prefixes,
    and for subsets the smaller side's rarest token. `titles` holds (title, tokens), `files` (file, tokens)."""
    sig = lambda c: F.array_join(c, " ")
    t = titles.where(F.size("tokens") > 0).select(sig("tokens").alias("tk"), F.col("tokens").alias("tt")).distinct()
    f = (files.where(F.size("tokens") > 0).groupBy(sig("tokens").alias("fk")).agg(
        F.first("tokens").alias("ft"), F.count("*").alias("n"), F.min("file").alias("file")))
    prefixes = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.size(c)), lambda i: F.array_join(F.slice(c, 1, i), " ")))

    def rarest(left, lt, lk, pool, pt):
        seen = pool.select(F.explode(F.array_distinct(pt)).alias("_w")).groupBy("_w").agg(F.count("*").alias("_n"))
        words = left.select(lk, F.explode(F.array_distinct(lt)).alias("_w")).join(seen, "_w", "left")
        words = words.groupBy(lk).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_w"))).alias("_b"))
        return left.join(words.select(lk, F.col("_b._w").alias("_w")), lk)

    exact = t.join(f, t.tk == f.fk).select("tk", "fk", F.lit(3).alias("score"))
    pre = (t.join(f.select("fk", prefixes("ft").alias("_p")), F.col("tk") == F.col("_p")).select("tk", "fk")
           .unionByName(f.join(t.select("tk", prefixes("tt").alias("_p")), F.col("fk") == F.col("_p")).select("tk", "fk"))
           .withColumn("score", F.lit(2)))
    inside = lambda a, b: F.size(F.array_except(a, b)) == 0
    sub1 = (rarest(t, "tt", "tk", f, "ft").join(f.select("fk", "ft", F.explode(F.array_distinct("ft")).alias("_w")), "_w")
            .where(inside("tt", "ft")).select("tk", "fk"))
    sub2 = (rarest(f, "ft", "fk", t, "tt").join(t.select("tk", "tt", F.explode(F.array_distinct("tt")).alias("_w")), "_w")
            .where(inside("ft", "tt")).select("tk", "fk"))
    pairs = exact.unionByName(pre).unionByName(sub1.unionByName(sub2).withColumn("score", F.lit(1)))
    best = pairs.groupBy("tk", "fk").agg(F.max("score").alias("score")).join(f.select("fk", "n", "file"), "fk")
    by_score = best.groupBy("tk", "score").agg(F.sum("n").alias("n_best"), F.min("file").alias("file"))
    top = by_score.groupBy("tk").agg(F.max(F.struct("score", "n_best", "file")).alias("_b")).select("tk", "_b.*")
    return (titles.join(top, sig("tokens") == F.col("tk"), "left").drop("tk")
            .withColumn("file", F.when(F.col("n_best") == 1, F.col("file"))))


def canonical_spellings(df: DataFrame, name: str, length: str) -> DataFrame:
    """Per lower-cased name: the most frequent spelling (the greater one on a tie), the others, and whether
    the recorded lengths disagree. Spellings are counted first, so only distinct ones are listed."""
    x = df.where(F.trim(F.col(name)) != "").withColumn("_s", F.trim(F.col(name))).withColumn("key", F.lower("_s"))
    c = x.groupBy("key", "_s").agg(F.count("*").alias("_n"))
    g = c.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("_n", "_s")), asc=False).alias("_l"), F.sum("_n").alias("n"))
    d = x.groupBy("key").agg(F.countDistinct(num(length)).alias("n_lengths"), F.min(num(length)).alias("length"))
    names = F.transform("_l", lambda e: e["_s"])
    return g.join(d, "key").select("key", names[0].alias("canonical"), F.array_join(F.slice(names, 2, F.size(names)), "|").alias("variants"),
                                   "n", "n_lengths", "length", (F.col("n_lengths") > 1).alias("conflict"))


def registry_integrity(df: DataFrame, key: str, files: DataFrame, expected_rows: int) -> DataFrame:
    s = df.agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_unique"))
    m = df.join(files.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("n_missing_files"))
    return s.crossJoin(m).withColumn("ok", (F.col("n_rows") == expected_rows) & (F.col("n_unique") == F.col("n_rows")) & (F.col("n_missing_files") == 0))


def unresolved_references(events: DataFrame, registries: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Values in the given columns that their registry lacks, with row counts. Values are counted before the
    anti join, so repeated references move once."""
    parts = []
    for column, (reg, key) in registries.items():
        used = events.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
        parts.append(used.join(reg.select(F.col(key).alias("value")).distinct(), "value", "left_anti").select(F.lit(column).alias("column"), "value", "n"))
    return reduce(DataFrame.unionByName, parts)


def shared_items(rows: DataFrame, keys, pair: str, fixed) -> DataFrame:
    """Stable mapping per pair: the fixed columns have one value each, else the row is marked unstable."""
    g = rows.groupBy(*keys, pair).agg(F.count("*").alias("n_presentations"), *[F.countDistinct(c).alias(f"_n_{c}") for c in fixed],
                                      *[F.min(c).alias(c) for c in fixed])
    ok = reduce(lambda a, b: a & b, [F.col(f"_n_{c}") == 1 for c in fixed])
    g = g.withColumn("stable", ok).drop(*[f"_n_{c}" for c in fixed])
    g = g.withColumn("role", F.when(F.col("enCon") == 3, "triplet").when(F.col("enCon") == 2, "single"))
    return g.withColumn("position", F.when(F.col("role") == "triplet", F.col(pair)).otherwise(0))


def verify(checks: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """OK / FAIL rows: each check counts the rows that break its condition."""
    parts = []
    for name, (df, ok) in checks.items():
        c = df.agg(F.count("*").alias("n_checked"), F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias("n_bad"))
        parts.append(c.select(F.lit(name).alias("check_name"), "n_checked", "n_bad", F.when(F.col("n_bad") == 0, "OK").otherwise("FAIL").alias("status")))
    return reduce(DataFrame.unionByName, parts)


def parse_clock(c) -> tuple[Column, Column]:
    """m.ss text or number to seconds, and whether the seconds field is out of range."""
    s = F.nullif(F.trim((F.col(c) if isinstance(c, str) else c).cast("string")), F.lit(""))
    part = lambda i: F.coalesce(F.nullif(F.split(s, ":")[i], F.lit("")).try_cast("double"), F.lit(0.0))
    v = s.try_cast("double")
    secs = F.rint(half_even(v - F.floor(v), 4) * 100)
    colon = F.contains(s, F.lit(":"))
    bad = F.coalesce(~colon & (secs > 59), F.lit(False))
    value = F.when(colon, part(0) * 60 + part(1)).when(secs <= 59, F.floor(v) * 60 + secs)
    return value, bad


def annotations_long(df: DataFrame, keys, levels) -> DataFrame:
    """Wide annotation rows to one row per level and segment; blank cells are skipped."""
    items = F.array(*[F.struct(F.lit(v).alias("level"), F.col(f"{v}_onset").cast("double").alias("onset"), F.col(f"{v}_offset").cast("double").alias("offset")) for v in levels])
    x = df.select(*keys, F.explode(items).alias("_x")).select(*keys, "_x.*")
    return x.where("onset is not null and offset is not null").withColumn("duration", F.col("offset") - F.col("onset"))


def apply_corrections(long: DataFrame, corrections: DataFrame, keys, fields=("onset", "offset")) -> DataFrame:
    """Corrections (keys, field, old, new) change a value only where the source still holds the old one."""
    out = long
    for f in fields:
        c = corrections.where(F.col("field") == f).select(*keys, F.col("old").alias("_old"), F.col("new").alias("_new"))
        out = out.join(c, list(keys), "left").withColumn(f"_hit_{f}", F.coalesce(F.col(f) == F.col("_old"), F.lit(False)))
        out = out.withColumn(f, F.when(F.col(f"_hit_{f}"), F.col("_new")).otherwise(F.col(f))).drop("_old", "_new")
    hit = reduce(lambda a, b: a | b, [F.col(f"_hit_{f}") for f in fields])
    return out.withColumn("corrected", hit).withColumn("duration", F.col("offset") - F.col("onset")).drop(*[f"_hit_{f}" for f in fields])


def refused_corrections(long: DataFrame, corrections: DataFrame, keys) -> DataFrame:
    """Corrections that do not apply, with the reason."""
    cur = long.select(*keys, F.col("onset").alias("_on"), F.col("offset").alias("_off"), F.lit(True).alias("_seen"))
    j = corrections.join(cur, list(keys), "left")
    have = F.when(F.col("field") == "onset", F.col("_on")).otherwise(F.col("_off"))
    reason = F.when(F.col("_seen").isNull(), "no such segment").when(F.coalesce(have != F.col("old"), F.lit(True)), "source differs")
    return j.withColumn("reason", reason).where("reason is not null").drop("_on", "_off", "_seen")


def check_annotations(long: DataFrame, lengths: DataFrame, keys, tolerance: float) -> DataFrame:
    """Last offset per item and level against the known length, and the number of negative durations."""
    g = long.groupBy(*keys, "level").agg(F.max("offset").alias("last_offset"), F.count(F.when(F.col("duration") < 0, 1)).alias("n_negative"))
    j = g.join(lengths.select(*keys, "length"), list(keys))
    return j.withColumn("problem", (F.abs(F.col("last_offset") - F.col("length")) > tolerance) | (F.col("n_negative") > 0))


def caption_table(captions: DataFrame, wanted: DataFrame, key: str, order: str, width: int) -> DataFrame:
    """A report format: captions 1 to `width` of each wanted item in columns, '' where there are fewer, and n_captions,
    which tells when there are more. caption_rows has all of them."""
    x = row_index(captions.join(wanted.select(key).distinct(), key, "left_semi"), [key], [order], id_block(order), "_i")
    g = x.groupBy(key).agg(F.count("*").alias("n_captions"), *[F.max(F.when(F.col("_i") == i, F.trim("caption"))).alias(f"caption_{i + 1}") for i in range(width)])
    return wanted.select(key).distinct().join(g, key, "left").fillna("", [f"caption_{i + 1}" for i in range(width)]).fillna(0, ["n_captions"])


def caption_rows(captions: DataFrame, wanted: DataFrame, key: str, order: str) -> DataFrame:
    x = row_index(captions.join(wanted.select(key).distinct(), key, "left_semi"), [key], [order], id_block(order), "_i")
    return x.select(key, (F.col("_i") + 1).alias("caption_index"), F.trim("caption").alias("caption"))


def instance_summary(instances: DataFrame, key: str, category: str, group: str) -> DataFrame:
    """Categories with counts, super-categories and totals per item. Instances are counted per category
    first; the lists hold distinct category names of a fixed vocabulary."""
    c = instances.groupBy(key, category, group).agg(F.count("*").alias("_n"))
    cats = F.array_sort(F.collect_list(F.struct(F.col(category).alias("c"), F.col("_n").alias("n"))))
    g = c.groupBy(key).agg(cats.alias("_l"), F.array_sort(F.collect_set(group)).alias("_g"), F.sum("_n").alias("n_instances"), F.count("*").alias("n_categories"))
    return g.select(key, F.array_join(F.transform("_l", lambda e: e["c"]), "; ").alias("categories"),
                    F.array_join(F.transform("_l", lambda e: F.concat(e["c"], F.lit(":"), e["n"].cast("string"))), "; ").alias("counts"),
                    F.array_join("_g", "; ").alias("groups"), "n_instances", "n_categories")


def join_completeness(rows: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """How complete a join on the key is: matched registry entries, entries without rows, unknown keys."""
    k, r = rows.select(key).distinct(), registry.select(key).distinct()
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(r.join(k, key, "left_semi"), "n_matched").crossJoin(n(r.join(k, key, "left_anti"), "n_without_rows")).crossJoin(
        n(k.join(r, key, "left_anti"), "n_unknown"))


def transcript_union(items: DataFrame, segments: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Segments with speech, and the items that have none."""
    spoken = segments.where(F.trim(F.coalesce(text, F.lit(""))) != "").join(items.select(key).distinct(), key, "left_semi")
    return spoken, items.select(key).distinct().join(spoken.select(key).distinct(), key, "left_anti")


def number_text(c) -> Column:
    """Whole-valued numbers without the decimal point, 'n/a' for missing."""
    v = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.when(F.rint(v) == v, v.cast("long").cast("string")).otherwise(v.cast("string")), F.lit("n/a"))


def session_table(log: DataFrame, questionnaire: DataFrame, exceptions: DataFrame, flags, answers) -> DataFrame:
    """Session log with questionnaire answers of the same person and day, flags as true/false text, notes
    cleaned, and exception columns. Keys: subject, day."""
    x = log.withColumn("acq_date", F.to_date("acq_time"))
    q = questionnaire.withColumn("acq_date", F.to_date("filled_at")).select("subject", "acq_date", *answers)
    j = x.join(q, ["subject", "acq_date"], "left").join(exceptions, ["subject", "session"], "left")
    j = j.withColumns({f: F.when(F.col(f) == 1, "true").otherwise("false") for f in flags})
    j = j.withColumns({a: number_text(a) for a in answers})
    return (j.withColumn("acq_date", F.date_format("acq_date", "yyyy-MM-dd"))
            .withColumn("note", F.regexp_replace(F.regexp_replace(F.trim(F.coalesce("note", F.lit(""))), "\n", " "), "\r", ""))
            .withColumn("exception", F.coalesce("exception", F.lit("")))
            .withColumn("verified", F.when(F.col("exception") != "", F.col("verified")).otherwise("n/a")))


def phenotype(df: DataFrame, id_map: DataFrame, key: str, items: dict[str, str], total: str) -> DataFrame:
    """Mapped ids, renamed items and their row total (missing items count as 0)."""
    x = df.join(id_map, key).select("participant_id", *[num(old).alias(new) for old, new in items.items()])
    return x.withColumn(total, reduce(lambda a, b: a + b, [F.coalesce(F.col(n), F.lit(0.0)) for n in items.values()]))


def clean_text(c) -> Column:
    s = F.trim(F.regexp_replace((F.col(c) if isinstance(c, str) else c).cast("string"), r"\s+", " "))
    return F.when(s.isNull() | s.isin("", "nan", "None"), "n/a").otherwise(s)


def condition_id(item, cue=None) -> Column:
    """Plain integer text of an id (998.0 becomes 998), optionally crossed with the cue."""
    c = F.col(item) if isinstance(item, str) else item
    base = F.coalesce(whole(c).cast("string"), c.cast("string"), F.lit("n/a"))
    return base if cue is None else F.concat_ws("_", base, cue)


def condition_map(trials: DataFrame, condition: str, order: str) -> DataFrame:
    """Dense column index by first appearance and the number of presentations."""
    g = trials.groupBy(condition).agg(F.min(order).alias("first_seen"), F.count("*").alias("n_presentations"))
    return row_index(g, [], ["first_seen"], id_block("first_seen"), "col_index")


def repetition_histogram(conditions: DataFrame) -> DataFrame:
    return conditions.groupBy("n_presentations").agg(F.count("*").alias("n_conditions"))


def chunk_conditions(events: DataFrame, movie: str, duration: str, order: str) -> DataFrame:
    """Movies cut to whole chunks of their shortest presentation, with a dense index over all chunks."""
    g = events.groupBy(movie).agg(F.floor(F.min(duration) / CHUNK_S).alias("n_chunks"), F.min(order).alias("_first"), F.count("*").alias("n_presentations"))
    x = g.where("n_chunks >= 1").withColumn("chunk_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1)))
    return row_index(x, [], ["_first", "chunk_idx"], id_block("_first"), "col_index").drop("_first")


def design_rows(trials: DataFrame, conditions: DataFrame, condition: str, volumes: DataFrame, run: str, tr: float, chunked: bool = False) -> DataFrame:
    """Sparse design: one row per trial (and chunk) with its onset volume, column, and whether it is inside
    the run and the only use of its column in that run. Uses are counted over runs and columns, which hold a few rows each;
    these are dealt out anew, so that a task never sorts for the count and for the join before it."""
    j = trials.join(conditions.drop("n_presentations", "first_seen"), condition).join(volumes.select(run, "n_volumes"), run)
    vol = rint_long(F.col("onset") / tr)
    if chunked:
        vol = vol + CHUNK_VOLUMES * F.col("chunk_idx")
    j = j.withColumn("onset_vol", vol).withColumn("inside", (F.col("onset_vol") >= 0) & (F.col("onset_vol") < F.col("n_volumes")))
    used = F.count("*").over(Window.partitionBy(run, "col_index"))
    return j.repartition(run, "col_index").withColumn("unique_in_run", used == 1)


def spike_regressors(volumes: DataFrame, run, volume: str, fd: str, threshold: float) -> DataFrame:
    """One regressor per volume over the displacement limit, numbered within the run."""
    hot = volumes.where(num(fd) > threshold).select(*run, volume)
    return row_index(hot, run, [volume], id_block(volume), "spike")


def cue_purity(trials: DataFrame, run, cue: str) -> DataFrame:
    """The single cue of each run; runs that mix cues are marked."""
    return trials.where(F.col(cue).isNotNull()).groupBy(*run).agg(F.countDistinct(cue).alias("n_cues"), F.min(cue).alias("cue"), F.count("*").alias("n_trials"))


def runs_with_cue(trials: DataFrame, run, cue: str, wanted: str) -> DataFrame:
    pure = cue_purity(trials, run, cue).where((F.col("n_cues") == 1) & (F.col("cue") == wanted))
    return trials.join(pure.select(*run), list(run), "left_semi")
