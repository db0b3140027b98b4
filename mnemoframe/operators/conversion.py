"""Task logs to event tables. Every operator works on the logs of many files at once, keyed by `keys`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import div, num, rint_long, top_per_group
from ..functions.quantiles import exact_quantiles
from ..functions.scan import id_block, ordered_neighbours, running_total

# Trial spacing of the tasks (seconds), tick length (ms), filler words, sweep directions.
FIRST_TRIAL, TRIAL_STEP, IMAGE_S, WORD_S = 9.0, 4.5, 3.0, 0.54
FIRST_MATH = 6.0
TICK_MS = 2.5
FILLERS = ("um", "uh", "hmm", "mm", "mhm")
TRIM_CHARS = ".,!?…'\""


def np_round(c, digits: int) -> Column:
    """Scale, round half to even, scale back."""
    c = F.col(c) if isinstance(c, str) else c
    return F.rint(c * 10 ** digits) / 10 ** digits


def phase(kind: str, onset: Column, duration: Column, **more) -> Column:
    return F.struct(F.lit(kind).alias("trial_type"), onset.cast("double").alias("onset"), duration.cast("double").alias("duration"),
                    *[v.alias(k) for k, v in more.items()])


def _unfold(df: DataFrame, keep, phases) -> DataFrame:
    """One output row per phase; NULL phases vanish."""
    return df.select(*keep, F.explode(F.array_compact(F.array(*phases))).alias("_p")).select(*keep, "_p.*")


def _merged(beh: DataFrame, timing: DataFrame, keys, trial: str, previous: str | None = None) -> DataFrame:
    """Behaviour joined with timing on the trial, with the 0-based position in the run and, if asked, the
    previous trial's value of a timing column."""
    j = beh.join(timing, [*keys, trial])
    exprs = {"_prev": lambda w: F.lag(previous).over(w)} if previous else {}
    return ordered_neighbours(j, keys, [trial], id_block(trial), before=1 if previous else 0, idx="_i", **exprs)


def _blank_on_rest(df: DataFrame, columns, rest: Column) -> DataFrame:
    return df.select(*[F.when(~rest, F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def encoding_events(beh: DataFrame, timing: DataFrame, keys, trial: str, metadata) -> DataFrame:
    """Image row and word row per trial; one row for rest (no word, or pair 0), with metadata blanked and the
    previous fixation end as its actual onset."""
    m = _merged(beh, timing, keys, trial, "fixation_end")
    rest = F.col("word").isNull() | (F.coalesce(num("pairId"), F.lit(-1.0)) == 0)
    m = m.withColumn("_rest", rest)
    m = _blank_on_rest(m, metadata, F.col("_rest"))
    at = FIRST_TRIAL + TRIAL_STEP * F.col("_i")
    word = F.col("word_end") - F.col("word_start")
    none = F.lit(None).cast("string")

    def row(kind, cond, dur, on_actual, dur_actual, modality):
        return F.when(cond, phase(kind, at, dur, onset_actual=on_actual, duration_actual=dur_actual, modality=modality))

    rest_onset = F.when(F.col("_i") == 0, F.col("image_start")).otherwise(F.col("_prev"))
    return _unfold(m, [*keys, trial, *metadata], [
        row("rest", F.col("_rest"), F.lit(IMAGE_S), rest_onset, F.lit(IMAGE_S), none),
        row("image", ~F.col("_rest"), F.lit(IMAGE_S), F.col("image_start"), F.col("image_end") - F.col("image_start"), F.lit("visual")),
        row("word", ~F.col("_rest"), word, F.col("word_start"), word, F.lit("auditory"))])


def math_events(beh: DataFrame, timing: DataFrame, keys, trial: str) -> DataFrame:
    m = _merged(beh, timing, keys, trial)
    return m.select(*keys, trial, F.lit("math").alias("trial_type"), (FIRST_MATH + TRIAL_STEP * F.col("_i")).alias("onset"),
                    F.lit(3.0).alias("duration"), F.col("image_start").alias("onset_actual"),
                    (F.col("image_end") - F.col("image_start")).alias("duration_actual"))


def retrieval_events(beh: DataFrame, timing: DataFrame, keys, trial: str, metadata, final: bool = False) -> DataFrame:
    """Cue type from the timing pair that is filled. Rest lasts 3 s, or in the final session 3 s in runs
    with any image cue and the word length otherwise; the first row's rest has no actual onset."""
    m = _merged(beh, timing, keys, trial, "fixation_end")
    m = m.withColumn("_rest", F.col("cueId").isNull() | (F.trim(F.col("cueId").cast("string")) == ""))
    image = F.col("image_start").isNotNull() & F.col("image_end").isNotNull()
    word = F.col("word_start").isNotNull() & F.col("word_end").isNotNull()
    rest_s = F.lit(IMAGE_S)
    if final:
        per_run = m.groupBy(*keys).agg(F.max(image & ~F.col("_rest")).alias("_any_image"))
        m = m.join(per_run, list(keys))
        rest_s = F.when(F.coalesce("_any_image", F.lit(False)), IMAGE_S).otherwise(WORD_S)
    m = _blank_on_rest(m, metadata, F.col("_rest"))
    r = F.col("_rest")
    return m.select(
        *keys, trial, *metadata, (FIRST_TRIAL + TRIAL_STEP * F.col("_i")).alias("onset"),
        F.when(r, rest_s).when(image, IMAGE_S).otherwise(WORD_S).alias("duration"),
        F.when(r, F.col("_prev")).when(image, F.col("image_start")).when(word, F.col("word_start")).alias("onset_actual"),
        F.when(r, rest_s).when(image, F.col("image_end") - F.col("image_start")).when(word, F.col("word_end") - F.col("word_start")).alias("duration_actual"),
        F.when(r, "rest").when(image, "image").otherwise("word").alias("trial_type"),
        F.when(r, F.lit(None)).when(image, "visual").otherwise("auditory").alias("modality"))


def renumber_sessions(df: DataFrame, offsets: dict[str, int], task: str = "task", session: str = "session") -> DataFrame:
    c = F.lit(0)
    for name, k in offsets.items():
        c = F.when(F.col(task) == name, k).otherwise(c)
    return df.withColumn("bids_session", F.col(session) + c)


def parse_log_name(df: DataFrame, name: str = "file_name", rules: tuple = ()) -> DataFrame:
    """Subject, session and run numbers from a log name, and the task by the first rule (pattern, task) that
    matches."""
    task = F.lit(None).cast("string")
    for pattern, t in reversed(rules):
        task = F.when(F.col(name).rlike(pattern), t).otherwise(task)
    part = lambda p: F.regexp_extract(name, p, 1).try_cast("int")
    return (df.withColumn("subject_no", part(r"sub-?(\d+)")).withColumn("session_no", part(r"ses(?:s|sion)?-?(\d+)"))
            .withColumn("run_no", part(r"run-?(\d+)")).withColumn("task", task))


def pair_timing(logs: DataFrame, timing: DataFrame, keys) -> DataFrame:
    """Best timing file per log: lowest priority number, then name. An aggregate, not a window."""
    best = timing.groupBy(*keys).agg(F.min(F.struct("priority", "timing_name")).alias("_b"))
    return logs.join(best.select(*keys, F.col("_b.timing_name").alias("timing_name")), list(keys), "left")


def _clock_zero(log: DataFrame, keys, row: str, started: str) -> DataFrame:
    """Last non-missing start per file in row order."""
    return log.where(F.col(started).isNotNull()).groupBy(*keys).agg(F.max_by(started, row).alias("_zero"))


def _first(c: str, row: str) -> Column:
    return F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(row)))


def movie_events(log: DataFrame, keys, row: str) -> DataFrame:
    """Title, fixation (if timed) and movie rows per trial on the scanner clock, and one trailing blank.
    Files without trial rows or without a clock start give nothing."""
    zero = _clock_zero(log, keys, row, "wait_started")
    z = F.col("_zero")
    tr = log.where("trial_n is not null").join(zero, list(keys))
    meta = lambda on: {"movie_name": F.when(F.lit(on), F.col("movie_name"))}
    fix = F.col("fixation_started").isNotNull() & F.col("fixation_stopped").isNotNull()
    rows = _unfold(tr.withColumn("trial_num", F.col("trial_n") + 1), [*keys, "trial_num"], [
        phase("title", F.col("title_started") - z, F.col("title_stopped") - F.col("title_started"), **meta(False)),
        F.when(fix, phase("fixation", F.col("fixation_started") - z, F.col("fixation_stopped") - F.col("fixation_started"), **meta(False))),
        phase("movie", F.col("movie_started") - z, F.col("movie_stopped") - F.col("movie_started"), **meta(True))])
    tail = (log.groupBy(*keys).agg(F.max(F.col("trial_n").isNotNull()).alias("_any"), _first("blank_started", row).alias("_b"), _first("stop_stopped", row).alias("_s"))
            .where("_any and _b is not null and _s is not null").join(zero, list(keys)))
    tail = tail.select(*keys, F.lit(None).cast("long").alias("trial_num"), F.lit("blank").alias("trial_type"),
                       (F.col("_b") - z).alias("onset"), (F.col("_s") - F.col("_b")).alias("duration"), F.lit(None).cast("string").alias("movie_name"))
    return rows.unionByName(tail)


def _given(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.trim(F.col(c)).isin("", "None")


def recall_events(log: DataFrame, keys, row: str) -> DataFrame:
    """Blank, prompt, cue and recall rows per trial. The cue answer is 7 when an image stayed longer than .1 s,
    else the key (with a fallback column); an open-ended recall has no duration."""
    zero = _clock_zero(log, keys, row, "wait_started")
    z = F.col("_zero")
    tr = log.where("trial_n is not null").join(zero, list(keys)).withColumn("trial_num", F.col("trial_n") + 1)
    shown = F.coalesce(F.col("image_stopped") - F.col("image_started") > 0.1, F.lit(False))
    key = F.trim(F.when(_given("key_main"), F.col("key_main")).when(_given("key_other"), F.col("key_other")))
    answer = F.when(shown, 7).when(key.isin("7", "7.0", "apostrophe"), 7).when(key.isin("6", "6.0"), 6).otherwise(num(key).cast("int"))
    cue_on = F.when(shown, F.col("image_started")).otherwise(F.col("plus_started")) - z
    cue_s = F.when(shown, F.col("image_stopped") - F.col("image_started")).otherwise(F.lit(0.0))
    none = F.lit(None).cast("int")
    return _unfold(tr, [*keys, "trial_num"], [
        phase("blank", F.col("recall_started") - z, F.col("prompt_started") - F.col("recall_started"), cue_response=none),
        phase("prompt", F.col("prompt_started") - z, F.col("prompt_stopped") - F.col("prompt_started"), cue_response=none),
        phase("cue", cue_on, cue_s, cue_response=answer),
        phase("recall", F.col("plus_started") - z, F.col("recall_stopped") - F.col("plus_started"), cue_response=answer)])


def two_phase_events(df: DataFrame, keep, start: str, end: str, fixation_end: str, kind: str) -> DataFrame:
    return _unfold(df, keep, [phase(kind, F.col(start), F.col(end) - F.col(start)),
                              phase("fixation", F.col(end), F.col(fixation_end) - F.col(end))])


def motor_events(df: DataFrame, keep, onset: str = "onset_s", offset: str = "offset_s") -> DataFrame:
    return df.select(*keep, F.col(onset).alias("onset"), (F.col(offset) - F.col(onset)).alias("duration"))


def calibration_events(log: DataFrame, keys) -> DataFrame:
    """Files with exactly one `movie` row and one sync marker at 0 give an event; others carry the reason."""
    mv, sy = F.col("event") == "movie", F.col("event") == "sync"
    g = log.groupBy(*keys).agg(F.count(F.when(mv, 1)).alias("n_movie"), F.count(F.when(sy, 1)).alias("n_sync"),
                               F.min(F.when(mv, F.col("onset_s"))).alias("_on"), F.min(F.when(mv, F.col("offset_s"))).alias("_off"),
                               F.min(F.when(sy, F.col("onset_s"))).alias("_sync"))
    problem = F.when(F.col("n_movie") != 1, "movie rows").when((F.col("n_sync") != 1) | (F.col("_sync") != 0), "sync marker")
    g = g.withColumn("problem", problem)
    return g.select(*keys, "problem", F.when(F.col("problem").isNull(), F.col("_on")).alias("onset"),
                    F.when(F.col("problem").isNull(), F.col("_off") - F.col("_on")).alias("duration"))


def truncate_events(events: DataFrame, lengths: DataFrame, keys, tolerance: float = 1e-3) -> DataFrame:
    """Cut events to the acquired length; files of unknown length stay as they are."""
    j = events.join(lengths.select(*keys, "run_s"), list(keys), "left")
    keep = F.col("run_s").isNull() | (F.col("onset") < F.col("run_s") - tolerance)
    over = F.coalesce(F.col("onset") + F.col("duration") > F.col("run_s") + tolerance, F.lit(False))
    return (j.where(keep).withColumn("clipped", over)
            .withColumn("duration", F.when(over, F.col("run_s") - F.col("onset")).otherwise(F.col("duration"))).drop("run_s"))


def truncation_counts(events: DataFrame, lengths: DataFrame, keys, tolerance: float = 1e-3) -> DataFrame:
    j = events.join(lengths.select(*keys, "run_s"), list(keys))
    late = F.col("onset") >= F.col("run_s") - tolerance
    over = ~late & (F.col("onset") + F.col("duration") > F.col("run_s") + tolerance)
    return j.groupBy(*keys).agg(F.count(F.when(late, 1)).alias("n_dropped"), F.count(F.when(over, 1)).alias("n_clipped"))


def block_events(trials: DataFrame, keys, totals: DataFrame, size: int) -> DataFrame:
    """Trials collapsed to blocks; a block has a fixed size and one condition, lasts to the next block's start,
    and the last one to the end of the task. Blocks that break a rule are marked."""
    b = trials.groupBy(*keys, "block").agg(
        F.count("*").alias("n_trials"), F.countDistinct("condition").alias("n_conditions"), F.min("condition").alias("condition"),
        F.min("onset").alias("_start"), F.sum("oddball").alias("n_oddball"), F.sum("response").alias("n_response"))
    b = ordered_neighbours(b, keys, ["block"], id_block("block"), after=1, _next=lambda w: F.lead("_start").over(w))
    b = b.join(totals.select(*keys, "total_time"), list(keys))
    return b.select(*keys, "block", np_round("_start", 3).alias("onset"),
                    np_round(F.coalesce("_next", "total_time") - F.col("_start"), 3).alias("duration"), "condition", "n_oddball", "n_response",
                    ((F.col("n_trials") == size) & (F.col("n_conditions") == 1)).alias("valid"))


def run_completeness(runs: DataFrame, keys, run: str = "run") -> DataFrame:
    """Are the resolved runs exactly 1..N? Decided from counts, so no list of runs is gathered."""
    g = runs.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(run).alias("n_distinct"), F.min(run).alias("first"), F.max(run).alias("last"))
    return g.withColumn("complete", (F.col("first") == 1) & (F.col("last") == F.col("n")) & (F.col("n_distinct") == F.col("n")))


def self_paced_events(df: DataFrame, keys, trial: str, rt: str = "resp_RT") -> DataFrame:
    """Onset = sum of the earlier reaction times, duration = own reaction time."""
    x = num(rt)
    return running_total(df, keys, [trial], id_block(trial), x, "onset", inclusive=False).withColumn("duration", x)


def word_events(words: DataFrame) -> DataFrame:
    chars = "".join("\\" + c if c in ".?'\"" else c for c in TRIM_CHARS)
    clean = F.lower(F.regexp_replace(F.regexp_replace("word", f"^[{chars}]+", ""), f"[{chars}]+$", ""))
    return (words.withColumn("filler", clean.isin(*FILLERS).cast("int"))
            .withColumn("duration", np_round(F.col("offset") - F.col("onset"), 3)).withColumn("onset", np_round("onset", 3)))


def regular_grid(samples: DataFrame, keys, tick: str, value: str, order: str, sample_ms: float) -> DataFrame:
    """Irregular ticks to an even grid, taking the last value at or before each grid point. Each sample emits
    the grid points up to the next sample, so the grid of a long file never sits in one row."""
    step = sample_ms / TICK_MS
    span = samples.groupBy(*keys).agg(F.min(tick).alias("_t0"), F.max(tick).alias("_t1"))
    s = ordered_neighbours(samples, keys, [tick, order], id_block(tick), after=1, _next=lambda w: F.lead(tick).over(w))
    s = s.join(span, list(keys))
    last = rint_long((F.col("_t1") - F.col("_t0")) / step)
    lo = F.ceil((F.col(tick) - F.col("_t0")) / step)
    hi = F.when(F.col("_next").isNull(), last).otherwise(F.least(F.ceil((F.col("_next") - F.col("_t0")) / step) - 1, last))
    return (s.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi")
            .select(*keys, "_t0", F.explode(F.sequence("_lo", "_hi")).alias("sample"), F.col(value).alias("value"))
            .select(*keys, "sample", (F.col("_t0") + F.col("sample") * step).alias("tick"), "value"))


def start_times(samples: DataFrame, volumes: DataFrame, keys, tick: str) -> DataFrame:
    """Seconds from volume 0 to the first sample; 0 where no volume is known."""
    f = samples.groupBy(*keys).agg(F.min(tick).alias("first_tick"))
    j = f.join(volumes.select(*keys, "vol0_tick"), list(keys), "left")
    return j.withColumn("start_time", F.coalesce((F.col("first_tick") - F.col("vol0_tick")) * TICK_MS / 1000, F.lit(0.0)))


def trigger_windows(triggers: DataFrame, keys, time: str = "t", code: str = "code", scan_code: int = 255) -> DataFrame:
    hit = F.col(code) == scan_code
    return triggers.groupBy(*keys).agg(F.count(F.when(hit, 1)).alias("n_triggers"), F.min(F.when(hit, F.col(time))).alias("scan_start"),
                                       F.max(F.when(hit, F.col(time))).alias("scan_end"))


def trim_to_scan(samples: DataFrame, windows: DataFrame, keys, time: str = "t", gaze=("x", "y"), pupil: str = "pupil") -> DataFrame:
    """Samples between the first and last trigger (at least two); gaze NaN and pupil 0 become missing."""
    w = windows.where("n_triggers >= 2").select(*keys, "scan_start", "scan_end")
    s = samples.join(w, list(keys)).where(F.col(time).between(F.col("scan_start"), F.col("scan_end"))).drop("scan_start", "scan_end")
    for g in gaze:
        s = s.withColumn(g, num(g))
    return s.withColumn(pupil, F.when(F.col(pupil) != 0, F.col(pupil)))


def eye_triage(samples: DataFrame, windows: DataFrame, keys, time: str = "t", gaze: str = "x", pupil: str = "pupil", viable: float = 0.6) -> DataFrame:
    """Valid share of gaze and pupil inside the scan window (whole recording with fewer than two triggers),
    viability and the decision on channels."""
    j = samples.join(windows, list(keys), "left").withColumn("n_triggers", F.coalesce("n_triggers", F.lit(0)))
    few = F.col("n_triggers") < 2
    inside = few | F.col(time).between(F.col("scan_start"), F.col("scan_end"))
    g = j.groupBy(*keys).agg(
        F.max("n_triggers").alias("n_triggers"), F.count("*").alias("n_samples"), F.count(F.when(inside, 1)).alias("_n"),
        F.count(F.when(inside & num(gaze).isNotNull(), 1)).alias("_g"), F.count(F.when(inside & (F.col(pupil) > 0), 1)).alias("_p"))
    gv, pv = F.coalesce(div("_g", "_n"), F.lit(0.0)), F.coalesce(div("_p", "_n"), F.lit(0.0))
    g = g.withColumn("gaze_viable", gv >= viable).withColumn("pupil_viable", pv >= viable)
    return (g.withColumn("gaze_valid_pct", F.bround(100 * gv, 1)).withColumn("pupil_valid_pct", F.bround(100 * pv, 1))
            .withColumn("decision", F.when(F.col("gaze_viable") | F.col("pupil_viable"), "include").otherwise("exclude"))
            .withColumn("channels", F.when(F.col("gaze_viable") & F.col("pupil_viable"), "gaze+pupil").when(F.col("gaze_viable"), "gaze_only")
                        .when(F.col("pupil_viable"), "pupil_only").otherwise(""))
            .withColumn("note", F.when(F.col("n_triggers") < 2, "insufficient triggers").otherwise("")).drop("_n", "_g", "_p"))


def physio_triage(volume_starts: DataFrame, recordings: DataFrame, keys, tick: str, complete: float = 0.9, partial: float = 0.5) -> DataFrame:
    """Repetition time from the median gap between volume starts, recorded over expected duration, state.
    `recordings` holds the longest waveform's sample count and sample ticks; none means info only."""
    d = ordered_neighbours(volume_starts, keys, [tick], id_block(tick), after=1, _gap=lambda w: F.lead(tick).over(w) - F.col(tick))
    n = volume_starts.groupBy(*keys).agg(F.count("*").alias("num_volumes"))
    tr = exact_quantiles(d, keys, "_gap", {"_med": .5})
    j = recordings.join(n, list(keys), "left").join(tr, list(keys), "left")
    j = j.withColumn("tr_ms", F.coalesce(F.bround(F.col("_med") * TICK_MS, 1), F.lit(0.0)))
    j = j.withColumn("rec_dur", F.bround(F.col("n_samples") * F.col("sample_ticks") * TICK_MS / 1000.0, 1))
    j = j.withColumn("expected_dur", F.bround(F.coalesce("num_volumes", F.lit(0)) * F.col("tr_ms") / 1000.0, 1))
    j = j.withColumn("ratio", F.coalesce(F.bround(div("rec_dur", "expected_dur"), 3), F.lit(0.0)))
    r = F.col("ratio")
    return j.withColumn("status", F.when(F.col("n_samples").isNull(), "INFO_ONLY").when(r >= complete, "COMPLETE").when(r >= partial, "PARTIAL")
                        .otherwise("TRUNCATED")).drop("_med")
