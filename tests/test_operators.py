"""Operator rules on small hand-made tables, and matrix operators against NumPy."""

import json
import gzip
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mnemoframe.operators import behaviour as B
from mnemoframe.operators import catalog, cleaning, compare, conversion, features, qc, registry, series, similarity, status
from mnemoframe.sources import files, inventory


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_filter_rt_keeps_single_trial_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.1), ("b", 5.0), ("c", 0.1), (None, 2.0)], "g string, resp_RT double")
    assert cleaning.filter_rt(df, by=["g"]).count() == 4
    assert cleaning.filter_rt(df.limit(1), max_sd=3).count() == 0  # one row in all: undefined deviation drops it
    assert cleaning.filter_rt(df, max_sd=None, max_rt=3).count() == 3


def test_missing_response_rules(spark):
    df = spark.createDataFrame([(None, 2, None), (1, 1, 1.0), (4, 1, 0.0)], "resp int, correct_resp int, trial_accuracy double")
    assert rows(cleaning.decompose_choice(df), "recog", "confidence", "is_correct") == [(1, "sure", True), (2, "maybe", True), (2, "sure", False)]
    assert {r.accurate: r.n_trials for r in B.rt_by_accuracy(df.withColumn("resp_RT", F.lit(1.0))).collect()} == {True: 2, False: 1}
    assert {r.confidence_level: r.n_trials for r in B.confidence_accuracy(df).collect()} == {1: 0, 2: 2}


def test_accuracy_of_missing_group(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("b", 0.0), (None, 1.0)], "g string, trial_accuracy double")
    got = {r.g: (r.n_trials, r.n_correct, r.accuracy) for r in B.accuracy_by_condition(df, ["g"]).collect()}
    assert got == {"a": (0, 0, None), "b": (2, 1, 0.5)}


def test_dprime_corrections(spark):
    df = spark.createDataFrame([(True, True)] * 10 + [(False, False)] * 10, "s boolean, r boolean")
    ll = B.signal_detection(df, F.col("s"), F.col("r")).collect()[0]
    cl = B.signal_detection(df, F.col("s"), F.col("r"), correction="clip").collect()[0]
    assert math.isclose(ll.dprime, 3.3812449, abs_tol=1e-5) and math.isclose(cl.dprime, 2 * 1.6448536, abs_tol=1e-5) and abs(ll.criterion) < 1e-12


def test_retention_takes_first_known_value(spark):
    tb = spark.createDataFrame([("s", "04", 1, 10, None), ("s", "05", 1, 11, 1.0), ("s", "06", 1, 12, 0.0)], "subject string, session string, pairId long, trial_id long, trial_accuracy double")
    fin = spark.createDataFrame([("s", 1, 99, 0.0)], "subject string, pairId long, trial_id long, trial_accuracy double")
    r = B.retention(tb, fin).collect()[0]
    assert (r.initial_session, r.initial_accuracy, r.retention_delta) == ("04", 1.0, -1.0)


def test_subsequent_memory_rejects_foreign_groups(spark):
    df = spark.createDataFrame([("s", 1, 1, 1.0)], "subject string, pairId int, resp int, trial_accuracy double")
    with pytest.raises(ValueError):
        B.subsequent_memory(df, df, ["subject", "pairId"], group_cols=["enCon"])


def test_empty_report_fails(spark):
    df = spark.createDataFrame([("03", "04")], "subject string, session string")
    with pytest.raises(B.EmptyReport):
        B.report(df, lambda d: d, subjects=["99"])


def test_select_gate(spark):
    df = spark.range(5)
    assert catalog.run_select(spark, "SELECT count(*) AS n FROM {t} WHERE id > :a", {"a": 2}, t=df).collect()[0].n == 2
    assert catalog.run_select(spark, "SUMMARIZE {t}", t=df).where("summary = 'max'").first().id == "4"
    assert catalog.run_select(spark, "WITH a AS (SELECT 1 AS x) SELECT * FROM a").count() == 1 and catalog.run_select(spark, "SHOW TABLES") is not None
    spark.sql("CREATE OR REPLACE TEMP VIEW updates_set AS SELECT 1 AS add_x")
    for fine in ("SHOW COLUMNS IN updates_set", "DESCRIBE updates_set", "SELECT add_x FROM updates_set", "SHOW TBLPROPERTIES updates_set"):
        assert catalog.run_select(spark, fine) is not None
    with pytest.raises(Exception, match="(?i)not.*found|VIEW|table"):  # allowed by the gate; a temporary view has no such text
        catalog.run_select(spark, "SHOW CREATE TABLE no_such_table")
    for bad in ("DROP TABLE x", "insert into t values (1)", "  update t set a = 1", "WITH a AS (SELECT 1 x) INSERT INTO t SELECT * FROM a", "WITH a AS (SELECT 1 x) FROM a INSERT OVERWRITE t SELECT *"):
        with pytest.raises(ValueError):
            catalog.run_select(spark, bad)


def test_null_safe_companions(spark):
    a = spark.createDataFrame([("01", None), ("01", 1), ("02", 1)], "subject string, run int").withColumn("session", F.lit("a"))
    b = spark.createDataFrame([("01", None), ("02", 1)], "subject string, run int")
    assert rows(catalog.missing_companions(a, b, "c", "warn", "x", ["subject"]), "subject", "run") == [("01", 1)]


def test_review_rules(spark):
    req = spark.createDataFrame([("k", "keep", "r", "Ann", False, None), ("k", "keep", "r", "auto-stub", True, None), ("k", "keep", "r", " Auto ", False, None),
                                 ("k", "pending", "r", "auto-stub", True, "keep"), ("k", "maybe", "r", "Ann", False, None), ("k", "pending", "r", "auto", True, "drop")],
                                "run_key string, decision string, reason string, reviewer string, automated boolean, recommendation string")
    ok = qc.append_decisions(req.limit(0).withColumn("timestamp", F.lit("")), req)
    assert rows(ok, "decision", "reviewer") == [("keep", "Ann"), ("pending", "auto-stub")]
    assert ok.where("timestamp rlike '^\\\\d{4}-'").count() == 2


def test_gate_reports_missing_decisions(spark):
    runs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "run_key string")
    dec = spark.createDataFrame([("a", "keep", "Ann", False), ("b", "keep", "auto-stub", None), ("c", "investigate", "Ann", None)], "run_key string, decision string, reviewer string, automated boolean")
    with pytest.raises(qc.MissingDecisions):
        qc.gate(runs, dec)
    three = runs.where("run_key <> 'd'")
    assert rows(qc.gate(three, dec), "run_key") == [("a",)]
    assert rows(qc.gate(three, dec, investigate="keep", pending="keep"), "run_key") == [("a",), ("b",), ("c",)]


def test_latest_decision_over_roots(spark):
    df = spark.createDataFrame([("k", 1, ["x", "y"]), ("k", 2, ["z"]), ("j", 1, ["only"])], "run_key string, root_order int, decisions array<string>")
    assert rows(qc.latest_decisions(df), "run_key", "latest", "n_entries") == [("j", "only", 1), ("k", "z", 3)]


def test_states(spark):
    df = spark.createDataFrame([(0, 0), (3, 0), (3, 2), (3, 3), (3, 5)], "expected long, found long")
    assert [r.status for r in status.with_state(df).orderBy("expected", "found").collect()] == ["skipped", "missing", "partial", "complete", "complete"]


def test_run_completeness(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 3), ("c", 1), ("c", 1), ("d", 2)], "s string, run long")
    assert {r.s: r.complete for r in conversion.run_completeness(df, ["s"]).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_regular_grid(spark):
    ticks = [3, 4, 9, 9, 20, 21, 40]
    df = spark.createDataFrame([("f", t, float(i), i) for i, t in enumerate(ticks)], "f string, tick long, value double, i int")
    got = [r.value for r in conversion.regular_grid(df, ["f"], "tick", "value", "i", 10.0).orderBy("sample").collect()]
    grid = 3 + 4.0 * np.arange(int(np.round((40 - 3) / 4.0)) + 1)
    assert got == [float(i) for i in np.clip(np.searchsorted(ticks, grid, side="right") - 1, 0, 6)]


def test_clock_values(spark):
    df = spark.createDataFrame([("1.5",), ("1:06",), (":7",), ("2.75",), (" ",), ("0.08",)], "c string")
    v, bad = registry.parse_clock("c")
    assert [tuple(r) for r in df.select(v, bad).collect()] == [(110.0, False), (66.0, False), (7.0, False), (None, True), (None, False), (8.0, False)]


def test_title_tokens(spark):
    df = spark.createDataFrame([("The Miner's Song",), ("Café & Co",), ("A Bug s Life",), ("Of the",)], "t string")
    assert [r[0] for r in df.select(registry.norm_tokens("t")).collect()] == [["miners", "song"], ["cafe", "and", "co"], ["bugs", "life"], []]


def test_titles_are_decomposed(spark):
    df = spark.createDataFrame([("\u010capek",), ("\ufb01lm",), ("\u00c5land",), (None,)], "t string")
    assert [r[0] for r in df.select(registry.norm_tokens("t")).collect()] == [["c", "apek"], ["film"], ["land"], None]


def test_match_titles_ties_and_scores(spark):
    t = spark.createDataFrame([("x", ["big", "fish"]), ("y", ["red"]), ("z", ["none"]), ("w", ["fish", "soup"])], "title string, tokens array<string>")
    f = spark.createDataFrame([("f1", ["big", "fish"]), ("f2", ["big", "fish", "two"]), ("f3", ["red", "a1"]), ("f4", ["red", "b1"]), ("f5", ["hot", "soup", "fish"])], "file string, tokens array<string>")
    assert rows(registry.match_titles(t, f), "title", "score", "n_best", "file") == [("w", 1, 1, "f5"), ("x", 3, 1, "f1"), ("y", 2, 2, None), ("z", None, None, None)]


def test_compare_files(spark):
    g = spark.createDataFrame([("a", 1, "w", 1.0), ("a", 2, None, 2.0), ("b", 1, "w", 1.0), ("c", 1, "w", 1.0)], "file string, row int, word string, onset double")
    r = spark.createDataFrame([("a", 1, "w", 1.5), ("a", 2, None, None), ("b", 1, "w", 1.0), ("b", 2, "w", 1.0), ("d", 1, "w", 1.0)], "file string, row int, word string, onset double")
    got = {x.file: (x.status, x.n_word, x.n_onset) for x in compare.compare_files(g, r, "file", "row", ["word"], ["onset"]).collect()}
    assert got == {"a": ("MISMATCH", 0, 1), "b": ("MISMATCH", None, None), "c": ("MISSING_REFERENCE", None, None), "d": ("MISSING_GENERATED", None, None)}


def test_header_renames(spark):
    g, r = spark.createDataFrame([(1, 2)], "a int, new int"), spark.createDataFrame([(1, 2)], "a int, old int")
    assert compare.header_renames(g, r, {"new": "old"}) == {"renamed": [("new", "old")], "only_generated": [], "only_reference": []}


def test_tsv_round_trip(spark, tmp_path):
    src = tmp_path / "sub-03" / "x"
    src.mkdir(parents=True)
    (src / "sub-03_ses-04_task-TB2AFC_beh.tsv").write_text("subject\trun_idx\tresp\tresp_RT\n9\t1\t2\tn/a\n9\t2\tn/a\t0.5\n")
    df = files.read_tsv(spark, str(tmp_path / "*" / "*"))
    assert rows(df, "subject", "session", "run", "resp", "resp_RT") == [("03", "04", "01", "2", None), ("03", "04", "02", None, "0.5")]
    files.write_tsv(df.select("subject", "resp"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert "n/a" in text and text.startswith("subject\tresp")
    files.write_json(df.select("subject", "resp"), str(tmp_path / "js"))
    assert '"resp":null' in "".join(p.read_text() for p in (tmp_path / "js").glob("*.json"))


def test_tsv_columns_are_united_by_name(spark, tmp_path):
    (tmp_path / "sub-01_ses-01_beh.tsv").write_text("trial\tresp\trt\n1\ta\t0.5\n2\tn/a\t0.7\n")
    (tmp_path / "sub-02_ses-01_beh.tsv").write_text("rt\textra\ttrial\tresp\n0.9\tx\t1\tb\n")
    with gzip.open(tmp_path / "sub-03_ses-01_beh.tsv.gz", "wt") as f:
        f.write("trial\tresp\trt\n7\tc\t0.1\n")
    df = files.read_tsv(spark, str(tmp_path))
    assert rows(df, "subject", "trial", "resp", "rt", "extra") == [("01", "1", "a", "0.5", None), ("01", "2", None, "0.7", None), ("02", "1", "b", "0.9", "x"), ("03", "7", "c", "0.1", None)]


def test_sequential_rows_without_key_or_number_stay(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", None, 5.0), (None, 1, 2.0), (None, 2, 4.0)], "g string, trial_id int, resp_RT double")
    got = B.rt_sequential(df, group_cols=["g"]).collect()
    assert sorted(((r.g or ""), r.rt_rolling_mean) for r in got) == [("", 2.0), ("", 3.0), ("a", 1.0), ("a", 3.0)]


def test_listings_are_whole(spark):
    raw = spark.range(60).select(F.lit("s").alias("subject"), F.col("id").alias("run"))
    assert qc.missing_runs(raw, raw.where("run < 5"), ["subject", "run"]).agg(F.max("position")).first()[0] == 55
    assert catalog.pending_report(raw, raw.limit(0), "run", ["subject"]).agg(F.max("position")).first()[0] == 60
    assert B.ranking(raw, "run", "run").where("rank = 60").first().run == 0
    assert qc.undecided(raw.select(F.col("run").cast("string").alias("run_key")), spark.createDataFrame([("3", "keep", "Ann", False)], "run_key string, decision string, reviewer string, automated boolean")).count() == 59


def test_constant_patterns_have_no_r(spark):
    from mnemoframe.functions.vectors import cell_sums
    rng = np.random.default_rng(1)
    data = [(i, 0, [0.1] * 20) for i in range(3)] + [(3 + i, 1, rng.normal(size=20).tolist()) for i in range(3)]
    got = cell_sums(spark.createDataFrame(data, "k long, cell long, v array<double>"), "k", "v", "cell", 2).collect()
    assert [(r.cell_a, r.cell_b, r.n_pairs) for r in got] == [(1, 1, 3)]


def test_lags_follow_the_length_of_each_movie(spark):
    rng = np.random.default_rng(2)
    data = [(m, u, t, float(rng.normal()), float(rng.normal())) for m, n in (("x", 7), ("y", 40)) for u in range(3) for t in range(n)]
    df = spark.createDataFrame(data, "movie string, unit long, t long, a double, b double")
    got = series.lag_similarity(df, ["movie"], "unit").collect()
    assert {m: sum(r.movie == m for r in got) for m in "xy"} == {"x": 7, "y": 40}
    pdf = df.toPandas()
    for r in got:
        g = pdf[pdf.movie == r.movie].sort_values(["unit", "t"])
        want = np.median([np.corrcoef(s.a, np.roll(s.b, -r.lag))[0, 1] for _, s in g.groupby("unit")])
        assert abs(r.median_r - want) < 1e-9


def test_convolution_crosses_blocks(spark):
    rng = np.random.default_rng(4)
    line, kernel = rng.normal(size=57), rng.normal(size=6)
    df = spark.createDataFrame([("m", i, float(v)) for i, v in enumerate(line)], "movie string, idx long, value double")
    for block in (8, 19, 4096):
        got = series.convolved(df, "movie", kernel, block=block).orderBy("idx").collect()
        assert [r.idx for r in got] == list(range(62)) and np.allclose([r.value for r in got], np.convolve(line, kernel))


def test_metric_records(spark, tmp_path):
    d = tmp_path / "func"
    d.mkdir()
    (d / "sub-01_ses-02_task-rest_run-01_bold.json").write_text(json.dumps({"fd_mean": 0.2, "bids_meta": {"a": 1}, "note": "x"}, indent=1))
    (d / "sub-01_ses-02_task-rest_run-01_timeseries.json").write_text("{}")
    rec = files.read_metric_records(spark, str(d))
    got = files.metric_table(files.with_entities(rec), ["subject", "run", "suffix"], ["fd_mean", "tsnr"]).collect()
    assert [tuple(r) for r in got] == [("01", "01", "bold", 0.2, None)]


def test_confound_selection(spark):
    forms = ("", "_derivative1", "_power2")
    cols = [f"{m}{f}" for m in ("trans_x", "rot_z") for f in forms] + [f"a_comp_cor_{i:02d}" for i in range(8)] + ["cosine00", "cosine01", "csf"]
    df = spark.createDataFrame([tuple([1.0] * len(cols))], cols)
    got = series.model_columns(df, ["csf", "rot_z_power2"], ["cosine"], {"a_comp_cor_": 6})
    assert got == ["csf", "rot_z_power2", "cosine00", "cosine01", *(f"a_comp_cor_{i:02d}" for i in range(6))]
    assert series.model_columns(df) == []
    with pytest.raises(KeyError):
        series.model_columns(df.drop("rot_z_power2"), ["rot_z_power2"])


def test_series_names(spark):
    df = spark.createDataFrame([("Series_7_localizer_tone_run02_PhysioLog", "COMPLETE"), ("Series_7_localizer_tone_PhysioLog", "PARTIAL"), ("Series_7_cued_recall_math_PhysioLog", "TRUNCATED"), ("odd", "COMPLETE")], "s string, status string")
    assert rows(inventory.series_to_task(df, "s"), "task", "run") == [("tone", 2), ("tone", None)]


def test_kernel_sums_to_one():
    h = series.response_kernel()
    assert math.isclose(sum(h), 1.0) and 4.5 <= np.argmax(h) * series.FRAME_S <= 5.5


def test_hrf_features_match_convolution(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=50)
    h = np.array(series.response_kernel())
    conv = np.convolve(x, h)
    f = spark.createDataFrame([("m", i, float(v)) for i, v in enumerate(x)], "movie string, idx long, value double")
    q = spark.createDataFrame([("m", j) for j in range(40)], "movie string, j long")
    for model, src, shift in (("hrf", conv, 4.5), ("fixed", x, 0.0)):
        got = [r.value for r in series.features_at(f, q, "movie", model, tr=1.37).orderBy("j").collect()]
        want = np.interp(shift + 1.37 * np.arange(40), np.arange(len(src)) * 0.5, src)
        assert np.allclose(got, want, atol=1e-10)


def test_autocorrelation(spark):
    rng = np.random.default_rng(8)
    x = np.cumsum(rng.normal(size=(3, 60)), axis=1)
    x[2] = 4.0
    df = spark.createDataFrame([(u, t, float(x[u, t])) for u in range(3) for t in range(60)], "u int, t long, v double")
    c = x - x.mean(1, keepdims=True)
    var = (c ** 2).sum(1)
    var[var == 0] = 1
    want = [np.mean((c[:, :-k] * c[:, k:]).sum(1) / var) for k in range(1, 6)]
    assert np.allclose([r.acf for r in series.autocorrelation(df, "u", "t", "v").orderBy("lag").collect()], want)


def make_patterns(spark, n=240, d=10, seed=6):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d))
    lab = [(i, i % 2, (i // 2) % 4, (i // 8) % 2, int(rng.integers(0, 5)) if rng.random() > .35 else 0) for i in range(n)]
    df = spark.createDataFrame([(*l, [float(v) for v in r]) for l, r in zip(lab, m)], "id long, subject long, session long, run long, item long, vec array<double>")
    return m, lab, df


def test_item_discriminability_equals_all_pairs(spark):
    m, lab, df = make_patterns(spark)
    r = np.corrcoef(m)
    got = {x.session: x for x in similarity.item_discriminability(df, ["session"], "item", "run").collect()}
    for s in range(4):
        ids = [i for i, l in enumerate(lab) if l[2] == s]
        w = [r[i, j] for a, i in enumerate(ids) for j in ids[a + 1:] if lab[i][4] == lab[j][4] and lab[i][3] != lab[j][3]]
        b = [r[i, j] for a, i in enumerate(ids) for j in ids[a + 1:] if lab[i][4] != lab[j][4] and lab[i][3] != lab[j][3]]
        assert (got[s].n_within, got[s].n_between) == (len(w), len(b))
        assert math.isclose(got[s].within_r, np.mean(w), abs_tol=1e-9) and math.isclose(got[s].between_r, np.mean(b), abs_tol=1e-9)


def test_within_and_across_cells_equal_all_pairs(spark):
    m, lab, df = make_patterns(spark)
    r = np.corrcoef(m)
    draws = spark.createDataFrame([(i, d, (i * 7 + d * 13) % len(lab)) for i in range(len(lab)) for d in range(10)], "id long, draw_no int, surrogate long")
    got = {(x.subject, x.item, x.cell): (x.n_pairs, x.r) for x in similarity.within_cells(df, draws, ["subject", "item"], "id", F.lit(True)).collect()}
    for sub in range(2):
        for it in range(5):
            p = [(i, j) for i, a in enumerate(lab) for j, b in enumerate(lab) if a[1] == b[1] == sub and a[4] == b[4] == it and a[2] < b[2]]
            same = np.mean([r[i, j] for i, j in p])
            diff = np.mean([r[i, (j * 7 + d * 13) % len(lab)] for i, j in p for d in range(10)])
            assert got[sub, it, "within_same"][0] == len(p) and math.isclose(got[sub, it, "within_same"][1], same, abs_tol=1e-9)
            assert math.isclose(got[sub, it, "within_diff"][1], diff, abs_tol=1e-9)
    ac = {(x.item, x.cell, x.session_scope): (x.n_pairs, x.r) for x in similarity.across_cells(df, draws, [], "id", F.lit(True)).collect()}
    for it in range(5):
        p = [(i, j) for i, a in enumerate(lab) for j, b in enumerate(lab) if a[1] == 0 and b[1] == 1 and a[4] == b[4] == it]
        mt = [(i, j) for i, j in p if lab[i][2] == lab[j][2]]
        for scope, q in (("all", p), ("matched", mt)):
            assert ac[it, "across_same", scope][0] == len(q) and math.isclose(ac[it, "across_same", scope][1], np.mean([r[i, j] for i, j in q]), abs_tol=1e-9)
            want = np.mean([r[i, (j * 7 + d * 13) % len(lab)] for i, j in q for d in range(10)])
            assert math.isclose(ac[it, "across_diff", scope][1], want, abs_tol=1e-9)


@pytest.mark.parametrize("relation", ["any", "same", "different"])
def test_nearest_cosine_over_many_blocks(spark, relation):
    m, lab, df = make_patterns(spark, 150)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    c = u @ u.T
    g = np.array([l[4] for l in lab])
    np.fill_diagonal(c, -np.inf)
    if relation != "any":
        c[(g[:, None] == g[None, :]) != (relation == "same")] = -np.inf
    d = features.unit_vectors(df, "vec").select("id", "item", "u")
    got = features.nearest_cosine(d, d, "id", "u", None if relation == "any" else "item", relation, block_rows=20).toPandas().sort_values("id")
    assert len(got) == 150 and np.allclose(got.nn_cosine, c.max(axis=1))


def test_ridge_leave_one_out(spark):
    rng = np.random.default_rng(9)
    x, b = rng.normal(size=(80, 6)) * [1, 2, 3, 1, 1, 5], rng.normal(size=(6, 2))
    y = x @ b + rng.normal(size=(80, 2)) * 3 + 1
    df = spark.createDataFrame([([float(v) for v in p], [float(v) for v in q]) for p, q in zip(x, y)], "x array<double>, y array<double>").repartition(4)
    path, fit = features.ridge_path(df, "x", "y")
    z = (x - x.mean(0)) / x.std(0)
    want = {}
    for a in features.ALPHAS:
        err = 0.0
        for i in range(80):
            k = np.arange(80) != i
            zc, yc = z[k] - z[k].mean(0), y[k] - y[k].mean(0)
            beta = np.linalg.solve(zc.T @ zc + a * np.eye(6), zc.T @ yc)
            err += ((y[i] - y[k].mean(0) - (z[i] - z[k].mean(0)) @ beta) ** 2).sum()
        want[a] = err / 160
    got = {r.alpha: r.loo_mse for r in path.collect()}
    # The usual shortcut holds the penalised centring fixed, so it differs from a refit by the shift of the mean only.
    assert all(math.isclose(got[a], want[a], rel_tol=0.02) for a in want)
    assert fit.alpha == min(got, key=got.get)
    pred = np.vstack([r.p for r in fit.transform(df, "x", "p").collect()])
    assert pred.shape == (80, 2)


def test_pca_keeps_variance(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(100, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    p = features.project_pca(df, "id", "v").toPandas()
    ev = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose([p.pc1.var(), p.pc2.var()], ev[:2]) and abs(p.pc1.mean()) < 1e-9


def test_whole_vectors_of_the_registered_projection_and_ridge(spark):
    """v05 and v09 on all components of the small table against NumPy."""
    from __spark_entry__ import queries
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding").toPandas().sort_values("vec_id")
    x = np.vstack(d.embedding.to_numpy()).astype(float)
    c = x - x.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    got = queries()["v05_pca_projection"](spark, sf).toPandas().sort_values("vec_id")
    assert np.allclose(got[["pc1", "pc2"]], np.abs(c @ vt[:2].T), atol=2e-6)
    z, y = c / x.std(0), np.eye(10)[d.label.astype(int)]
    y = y - y.mean(0)
    path = {r.alpha: r for r in queries()["v09_ridge_path"](spark, sf).collect()}
    want = {}
    for a in features.ALPHAS:
        hat = z @ np.linalg.solve(z.T @ z + a * np.eye(64), z.T)
        want[a] = np.mean(((y - hat @ y) / (1 - 1 / len(z) - np.diag(hat))[:, None]) ** 2)
    assert all(math.isclose(path[a].loo_mse, want[a], rel_tol=1e-6) for a in want)
    assert [a for a in want if path[a].chosen] == [min(want, key=want.get)]


def test_procrustes_recovers_rotation(spark):
    rng = np.random.default_rng(11)
    q = np.linalg.qr(rng.normal(size=(4, 4)))[0]
    x = rng.normal(size=(500, 4))
    x = (x - x.mean(0)) @ np.linalg.inv(np.linalg.cholesky(np.cov(x.T))).T
    y = x @ q
    df = spark.createDataFrame([([float(v) for v in a], [float(v) for v in b]) for a, b in zip(x, y)], "x array<double>, y array<double>")
    assert np.allclose(features.procrustes(df, "x", "y")["procrustes"], q, atol=1e-6)


def test_identification_of_perfect_prediction(spark):
    rng = np.random.default_rng(12)
    c = spark.createDataFrame([(i, p, float(v)) for i in range(6) for p, v in enumerate(rng.normal(size=20))], "item long, pos int, x double")
    r = features.identification(features.cross_correlations(c, c, "item"), 1, 200).collect()[0]
    assert r.rank_accuracy == 1.0 and r.n_items == 6 and r.p < 0.05


def test_signed_rank(spark):
    d = [1.5, -0.5, 2.0, 0.5, 0.0, 3.0, -1.5]
    df = spark.createDataFrame([("g", x) for x in d], "g string, d double")
    r = similarity.signed_rank(df, ["g"]).collect()[0]
    assert r.n_nonzero == 6 and r.w_plus == 3.5 + 5 + 1.5 + 6 and 0 < r.p < 1


def test_spearman_with_ties(spark):
    x, y = [1.0, 2.0, 2.0, 3.0, -5.25], [10.0, 30.0, 20.0, 20.0, 0.5]
    df = spark.createDataFrame([("g", a, b) for a, b in zip(x, y)], "g string, x double, y double")
    assert math.isclose(series.spearman(df, ["g"], "x", "y").collect()[0].rho, pd.Series(x).rank().corr(pd.Series(y).rank()), abs_tol=1e-12)


def test_listed_volumes_are_not_broadcast(spark):
    """A few events can list very many volumes; the planner knows the size of the events only."""
    runs = spark.range(2000).select((F.col("id") % 2).alias("run"), F.floor(F.col("id") / 2).alias("t"), F.col("id").cast("double").alias("value"))
    events = spark.createDataFrame([(0, "a", 3.0, 1200.0), (1, "b", 0.0, 9.0), (1, "c", 30.0, 0.0)], "run long, movie string, onset double, duration double")
    got = series.segments(runs, events, ["run"], "movie", 1.5)
    assert "Broadcast" not in got._jdf.queryExecution().sparkPlan().toString()
    assert {(r.movie, r.n, r.low, r.high) for r in got.groupBy("movie").agg(F.count("*").alias("n"), F.min("t").alias("low"), F.max("t").alias("high")).collect()} == {("a", 800, 2, 801), ("b", 6, 0, 5)}


@pytest.mark.parametrize("relation", ["any", "same", "different"])
def test_nearest_cosine_over_tiles(spark, relation):
    """Blocks of more rows than are multiplied at once."""
    rng = np.random.default_rng(8)
    u, g = rng.normal(size=(2500, 4)), np.arange(2500) % 2
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -np.inf)
    if relation != "any":
        c[(g[:, None] == g[None, :]) != (relation == "same")] = -np.inf
    d = spark.createDataFrame(pd.DataFrame({"id": np.arange(2500), "u": u.tolist(), "item": g}))
    for rows in (None, 2500):
        got = features.nearest_cosine(d, d, "id", "u", None if relation == "any" else "item", relation, rows).toPandas().sort_values("id")
        assert len(got) == 2500 and np.allclose(got.nn_cosine, c.max(axis=1))


def test_design_rows_count_uses_without_a_second_join(spark):
    trials = spark.createDataFrame([("r", "a", 0.0), ("r", "a", 3.0), ("r", "b", 60.0), ("s", "a", -3.0), (None, "a", 0.0)], "run string, condition string, onset double")
    conditions = spark.createDataFrame([("a", 0, 2, 4), ("b", 1, 1, 9)], "condition string, col_index long, n_presentations long, first_seen long")
    volumes = spark.createDataFrame([("r", 40), ("s", 40)], "run string, n_volumes long")
    got = registry.design_rows(trials, conditions, "condition", volumes, "run", 1.5)
    assert rows(got, "run", "col_index", "onset_vol", "inside", "unique_in_run") == [("r", 0, 0, True, False), ("r", 0, 2, True, False), ("r", 1, 40, False, True), ("s", 0, -2, False, True)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
