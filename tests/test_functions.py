"""Building blocks against pandas / NumPy, with block sizes small enough that every border is crossed."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mnemoframe.functions import core, gram, quantiles, scan, vectors


def hot_frame(spark, n=3000, seed=1):
    """One key holds more than a third of the rows."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < .4, 0, rng.integers(1, 8, n))
    pdf = pd.DataFrame({"k": key, "i": np.arange(n), "x": np.round(rng.lognormal(size=n), 4)})
    pdf.loc[pdf.i % 97 == 0, "x"] = 1e9
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_inverse_normal(spark):
    ps = [1e-12, 0.001, 0.025, 0.3, 0.5, 0.75, 0.975, 0.999999]
    want = [-7.034483825, -3.090232306, -1.959963985, -0.524400513, 0.0, 0.674489750, 1.959963985, 4.753424309]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(core.norm_ppf("p")).collect()]
    assert np.allclose(got, want, atol=1e-7)
    assert spark.createDataFrame([(0.0,), (1.0,), (None,)], "p double").select(core.norm_ppf("p").alias("z")).where("z is not null").count() == 0


def test_numbers_from_text(spark):
    df = spark.createDataFrame([("998.0",), ("NaN",), ("n/a",), (" 3 ",), ("2.5",)], "c string")
    assert [r[0] for r in df.select(core.num("c")).collect()] == [998.0, None, None, 3.0, 2.5]
    assert [r[0] for r in df.select(core.whole("c")).collect()] == [998, None, None, 3, None]


def test_adjusted_skew(spark):
    pdf = pd.DataFrame({"g": ["a"] * 5 + ["b"] * 2 + ["c"] * 4, "x": [1., 2, 3, 4, 30, 1, 2, 5, 5, 5, 5]})
    got = {r.g: r.s for r in spark.createDataFrame(pdf).groupBy("g").agg(core.adjusted_skew("x").alias("s")).collect()}
    assert math.isclose(got["a"], pdf[pdf.g == "a"].x.skew()) and got["b"] is None and got["c"] == 0.0


@pytest.mark.parametrize("qs", [{"a": .5}, {"lo": .25, "hi": .75, "p": .013}, {"z": 0.0, "o": 1.0}])
def test_exact_quantiles(spark, qs):
    pdf, df = hot_frame(spark)
    got = quantiles.exact_quantiles(df, ["k"], "x", qs).toPandas().set_index("k").sort_index()
    for name, q in qs.items():
        assert np.allclose(got[name], pdf.groupby("k").x.quantile(q), rtol=1e-12)


def test_quantiles_without_groups_and_with_gaps(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (4.0,), (7.0,)], "x double")
    assert quantiles.exact_quantiles(df, [], "x", {"m": .5}).collect()[0].m == 4.0
    assert quantiles.exact_quantiles(df.where("x is null or x > 1e9"), [], "x", {"m": .5}).count() <= 1


def test_upper_median(spark):
    df = spark.createDataFrame([("a", x) for x in (5, 1, 3, 9)] + [("b", 2)], "k string, x int")
    got = {r.k: r.m for r in quantiles.exact_quantiles(df, ["k"], "x", {"m": .5}, upper=True).collect()}
    assert got == {"a": 5.0, "b": 2.0}


@pytest.mark.parametrize("width", [1, 7, 500, 10 ** 6])
def test_running_total_and_index(spark, width):
    pdf, df = hot_frame(spark)
    pdf = pdf.sort_values(["k", "i"])
    r = scan.running_total(df, ["k"], ["i"], scan.id_block("i", width), F.col("i") % 5, "t").toPandas().sort_values(["k", "i"])
    assert (r.t.to_numpy() == (pdf.i % 5).groupby(pdf.k).cumsum().to_numpy()).all()
    n = scan.row_index(df, ["k"], ["i"], scan.id_block("i", width), "n").toPandas().sort_values(["k", "i"])
    assert (n.n.to_numpy() == pdf.groupby("k").cumcount().to_numpy()).all()


@pytest.mark.parametrize("size", [3, 8, 65536])
def test_neighbours_cross_blocks(spark, size):
    pdf, df = hot_frame(spark, 600)
    idx = scan.row_index(df, ["k"], ["i"], scan.id_block("i", 50), "n")
    wide, part = scan.neighbourhood(idx, ["k"], "n", 2, 1, size)
    from pyspark.sql import Window
    w = Window.partitionBy(*part).orderBy("n")
    got = scan.home_rows(wide.withColumn("m", F.avg("x").over(w.rowsBetween(-2, 0))).withColumn("nx", F.lead("x").over(w))).toPandas().sort_values(["k", "i"])
    pdf = pdf.sort_values(["k", "i"])
    assert len(got) == len(pdf)
    assert np.allclose(got.m, pdf.groupby("k").x.rolling(3, min_periods=1).mean().to_numpy())
    assert np.array_equal(got.nx.to_numpy(), pdf.groupby("k").x.shift(-1).to_numpy(), equal_nan=True)


def test_pair_correlations(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame([{"g": g, "t": t, "m": m, "x": rng.normal()} for g in "ab" for t in range(40) for m in "pqr" if rng.random() > .2])
    got = gram.pair_correlations(spark.createDataFrame(pdf).repartition(6), ["g"], "t", "m", "x", "pqr").toPandas()
    assert len(got) == 6
    for r in got.itertuples():
        w = pdf[pdf.g == r.g].pivot(index="t", columns="m", values="x")[[r.member_a, r.member_b]].dropna()
        assert r.n == len(w) and math.isclose(r.r, np.corrcoef(w.T)[0, 1], abs_tol=1e-10)


def test_least_squares(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5))
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(5)]).assign(k=np.arange(300) % 3)
    pdf["x4"] = 7.0  # constant next to the intercept: rank deficient
    pdf["y"] = 2 + 3 * pdf.x0 - pdf.x3 + rng.normal(size=300)
    pdf.loc[5, "x1"] = np.nan
    from mnemoframe.operators.series import residuals
    cols = [f"x{i}" for i in range(5)]
    got = residuals(spark.createDataFrame(pdf.reset_index(names="i")).repartition(7), ["k"], cols, "y").toPandas().set_index("i").sort_index()
    for k, g in pdf.groupby("k"):
        a = np.column_stack([np.ones(len(g)), np.nan_to_num(g[cols].to_numpy())])
        want = g.y - a @ np.linalg.lstsq(a, g.y, rcond=None)[0]
        assert np.allclose(got.residual[g.index], want, atol=1e-8)


def test_block_pairs_reach_every_pair(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(60, 12))
    m[rng.random(m.shape) < .1] = np.nan
    cell = np.where(np.arange(60) < 25, 0, np.arange(60) % 4)
    df = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(m, cell))], "id long, vec array<double>, cell long")
    want = {}
    for i in range(60):
        for j in range(i + 1, 60):
            ok = np.isfinite(m[i]) & np.isfinite(m[j])
            want.setdefault((min(cell[i], cell[j]), max(cell[i], cell[j])), []).append(np.corrcoef(m[i][ok], m[j][ok])[0, 1])
    for blocks in (1, 4):
        got = vectors.cell_sums(df, "id", "vec", "cell", blocks).collect()
        assert {(r.cell_a, r.cell_b): r.n_pairs for r in got} == {k: len(v) for k, v in want.items()}
        assert all(math.isclose(r.mean_r, np.mean(want[r.cell_a, r.cell_b]), abs_tol=1e-10) for r in got)


def test_draws_repeat(spark):
    df = spark.range(100)
    a = [r[0] for r in df.select(core.draw(3, "id") % 10).collect()]
    assert a == [r[0] for r in df.repartition(7).orderBy("id").select(core.draw(3, "id") % 10).collect()] and len(set(a)) == 10


def test_products_leave_once_per_group_and_block(spark):
    from mnemoframe.functions import gram
    pdf = pd.DataFrame({"k": [0] * 3000 + [1] * 100, "x": np.arange(3100.0), "y": np.arange(3100.0) ** 0.5})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = gram.normal_equations(spark.createDataFrame(pdf).repartition(20), ["k"], ["x"], ["y"]).where("pos = 0").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.k, r.v) for r in got} == {(0, 3000.0), (1, 100.0)}


def test_members_outside_the_roster_are_an_error(spark):
    from mnemoframe.functions import gram
    df = spark.createDataFrame([("k", 1, "a", 1.0), ("k", 1, "zz", 2.0)], "k string, t long, m string, v double")
    with pytest.raises(Exception, match="not in the roster"):
        gram.pair_correlations(df, ["k"], "t", "m", "v", ["a", "b"]).collect()


def test_quantiles_between_far_outliers(spark):
    from mnemoframe.functions.quantiles import exact_quantiles
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=20_000), [1e12, -1e12, 3e300, -3e300], np.full(5000, 0.25), 1e-9 * rng.normal(size=3000)])
    want = {"a": 0.01, "b": 0.3, "c": 0.5, "d": 0.777, "e": 1.0}
    got = exact_quantiles(spark.createDataFrame(pd.DataFrame({"x": x})).repartition(6), [], "x", want).first()
    assert all(got[n] == pytest.approx(np.quantile(x, q), rel=1e-12, abs=1e-15) for n, q in want.items())


def test_hot_groups_arrive_as_products(spark, monkeypatch):
    """One group with nine tenths of the rows and many small ones: sums equal NumPy, and few rows are shuffled."""
    rng = np.random.default_rng(21)
    n = 20_000
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < .9, 0, rng.integers(1, 60, n)), "a": rng.normal(size=n), "b": rng.normal(size=n), "y": rng.normal(size=n)})
    df = spark.createDataFrame(pdf).repartition(12)
    for held in (gram.HELD, 50):  # all groups kept to the end, and sent whenever they are many
        monkeypatch.setattr(gram, "HELD", held)
        got = {}
        for r in gram.normal_equations(df, ["k"], ["a", "b"], ["y"]).collect():
            got.setdefault(r.k, np.zeros(16))[r.pos] = r.v
        assert len(got) == pdf.k.nunique()
        for k, g in pdf.groupby("k"):
            full = np.column_stack([np.ones(len(g)), g[["a", "b", "y"]]])
            assert np.allclose(got[k], (full.T @ full).ravel())
    total = {r.pos: r.v for r in gram.normal_equations(df, [], ["a", "b"], ["y"]).collect()}
    assert total[0] == n and math.isclose(total[5], (pdf.a ** 2).sum())
    monkeypatch.setattr(gram, "HELD", 1 << 23)
    sums = gram._Sums(lambda m: m.T @ m, 4)
    for _ in range(100):
        sums.add_rows("hot", np.ones((50, 4)))
        sums.add_rows("small", np.ones((0, 4)))
    sent = list(sums.taken(False))
    assert [(k, raw is None or raw.size, None if p is None else p[0]) for k, raw, p in sent] == [("small", 0, None), ("hot", True, 5000.0)]


def test_copies_of_a_row_do_not_grow_with_the_table():
    """Of 12,000, 120,000 and 720,000 vectors of 64 components; a block holds at most BLOCK_BYTES."""
    assert [vectors.block_count(n, 64) for n in (12_000, 120_000, 720_000)] == [8, 8, 8]
    assert all(n / vectors.block_count(n, d) * 8 * d <= vectors.BLOCK_BYTES for n in (10 ** 6, 10 ** 8) for d in (64, 768))


def test_cell_sums_over_tiles(spark):
    """A block of more rows than are multiplied at once."""
    rng = np.random.default_rng(6)
    m, cell = rng.normal(size=(2300, 5)), np.arange(2300) % 3
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(2300), "vec": m.tolist(), "cell": cell}))
    r = np.corrcoef(m)
    got = {(x.cell_a, x.cell_b): x for blocks in (1,) for x in vectors.cell_sums(df, "id", "vec", "cell", blocks).collect()}
    i, j = np.triu_indices(2300, 1)
    low, high = np.minimum(cell[i], cell[j]), np.maximum(cell[i], cell[j])
    for (a, b), x in got.items():
        at = (low == a) & (high == b)
        assert x.n_pairs == at.sum() and math.isclose(x.mean_r, r[i, j][at].mean(), abs_tol=1e-10)
    assert len(got) == 6


def test_rows_that_miss_the_same_components_are_summed(spark, monkeypatch):
    """Every r of two rows is in the mean of its cells, and no pair of rows is formed where few patterns are missing."""
    from mnemoframe.operators.similarity import pairwise_cells
    rng = np.random.default_rng(8)
    m = rng.normal(size=(700, 9)) + rng.integers(0, 2, size=(700, 1)) * 1e6
    m[:200] = np.round(m[:200])
    m[40:60, 2:] = 0.1  # constant where the first two are missing
    for i in range(700):
        m[i, [[], [0, 1], [3], [2, 3, 4, 5, 6, 7]][i % 4]] = np.nan
    m[5:9] = np.nan
    cell = [None if i % 50 == 0 else i % 3 for i in range(700)]
    rows = [(i, [None if np.isnan(v) and i % 3 else float(v) for v in r], c) for i, (r, c) in enumerate(zip(m, cell))] + [(700, None, 1)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, cell long").repartition(5)
    want = {}
    for i in range(700):
        for j in range(i + 1, 700):
            ok = np.isfinite(m[i]) & np.isfinite(m[j])
            if ok.sum() >= 3 and np.ptp(m[i][ok]) and np.ptp(m[j][ok]):
                a, b = m[i][ok] - m[i][ok].mean(), m[j][ok] - m[j][ok].mean()
                own = [c for c in (cell[i], cell[j]) if c is not None] or [None]
                want.setdefault((min(own), max(own)) if own[0] is not None else (None, None), []).append((a @ b / np.sqrt(a @ a * (b @ b)), ok.sum()))
    blocks = {(r.cell_a, r.cell_b): r for r in pairwise_cells(df, "id", "vec", "cell", n_blocks=2).collect()}
    monkeypatch.setattr(vectors, "block_pairs", None)
    got = {(r.cell_a, r.cell_b): r for r in pairwise_cells(df, "id", "vec", "cell").collect()}
    for found in (blocks, got):
        assert {k: r.n_pairs for k, r in found.items()} == {k: len(v) for k, v in want.items()}
        assert all(np.allclose([r.mean_r, r.mean_n], np.mean(want[k], axis=0), atol=1e-9) for k, r in found.items())


def test_as_many_patterns_as_rows_go_through_blocks(spark):
    m = np.random.default_rng(9).normal(size=(64, 40))
    rows = [(i, [None if i >> k & 1 else float(v) for k, v in enumerate(r)], 0) for i, r in enumerate(m)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, cell long")
    assert vectors.few_patterns(df, "vec", "cell") is None
    assert vectors.few_patterns(df.select("cell", F.slice("vec", 7, 34).alias("vec")), "vec", "cell") == ["1" * 34]


def test_rows_are_not_dealt_out_by_a_declared_list(spark):
    """Three metrics must not make three tasks that read all rows: only the join of the two summaries is by metric."""
    from mnemoframe.operators import qc
    df = spark.range(3000).select((F.col("id") % 100).alias("a"), F.col("id").alias("b"), F.lit(None).cast("double").alias("c"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = qc.metric_summary(df, ["a", "b", "c"])
        assert got._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") == 1
        assert {r.metric: (r.p25, r.p50, r.p75) for r in got.collect() if r.metric != "c"} == {"a": (24.75, 49.5, 74.25), "b": (749.75, 1499.5, 2249.25)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
