"""Tail probabilities against enumeration and fixed values."""

import itertools

import pytest
from pyspark.sql import functions as F

from mnemoframe.functions import statistics as S
from mnemoframe.operators import similarity as M


def enumerated(n):
    sums = [sum(s) for s in itertools.product(*[(0, k) for k in range(1, n + 1)])]
    return {w: min(1.0, 2 * min(sum(x <= w for x in sums), sum(x >= w for x in sums)) / len(sums)) for w in set(sums)}


def test_signed_rank_table_equals_enumeration(spark):
    got = {}
    for r in S.signed_rank_table(spark).collect():
        got.setdefault(r.exact_n, {})[int(r.w)] = r.exact_p
    assert sorted(got) == list(range(1, 51))
    for n in range(1, 13):
        assert got[n] == pytest.approx(enumerated(n), abs=1e-15)
    assert sorted(got[50]) == list(range(1276)) and got[50][637] == got[50][638] and got[50][0] == 2 / 2 ** 50


def test_signed_rank_is_exact_without_ties_and_zeros(spark):
    ties, zero = [.1, .2, .2, -.4], [.1, .2, .3, 0.0, -.4]
    groups = {"exact": [.3, -.1, .7, .9, 1.1, -.2, 2.0], "ties": ties, "zero": zero, "one": [1.0], "none": [0.0, None], "large": [i - 9.5 for i in range(51)], "fifty": [i + .5 - 30.25 for i in range(50)]}
    df = spark.createDataFrame([(k, d) for k, v in groups.items() for d in v], "k string, d double")
    rows = {r.k: r for r in M.signed_rank(df, ["k"]).collect()}
    assert rows["exact"].p == pytest.approx(enumerated(7)[25]) and rows["one"].p == 1.0 and "none" not in rows
    for k in ("ties", "zero", "large"):  # the normal form
        assert rows[k].p == pytest.approx(2 * (1 - normal(abs(rows[k].z))), abs=1e-6)
    assert rows["fifty"].p != pytest.approx(2 * (1 - normal(abs(rows["fifty"].z))), abs=1e-9)


def normal(z):
    import math
    return .5 * (1 + math.erf(z / math.sqrt(2)))


def test_two_sided_t(spark):
    """Values of the t table and closed forms: df 1 is Cauchy, df 2 is algebraic."""
    import math
    fixed = [(12.706204736, 1, .05), (2.228138852, 10, .05), (1.812461123, 10, .1), (2.042272456, 30, .05), (1.962339081, 1000, .05), (3.290526731, 10 ** 7, .001), (0.0, 5, 1.0), (40.0, 3, None)]
    closed = [(t, 1, 1 - 2 / math.pi * math.atan(t)) for t in (.1, 1.0, 7.0, 1e6)] + [(t, 2, 1 - t / math.sqrt(2 + t * t)) for t in (.01, .5, 3.0, 20.0)]
    rows = spark.createDataFrame([(float(t), int(df)) for t, df, _ in fixed + closed], "t double, df int").select(S.two_sided_t(F.col("t"), F.col("df")).alias("p")).collect()
    for r, (t, df, want) in zip(rows, fixed + closed):
        assert 0 <= r.p <= 1 and (want is None or r.p == pytest.approx(want, rel=1e-5 if (t, df, want) in fixed else 1e-9, abs=1e-14)), (t, df)


def test_correlation_p_equals_its_series(spark):
    import duckdb
    pairs = [(r, n) for r in (-1.0, -.9, -.3, 0.0, .001, .5, .97, 1.0) for n in (2, 3, 4, 5, 8, 41, 300, 2001)]
    got = [r.p for r in spark.createDataFrame(pairs, "r double, n int").select(S.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()]
    con = duckdb.connect()
    for (r, n), p in zip(pairs, got):
        want = con.execute(f"SELECT {S.correlation_p_sql(f'({r}::DOUBLE)', f'({n})')}").fetchone()[0]
        assert (p is None) == (want is None) and (p is None or p == pytest.approx(want, rel=1e-8, abs=1e-12)), (r, n)
