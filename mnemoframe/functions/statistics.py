"""Tail probabilities as DataFrame expressions: exact signed-rank sums, Student's t, the incomplete beta function."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXACT = 50
STEPS = 500
# Coefficients of the Lanczos approximation of the gamma function for g = 7 and nine terms.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.aggregate(F.array(), value, lambda held, _: held, body)


def signed_rank_counts(n: Column) -> Column:
    """How many of the 2^n choices of signs give each sum 0 .. n (n + 1) / 2 of the ranks 1 .. n, for n up to 62.

    Rank k shifts the counts so far by k and adds them: n folds over one array."""
    start = F.array(F.lit(1).cast("long"))

    def with_rank(counts: Column, k: Column) -> Column:
        zeros = F.array_repeat(F.lit(0).cast("long"), k)
        return F.zip_with(F.concat(counts, zeros), F.concat(zeros, counts), lambda a, b: a + b)

    return F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), start, with_rank)


def signed_rank_table(spark: SparkSession, largest: int = EXACT) -> DataFrame:
    """(exact_n, w, exact_p): two-sided p of every rank sum for 1 .. largest differences: twice the smaller tail, at most 1.

    About largest^3 / 6 rows, whatever the data."""
    n = F.col("id").cast("int")
    tails = spark.range(1, largest + 1, numPartitions=1).select(n.alias("exact_n"), signed_rank_counts(n).alias("_c"))
    running = F.aggregate("_c", F.array().cast("array<bigint>"), lambda a, c: F.concat(a, F.array(c + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)))))
    rows = tails.select("exact_n", F.posexplode(let(running, lambda r: F.transform(r, lambda x, i: F.least(x, F.get(r, F.size(r) - 1 - i))))).alias("w", "_tail"))
    return rows.select("exact_n", F.col("w").cast("double").alias("w"), F.least(F.lit(1.0), 2 * F.col("_tail") / F.pow(F.lit(2.0), "exact_n")).alias("exact_p"))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1/2."""
    z = x - 1
    terms = sum((F.lit(c) / (z + i) for i, c in enumerate(LANCZOS) if i), F.lit(LANCZOS[0]))
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(terms)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function by modified Lentz steps; ends when a step changes nothing."""
    tiny = F.lit(1e-300)
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    first = let(F.lit(1.0) / safe(1 - (a + b) * x / (a + 1)), lambda d: F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"), F.lit(False).alias("done")))

    def half(s: Column, term: Column) -> Column:
        return let(F.struct((F.lit(1.0) / safe(1 + term * s.d)).alias("d"), safe(1 + term / s.c).alias("c")),
                   lambda n: F.struct(n.c.alias("c"), n.d.alias("d"), (s.h * n.c * n.d).alias("h"), (F.abs(n.c * n.d - 1) < 1e-16).alias("done")))

    def step(s: Column, k: Column) -> Column:
        m = k.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(s.done, s).otherwise(let(half(s, even), lambda e: half(e, odd)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), first, step, lambda s: s.h)


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b) for a, b >= 1/2; null where an argument is null or x is outside 0 .. 1."""
    def part(a: Column, b: Column, x: Column) -> Column:
        return F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x)) * _fraction(a, b, x) / a
    inside = F.when(x < (a + 1) / (a + b + 2), part(a, b, x)).otherwise(1 - part(b, a, 1 - x))
    return F.when(x == 0, F.lit(0.0)).when(x == 1, F.lit(1.0)).when((x > 0) & (x < 1), inside)


def two_sided_t(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t with df >= 1 degrees of freedom."""
    return incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation over n pairs by the t distribution with n - 2 degrees of freedom: 0 where |r| is 1, null for fewer
    than three pairs. df / (df + t^2) is 1 - r^2."""
    df = (n - 2).cast("double")
    one = 1 - r * r
    return F.when(df >= 1, F.when(one <= 0, F.lit(0.0)).otherwise(incomplete_beta(df / 2, F.lit(0.5), one)))


def signed_rank_dist_sql(largest: int = EXACT) -> str:
    """Recursive common table sr_dist (n, s, c), and sr_tail (n, s, p), the exact two-sided p, for SQL."""
    return f"""sr_dist(n, s, c) AS (SELECT 0, 0, 1::HUGEINT UNION ALL SELECT n + 1, s2, sum(c)::HUGEINT FROM (SELECT n, s + v.d * (n + 1) AS s2, c FROM sr_dist, (VALUES (0), (1)) AS v(d) WHERE n < {largest}) GROUP BY n, s2),
  sr_sum AS (SELECT n, s, sum(c) OVER (PARTITION BY n ORDER BY s) AS lo, sum(c) OVER (PARTITION BY n ORDER BY s DESC) AS hi FROM sr_dist), sr_tail AS (SELECT n, s, least(1.0, 2 * least(lo, hi)::DOUBLE / power(2.0, n)) AS p FROM sr_sum)"""


def correlation_p_sql(r: str, n: str) -> str:
    """The same p by its finite series in the angle atan(t / sqrt(df)), for SQL."""
    angle, df = f"asin(least(1.0, abs({r})))", f"({n} - 2)"
    even = f"sin({angle}) * list_sum(list_transform(range(0, {df} // 2), lambda k: exp(lgamma(2 * k + 1) - 2 * k * ln(2) - 2 * lgamma(k + 1) + 2 * k * ln(cos({angle})))))"
    odd = f"2 / pi() * ({angle} + sin({angle}) * coalesce(list_sum(list_transform(range(0, ({df} - 1) // 2), lambda k: exp(2 * k * ln(2) + 2 * lgamma(k + 1) - lgamma(2 * k + 2) + (2 * k + 1) * ln(cos({angle}))))), 0))"
    return f"CASE WHEN {df} < 1 THEN NULL WHEN abs({r}) >= 1 THEN 0.0 WHEN {df} % 2 = 0 THEN 1 - {even} ELSE 1 - {odd} END"
