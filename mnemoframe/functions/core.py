"""Small Column expressions with pandas-compatible missing-value rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def num(c) -> Column:
    """Numeric coercion: text that is no number, and NaN, become NULL."""
    c = F.col(c) if isinstance(c, str) else c
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def whole(c) -> Column:
    """Integer coercion through double, so that '998.0' gives 998."""
    d = num(c)
    return F.when(F.rint(d) == d, d.cast("long"))


def div(a, b) -> Column:
    """a / b in doubles, NULL where b is 0."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def sem(c) -> Column:
    """Standard error of the mean (n-1), NULL for a single value."""
    return F.stddev_samp(c) / F.sqrt(F.nullif(F.count(c), F.lit(0)))


def adjusted_skew(c) -> Column:
    """Bias-adjusted skewness; NULL below three values, 0 for a constant."""
    n = F.count(c).cast("double")
    adj = F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n >= 3, F.when(F.var_pop(c) == 0, F.lit(0.0)).otherwise(adj))


def half_even(c, digits: int = 0) -> Column:
    return F.bround(c, digits)


def rint_long(c) -> Column:
    """Round half to even and return a long."""
    return F.rint(c).cast("long")


def pad2(c) -> Column:
    """Two-digit identifier as used in subject and session keys."""
    c = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)


# Wichura (1988), algorithm AS 241, PPND16 coefficients, order 0..7.
_CENTRE_NUM = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
               1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
               3.3430575583588128105e4, 2.5090809287301226727e3)
_CENTRE_DEN = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
               2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
               5.2264952788528545610e3)
_MID_NUM = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
            3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
            2.27238449892691845833e-2, 7.74545014278341407640e-4)
_MID_DEN = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
            1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
            1.05075007164441684324e-9)
_TAIL_NUM = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
             2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
             2.71155556874348757815e-5, 2.01033439929228813265e-7)
_TAIL_DEN = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
             7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
             2.04426310338993978564e-15)


def _horner(coefs, x: str) -> str:
    text = f"{coefs[-1]!r}e0" if "e" not in repr(coefs[-1]) else repr(coefs[-1])
    for c in reversed(coefs[:-1]):
        lit = repr(c) if "e" in repr(c) else f"{c!r}e0"
        text = f"({lit} + {x} * {text})"
    return text


def norm_ppf_sql(p: str) -> str:
    """Inverse normal CDF as SQL text that Spark and DuckDB both accept; NULL outside (0, 1)."""
    q = f"(({p}) - 0.5e0)"
    r0 = f"(0.180625e0 - {q} * {q})"
    tail = f"sqrt(-ln(least(({p}), 1.0e0 - ({p}))))"
    rm, rt = f"({tail} - 1.6e0)", f"({tail} - 5.0e0)"
    return (f"CASE WHEN ({p}) <= 0.0e0 OR ({p}) >= 1.0e0 OR ({p}) IS NULL THEN NULL "
            f"WHEN abs({q}) <= 0.425e0 THEN {q} * {_horner(_CENTRE_NUM, r0)} / {_horner(_CENTRE_DEN, r0)} "
            f"ELSE sign({q}) * (CASE WHEN {tail} <= 5.0e0 THEN {_horner(_MID_NUM, rm)} / {_horner(_MID_DEN, rm)} "
            f"ELSE {_horner(_TAIL_NUM, rt)} / {_horner(_TAIL_DEN, rt)} END) END")


def norm_ppf(column_name: str) -> Column:
    return F.expr(norm_ppf_sql(column_name))


# Abramowitz and Stegun 7.1.26 (error below 1.5e-7).
_ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def two_sided_p_sql(z: str) -> str:
    """Two-sided normal p-value of z as SQL text for both engines."""
    x = f"(abs({z}) / sqrt(2.0e0))"
    t = f"(1.0e0 / (1.0e0 + 0.3275911e0 * {x}))"
    poly = _horner((0.0,) + _ERF, t)
    return f"({poly} * exp(-({x} * {x})))"


def snapped(r) -> Column:
    """r within 1e-12 of a perfect correlation is one: rounding must not tell equal pairs apart."""
    return F.when(F.abs(r) >= 1 - 1e-12, F.signum(r)).otherwise(r)


def significant(x, digits: int = 9) -> Column:
    """x rounded to so many significant digits; what is within 1e-12 of 0 is 0."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(F.abs(x) < 1e-12, 0.0).otherwise(F.round(x * scale) / scale)


def significant_sql(x: str, digits: int = 9) -> str:
    scale = f"pow(10.0, {digits - 1} - floor(log10(abs({x}))))"
    return f"CASE WHEN abs({x}) < 1e-12 THEN 0.0 ELSE round({x} * {scale}) / {scale} END"


def pearson_from_sums(n, sx, sy, sxx, syy, sxy) -> Column:
    """Pearson r from six sums; NULL where a side is constant (to 1e-12 of its second moment)."""
    c = [F.col(v) if isinstance(v, str) else v for v in (n, sx, sy, sxx, syy, sxy)]
    n, sx, sy, sxx, syy, sxy = c
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    ok = (n > 0) & (vx > sxx * 1e-12) & (vy > syy * 1e-12)
    return F.when(ok, snapped((sxy - sx * sy / n) / F.sqrt(vx * vy)))


def r_agg(x, y) -> Column:
    """Pearson r as an aggregate over pairwise complete rows; NULL for a constant side."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    sd = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(F.count(x) >= 2, snapped(F.covar_pop(x, y) / F.when(sd > 1e-14, sd)))


def fisher_z(r) -> Column:
    return F.atanh(F.when(F.abs(r) < 1, r))


def first_by(value, order) -> Column:
    """First non-missing value in the given order (order expression must be unique)."""
    value = F.col(value) if isinstance(value, str) else value
    return F.min(F.when(value.isNotNull(), F.struct(order, value.alias("v"))))["v"]


def with_group_stats(df: DataFrame, keys, **aggs) -> DataFrame:
    """Attach per-group aggregates by aggregate-then-join, so that a hot group is combined map-side
    and the join back is broadcast or split by AQE instead of windowed in one task."""
    if not keys:
        stats = df.agg(*[a.alias(n) for n, a in aggs.items()])
        return df.crossJoin(F.broadcast(stats))  # exactly one row
    stats = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return df.join(stats, list(keys), "left")  # rows without a key stay, with no statistics


_PRIME = 2147483647


def draw(seed: int, *keys) -> Column:
    """Deterministic integer in [0, 2^31 - 1) from non-negative integer keys, repeatable in any engine with 64-bit
    integers, so draws survive task retries. Squaring modulo a prime breaks up runs of neighbouring keys."""
    h = F.lit(seed).cast("long")
    step = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # names the value, so the expression stays small
    for k in keys:
        k = F.col(k) if isinstance(k, str) else k
        h = (h * 31 + (k.cast("long") % _PRIME) * 7919 + 104729) % _PRIME
        h = step(h, lambda v: (v * v + v * 5 + 48271) % _PRIME)
    return step(step(h, lambda v: (v * v + 69621) % _PRIME), lambda v: (v * v + 16807) % _PRIME)


def draw_sql(seed: int, *keys: str) -> str:
    """The same draw as SQL text; a let-style nesting keeps the text short."""
    h = f"CAST({seed} AS BIGINT)"
    step = lambda x, f: f"list_transform([{x}], lambda h: {f})[1]"
    for k in keys:
        h = f"(({h} * 31 + (CAST({k} AS BIGINT) % {_PRIME}) * 7919 + 104729) % {_PRIME})"
        h = step(h, f"(h * h + h * 5 + 48271) % {_PRIME}")
    return step(step(h, f"(h * h + 69621) % {_PRIME}"), f"(h * h + 16807) % {_PRIME}")


def top_per_group(df: DataFrame, keys, order, n: int) -> DataFrame:
    """First n rows per group. The filter right on row_number lets Spark keep n rows per group and
    task before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
