"""Comparison of two versions of the same files, row by row, with tolerances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import num, pad2

SPELLINGS_OF_MISSING = ("", "nan", "NaN", "None", "n/a")


def normal_value(c) -> Column:
    s = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    return F.when(s.isNull() | s.isin(*SPELLINGS_OF_MISSING), "n/a").otherwise(s)


def _file_pairs(gen: DataFrame, ref: DataFrame, file: str) -> DataFrame:
    g, r = gen.groupBy(file).agg(F.count("*").alias("n_generated")), ref.groupBy(file).agg(F.count("*").alias("n_reference"))
    return g.join(r, file, "full_outer")


def _rows(gen: DataFrame, ref: DataFrame, pairs: DataFrame, file: str, row: str, columns) -> DataFrame:
    same = pairs.where(F.col("n_generated") == F.col("n_reference")).select(file)
    side = lambda df, p: df.select(file, row, *[F.col(c).alias(p + c) for c in columns])
    return side(gen, "g_").join(side(ref, "r_"), [file, row], "full_outer").join(same, file, "left_semi")


def compare_files(gen: DataFrame, ref: DataFrame, file: str, row: str, exact, timing, tolerance: float = 0.01) -> DataFrame:
    """Per file: presence on both sides, row counts, and only where these agree the mismatches per exact column
    and the values beyond tolerance per timing column (both sides numeric)."""
    pairs = _file_pairs(gen, ref, file)
    j = _rows(gen, ref, pairs, file, row, [*exact, *timing])
    aggs = [F.count(F.when(~F.col("g_" + c).cast("string").eqNullSafe(F.col("r_" + c).cast("string")), 1)).alias(f"n_{c}") for c in exact]
    for c in timing:
        d = F.abs(num("g_" + c) - num("r_" + c))
        aggs += [F.count(F.when(d > tolerance, 1)).alias(f"n_{c}"), F.max(d).alias(f"max_{c}")]
    out = pairs.join(j.groupBy(file).agg(*aggs), file, "left")
    differs = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"n_{c}") > 0, F.lit(False)) for c in [*exact, *timing]])
    status = (F.when(F.col("n_reference").isNull(), "MISSING_REFERENCE").when(F.col("n_generated").isNull(), "MISSING_GENERATED")
              .when((F.col("n_generated") != F.col("n_reference")) | differs, "MISMATCH").otherwise("MATCH"))
    return out.withColumn("status", status)


def column_differences(gen: DataFrame, ref: DataFrame) -> dict[str, list[str]]:
    """Columns on one side only; looks at schemas, reads no rows."""
    return {"only_generated": sorted(set(gen.columns) - set(ref.columns)), "only_reference": sorted(set(ref.columns) - set(gen.columns))}


def sweep_counts(comparison: DataFrame, by) -> DataFrame:
    return comparison.groupBy(*by, "status").agg(F.count("*").alias("n"))


def compare_columns(gen: DataFrame, ref: DataFrame, file: str, row: str, timing, categorical, other=(), tolerance: float = 0.001) -> DataFrame:
    """One row per file and column. Timing columns: values beyond tolerance and one-sided n/a. Categorical
    columns: exact after n/a normalisation. Others: numeric when every value is, else exact."""
    columns = [*timing, *categorical, *other]
    pairs = _file_pairs(gen, ref, file)
    j = _rows(gen, ref, pairs, file, row, columns)
    aggs = []
    for c in columns:
        a, b = normal_value("g_" + c), normal_value("r_" + c)
        x, y = num(a), num(b)
        d = F.abs(x - y)
        text = ((a != "n/a") & x.isNull()) | ((b != "n/a") & y.isNull())
        exact = F.count(F.when(a != b, 1))
        if c in categorical:
            n, na, mx = exact, F.lit(0).cast("long"), F.lit(None).cast("double")
        else:
            n, na, mx = F.count(F.when(d > tolerance, 1)), F.count(F.when(x.isNull() != y.isNull(), 1)), F.coalesce(F.max(d), F.lit(0.0))
            if c in other:
                is_text = F.coalesce(F.max(text), F.lit(False))
                n, na, mx = F.when(is_text, exact).otherwise(n), F.when(is_text, F.lit(0).cast("long")).otherwise(na), F.when(~is_text, mx)
        aggs.append(F.struct(F.lit(c).alias("column"), n.alias("n_mismatch"), na.alias("n_na_mismatch"), mx.alias("max_diff")).alias("s_" + c))
    g = j.groupBy(file).agg(*aggs)
    out = g.select(file, F.explode(F.array(*["s_" + c for c in columns])).alias("s")).select(file, "s.*")
    return out.withColumn("status", F.when((F.col("n_mismatch") > 0) | (F.col("n_na_mismatch") > 0), "MISMATCH").otherwise("MATCH"))


def clock_offsets(gen: DataFrame, ref: DataFrame, file: str, row: str, onset: str = "onset") -> DataFrame:
    """Difference of the first numeric onsets per file."""
    first = lambda df, n: df.where(num(onset).isNotNull()).groupBy(file).agg(F.min_by(num(onset), F.col(row)).alias(n))
    return first(gen, "_g").join(first(ref, "_r"), file).select(file, (F.col("_g") - F.col("_r")).alias("offset"))


def align_clock(gen: DataFrame, ref: DataFrame, file: str, row: str, columns, onset: str = "onset") -> DataFrame:
    """The generated side with the clock columns moved by the file's offset, ready for compare_columns."""
    o = clock_offsets(gen, ref, file, row, onset)
    return gen.join(o, file, "left").withColumns({c: num(c) - F.coalesce("offset", F.lit(0.0)) for c in columns}).drop("offset")


def map_paths(df: DataFrame, path: str, rules) -> DataFrame:
    """Output path by the first rule (pattern, replacement) that matches; NULL when none does."""
    out = F.lit(None).cast("string")
    for pattern, repl in reversed(rules):
        out = F.when(F.col(path).rlike(pattern), F.regexp_replace(path, pattern, repl)).otherwise(out)
    return df.withColumn("mapped", out)


def unmatched_outputs(outputs: DataFrame, mapped: DataFrame, path: str) -> DataFrame:
    return outputs.join(mapped.select(F.col("mapped").alias(path)).distinct(), path, "left_anti")


def pair_files(left: DataFrame, right: DataFrame, keys, run: str = "run") -> DataFrame:
    """Pairs by exact key, else an absent run number against run 01; the rest is listed from either side."""
    norm = lambda df, p: df.select(*keys, F.col(run).alias(p + run), F.coalesce(run, F.lit("-")).alias("_k"), F.col("path").alias(p + "path"))
    l, r = norm(left, "left_"), norm(right, "right_")
    exact = l.join(r, [*keys, "_k"])
    l2, r2 = l.join(exact, [*keys, "_k"], "left_anti"), r.join(exact, [*keys, "_k"], "left_anti")
    flip = F.when(F.col("_k") == "-", "01").when(F.col("_k") == "01", "-")
    loose = l2.withColumn("_k", flip).where("_k is not null").join(r2, [*keys, "_k"])
    cols = [*keys, "left_path", "right_path"]
    got = exact.select(*cols, F.lit("exact").alias("match")).unionByName(loose.select(*cols, F.lit("run").alias("match")))
    only_l = l2.join(loose.select("left_path"), "left_path", "left_anti").select(*keys, "left_path", F.lit(None).cast("string").alias("right_path"), F.lit("left only").alias("match"))
    only_r = r2.join(loose.select("right_path"), "right_path", "left_anti").select(*keys, F.lit(None).cast("string").alias("left_path"), "right_path", F.lit("right only").alias("match"))
    return got.unionByName(only_l).unionByName(only_r)


def offset_consistency(gen: DataFrame, ref: DataFrame, file: str, row: str, onset: str = "onset", limit: float = 0.001) -> DataFrame:
    """Is the onset difference of a file the same in all rows (range below 1 ms)?"""
    a = gen.select(file, row, num(onset).alias("_a"))
    j = a.join(ref.select(file, row, num(onset).alias("_b")), [file, row]).withColumn("_d", F.col("_a") - F.col("_b"))
    g = j.where("_d is not null").groupBy(file).agg(F.count("*").alias("n_rows"), F.min("_d").alias("min_offset"), F.max("_d").alias("max_offset"), F.avg("_d").alias("mean_offset"))
    return g.withColumn("constant", F.col("max_offset") - F.col("min_offset") < limit)


def header_renames(gen: DataFrame, ref: DataFrame, renames: dict[str, str]) -> dict[str, list]:
    """Header differences after known renames (schemas only)."""
    d = column_differences(gen, ref)
    known = [(a, b) for a, b in renames.items() if a in d["only_generated"] and b in d["only_reference"]]
    return {"renamed": known, "only_generated": [c for c in d["only_generated"] if c not in dict(known)],
            "only_reference": [c for c in d["only_reference"] if c not in [b for _, b in known]]}
