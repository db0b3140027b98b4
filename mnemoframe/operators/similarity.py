"""Pattern similarity: cells of same and different items, seeded surrogates, contrasts, reliability.

A pattern table holds one row per presentation: an id, labels (subject, session, run, item) and a vector.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import div, draw, r_agg, two_sided_p_sql, with_group_stats
from ..functions.gram import pair_correlations
from ..functions.quantiles import exact_quantiles
from ..functions.scan import id_block, ordered_neighbours, row_index, running_total
from ..functions.vectors import block_count, cell_sums, complete_vectors, explode_unit, few_patterns, pattern_cell_sums, pearson_complete, rows_and_dim, with_scale
from ..functions.statistics import signed_rank_table
from .series import mid_ranks

N_DRAWS = 10
WINDOW = 3


def matched_r(a: DataFrame, b: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """r between the two vectors of a key over components both have, with their number."""
    j = a.select(key, F.col(vec).alias("_a")).join(b.select(key, F.col(vec).alias("_b")), key)
    r, n = pearson_complete("_a", "_b")
    return j.select(key, r.alias("r"), n.alias("n_voxels"))


def pairwise_cells(df: DataFrame, key: str, vec: str, cell: str, n_blocks: int | None = None) -> DataFrame:
    """Mean r over all pairs of rows by pair of cells, pairwise complete. Rows that miss the same components are summed, so work is linear
    in the rows. Where about as many patterns are missing as there are rows, or n_blocks is given, the pairs run as block products,
    and only cell sums leave a block. Use the sums in `item_cells` where nothing is missing."""
    patterns = None if n_blocks else few_patterns(df, vec, cell)
    if patterns is not None:
        return pattern_cell_sums(df, vec, cell, patterns)
    return cell_sums(df, key, vec, cell, n_blocks or block_count(*rows_and_dim(df, vec)))


def run_positions(df: DataFrame, run, order: str, out: str = "pos") -> DataFrame:
    return row_index(df, run, [order], id_block(order), out)


def triplet_blocks(df: DataFrame, run, triplet: Column, item: str, pos: str = "pos") -> DataFrame:
    """Consecutive threes of triplet trials per run, and whether each is contiguous and complete."""
    t = row_index(df.where(triplet), run, [pos], id_block(pos), "_k")
    t = t.withColumn("block", F.floor(F.col("_k") / 3))
    g = t.groupBy(*run, "block").agg(F.count("*").alias("n"), F.min(pos).alias("start"), F.max(pos).alias("_e"), F.countDistinct(item).alias("_d"))
    return g.select(*run, "block", "n", "start", ((F.col("n") == 3) & (F.col("_e") - F.col("start") == 2) & (F.col("_d") == 3)).alias("valid"))


def surrogate_pool(df: DataFrame, run, eligible: Column, pos: str = "pos", window: int = 1) -> DataFrame:
    """Numbered pool per run: positions where `window` consecutive trials are all eligible. Draws address the pool
    by number, so it is never gathered into one row."""
    x = df.withColumn("_ok", eligible.cast("int"))
    if window > 1:
        from ..functions.scan import with_neighbours
        x = with_neighbours(x, run, pos, after=window - 1, **{f"_l{k}": (lambda w, k=k: F.lead("_ok", k).over(w)) for k in range(1, window)})
        ok = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"_l{k}") == 1, F.lit(False)) for k in range(1, window)], F.col("_ok") == 1)
    else:
        ok = F.col("_ok") == 1
    return row_index(x.where(ok).select(*run, F.col(pos).alias("start")), run, ["start"], id_block("start"), "slot")


def draw_surrogates(targets: DataFrame, pool: DataFrame, patterns: DataFrame, run, key: str, seed: int, offset=None, n_draws: int = N_DRAWS) -> DataFrame:
    """Surrogate presentations per target from the target's own run: (key, draw_no, surrogate). The draw depends on
    the target's id and number only, so every version of the data gets the same surrogates."""
    size = pool.groupBy(*run).agg(F.count("*").alias("_size"))
    t = targets.join(size, list(run)).withColumn("draw_no", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
    t = t.withColumn("slot", draw(seed, key, "draw_no") % F.col("_size"))
    t = t.join(pool, [*run, "slot"]).withColumn("pos", F.col("start") + (F.col(offset) if offset else F.lit(0)))
    d = t.select(*run, key, "draw_no", "pos").join(patterns.select(*run, "pos", F.col(key).alias("surrogate")), [*run, "pos"])
    return d.select(key, "draw_no", "surrogate")  # seeded, so a second reading draws the same


def _surrogate_sums(targets: DataFrame, draws: DataFrame, scaled: DataFrame, keys, key: str, vec: str) -> DataFrame:
    """Per key and component: sum over all surrogates of the targets, with their number."""
    d = draws.join(targets.select(*keys, key), key)
    d = d.join(scaled.select(F.col(key).alias("surrogate"), "_mu", "_len", vec), "surrogate")
    return explode_unit(d, keys, vec).groupBy(*keys, "pos").agg(F.sum("x").alias("d"), F.count("*").alias("nd"))


def within_cells(patterns: DataFrame, draws: DataFrame, keys, key: str, wanted: Column, session: str = "session", vec: str = "vec") -> DataFrame:
    """Cross-session pairs of the same item against pairs whose later member is replaced by its surrogates. With S the
    vector sum of a session, the pairs add up to the product of S with the sum of all earlier sessions: exact, and
    linear in the presentations. `wanted` selects the items; surrogates come from all patterns."""
    scaled = with_scale(patterns, vec)
    mine = scaled.where(wanted)
    s = explode_unit(mine, [*keys, session], vec).groupBy(*keys, session, "pos").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys, "pos").orderBy(session).rowsBetween(Window.unboundedPreceding, -1)  # one row per session
    pre = s.withColumn("_b", F.sum("s").over(w)).withColumn("_nb", F.sum("n").over(w)).where("_nb > 0")
    d = _surrogate_sums(mine, draws, scaled, [*keys, session], key, vec)
    has = mine.join(draws.select(key).distinct(), key, "left_semi").groupBy(*keys, session).agg(F.count("*").alias("_nt"))
    j = pre.join(d, [*keys, session, "pos"], "left").join(has, [*keys, session], "left")
    first = F.col("pos") == 0
    g = j.groupBy(*keys).agg(
        F.sum(F.when(first, F.col("_nb") * F.col("n"))).alias("n_same"), F.sum(F.col("_b") * F.col("s")).alias("_rs"),
        F.sum(F.when(first, F.col("_nb") * F.col("_nt"))).alias("n_diff"), F.sum(F.col("_b") * F.col("d")).alias("_rd"),
        F.sum(F.when(first, F.col("_nb") * F.col("nd"))).alias("_nd"), (F.max("pos") + 1).cast("long").alias("n_voxels"))
    row = lambda name, n, draws_, r: F.struct(F.lit(name).alias("cell"), n.alias("n_pairs"), F.lit(draws_).alias("n_draws"), r.alias("r"))
    both = F.array(row("within_same", F.col("n_same"), 0, div("_rs", "n_same")), row("within_diff", F.col("n_diff"), N_DRAWS, div("_rd", "_nd")))
    return g.select(*keys, "n_voxels", F.explode(both).alias("c")).select(*keys, "n_voxels", "c.*").where("n_pairs is not null")


def across_cells(patterns: DataFrame, draws: DataFrame, keys, key: str, wanted: Column, subject: str = "subject", item: str = "item",
                 session: str = "session", vec: str = "vec") -> DataFrame:
    """Pairs of two subjects' presentations of an item, over all sessions and over matched sessions, with the second
    subject's presentations replaced by surrogates in the `diff` cells. Only per-subject sums meet, so the pairs
    formed are those of the declared subjects."""
    scaled = with_scale(patterns, vec)
    mine = scaled.where(wanted)
    k = [*keys, item, session, subject]
    s = explode_unit(mine, k, vec).groupBy(*k, "pos").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    s = s.join(_surrogate_sums(mine, draws, scaled, k, key, vec), [*k, "pos"], "left")
    out = []
    for scope, extra in (("all", []), ("matched", [session])):
        at = [*keys, item, *extra, "pos"]
        g = s.groupBy(*at, subject).agg(*[F.sum(c).alias(c) for c in ("s", "n", "d", "nd")])
        a = g.select(*at, F.col(subject).alias("sub_a"), F.col("s").alias("_sa"), F.col("n").alias("_na"))
        p = a.join(g.withColumnRenamed(subject, "sub_b"), at).where("sub_a < sub_b")
        first = F.col("pos") == 0
        h = p.groupBy(*keys, item, "sub_a", "sub_b").agg(F.sum(F.when(first, F.col("_na") * F.col("n"))).alias("n_pairs"), F.sum(F.col("_sa") * F.col("s")).alias("_same"),
                                                         F.sum(F.col("_sa") * F.col("d")).alias("_diff"), F.sum(F.when(first, F.col("_na") * F.col("nd"))).alias("_nd"))
        for name, r in (("across_same", F.col("_same") / F.col("n_pairs")), ("across_diff", div("_diff", "_nd"))):
            out.append(h.select(*keys, item, F.concat_ws("+", "sub_a", "sub_b").alias("unit"), F.lit(name).alias("cell"), F.lit(scope).alias("session_scope"), "n_pairs", r.alias("r")))
    return reduce(DataFrame.unionByName, out)


def context_class(role_a, role_b) -> Column:
    return (F.when((role_a == "triplet") & (role_b == "triplet"), "triplet-triplet").when((role_a == "single") & (role_b == "single"), "single-single").otherwise("mixed"))


# -- movies -------------------------------------------------------------------------------------------------------

def _movie_lengths(p: DataFrame, keys, movie: str, session: str, run: str) -> DataFrame:
    return p.groupBy(*keys, session, run, movie).agg((F.max("uidx") + 1).alias("length"))


def _paired_movies(u: DataFrame, pairs: DataFrame, ln: DataFrame, keys, side, movie: str, session: str, run: str, vec: str, seed: int, n_draws: int):
    """(same, diff): mean r of each row of pairs (keys, sides, movie, s1, s2, r2, L) over index-matched columns, and over windows of
    another movie in the second member's run. `side` names the member columns of pairs: one for both, or one each."""
    first, second = [*keys, side[0]], [*keys, side[-1]]
    ids = list(dict.fromkeys([*first, *second, movie, "s1", "s2"]))
    member = ln.columns[len(keys)]
    repeated = pairs.select(movie).distinct()
    a = explode_unit(u.join(repeated, movie, "left_semi"), [*keys, member, movie, session, "uidx"], vec).withColumnsRenamed({member: side[0], session: "s1", "x": "_xa"})
    b = explode_unit(u, [*keys, member, movie, session, "uidx"], vec).withColumnsRenamed({member: side[-1], movie: "m2", session: "s2", "uidx": "u2", "x": "_xb"})
    mean_r = F.sum(F.col("_xa") * F.col("_xb")) / F.count(F.when(F.col("pos") == 0, 1))
    on_a, on_b = [*first, movie, "s1"], [*second, "m2", "s2", "u2", "pos"]
    same = a.join(pairs, on_a).where("uidx < L").withColumn("m2", F.col(movie)).withColumn("u2", F.col("uidx")).join(b, on_b).groupBy(*ids).agg(mean_r.alias("_r"))
    other = ln.withColumnsRenamed({member: side[-1], session: "s2", run: "r2", movie: "m2", "length": "_lo"})
    cand = pairs.join(other, [*second, "s2", "r2"]).where(F.col("m2") != F.col(movie)).withColumn("_full", F.col("_lo") >= F.col("L"))
    cand = with_group_stats(cand, ids, _any=F.max("_full")).where("_full or not _any")
    cand = cand.withColumn("_c", F.row_number().over(Window.partitionBy(*ids).orderBy("m2")) - 1)  # the movies of one run
    size = cand.groupBy(*ids).agg(F.count("*").alias("_nc"))
    code = lambda c: F.conv(F.substring(F.md5(F.col(c).cast("string")), 1, 7), 16, 10).cast("long")
    codes = [code(c) for c in (*(side if len(side) > 1 else ()), movie, "s1", "s2")]
    dr = pairs.join(size, ids).withColumn("draw_no", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
    dr = dr.withColumn("_c", (draw(seed, *codes, "draw_no") % F.col("_nc")).cast("int")).join(cand.select(*ids, "_c", "m2", "_lo"), [*ids, "_c"])
    dr = dr.withColumn("_w", F.least("L", "_lo")).withColumn("_st", draw(seed + 1, *codes, "draw_no") % (F.col("_lo") - F.col("_w") + 1))
    dc = a.join(dr, on_a).where("uidx < _w").withColumn("u2", F.col("_st") + F.col("uidx"))
    diff = dc.join(b, on_b).groupBy(*ids, "draw_no").agg(mean_r.alias("_d")).groupBy(*ids).agg(F.avg("_d").alias("_r"))
    return same, diff


def movie_cells(patterns: DataFrame, keys, repeated, movie: str = "movie", session: str = "session", run: str = "run", vec: str = "vec", seed: int = 1,
                n_draws: int = N_DRAWS) -> DataFrame:
    """Per repeated movie and pair of sessions: mean r of index-matched columns, and of windows of another movie in
    the later session's run (one that is long enough if there is any, else its full length). Means of means. There is
    one row per session and column, so pairs per column are those of the declared sessions. The last key is the subject."""
    u = with_scale(patterns, vec)
    ln = _movie_lengths(u, keys, movie, session, run)
    rep = ln.where(F.col(movie).isin(*repeated))
    one = rep.select(*keys, movie, F.col(session).alias("s1"), F.col("length").alias("_l1"))
    two = rep.select(*keys, movie, F.col(session).alias("s2"), F.col(run).alias("r2"), F.col("length").alias("_l2"))
    pairs = one.join(two, [*keys, movie]).where("s1 < s2").withColumn("L", F.least("_l1", "_l2")).drop("_l1", "_l2")
    same, diff = _paired_movies(u, pairs, ln, list(keys)[:-1], [list(keys)[-1]], movie, session, run, vec, seed, n_draws)
    cell = lambda x, name: x.groupBy(*keys, movie).agg(F.count("*").alias("n_pairs"), F.avg("_r").alias("r")).withColumn("cell", F.lit(name))
    return cell(same, "within_same").unionByName(cell(diff, "within_diff"))


def movie_cells_across(patterns: DataFrame, keys, repeated, subject: str = "subject", movie: str = "movie", session: str = "session", run: str = "run", vec: str = "vec",
                       seed: int = 1, n_draws: int = N_DRAWS) -> DataFrame:
    """The same between two subjects (unit `a+b`, a < b): all pairs of a session of one and a session of the other, windows drawn in
    the second subject's run. One row per unit, movie, cell and scope: all session pairs, or those of equal sessions. Units without a
    matched pair have no row in that scope. Pairs are those of declared subjects and sessions."""
    u = with_scale(patterns, vec)
    ln = _movie_lengths(u, [*keys, subject], movie, session, run)
    rep = ln.where(F.col(movie).isin(*repeated))
    one = rep.select(*keys, movie, F.col(subject).alias("sub_a"), F.col(session).alias("s1"), F.col("length").alias("_l1"))
    two = rep.select(*keys, movie, F.col(subject).alias("sub_b"), F.col(session).alias("s2"), F.col(run).alias("r2"), F.col("length").alias("_l2"))
    pairs = one.join(two, [*keys, movie]).where("sub_a < sub_b").withColumn("L", F.least("_l1", "_l2")).drop("_l1", "_l2")
    same, diff = _paired_movies(u, pairs, ln, keys, ["sub_a", "sub_b"], movie, session, run, vec, seed, n_draws)
    both = same.withColumn("cell", F.lit("across_same")).unionByName(diff.withColumn("cell", F.lit("across_diff")))
    scopes = both.withColumn("scope", F.explode(F.when(F.col("s1") == F.col("s2"), F.array(F.lit("all"), F.lit("matched"))).otherwise(F.array(F.lit("all")))))
    unit = F.concat_ws("+", F.col("sub_a").cast("string"), F.col("sub_b").cast("string")).alias("unit")
    return scopes.groupBy(*keys, unit, movie, "cell", "scope").agg(F.count("*").alias("n_pairs"), F.avg("_r").alias("r"))


# -- tables over cells ----------------------------------------------------------------------------------------------

def roll_up(cells: DataFrame, keys) -> DataFrame:
    return cells.groupBy(*keys, "cell").agg(F.avg("r").alias("r"), F.count("*").alias("n_units"), F.avg("n_voxels").alias("n_voxels"))


def pair_count_check(cells: DataFrame, expected: dict[str, int]) -> DataFrame:
    exp = reduce(lambda c, kv: F.when(F.col("cell") == kv[0], kv[1]).otherwise(c), expected.items(), F.lit(None).cast("long"))
    return cells.withColumn("n_expected", exp).groupBy("cell").agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("n_pairs") != F.col("n_expected"), 1)).alias("n_bad"))


def signed_rank(df: DataFrame, keys, d: str = "d") -> DataFrame:
    """Signed-rank sum of non-zero differences (ties averaged), its z with tie correction, and its two-sided p: exact for up to
    EXACT differences without ties and zeros, else by the normal approximation."""
    zeros = df.groupBy(*keys).agg(F.count(F.when(F.col(d) == 0, 1)).alias("_zeros"))
    x = df.where((F.col(d) != 0) & F.col(d).isNotNull()).select(*keys, d, F.abs(F.col(d)).alias("_abs"))
    x = mid_ranks(x, keys, "_abs", "_rank")
    g = x.groupBy(*keys).agg(F.count("*").alias("n_nonzero"), F.sum(F.when(F.col(d) > 0, F.col("_rank")).otherwise(0.0)).alias("w_plus"))
    ties = x.groupBy(*keys, "_abs").agg(F.count("*").cast("double").alias("_t")).groupBy(*keys).agg(F.sum(F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).alias("_tie"))
    n = F.col("n_nonzero").cast("double")
    g = g.join(ties, list(keys)).join(zeros, list(keys)).withColumn("z", (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(F.nullif(n * (n + 1) * (2 * n + 1) / 24 - F.col("_tie") / 48, F.lit(0.0))))
    exact = signed_rank_table(df.sparkSession).withColumnRenamed("w", "_w")
    g = g.withColumn("_n", F.when((F.col("_tie") == 0) & (F.col("_zeros") == 0), F.col("n_nonzero")))
    g = g.join(exact, (F.col("_n") == F.col("exact_n")) & (F.col("w_plus") == F.col("_w")), "left")
    return g.withColumn("p", F.coalesce("exact_p", F.expr(two_sided_p_sql("z")))).drop("_tie", "_zeros", "_n", "_w", "exact_n", "exact_p")


def _contrast(pairs: DataFrame, keys, name: str) -> DataFrame:
    p = pairs.withColumn("d", F.col("a") - F.col("b"))
    g = p.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("d").alias("delta"))
    return g.join(signed_rank(p, keys).select(*keys, "w_plus", "p"), list(keys), "left").withColumn("contrast", F.lit(name))


def contrasts(cells: DataFrame, keys) -> DataFrame:
    """Same against different items, within and across subjects, and each subject's within cell against the mean of
    the across cells it takes part in."""
    pick = lambda c, n: cells.where(F.col("cell") == c).select(*keys, "unit", "item", F.col("r").alias(n))
    out = []
    for level in ("within", "across"):
        out.append(_contrast(pick(f"{level}_same", "a").join(pick(f"{level}_diff", "b"), [*keys, "unit", "item"]), keys, f"{level}_same_vs_diff"))
    a = pick("across_same", "b").withColumn("unit", F.explode(F.split("unit", r"\+"))).groupBy(*keys, "unit", "item").agg(F.avg("b").alias("b"))
    out.append(_contrast(pick("within_same", "a").join(a, [*keys, "unit", "item"]), keys, "within_vs_across_same"))
    return reduce(DataFrame.unionByName, out)


def version_contrast(cells: DataFrame, keys, version: str, base: str, other: str, pair=("unit", "item"), value: str = "r") -> DataFrame:
    """Two versions of the data over the units both have."""
    p = cells.groupBy(*keys, *pair).pivot(version, [base, other]).agg(F.avg(value)).na.drop(subset=[base, other])
    p = p.withColumn("d", F.col(other) - F.col(base))
    g = p.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(base).alias("base"), F.avg(other).alias("other"), F.avg("d").alias("delta"), F.avg((F.col("d") > 0).cast("double")).alias("share_up"))
    return g.join(signed_rank(p, keys).select(*keys, "w_plus", "p"), list(keys), "left")


def context_table(cells: DataFrame, keys) -> DataFrame:
    return cells.where(F.col("cell").startswith("across")).groupBy(*keys, "cell", "context_match").agg(F.avg("r").alias("r"), F.count("*").alias("n_rows"))


def standardised_effect(cells: DataFrame, keys) -> DataFrame:
    """Mean over standard deviation (n-1) of the paired same - diff values; NULL for one pair or no spread."""
    lv = cells.withColumn("level", F.split("cell", "_")[0]).withColumn("kind", F.split("cell", "_")[1])
    p = lv.groupBy(*keys, "level", "unit", "item").pivot("kind", ["same", "diff"]).agg(F.avg("r")).na.drop(subset=["same", "diff"])
    d = F.col("same") - F.col("diff")
    return p.groupBy(*keys, "level").agg(F.count("*").alias("n"), div(F.avg(d), F.stddev_samp(d)).alias("effect"))


# -- discriminability -------------------------------------------------------------------------------------------------

def item_discriminability(patterns: DataFrame, keys, item: str, run: str, vec: str = "vec") -> DataFrame:
    """Mean r of same-item and of different-item pairs across runs, per group of trials. Components missing anywhere
    in the group are dropped. Sums over squared vector sums replace the pairs:
    cross-run pairs = (|S|^2 - sum over runs |S_run|^2) / 2."""
    u = with_scale(complete_vectors(patterns, keys, vec), "v")
    s = explode_unit(u, [*keys, item, run], "v").groupBy(*keys, item, run, "pos").agg(F.sum("x").alias("s"), F.count("*").alias("n"))

    def level(by, name):
        """Per group of `by`: squared norm of its sum and squared count, added up per key."""
        g = s.groupBy(*keys, *by, "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        return g.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias(f"_q{name}"), F.sum(F.when(F.col("pos") == 0, F.col("n") * F.col("n"))).alias(f"_m{name}"))

    j = reduce(lambda a, b: a.join(b, list(keys)), [level([], "0"), level([run], "r"), level([item], "i"), level([item, run], "ir")])
    n_w, n_all = (F.col("_mi") - F.col("_mir")) / 2, (F.col("_m0") - F.col("_mr")) / 2
    s_w, s_all = (F.col("_qi") - F.col("_qir")) / 2, (F.col("_q0") - F.col("_qr")) / 2
    out = j.select(*keys, n_w.cast("long").alias("n_within"), (n_all - n_w).cast("long").alias("n_between"), div(s_w, n_w).alias("within_r"), div(s_all - s_w, n_all - n_w).alias("between_r"))
    return out.withColumn("discriminability", F.col("within_r") - F.col("between_r"))


def movie_discriminability(series: DataFrame, keys, subjects, movies, value: str = "value", min_len: int = 4) -> DataFrame:
    """The same for series of different subjects, equal or different movie, cut to the shorter of each pair. Members
    are the declared subjects times movies."""
    s = series.withColumn("_m", F.concat_ws("|", "subject", "movie"))
    p = pair_correlations(s, keys, "t", "_m", value, [f"{a}|{b}" for a in subjects for b in movies], min_len)
    part = lambda c, i: F.split(c, r"\|")[i]
    p = p.where(part("member_a", 0) != part("member_b", 0)).withColumn("_same", part("member_a", 1) == part("member_b", 1))
    g = p.groupBy(*keys).agg(F.avg(F.when(F.col("_same"), F.col("r"))).alias("within_r"), F.avg(F.when(~F.col("_same"), F.col("r"))).alias("between_r"),
                             F.count(F.when(F.col("_same"), 1)).alias("n_within"), F.count(F.when(~F.col("_same"), 1)).alias("n_between"))
    return g.withColumn("discriminability", F.col("within_r") - F.col("between_r"))


def collect_results(parts, model: str = "none") -> DataFrame:
    """Union of result tables; where one carries several confound models only the named one is kept."""
    pick = lambda d: d.where(F.col("confound_model") == model).drop("confound_model") if "confound_model" in d.columns else d
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [pick(d) for d in parts])


def version_table(df: DataFrame, keys, version: str, base: str, other: str, value: str = "discriminability") -> DataFrame:
    """Mean per version, their difference, and the difference in per cent of the base."""
    g = df.groupBy(*keys).pivot(version, [base, other]).agg(F.avg(value)).na.drop(subset=[base, other])
    return g.select(*keys, F.col(base).alias("base"), F.col(other).alias("other"), (F.col(other) - F.col(base)).alias("delta"), (100 * div(F.col(other) - F.col(base), F.abs(F.col(base)))).alias("pct"))


def paired_test(df: DataFrame, keys, unit, version: str, base: str, other: str, value: str = "discriminability") -> DataFrame:
    """Per group (keys): the differences between two versions over the units that have both, their number, mean, share
    above 0 in per cent, and the signed-rank p."""
    g = df.groupBy(*keys, *unit).pivot(version, [base, other]).agg(F.avg(value)).na.drop(subset=[base, other])
    d = g.select(*keys, (F.col(other) - F.col(base)).alias("d"))
    s = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("d").alias("mean"), (100 * F.avg((F.col("d") > 0).cast("double"))).alias("pct_pos"))
    return s.join(signed_rank(d, keys).select(*keys, "p"), list(keys), "left")


def component_table(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("within_r", "between_r", "discriminability")])


def headline(table: DataFrame) -> DataFrame:
    """How often the other version wins, and the best relative gain."""
    return table.agg(F.count(F.when(F.col("other") > F.col("base"), 1)).alias("n_won"), F.count("*").alias("n_total"), F.max_by("roi", "pct").alias("best_roi"), F.max("pct").alias("best_pct"))


# -- reliability --------------------------------------------------------------------------------------------------------

def _components(p: DataFrame, keep, vec: str) -> DataFrame:
    x = p.select(*keep, F.posexplode(vec).alias("pos", "_x"))
    v = F.col("_x").cast("double")
    return x.select(*keep, "pos", F.when(~F.isnan(v), v).alias("x"))


def loo_reliability(patterns: DataFrame, item: str, order: str, vec: str = "vec") -> DataFrame:
    """Per component: r over repeated items between one presentation and the mean of the others, averaged over splits
    with at least three items. An item counts in a split when the first component of its single presentation is
    there; a component with a gap in a split has no r in it."""
    p = row_index(patterns, [item], [order], id_block(order), "split").withColumn("_in", F.get(F.col(vec), F.lit(0)).isNotNull())
    x = _components(p, [item, "split", "_in"], vec)
    tot = x.groupBy(item, "pos").agg(F.sum("x").alias("_s"), F.count("x").alias("_c"), F.count("*").alias("_n")).where("_n >= 2")
    j = x.where("_in").join(tot, [item, "pos"])
    b = F.when(F.col("_c") == F.col("_n"), (F.col("_s") - F.col("x")) / (F.col("_n") - 1))
    g = j.groupBy("split", "pos").agg(F.count("*").alias("n_items"), F.count(F.when(F.col("x").isNotNull() & b.isNotNull(), 1)).alias("_k"), r_agg("x", b).alias("r"))
    g = g.where("n_items >= 3").withColumn("r", F.when(F.col("_k") == F.col("n_items"), F.col("r")))
    return g.groupBy("pos").agg(F.avg("r").alias("reliability"), F.count("r").alias("n_splits"))


def _halves_r(x: DataFrame, item: str, first: Column, second: Column) -> DataFrame:
    """Per component: r over items between two averages of presentations; NULL where any item has a gap."""
    g = x.groupBy(item, "pos").agg(F.avg(F.when(first, F.col("x"))).alias("a"), F.avg(F.when(second, F.col("x"))).alias("b"))
    r = g.groupBy("pos").agg(r_agg("a", "b").alias("r"), F.count("*").alias("n_items"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("_k"))
    return r.select("pos", F.when(F.col("_k") == F.col("n_items"), F.col("r")).alias("r"), "n_items")


def first_second_reliability(patterns: DataFrame, item: str, order: str, vec: str = "vec") -> DataFrame:
    """Between the first and the second presentation of every repeated item."""
    p = with_group_stats(row_index(patterns, [item], [order], id_block(order), "_k"), [item], _n=F.count("*")).where("_k < 2 and _n >= 2")
    return _halves_r(_components(p, [item, "_k"], vec), item, F.col("_k") == 0, F.col("_k") == 1)


def split_half_reliability(patterns: DataFrame, item: str, order: str, half: int, vec: str = "vec") -> DataFrame:
    """Between the mean of the first `half` and of the last `half` presentations."""
    p = with_group_stats(row_index(patterns, [item], [order], id_block(order), "_k"), [item], _n=F.count("*")).where(F.col("_n") >= 2 * half)
    return _halves_r(_components(p, [item, "_k", "_n"], vec), item, F.col("_k") < half, F.col("_k") >= F.col("_n") - half)


def roi_quantiles(components: DataFrame, roi: Column, value: str = "r", wanted: dict | None = None) -> DataFrame:
    return exact_quantiles(components.withColumn("roi", roi), ["roi"], value, wanted or {"median": .5, "p90": .9})


def session_z(patterns: DataFrame, keys, keep, vec: str = "vec") -> DataFrame:
    """Components (keys, keep, pos, z): z-scores within a session; no spread gives missing."""
    x = _components(patterns, [*keys, *keep], vec)
    j = with_group_stats(x, [*keys, "pos"], _m=F.avg("x"), _sd=F.stddev_pop("x"))
    return j.withColumn("z", (F.col("x") - F.col("_m")) / F.when(F.col("_sd") > 1e-12, F.col("_sd"))).drop("x", "_m", "_sd")


def repeat_average(components: DataFrame, item, value: str = "z") -> DataFrame:
    return components.groupBy(*item, "pos").agg(F.avg(value).alias("mean_z"), F.count(F.lit(1)).alias("n"))


def restart_segments(df: DataFrame, keys, order: str, index: str, value: str) -> DataFrame:
    """Number the presentations where the position index restarts, then average each position over them."""
    p = ordered_neighbours(df, keys, [order], id_block(order), before=1, _restart=lambda w: F.coalesce((F.col(index) <= F.lag(index).over(w)).cast("long"), F.lit(0).cast("long"))).drop("_idx")
    p = running_total(p, keys, [order], id_block(order), F.col("_restart"), "presentation")
    return p.groupBy(*keys, index).agg(F.avg(value).alias("mean_value"), F.count(value).alias("n"), (F.max("presentation") + 1).alias("last_presentation"))


def tuning_ranks(patterns: DataFrame, feature: str, fold: str, seed: int, min_n: int = 50, vec: str = "vec") -> DataFrame:
    """Every component valid in both folds: its r with a feature on each (r0, r1), its rank by either, and a seeded
    random rank. A choice of components is a filter on a rank."""
    x = patterns.select(feature, fold, F.posexplode(vec).alias("pos", "x")).where("x is not null")
    r = x.groupBy(fold, "pos").agg(F.count("*").alias("_n"), r_agg("x", feature).alias("r")).where((F.col("_n") >= min_n) & F.col("r").isNotNull())
    w = r.groupBy("pos").agg(F.max(F.when(F.col(fold) == 0, F.col("r"))).alias("r0"), F.max(F.when(F.col(fold) == 1, F.col("r"))).alias("r1")).where("r0 is not null and r1 is not null")
    at = lambda *order: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long")  # noqa: E731  one row per component of a vector
    return w.withColumns({"rank0": at(F.col("r0").desc(), "pos"), "rank1": at(F.col("r1").desc(), "pos"), "rank_random": at(draw(seed, "pos"), "pos")})


def tuning_check(ranks: DataFrame, chosen: int) -> DataFrame:
    """Per direction of a two-fold split: the median r of the `chosen` best components of one fold, on it and on the
    other, and of as many random ones."""
    out = []
    for name, a, b in (("0->1", "0", "1"), ("1->0", "1", "0")):
        best, some = F.col(f"rank{a}") <= chosen, F.col("rank_random") <= chosen
        out.append(ranks.agg(F.count("*").alias("n_valid"), F.percentile(F.when(best, F.col(f"r{a}")), F.lit(0.5)).alias("sel_r_train"),
                             F.percentile(F.when(best, F.col(f"r{b}")), F.lit(0.5)).alias("sel_r_heldout"), F.percentile(F.when(some, F.col(f"r{b}")), F.lit(0.5)).alias("rand_r_heldout")).withColumn("fold", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


# -- maps ---------------------------------------------------------------------------------------------------------------

def roi_stats(df: DataFrame, roi: str, value: str) -> DataFrame:
    x = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    s = x.groupBy(roi).agg(F.count("*").alias("n_voxels"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return s.join(exact_quantiles(x, [roi], value, {"median": .5, "p5": .05, "p95": .95}), roi, "left")


def dice(df: DataFrame, keys, a: Column, b: Column, voxel_volume: float) -> DataFrame:
    """Overlap of two labelings per group, with their volumes; NULL when both are empty."""
    n = lambda c: F.count(F.when(c, 1))
    return df.groupBy(*keys).agg(div(2 * n(a & b), n(a) + n(b)).alias("dice"), (n(a) * voxel_volume).alias("volume_a"), (n(b) * voxel_volume).alias("volume_b"))


def union_mask(masks: DataFrame, voxel: str, run: str, grid: str) -> DataFrame:
    return masks.groupBy(voxel).agg(F.countDistinct(run).alias("n_runs"), F.countDistinct(grid).alias("_g")).withColumn("same_grid", F.col("_g") == 1).drop("_g")


def roi_cache(voxels: list[int], betas: DataFrame, trials: DataFrame, trial: str, vec: str = "vec") -> DataFrame:
    """Beta values of a region's voxel list per trial with its labels; voxels or trials without data stay as missing.
    Patterns are joined as arrays by trial and the listed components read off them."""
    j = trials.join(betas.select(trial, vec), trial, "left")
    pick = F.transform(F.array(*[F.lit(int(v)) for v in voxels]), lambda v: F.struct(v.alias("voxel"), F.get(F.col(vec), v).cast("double").alias("beta")))
    return j.select(*trials.columns, F.explode(pick).alias("_e")).select(*trials.columns, "_e.*")


def cardinality_check(cache: DataFrame, voxels: list[int], trials: DataFrame) -> DataFrame:
    c = cache.agg(F.count("*").alias("n_rows"), F.count("beta").alias("n_values"))
    e = trials.agg((F.count("*") * len(voxels)).alias("n_expected"))
    return c.crossJoin(e).withColumn("ok", F.col("n_rows") == F.col("n_expected"))  # one row each


def map_improvement(df: DataFrame, keys, a: str, b: str) -> DataFrame:
    """Paired maps: median difference and share of voxels improved, with means of both."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_d", F.col(b) - F.col(a))
    s = x.groupBy(*keys).agg(F.count("*").alias("n_voxels"), (100 * F.avg((F.col("_d") > 0).cast("double"))).alias("pct_improved"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"))
    return s.join(exact_quantiles(x, keys, "_d", {"median_diff": .5}), list(keys)).join(exact_quantiles(x, keys, a, {"median_a": .5}), list(keys))
