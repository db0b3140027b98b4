"""Pattern similarity (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import draw_sql, two_sided_p_sql
from ..functions.statistics import signed_rank_dist_sql
from ..operators import similarity as M
from .registry import query
from .views import CELLS, PATTERNS, SERIES

P = f"WITH {PATTERNS}"
RUN = ["subject", "session", "run"]
R = "covar_pop({0}, {1}) / nullif(stddev_pop({0}) * stddev_pop({1}), 0)"


def _gaps(t):
    """Patterns with missing components."""
    return t.embeddings.select("vec_id", F.col("label").cast("long").alias("item"), F.transform(
        F.col("embedding"), lambda x, i: F.when((F.col("vec_id") + i) % 17 != 0, x.cast("double"))).alias("vec"))


LONG = """lg AS (SELECT vec_id, item, pos, CASE WHEN (vec_id + pos) % 17 <> 0 THEN x END AS x FROM (SELECT vec_id, CAST(label AS BIGINT) AS item, unnest(range(64)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings))"""


@query("m01_matched_r", f"""WITH {LONG} SELECT a.vec_id, {R.format('a.x', 'b.x')} AS r, count(*) AS n_voxels FROM lg a JOIN lg b ON b.vec_id = a.vec_id + 1 AND a.pos = b.pos AND a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1""", ("r",))
def _(t):
    g = _gaps(t)
    return M.matched_r(g, g.select((F.col("vec_id") - 1).alias("vec_id"), "vec"), "vec_id")


@query("m02_pairwise_cells", f"""WITH {LONG}, p AS (SELECT a.vec_id AS i, b.vec_id AS j, least(a.item, b.item) AS cell_a, greatest(a.item, b.item) AS cell_b, {R.format('a.x', 'b.x')} AS r, count(*) AS n FROM lg a JOIN lg b ON a.vec_id < b.vec_id AND a.pos = b.pos AND a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY ALL)
  SELECT cell_a, cell_b, count(*) AS n_pairs, avg(r) AS mean_r, avg(n) AS mean_n FROM p WHERE n >= 3 AND r IS NOT NULL GROUP BY ALL""", ("mean_r", "mean_n"))
def _(t):
    return M.pairwise_cells(_gaps(t), "vec_id", "vec", "item")


@query("m03_triplet_blocks", P + """, t AS (SELECT *, (row_number() OVER (PARTITION BY subject, session, run ORDER BY pos) - 1) // 3 AS block FROM patterns WHERE item < 3)
  SELECT subject, session, run, block, count(*) AS n, min(pos) AS start, count(*) = 3 AND max(pos) - min(pos) = 2 AND count(DISTINCT item) = 3 AS valid FROM t GROUP BY ALL""")
def _(t):
    return M.triplet_blocks(t.patterns, RUN, F.col("item") < 3, "item")


POOL = """, wp AS (SELECT *, row_number() OVER (PARTITION BY subject, session, run ORDER BY start) - 1 AS slot FROM (SELECT subject, session, run, pos AS start FROM (SELECT *, lead(item, 1) OVER w AS i1, lead(item, 2) OVER w AS i2 FROM patterns WINDOW w AS (PARTITION BY subject, session, run ORDER BY pos)) WHERE item > 4 AND i1 > 4 AND i2 > 4)),
  np AS (SELECT *, row_number() OVER (PARTITION BY subject, session, run ORDER BY start) - 1 AS slot FROM (SELECT subject, session, run, pos AS start FROM patterns WHERE item > 4))"""


def _pools(t):
    p = t.patterns
    return M.surrogate_pool(p, RUN, F.col("item") > 4, window=3), M.surrogate_pool(p, RUN, F.col("item") > 4)


@query("m03_surrogate_windows", P + POOL + " SELECT * FROM wp")
def _(t):
    return _pools(t)[0]


DRAWS = POOL + f""", tg AS (SELECT vec_id, subject, session, run, item, unnest(range(10)) AS draw_no FROM patterns WHERE item < 5),
  dr AS (SELECT tg.vec_id, draw_no, s.vec_id AS surrogate FROM tg JOIN (SELECT subject, session, run, count(*) AS n FROM wp GROUP BY ALL) z USING (subject, session, run) JOIN wp ON wp.subject = tg.subject AND wp.session = tg.session AND wp.run = tg.run AND slot = {draw_sql(11, 'tg.vec_id', 'draw_no')} % z.n
  JOIN patterns s ON s.subject = tg.subject AND s.session = tg.session AND s.run = tg.run AND s.pos = start + tg.item WHERE tg.item < 3
  UNION ALL SELECT tg.vec_id, draw_no, s.vec_id FROM tg JOIN (SELECT subject, session, run, count(*) AS n FROM np GROUP BY ALL) z USING (subject, session, run) JOIN np ON np.subject = tg.subject AND np.session = tg.session AND np.run = tg.run AND slot = {draw_sql(12, 'tg.vec_id', 'draw_no')} % z.n
  JOIN patterns s ON s.subject = tg.subject AND s.session = tg.session AND s.run = tg.run AND s.pos = start WHERE tg.item >= 3)"""


def _draws(t):
    wp, np_ = _pools(t)
    p = t.patterns
    return M.draw_surrogates(p.where("item < 3"), wp, p, RUN, "vec_id", 11, offset="item").unionByName(
        M.draw_surrogates(p.where("item between 3 and 4"), np_, p, RUN, "vec_id", 12))


@query("m04_surrogate_draws", P + DRAWS + " SELECT vec_id, CAST(draw_no AS INTEGER) AS draw_no, surrogate FROM dr")
def _(t):
    return _draws(t)


WITHIN = """, wpair AS (SELECT a.subject, a.item, a.u AS ua, b.u AS ub, b.vec_id AS j FROM up a JOIN up b ON a.subject = b.subject AND a.item = b.item AND a.session < b.session WHERE a.item < 3),
  wc AS (SELECT subject, item, 'within_same' AS cell, count(*) AS n_pairs, 0 AS n_draws, 64 AS n_voxels, avg(list_dot_product(ua, ub)) AS r FROM wpair GROUP BY ALL
  UNION ALL SELECT w.subject, w.item, 'within_diff', count(*) // 10, 10, 64, avg(list_dot_product(ua, s.u)) FROM wpair w JOIN dr ON dr.vec_id = j JOIN up s ON s.vec_id = surrogate GROUP BY ALL)"""


@query("m05_within_cells", P + DRAWS + WITHIN + " SELECT * FROM wc", ("r",))
def _(t):
    return M.within_cells(t.patterns, _draws(t), ["subject", "item"], "vec_id", F.col("item") < 3)


ACROSS = """, apair AS (SELECT a.subject AS sa, b.subject AS sb, a.item, a.u AS ua, b.u AS ub, b.vec_id AS j, a.session = b.session AS matched FROM up a JOIN up b ON a.item = b.item AND a.subject < b.subject WHERE a.item < 5),
  as0 AS (SELECT item, sa || '+' || sb AS unit, unnest(CASE WHEN matched THEN ['all', 'matched'] ELSE ['all'] END) AS session_scope, list_dot_product(ua, ub) AS x FROM apair),
  ad0 AS (SELECT a.item, sa || '+' || sb AS unit, unnest(CASE WHEN matched THEN ['all', 'matched'] ELSE ['all'] END) AS session_scope, list_dot_product(ua, s.u) AS x FROM apair a JOIN dr ON dr.vec_id = j JOIN up s ON s.vec_id = surrogate),
  ac AS (SELECT item, unit, 'across_same' AS cell, session_scope, count(*) AS n_pairs, avg(x) AS r FROM as0 GROUP BY ALL
  UNION ALL SELECT s.item, s.unit, 'across_diff', s.session_scope, s.n, d.r FROM (SELECT item, unit, session_scope, count(*) AS n FROM as0 GROUP BY ALL) s LEFT JOIN (SELECT item, unit, session_scope, avg(x) AS r FROM ad0 GROUP BY ALL) d USING (item, unit, session_scope))"""


@query("m06_across_cells", P + DRAWS + ACROSS + " SELECT * FROM ac", ("r",))
def _(t):
    return M.across_cells(t.patterns, _draws(t), [], "vec_id", F.col("item") < 5)


MOV = f"""WITH b AS (SELECT vec_id, vec_id % 2 AS subject, (vec_id // 2) % 3 AS session, 0 AS run, 'm' || label % 4 AS movie, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings), p0 AS (SELECT *, row_number() OVER (PARTITION BY subject, session, movie ORDER BY vec_id) - 1 AS uidx FROM b),
  p1 AS (SELECT *, list_transform(vec, lambda x: x - list_avg(vec)) AS c FROM p0), p AS (SELECT * EXCLUDE (c, vec), list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS u FROM p1),
  ln AS (SELECT subject, session, movie, max(uidx) + 1 AS len FROM p GROUP BY ALL), pr AS (SELECT a.subject, a.movie, a.session AS s1, b.session AS s2, least(a.len, b.len) AS L FROM ln a JOIN ln b ON a.subject = b.subject AND a.movie = b.movie AND a.session < b.session WHERE a.movie IN ('m0', 'm1')),
  same AS (SELECT pr.subject, pr.movie, s1, s2, avg(list_dot_product(a.u, b.u)) AS r FROM pr JOIN p a ON a.subject = pr.subject AND a.movie = pr.movie AND a.session = s1 JOIN p b ON b.subject = pr.subject AND b.movie = pr.movie AND b.session = s2 AND b.uidx = a.uidx WHERE a.uidx < L GROUP BY ALL),
  cd0 AS (SELECT pr.*, o.movie AS m2, o.len AS lo, o.len >= L AS f FROM pr JOIN ln o ON o.subject = pr.subject AND o.session = s2 AND o.movie <> pr.movie), cd1 AS (SELECT *, bool_or(f) OVER (PARTITION BY subject, movie, s1, s2) AS a FROM cd0),
  cd AS (SELECT *, row_number() OVER (PARTITION BY subject, movie, s1, s2 ORDER BY m2) - 1 AS c, count(*) OVER (PARTITION BY subject, movie, s1, s2) AS nc FROM cd1 WHERE f OR NOT a),
  h AS (SELECT *, ('0x' || substr(md5(movie), 1, 7))::BIGINT AS hm, ('0x' || substr(md5(s1::VARCHAR), 1, 7))::BIGINT AS h1, ('0x' || substr(md5(s2::VARCHAR), 1, 7))::BIGINT AS h2 FROM (SELECT pr.*, unnest(range(10)) AS d FROM pr)),
  dr AS (SELECT h.*, m2, lo, least(h.L, lo) AS w, {draw_sql(2, 'hm', 'h1', 'h2', 'd')} % (lo - least(h.L, lo) + 1) AS st FROM h JOIN cd ON cd.subject = h.subject AND cd.movie = h.movie AND cd.s1 = h.s1 AND cd.s2 = h.s2 AND c = {draw_sql(1, 'hm', 'h1', 'h2', 'd')} % nc),
  df AS (SELECT dr.subject, dr.movie, s1, s2, d, avg(list_dot_product(a.u, b.u)) AS r FROM dr JOIN p a ON a.subject = dr.subject AND a.movie = dr.movie AND a.session = s1 JOIN p b ON b.subject = dr.subject AND b.movie = m2 AND b.session = s2 AND b.uidx = st + a.uidx WHERE a.uidx < w GROUP BY ALL)
  SELECT subject, movie, count(*) AS n_pairs, avg(r) AS r, 'within_same' AS cell FROM same GROUP BY ALL UNION ALL SELECT subject, movie, count(*), avg(r), 'within_diff' FROM (SELECT subject, movie, s1, s2, avg(r) AS r FROM df GROUP BY ALL) GROUP BY subject, movie"""


@query("m07_movie_cells", MOV, ("r",))
def _(t):
    from ..functions.scan import id_block, row_index
    v = F.col("vec_id")
    x = t.embeddings.select("vec_id", (v % 2).alias("subject"), (F.floor(v / 2) % 3).alias("session"), F.lit(0).alias("run"), F.concat(F.lit("m"), (F.col("label") % 4).cast("string")).alias("movie"), F.col("embedding").alias("vec"))
    return M.movie_cells(row_index(x, ["subject", "session", "movie"], ["vec_id"], id_block("vec_id"), "uidx"), ["subject"], ["m0", "m1"])


_code = lambda c: f"('0x' || substr(md5({c}::VARCHAR), 1, 7))::BIGINT"
_CODES = [_code(c) for c in ("sa", "sb", "movie", "s1", "s2")]
XMOV = MOV[:MOV.index("pr AS (")] + f"""pr AS (SELECT a.subject AS sa, b.subject AS sb, a.movie, a.session AS s1, b.session AS s2, least(a.len, b.len) AS L FROM ln a JOIN ln b ON a.subject < b.subject AND a.movie = b.movie WHERE a.movie IN ('m0', 'm1')),
  same AS (SELECT pr.sa, pr.sb, pr.movie, s1, s2, avg(list_dot_product(a.u, b.u)) AS r FROM pr JOIN p a ON a.subject = sa AND a.movie = pr.movie AND a.session = s1 JOIN p b ON b.subject = sb AND b.movie = pr.movie AND b.session = s2 AND b.uidx = a.uidx WHERE a.uidx < L GROUP BY ALL),
  cd0 AS (SELECT pr.*, o.movie AS m2, o.len AS lo, o.len >= L AS f FROM pr JOIN ln o ON o.subject = sb AND o.session = s2 AND o.movie <> pr.movie), cd1 AS (SELECT *, bool_or(f) OVER (PARTITION BY sa, sb, movie, s1, s2) AS a FROM cd0),
  cd AS (SELECT *, row_number() OVER (PARTITION BY sa, sb, movie, s1, s2 ORDER BY m2) - 1 AS c, count(*) OVER (PARTITION BY sa, sb, movie, s1, s2) AS nc FROM cd1 WHERE f OR NOT a),
  h AS (SELECT *, {draw_sql(1, *_CODES, 'd')} AS d1, {draw_sql(2, *_CODES, 'd')} AS d2 FROM (SELECT pr.*, unnest(range(10)) AS d FROM pr)),
  dr AS (SELECT h.*, m2, lo, least(h.L, lo) AS w, d2 % (lo - least(h.L, lo) + 1) AS st FROM h JOIN cd USING (sa, sb, movie, s1, s2) WHERE c = d1 % nc),
  df AS (SELECT sa, sb, dr.movie, s1, s2, d, avg(list_dot_product(a.u, b.u)) AS r FROM dr JOIN p a ON a.subject = sa AND a.movie = dr.movie AND a.session = s1 JOIN p b ON b.subject = sb AND b.movie = m2 AND b.session = s2 AND b.uidx = st + a.uidx WHERE a.uidx < w GROUP BY ALL),
  rs AS (SELECT *, 'across_same' AS cell FROM same UNION ALL SELECT sa, sb, movie, s1, s2, avg(r), 'across_diff' FROM df GROUP BY sa, sb, movie, s1, s2)
  SELECT sa || '+' || sb AS unit, movie, cell, scope, count(*) AS n_pairs, avg(r) AS r FROM (SELECT *, unnest(CASE WHEN s1 = s2 THEN ['all', 'matched'] ELSE ['all'] END) AS scope FROM rs) GROUP BY ALL"""


@query("m07_movie_cells_across", XMOV, ("r",))
def _(t):
    from ..functions.scan import id_block, row_index
    v = F.col("vec_id")
    x = t.embeddings.select("vec_id", (v % 2).alias("subject"), (F.floor(v / 2) % 3).alias("session"), F.lit(0).alias("run"), F.concat(F.lit("m"), (F.col("label") % 4).cast("string")).alias("movie"), F.col("embedding").alias("vec"))
    return M.movie_cells_across(row_index(x, ["subject", "session", "movie"], ["vec_id"], id_block("vec_id"), "uidx"), [], ["m0", "m1"])


C = f"WITH {CELLS}"


@query("m08_roll_up", C + " SELECT roi, version, cell, avg(r) AS r, count(*) AS n_units, avg(n_voxels) AS n_voxels FROM cells GROUP BY ALL", ("r", "n_voxels"))
def _(t):
    return M.roll_up(t.cells, ["roi", "version"])


@query("m08_pair_count_check", C + " SELECT cell, count(*) AS n_rows, count(*) FILTER (n_pairs <> CASE cell WHEN 'within_same' THEN 35 WHEN 'across_same' THEN 30 END) AS n_bad FROM cells GROUP BY ALL")
def _(t):
    return M.pair_count_check(t.cells, {"within_same": 35, "across_same": 30})


SR = f""", {signed_rank_dist_sql()}""" + """, sr0 AS (SELECT {k}, d, abs(d) AS a FROM {t} WHERE d <> 0), sr1 AS (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY a) + (count(*) OVER (PARTITION BY {k}, a) - 1) / 2 AS rk FROM sr0),
  sr AS (SELECT {k}, count(*)::DOUBLE AS n0, coalesce(sum(rk) FILTER (d > 0), 0) AS w_plus, count(*) - count(DISTINCT a) AS nt FROM sr1 GROUP BY {k}), sz AS (SELECT {k}, count(*) FILTER (d = 0) AS nz FROM {t} GROUP BY {k}),
  srp AS (SELECT sr.*, (w_plus - n0 * (n0 + 1) / 4) / sqrt(n0 * (n0 + 1) * (2 * n0 + 1) / 24) AS z, e.p AS exact_p FROM sr JOIN sz USING ({k}) LEFT JOIN sr_tail e ON e.n = n0 AND e.s = w_plus AND nt = 0 AND nz = 0)"""
RC = C.replace("WITH ", "WITH RECURSIVE ", 1)
CON = """, pk AS (SELECT roi, version, unit, item, max(r) FILTER (cell = 'within_same') AS ws, max(r) FILTER (cell = 'within_diff') AS wd, max(r) FILTER (cell = 'across_same') AS xs, max(r) FILTER (cell = 'across_diff') AS xd FROM cells GROUP BY ALL),
  am AS (SELECT roi, version, item, u AS unit, avg(xs) AS xs FROM (SELECT *, unnest(string_split(unit, '+')) AS u FROM pk WHERE xs IS NOT NULL) GROUP BY ALL),
  pp AS (SELECT roi, version, 'within_same_vs_diff' AS contrast, ws AS a, wd AS b FROM pk WHERE ws IS NOT NULL AND wd IS NOT NULL UNION ALL SELECT roi, version, 'across_same_vs_diff', xs, xd FROM pk WHERE xs IS NOT NULL AND xd IS NOT NULL
  UNION ALL SELECT p.roi, p.version, 'within_vs_across_same', p.ws, am.xs FROM pk p JOIN am USING (roi, version, unit, item) WHERE ws IS NOT NULL), pd AS (SELECT *, a - b AS d FROM pp)"""


@query("m09_contrasts", RC + CON + SR.format(k="roi, version, contrast", t="pd") + f""" SELECT g.*, w_plus, coalesce(exact_p, {two_sided_p_sql('z')}) AS p FROM (SELECT roi, version, contrast, count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b, avg(d) AS delta FROM pd GROUP BY ALL) g JOIN srp USING (roi, version, contrast)""",
       ("mean_a", "mean_b", "delta", "p"))
def _(t):
    return M.contrasts(t.cells, ["roi", "version"])


VC = """, vp AS (SELECT roi, cell, unit, item, max(r) FILTER (version = 'O') AS o, max(r) FILTER (version = 'F') AS f FROM cells GROUP BY ALL), vd AS (SELECT *, f - o AS d FROM vp WHERE o IS NOT NULL AND f IS NOT NULL)"""


@query("m10_version_contrast", RC + VC + SR.format(k="roi, cell", t="vd") + f" SELECT g.*, w_plus, coalesce(exact_p, {two_sided_p_sql('z')}) AS p FROM (SELECT roi, cell, count(*) AS n, avg(o) AS base, avg(f) AS other, avg(d) AS delta, avg(CAST(d > 0 AS DOUBLE)) AS share_up FROM vd GROUP BY ALL) g JOIN srp USING (roi, cell)",
       ("base", "other", "delta", "share_up", "p"))
def _(t):
    return M.version_contrast(t.cells, ["roi", "cell"], "version", "O", "F")


@query("m10_version_contrast_units", RC + VC + SR.format(k="roi, cell, unit", t="vd") + f" SELECT g.*, w_plus, coalesce(exact_p, {two_sided_p_sql('z')}) AS p FROM (SELECT roi, cell, unit, count(*) AS n, avg(o) AS base, avg(f) AS other, avg(d) AS delta, avg(CAST(d > 0 AS DOUBLE)) AS share_up FROM vd GROUP BY ALL) g JOIN srp USING (roi, cell, unit)",
       ("base", "other", "delta", "share_up", "p"))
def _(t):
    return M.version_contrast(t.cells, ["roi", "cell", "unit"], "version", "O", "F", pair=("item",))


@query("m10_context_table", C + " SELECT version, cell, context_match, avg(r) AS r, count(*) AS n_rows FROM cells WHERE cell LIKE 'across%' GROUP BY ALL", ("r",))
def _(t):
    return M.context_table(t.cells, ["version"])


DISC = """WITH l0 AS (SELECT vec_id, (vec_id // 3) % 5 AS session, (vec_id // 15) % 2 AS run, CAST(label AS BIGINT) AS item, unnest(range(64)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x0 FROM embeddings), l1 AS (SELECT *, CASE WHEN NOT (vec_id % 97 = 3 AND pos % 5 = session) THEN x0 END AS x FROM l0),
  bad AS (SELECT DISTINCT session, pos FROM l1 WHERE x IS NULL), l2 AS (SELECT l1.* FROM l1 ANTI JOIN bad USING (session, pos)), st AS (SELECT vec_id, avg(x) AS m, stddev_pop(x) AS s, count(*) AS n FROM l2 GROUP BY 1),
  u AS (SELECT l2.vec_id, session, run, item, list((x - m) / (s * sqrt(n)) ORDER BY pos) AS u FROM l2 JOIN st USING (vec_id) GROUP BY ALL), pr AS (SELECT a.session, a.item = b.item AS same, list_dot_product(a.u, b.u) AS r FROM u a JOIN u b ON a.session = b.session AND a.vec_id < b.vec_id AND a.run <> b.run),
  g AS (SELECT session, count(*) FILTER (same) AS n_within, count(*) FILTER (NOT same) AS n_between, avg(r) FILTER (same) AS within_r, avg(r) FILTER (NOT same) AS between_r FROM pr GROUP BY 1) SELECT *, within_r - between_r AS discriminability FROM g"""


@query("m11_item_discriminability", DISC, ("within_r", "between_r", "discriminability"))
def _(t):
    v = F.col("vec_id")
    x = t.embeddings.select("vec_id", (F.floor(v / 3) % 5).alias("session"), (F.floor(v / 15) % 2).alias("run"), F.col("label").cast("long").alias("item"), "embedding")
    x = x.withColumn("vec", F.transform("embedding", lambda e, i: F.when(~((v % 97 == 3) & (i % 5 == F.col("session"))), e.cast("double"))))
    return M.item_discriminability(x, ["session"], "item", "run")


@query("m12_movie_discriminability", f"""WITH {SERIES}, pr AS (SELECT a.roi, a.session, a.movie = b.movie AS same, count(*) AS n, {R.format('a.value', 'b.value')} AS r FROM series a JOIN series b ON a.roi = b.roi AND a.session = b.session AND a.t = b.t AND (a.subject < b.subject) GROUP BY a.roi, a.session, a.subject, a.movie, b.subject, b.movie),
  g AS (SELECT roi, session, avg(r) FILTER (same) AS within_r, avg(r) FILTER (NOT same) AS between_r, count(r) FILTER (same) AS n_within, count(r) FILTER (NOT same) AS n_between FROM pr WHERE n >= 4 GROUP BY ALL) SELECT *, within_r - between_r AS discriminability FROM g""",
       ("within_r", "between_r", "discriminability"))
def _(t):
    return M.movie_discriminability(t.series, ["roi", "session"], ["00", "01", "02", "03"], [f"m{i}" for i in range(10)])


BEN = """WITH b AS (SELECT 'trial' AS stream, l_partkey % 6 AS roi, l_linestatus AS version, l_extendedprice / 105013 AS within_r, l_discount AS between_r, l_extendedprice / 105013 - l_discount AS discriminability FROM lineitem WHERE l_orderkey % 2 = 0
  UNION ALL SELECT 'movie', l_partkey % 6, l_linestatus, l_extendedprice / 105013, l_discount, l_extendedprice / 105013 - l_discount FROM lineitem WHERE l_orderkey % 2 = 1 AND l_returnflag <> 'A') """
VT = """, v AS (SELECT stream, roi, avg(discriminability) FILTER (version = 'O') AS base, avg(discriminability) FILTER (version = 'F') AS other FROM b GROUP BY ALL), vt AS (SELECT *, other - base AS delta, 100 * (other - base) / abs(base) AS pct FROM v)"""


def _bench(t):
    x = t.lineitem.select((F.col("l_partkey") % 6).alias("roi"), F.col("l_linestatus").alias("version"), (F.col("l_extendedprice") / 105013).alias("within_r"), F.col("l_discount").alias("between_r"),
                          (F.col("l_extendedprice") / 105013 - F.col("l_discount")).alias("discriminability"), "l_orderkey", F.when(F.col("l_returnflag") != "A", "none").otherwise("m8").alias("confound_model"))
    a = x.where("l_orderkey % 2 = 0").drop("confound_model", "l_orderkey").withColumn("stream", F.lit("trial"))
    return M.collect_results([a, x.where("l_orderkey % 2 = 1").drop("l_orderkey").withColumn("stream", F.lit("movie"))])


@query("m13_component_table", BEN + "SELECT stream, roi, version, avg(within_r) AS within_r, avg(between_r) AS between_r, avg(discriminability) AS discriminability FROM b GROUP BY ALL", ("within_r", "between_r", "discriminability"))
def _(t):
    return M.component_table(_bench(t), ["stream", "roi", "version"])


@query("m13_version_table", BEN + VT + " SELECT * FROM vt", {"base": 6, "other": 6, "delta": 6, "pct": 4})
def _(t):
    return M.version_table(_bench(t), ["stream", "roi"], "version", "O", "F")


@query("m13_paired_test", """WITH RECURSIVE pv AS (SELECT l_returnflag AS stream, l_suppkey AS unit, l_partkey % 6 AS roi, avg(l_extendedprice / 105013 - l_discount) FILTER (l_linestatus = 'O') AS o, avg(l_extendedprice / 105013 - l_discount) FILTER (l_linestatus = 'F') AS f FROM lineitem GROUP BY ALL),
  pt AS (SELECT stream, f - o AS d FROM pv WHERE o IS NOT NULL AND f IS NOT NULL)""" + SR.format(k="stream", t="pt") + f" SELECT g.*, coalesce(exact_p, {two_sided_p_sql('z')}) AS p FROM (SELECT stream, count(*) AS n, avg(d) AS mean, 100 * avg(CAST(d > 0 AS DOUBLE)) AS pct_pos FROM pt GROUP BY 1) g LEFT JOIN srp USING (stream)", ("mean", "pct_pos", "p"))
def _(t):
    x = t.lineitem.select(F.col("l_returnflag").alias("stream"), F.col("l_suppkey").alias("unit"), (F.col("l_partkey") % 6).alias("roi"), "l_linestatus", (F.col("l_extendedprice") / 105013 - F.col("l_discount")).alias("discriminability"))
    return M.paired_test(x, ["stream"], ["unit", "roi"], "l_linestatus", "O", "F")


@query("m13_headline", BEN + VT + " SELECT count(*) FILTER (other > base) AS n_won, count(*) AS n_total, arg_max(roi, pct) AS best_roi, max(pct) AS best_pct FROM vt WHERE stream = 'movie'", {"best_pct": 4})
def _(t):
    return M.headline(M.version_table(_bench(t).where("stream = 'movie'"), ["stream", "roi"], "version", "O", "F"))


PRES = """pres AS (SELECT vec_id, vec_id % 120 AS item, pos, CASE WHEN NOT (vec_id % 50 = 7 AND pos % 9 = 0) THEN x END AS x, row_number() OVER (PARTITION BY vec_id % 120, pos ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY vec_id % 120, pos) AS n
  FROM (SELECT vec_id, unnest(range(64)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings))"""


def _pres(t):
    v = F.col("vec_id")
    return t.embeddings.select("vec_id", (v % 120).alias("item"), F.transform("embedding", lambda e, i: F.when(~((v % 50 == 7) & (i % 9 == 0)), e.cast("double"))).alias("vec"))


@query("m14_loo_reliability", f"""WITH {PRES}, p AS (SELECT * REPLACE (CASE WHEN vec_id % 50 = 7 AND pos % 9 = 0 THEN NULL ELSE x END AS x) FROM pres), full_ AS (SELECT DISTINCT item, k FROM p WHERE pos = 0 AND x IS NOT NULL), t AS (SELECT item, pos, sum(x) AS s, count(x) AS c FROM p GROUP BY ALL),
  j AS (SELECT p.k AS split, p.pos, p.x AS a, CASE WHEN t.c = p.n THEN (t.s - p.x) / (p.n - 1) END AS b FROM p JOIN t ON t.item = p.item AND t.pos = p.pos JOIN full_ f ON f.item = p.item AND f.k = p.k WHERE p.n >= 2),
  g AS (SELECT split, pos, count(*) AS n, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS c, {R.format('a', 'b')} AS r FROM j GROUP BY ALL HAVING count(*) >= 3), h AS (SELECT *, CASE WHEN c = n THEN r END AS r2 FROM g)
  SELECT CAST(pos AS INTEGER) AS pos, avg(r2) AS reliability, count(r2) AS n_splits FROM h GROUP BY pos""", ("reliability",))
def _(t):
    return M.loo_reliability(_pres(t), "item", "vec_id")


HALF = "CASE WHEN count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) = count(*) THEN " + R.format("a", "b") + " END AS r, count(*) AS n_items"
FS = f"""WITH {PRES}, g AS (SELECT item, pos, max(x) FILTER (k = 0) AS a, max(x) FILTER (k = 1) AS b FROM pres WHERE n >= 2 GROUP BY ALL), r AS (SELECT pos, {HALF} FROM g GROUP BY pos)"""


@query("m15_first_second_reliability", FS + " SELECT CAST(pos AS INTEGER) AS pos, r, n_items FROM r", ("r",))
def _(t):
    return M.first_second_reliability(_pres(t), "item", "vec_id")


@query("m15_roi_reliability", FS + " SELECT CAST(pos // 32 AS BIGINT) AS roi, quantile_cont(r, 0.5) AS median, quantile_cont(r, 0.9) AS p90 FROM r GROUP BY 1", ("median", "p90"))
def _(t):
    return M.roi_quantiles(M.first_second_reliability(_pres(t), "item", "vec_id"), F.floor(F.col("pos") / 32))


@query("m15_split_half_reliability", f"""WITH {PRES}, g AS (SELECT item, pos, avg(x) FILTER (k < 2) AS a, avg(x) FILTER (k >= n - 2) AS b FROM pres WHERE n >= 4 GROUP BY ALL) SELECT CAST(pos AS INTEGER) AS pos, {HALF} FROM g GROUP BY pos""", ("r",))
def _(t):
    return M.split_half_reliability(_pres(t), "item", "vec_id", 2)


@query("m16_repeat_average", """WITH l AS (SELECT vec_id, CAST(label AS BIGINT) AS item, (vec_id // 3) % 5 AS session, unnest(range(64)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), z AS (SELECT item, pos, (x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0) AS z FROM l WINDOW w AS (PARTITION BY session, pos))
  SELECT item, pos::INTEGER AS pos, avg(z) AS mean_z, count(*) AS n FROM z GROUP BY ALL""", ("mean_z",))
def _(t):
    return M.repeat_average(M.session_z(t.patterns, ["session"], ["item"]), ["item"])


@query("m17_restart_segments", """WITH a AS (SELECT user_id, event_id, hour(ts) AS i, value, coalesce(CAST(hour(ts) <= lag(hour(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT), 0) AS f FROM events), b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY event_id) AS presentation FROM a)
  SELECT user_id, CAST(i AS INTEGER) AS i, avg(value) AS mean_value, count(value) AS n, CAST(max(presentation) + 1 AS BIGINT) AS last_presentation FROM b GROUP BY ALL""", ("mean_value",))
def _(t):
    return M.restart_segments(t.events.select("user_id", "event_id", F.hour("ts").alias("i"), "value"), ["user_id"], "event_id", "i", "value")


TUNE = """WITH l AS (SELECT label AS f, (vec_id // 3) % 5 % 2 AS fold, unnest(range(64)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), r AS (SELECT fold, pos, {r} AS r FROM l GROUP BY ALL HAVING count(*) >= 50),
  w AS (SELECT pos, max(r) FILTER (fold = 0) AS r0, max(r) FILTER (fold = 1) AS r1 FROM r GROUP BY 1) """.format(r=R.format("x", "f"))
TUNE1 = """SELECT '{n}' AS fold, (SELECT count(*) FROM w) AS n_valid, (SELECT quantile_cont({a}, 0.5) FROM (SELECT * FROM w ORDER BY {a} DESC, pos LIMIT 10)) AS sel_r_train, (SELECT quantile_cont({b}, 0.5) FROM (SELECT * FROM w ORDER BY {a} DESC, pos LIMIT 10)) AS sel_r_heldout,
  (SELECT quantile_cont({b}, 0.5) FROM (SELECT * FROM w ORDER BY {d}, pos LIMIT 10)) AS rand_r_heldout"""


@query("m18_tuning_check", TUNE + TUNE1.format(n="0->1", a="r0", b="r1", d=draw_sql(5, "pos")) + " UNION ALL " + TUNE1.format(n="1->0", a="r1", b="r0", d=draw_sql(5, "pos")), ("sel_r_train", "sel_r_heldout", "rand_r_heldout"))
def _(t):
    x = t.patterns.select(F.col("item").alias("f"), (F.col("session") % 2).alias("fold"), "vec")
    return M.tuning_check(M.tuning_ranks(x, "f", "fold", 5), 10)


@query("m18_tuning_ranks", TUNE + f""", v AS (SELECT * FROM w WHERE r0 IS NOT NULL AND r1 IS NOT NULL) SELECT CAST(pos AS INTEGER) AS pos, r0, r1, row_number() OVER (ORDER BY r0 DESC, pos) AS rank0, row_number() OVER (ORDER BY r1 DESC, pos) AS rank1, row_number() OVER (ORDER BY {draw_sql(5, "pos")}, pos) AS rank_random FROM v""", ("r0", "r1"))
def _(t):
    return M.tuning_ranks(t.patterns.select(F.col("item").alias("f"), (F.col("session") % 2).alias("fold"), "vec"), "f", "fold", 5)


@query("m19_roi_stats", "SELECT l_partkey % 12 AS roi, count(*) AS n_voxels, avg(l_extendedprice) AS mean, stddev_pop(l_extendedprice) AS std, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.05) AS p5, quantile_cont(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY 1", {"mean": 4, "std": 4, "median": 4, "p5": 4, "p95": 4})
def _(t):
    return M.roi_stats(t.lineitem.withColumn("roi", F.col("l_partkey") % 12), "roi", "l_extendedprice")


@query("m20_dice", """SELECT doc_id % 7 AS label, doc_id % 2 AS hemisphere, 2 * count(*) FILTER (quality = 1 AND toxic = 1) / nullif(count(*) FILTER (quality = 1) + count(*) FILTER (toxic = 1), 0) AS dice, count(*) FILTER (quality = 1) * 0.343 AS volume_a, count(*) FILTER (toxic = 1) * 0.343 AS volume_b FROM labels GROUP BY ALL""", ("dice", "volume_a", "volume_b"))
def _(t):
    x = t.labels.select((F.col("doc_id") % 7).alias("label"), (F.col("doc_id") % 2).alias("hemisphere"), "quality", "toxic")
    return M.dice(x, ["label", "hemisphere"], F.col("quality") == 1, F.col("toxic") == 1, 0.343)


@query("m21_union_mask", "SELECT user_id, count(DISTINCT day(ts)) AS n_runs, count(DISTINCT event_id % 2 * (user_id % 3)) = 1 AS same_grid FROM events GROUP BY 1")
def _(t):
    m = t.events.select("user_id", F.dayofmonth("ts").alias("run"), (F.col("event_id") % 2 * (F.col("user_id") % 3)).alias("grid"))
    return M.union_mask(m, "user_id", "run", "grid")


def _cache(t):
    return list(range(0, 80, 9)), t.patterns.select("vec_id", "subject", "item"), t.patterns.where("vec_id % 5 <> 0").select("vec_id", "vec")


@query("m22_roi_cache", """WITH v AS (SELECT vec_id, unnest(range(64)) AS voxel, unnest(CAST(embedding AS DOUBLE[])) AS beta FROM embeddings WHERE vec_id % 5 <> 0) SELECT e.vec_id, printf('%02d', e.vec_id % 3) AS subject, CAST(label AS BIGINT) AS item, CAST(r.voxel AS INTEGER) AS voxel, beta FROM embeddings e CROSS JOIN (SELECT unnest(range(0, 80, 9)) AS voxel) r
  LEFT JOIN v ON v.vec_id = e.vec_id AND v.voxel = r.voxel""", ("beta",))
def _(t):
    rv, tr, b = _cache(t)
    return M.roi_cache(rv, b, tr, "vec_id")


@query("m22_cardinality_check", "SELECT count(*) * 9 AS n_rows, count(*) FILTER (vec_id % 5 <> 0) * 8 AS n_values, count(*) * 9 AS n_expected, true AS ok FROM embeddings")
def _(t):
    rv, tr, b = _cache(t)
    return M.cardinality_check(M.roi_cache(rv, b, tr, "vec_id"), rv, tr)


@query("m23_standardised_effect", C + """, q AS (SELECT roi, version, split_part(cell, '_', 1) AS level, unit, item, max(r) FILTER (cell LIKE '%same') AS s, max(r) FILTER (cell LIKE '%diff') AS d FROM cells GROUP BY ALL)
  SELECT roi, version, level, count(*) AS n, avg(s - d) / nullif(stddev_samp(s - d), 0) AS effect FROM q WHERE s IS NOT NULL AND d IS NOT NULL GROUP BY ALL""", ("effect",))
def _(t):
    return M.standardised_effect(t.cells, ["roi", "version"])


@query("m24_map_improvement", """WITH x AS (SELECT l_partkey % 12 AS roi, l_extendedprice / 1000 AS a, l_extendedprice / 1000 + l_tax * 100 - l_discount * 90 AS b FROM lineitem)
  SELECT roi, count(*) AS n_voxels, 100 * avg(CAST(b - a > 0 AS DOUBLE)) AS pct_improved, avg(a) AS mean_a, avg(b) AS mean_b, quantile_cont(b - a, 0.5) AS median_diff, quantile_cont(a, 0.5) AS median_a FROM x GROUP BY 1""", {"pct_improved": 4, "mean_a": 6, "mean_b": 6, "median_diff": 6, "median_a": 6})
def _(t):
    a = F.col("l_extendedprice") / 1000
    x = t.lineitem.select((F.col("l_partkey") % 12).alias("roi"), a.alias("a"), (a + F.col("l_tax") * 100 - F.col("l_discount") * 90).alias("b"))
    return M.map_improvement(x, ["roi"], "a", "b")
