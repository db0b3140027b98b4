"""Stimulus features and embeddings (V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import draw_sql
from ..functions.scan import id_block, row_index
from ..operators import features as V
from .registry import query
from .views import USER_SERIES

EM = """em AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), eu AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM em)"""
W = f"WITH {EM}"


def _em(t):
    return t.embeddings.select("vec_id", F.col("label").cast("long").alias("label"), "embedding")


@query("v01_unit_vectors", W + " SELECT vec_id, CAST(pos AS INTEGER) AS pos, x FROM (SELECT vec_id, unnest(range(64)) AS pos, unnest(u) AS x FROM eu)", ("x",))
def _(t):
    d = t.embeddings.select("vec_id", *[F.col("embedding")[i].alias(f"emb_{i}") for i in range(64)])
    return V.unit_vectors(V.assemble(d, ["vec_id"], "emb_"), "vec").select("vec_id", F.posexplode("u").alias("pos", "x"))


def _units(t):
    return V.unit_vectors(_em(t), "embedding").select("vec_id", "label", "u")


PAIRS = ", d AS (SELECT a.vec_id AS i, a.label AS la, b.label AS lb, list_dot_product(a.u, b.u) AS c FROM eu a JOIN eu b ON a.vec_id <> b.vec_id)"


@query("v02_nearest_other", W + PAIRS + " SELECT i AS vec_id, max(c) AS nn_cosine FROM d GROUP BY 1", ("nn_cosine",))
def _(t):
    u = _units(t)
    return V.nearest_cosine(u, u, "vec_id", "u")


@query("v02_nearest_same_group", W + PAIRS + " SELECT i AS vec_id, max(c) AS nn_cosine FROM d WHERE la = lb GROUP BY 1", ("nn_cosine",))
def _(t):
    u = _units(t)
    return V.nearest_cosine(u, u, "vec_id", "u", "label", "same")


@query("v02_nearest_different_group", W + PAIRS + " SELECT i AS vec_id, max(c) AS nn_cosine FROM d WHERE la <> lb GROUP BY 1", ("nn_cosine",))
def _(t):
    u = _units(t)
    return V.nearest_cosine(u, u, "vec_id", "u", "label", "different")


REL = """SELECT '{n}' AS relation, i, max(c) AS m FROM d WHERE {w} GROUP BY i"""
Q3 = "quantile_cont(m, 0.1) AS p10, quantile_cont(m, 0.5) AS median, quantile_cont(m, 0.9) AS p90"
RELS = [("image-image", "la < 3 AND lb < 3"), ("word-word", "la IN (3, 4) AND lb IN (3, 4)"), ("frame-same", "la > 4 AND lb = la"), ("frame-different", "la > 4 AND lb > 4 AND lb <> la"),
        ("frame-image", "la > 4 AND lb < 3"), ("frame-word", "la > 4 AND lb IN (3, 4)"), ("image-word", "la < 3 AND lb IN (3, 4)")]


@query("v02_relation_summary", W + PAIRS + ", r AS (" + " UNION ALL ".join(REL.format(n=n, w=w) for n, w in RELS) + f") SELECT relation, count(*) AS n, {Q3} FROM r GROUP BY 1", ("p10", "median", "p90"))
def _(t):
    u = _units(t)
    im, wo, fr = u.where("label < 3"), u.where("label in (3, 4)"), u.where("label > 4")
    nn = lambda a, b, r="any": V.nearest_cosine(a, b, "vec_id", "u", "label" if r != "any" else None, r)
    return V.relation_summary({"image-image": nn(im, im), "word-word": nn(wo, wo), "frame-same": nn(fr, fr, "same"), "frame-different": nn(fr, fr, "different"),
                               "frame-image": nn(fr, im), "frame-word": nn(fr, wo), "image-word": nn(im, wo)})


CEN = """, lg AS (SELECT vec_id, label, unnest(range(64)) AS pos, unnest(u) AS x FROM eu), cm AS (SELECT label, pos, avg(x) AS m FROM lg GROUP BY ALL)"""


@query("v04_centroids", W + CEN + " SELECT label, CAST(pos AS INTEGER) AS pos, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS x FROM cm", ("x",))
def _(t):
    return V.centroids(_em(t), "label", "embedding")


@query("v03_cosine_matrix", W + CEN + ", c AS (SELECT label, pos, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS x FROM cm) SELECT a.label AS i, b.label AS j, sum(a.x * b.x) AS cosine FROM c a JOIN c b USING (pos) GROUP BY ALL", ("cosine",))
def _(t):
    return V.cosine_matrix(V.centroids(_em(t), "label", "embedding"), "label")


@query("v03_sample_cosine_matrix", W + f""", p AS (SELECT vec_id, u, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM (SELECT * FROM eu ORDER BY {draw_sql(42, "vec_id")}, vec_id LIMIT 50))
  SELECT a.i, b.i AS j, a.vec_id AS key_i, b.vec_id AS key_j, list_dot_product(a.u, b.u) AS cosine FROM p a, p b""", ("cosine",))
def _(t):
    return V.sample_cosine_matrix(_em(t), "vec_id", "embedding", 50, 42).withColumns({c: F.col(c).cast("long") for c in "ij"})


@query("v04_centred_modalities", W + ", lg AS (SELECT vec_id, label % 3 AS modality, unnest(range(64)) AS pos, unnest(v) AS x FROM em) SELECT modality, vec_id, CAST(pos AS INTEGER) AS pos, x - avg(x) OVER (PARTITION BY modality, pos) AS x FROM lg", ("x",))
def _(t):
    return V.centre_blocks(_em(t).withColumn("modality", F.col("label") % 3), "modality", ["vec_id"], "embedding")


# Eigenvectors of 64 components have no SQL form; tests compare them with NumPy.
@query("v05_pca_projection")
def _(t):
    return V.project_pca(_em(t), "vec_id", "embedding").select("vec_id", F.round(F.abs("pc1"), 6).alias("pc1"), F.round(F.abs("pc2"), 6).alias("pc2"))  # signs are free


@query("v06_wide_features", W + ", lg AS (SELECT vec_id, unnest(range(64)) AS pos, unnest(v) AS x FROM em) SELECT vec_id, " + ", ".join(f"max(x) FILTER (pos = {i}) AS f{i}" for i in range(64)) + " FROM lg GROUP BY 1")
def _(t):
    x = V.components(_em(t), ["vec_id"], "embedding").withColumn("feature", F.concat(F.lit("f"), F.col("pos").cast("string")))
    return V.to_wide(x, ["vec_id"], "feature", "x", [f"f{i}" for i in range(64)])


@query("v06_grid_check", f"""WITH {USER_SERIES}, g AS (SELECT user_id, t * 0.5 + CASE WHEN event_id % 200 = 0 THEN 0.25 ELSE 0 END AS time, t FROM user_series), d AS (SELECT user_id, time - lag(time) OVER (PARTITION BY user_id ORDER BY t) AS d FROM g)
  SELECT user_id, count(*) AS n_frames, count(*) FILTER (abs(d - 0.5) > 1e-5) AS n_uneven FROM d GROUP BY 1""")
def _(t):
    x = t.user_series.withColumn("time", F.col("t") * 0.5 + F.when(F.col("event_id") % 200 == 0, 0.25).otherwise(0.0))
    return V.grid_check(x, "user_id", "t", "time", 0.5)


@query("v07_feature_timeline", """SELECT epoch(ts) - 1704067200 AS time, event_id AS id, value AS brightness FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20'""", {"time": 3})
def _(t):
    at = F.expr("cast(unix_micros(cast(ts as timestamp)) as double) / 1000000 - 1704067200").alias("time")
    x = t.events.select(at, F.col("event_id").alias("id"), F.col("value").alias("brightness"), F.col("value").alias("clip_000"), F.col("event_type").alias("name"))
    return V.feature_timeline(x, start=9 * 86400.0, end=19 * 86400.0)


@query("v07_picked_movie", "SELECT event_id, event_type FROM events WHERE event_type = 'click'")
def _(t):
    return V.pick_movie(t.events, "Click", "event_type").select("event_id", "event_type")


@query("v08_caption_ids", """SELECT page_id, url || CASE WHEN page_id % 3 = 0 THEN '@x' ELSE '' END AS movie, page_id / 4 AS time FROM pages""")
def _(t):
    c = F.concat("url", F.when(F.col("page_id") % 3 == 0, "@x").otherwise(""), F.lit("@"), (F.col("page_id") / 4).cast("string"))
    return V.split_caption_id(t.pages.select("page_id", c.alias("c")), "c").select("page_id", "movie", "time")


# All components to one target per label; tests compare the errors with NumPy.
@query("v09_ridge_path")
def _(t):
    target = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: (F.col("label") == k).cast("double"))
    return V.ridge_path(_em(t).select(F.col("embedding").alias("x"), target.alias("y")), "x", "y")[0]


IDN = """, lg AS (SELECT vec_id, label, vec_id % 2 AS h, unnest(range(64)) AS pos, unnest(v) AS x FROM em), m AS (SELECT label, h, pos, avg(x) AS x FROM lg GROUP BY ALL), z AS (SELECT *, (x - avg(x) OVER w) / (stddev_pop(x) OVER w * sqrt(count(*) OVER w)) AS z FROM m WINDOW w AS (PARTITION BY label, h)),
  cr AS (SELECT a.label AS a, b.label AS b, sum(a.z * b.z) AS r FROM z a JOIN z b ON a.pos = b.pos AND a.h = 0 AND b.h = 1 GROUP BY ALL), rk AS (SELECT c.a, c.b, (SELECT count(*) FROM cr x WHERE x.a = c.a AND x.r >= c.r) AS rank FROM cr c)"""


def _corr(t):
    m = V.components(_em(t), ["vec_id", "label"], "embedding").groupBy("label", (F.col("vec_id") % 2).alias("h"), "pos").agg(F.avg("x").alias("x"))
    return V.cross_correlations(m.where("h = 0").drop("h"), m.where("h = 1").drop("h"), "label")


@query("v10_identification_ranks", W + IDN + " SELECT a, b, rank FROM rk")
def _(t):
    return V.rank_table(_corr(t)).select("a", "b", "rank")


@query("v10_identification", W + IDN + f""", o AS (SELECT (10 - avg(rank)) / 9 AS acc FROM rk WHERE a = b), pm AS (SELECT perm, a, row_number() OVER (PARTITION BY perm ORDER BY {draw_sql(3, 'perm', 'a')}, a) - 1 AS b FROM (SELECT a, unnest(range(1, 1001)) AS perm FROM (SELECT DISTINCT a FROM rk))),
  n AS (SELECT perm, (10 - avg(rank)) / 9 AS acc FROM pm JOIN rk USING (a, b) GROUP BY 1) SELECT o.acc AS rank_accuracy, 10 AS n_items, (1 + (SELECT count(*) FROM n WHERE n.acc >= o.acc - 1e-12)) / 1001 AS p FROM o""", ("rank_accuracy", "p"))
def _(t):
    return V.identification(_corr(t), 3, 1000)


@query("v11_alignment")
def _(t):
    e = t.embeddings.select("vec_id", F.col("label").cast("long").alias("label"), F.slice("embedding", 1, 32).alias("x"), F.slice("embedding", 33, 32).alias("y"),
                            F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (F.col("label") == i).cast("double")).alias("f"))
    s = row_index(e, ["label"], ["vec_id"], id_block("vec_id"), "i").withColumn("t", F.col("i").cast("int"))
    return V.align_and_evaluate(e, s, "x", "y", "label", 9, features="f", ranks=(8,))
