"""Time-series operators (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.statistics import correlation_p_sql
from ..functions.core import pad2, significant_sql
from ..operators import series as S
from .registry import query
from .views import SERIES, USER_SERIES

W = f"WITH {SERIES}"
U = f"WITH {USER_SERIES}"
G = ["roi", "subject", "session", "movie"]
ROSTER = ["00", "01", "02", "03"]
PAIR = """, cut AS (SELECT roi, session, movie, min(e) AS e FROM (SELECT roi, session, movie, subject, max(t) AS e FROM {s} GROUP BY ALL) GROUP BY ALL), st AS (SELECT * FROM {s} JOIN cut USING (roi, session, movie) WHERE t <= e),
  pr AS (SELECT a.roi, a.session, a.movie, a.subject AS member_a, b.subject AS member_b, count(*) AS n, covar_pop(a.{v}, b.{v}) / nullif(stddev_pop(a.{v}) * stddev_pop(b.{v}), 0) AS r FROM st a JOIN st b ON a.roi = b.roi AND a.session = b.session AND a.movie = b.movie AND a.t = b.t AND a.subject < b.subject GROUP BY ALL)"""
P = PAIR.format(s="series", v="value")


@query("s01_roi_mean", """SELECT c_nationkey AS roi, day(ts)::BIGINT AS t, avg(value) AS value, count(value) AS n_units FROM events JOIN customer ON c_custkey = user_id GROUP BY ALL""", ("value",))
def _(t):
    s = t.events.select("user_id", F.dayofmonth("ts").cast("long").alias("t"), "value")
    return S.roi_mean(s, t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("roi")), "user_id", "roi", ["t"])


RES = """, x AS (SELECT *, coalesce(motion, 0) AS x FROM series), b AS (SELECT roi, subject, session, movie, avg(value) AS my, avg(x) AS mx, coalesce(covar_pop(value, x) / nullif(var_pop(x), 0), 0) AS slope FROM x GROUP BY ALL),
  res AS (SELECT x.*, value - my - slope * (x - mx) AS residual FROM x JOIN b USING (roi, subject, session, movie))"""


def _res(t):
    return S.residuals(t.series, G, ["motion"])


@query("s02_residuals", W + RES + " SELECT roi, subject, session, movie, t, residual FROM res", ("residual",))
def _(t):
    return _res(t).select(*G, "t", "residual")


@query("s03_confound_model", """SELECT event_id, value AS framewise_displacement, value * 2 AS cosine00, value + 1 AS cosine01 FROM events""", ("cosine00", "cosine01"))
def _(t):
    v = F.col("value")
    x = t.events.select("event_id", v.alias("framewise_displacement"), (v * 2).alias("cosine00"), (v + 1).alias("cosine01"), v.alias("csf"), v.alias("trans_x"))
    return x.select("event_id", *S.model_columns(x, ["framewise_displacement"], ["cosine"]))


SEG = """, ev AS (SELECT user_id, event_id AS movie, value / 20 AS onset, 15 + CAST(json_extract(props, '$.k') AS DOUBLE) / 7 AS duration FROM events),
  sg AS (SELECT e.user_id, movie, s.t, s.t - CAST(round_even(onset / 1.5, 0) AS BIGINT) - {k} AS pos, value FROM ev e JOIN user_series s ON s.user_id = e.user_id AND s.t >= CAST(round_even(onset / 1.5, 0) AS BIGINT) + {k} AND s.t < CAST(round_even(onset / 1.5, 0) AS BIGINT) + {k} + CAST(round_even(duration / 1.5, 0) AS BIGINT))"""


def _movies(t):
    return t.events.select("user_id", F.col("event_id").alias("movie"), (F.col("value") / 20).alias("onset"),
                                                     (F.lit(15) + F.get_json_object("props", "$.k").cast("double") / 7).alias("duration"))


@query("s04_movie_segments", U + SEG.format(k=0) + """, g AS (SELECT user_id, movie, avg(value) AS m, stddev_pop(value) AS sd FROM sg GROUP BY ALL)
  SELECT user_id, movie, pos, CASE WHEN sd > 0 THEN (value - m) / sd ELSE value END AS z FROM sg JOIN g USING (user_id, movie)""", ("z",))
def _(t):
    return S.movie_segments(t.user_series, _movies(t), ["user_id"], "movie", 1.5).select("user_id", "movie", "pos", "z")


KEY = ["roi", "session", "movie"]


def _pairs(t, df=None, value="value", **k):
    return S.pairwise(df if df is not None else t.series, KEY, "subject", ROSTER, value, **k)


@query("s05_pairwise_isc", W + P + " SELECT * FROM pr WHERE r IS NOT NULL AND n >= 2", ("r",))
def _(t):
    return _pairs(t)


@query("s05_pairwise_wsc", W + PAIR.replace("session", "#").replace("subject", "session").replace("#", "subject").format(s="series", v="value").replace("a.session AS member_a, b.session AS member_b", "CAST(a.session AS VARCHAR) AS member_a, CAST(b.session AS VARCHAR) AS member_b")
       + " SELECT * FROM pr WHERE r IS NOT NULL AND n >= 2", ("r",))
def _(t):
    return S.pairwise(t.series, ["roi", "subject", "movie"], "session", ["0", "1", "2", "3"])


FISH = "tanh(avg(atanh(r))) AS mean_r, stddev_pop(atanh(r)) AS sd_z, count(r) AS n_obs"


@query("s06_fisher_summary", W + P + f" SELECT roi, {FISH} FROM pr WHERE abs(r) < 1 AND n >= 10 GROUP BY roi", ("mean_r", "sd_z"))
def _(t):
    return S.fisher_summary(_pairs(t, min_len=10), ["roi"])


@query("s07_isc_against_motion", W + P + f""", m AS (SELECT roi, session, member, tanh(avg(atanh(r))) AS mean_r FROM (SELECT roi, session, r, unnest([member_a, member_b]) AS member FROM pr WHERE n >= 10 AND abs(r) < 1) GROUP BY ALL),
  f AS (SELECT subject AS member, session, avg(motion) AS mean_fd FROM series GROUP BY ALL), j AS (SELECT roi, {significant_sql("mean_r")} AS mean_r, {significant_sql("mean_fd")} AS mean_fd FROM m JOIN f USING (member, session)),
  k AS (SELECT *, rank() OVER (PARTITION BY roi ORDER BY mean_r) + (count(*) OVER (PARTITION BY roi, mean_r) - 1) / 2 AS rx, rank() OVER (PARTITION BY roi ORDER BY mean_fd) + (count(*) OVER (PARTITION BY roi, mean_fd) - 1) / 2 AS ry FROM j)
  SELECT *, {correlation_p_sql("rho", "n")} AS p FROM (SELECT roi, covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) AS rho, count(*) AS n FROM k GROUP BY roi HAVING count(*) >= 3)""", ("rho", "p"))
def _(t):
    m = t.series.groupBy(F.col("subject").alias("member"), "session").agg(F.avg("motion").alias("mean_fd"))
    return S.correlation_against_motion(_pairs(t, min_len=10), m, ["roi"], "session")


WPAIR = PAIR.replace("session", "#").replace("subject", "session").replace("#", "subject").format(s="series", v="value")


@query("s07_wsc_against_motion", W + WPAIR + f""", f AS (SELECT subject, session, avg(motion) AS fd FROM series GROUP BY ALL), j0 AS (SELECT pr.roi, CASE WHEN abs(r) >= 1 - 1e-12 THEN sign(r) ELSE r END AS r, (x.fd + y.fd) / 2 AS fd FROM pr JOIN f x ON x.subject = pr.subject AND x.session = member_a JOIN f y ON y.subject = pr.subject AND y.session = member_b WHERE n >= 2 AND r IS NOT NULL),
  j AS (SELECT roi, {significant_sql("r")} AS r, {significant_sql("fd")} AS fd FROM j0),
  k AS (SELECT *, rank() OVER (PARTITION BY roi ORDER BY r) + (count(*) OVER (PARTITION BY roi, r) - 1) / 2 AS rx, rank() OVER (PARTITION BY roi ORDER BY fd) + (count(*) OVER (PARTITION BY roi, fd) - 1) / 2 AS ry FROM j)
  SELECT *, {correlation_p_sql("rho", "n")} AS p FROM (SELECT roi, covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) AS rho, count(*) AS n FROM k GROUP BY roi HAVING count(*) >= 3)""", ("rho", "p"))
def _(t):
    m = t.series.groupBy("subject", "session").agg(F.avg("motion").alias("mean_fd"))
    p = S.pairwise(t.series, ["roi", "subject", "movie"], "session", ["0", "1", "2", "3"])
    return S.pair_correlation_against_motion(p, m, ["roi"], "subject")


TRI = """ SELECT x.roi, x.session, x.movie, x.member_a || '|' || x.member_b || '|' || y.member_b AS triple, (x.r + y.r + z.r) / 3 AS mean_r FROM q x JOIN q y ON x.roi = y.roi AND x.session = y.session AND x.movie = y.movie AND x.member_b = y.member_a
  JOIN q z ON x.roi = z.roi AND x.session = z.session AND x.movie = z.movie AND z.member_a = x.member_a AND z.member_b = y.member_b"""


@query("s08_triple_isc", W + P + ", q AS (SELECT * FROM pr WHERE n >= 10 AND r IS NOT NULL)" + TRI, ("mean_r",))
def _(t):
    return S.triple_means(_pairs(t, min_len=10), KEY)


CROP = """, l AS (SELECT roi, subject, session, movie, max(t) + 1 AS n FROM series GROUP BY ALL), crop AS (SELECT series.* REPLACE (t - CAST(floor((n - 12) / 2) AS BIGINT) AS t) FROM series JOIN l USING (roi, subject, session, movie) WHERE t >= floor((n - 12) / 2) AND t < floor((n - 12) / 2) + 12)"""


@query("s08_cropped_triple_isc", W + CROP + PAIR.format(s="crop", v="value") + ", q AS (SELECT * FROM pr WHERE n >= 10 AND r IS NOT NULL)" + TRI, ("mean_r",))
def _(t):
    return S.triple_means(_pairs(t, S.centre_crop(t.series, G, 12), min_len=10), KEY)


ZRES = RES + """, zs AS (SELECT roi, subject, session, movie, avg(residual) AS m, stddev_pop(residual) AS sd FROM res GROUP BY ALL), zz AS (SELECT res.*, CASE WHEN sd > 0 THEN (residual - m) / sd ELSE residual END AS z FROM res JOIN zs USING (roi, subject, session, movie))"""


@query("s09_movie_isc", W + ZRES + PAIR.format(s="zz", v="z") + """ SELECT roi, CASE WHEN movie IN ('m0', 'm1') THEN movie || ' ' || (session + 1) ELSE movie END AS movie, session, member_a, member_b, n, r FROM pr WHERE n >= 10 AND r IS NOT NULL""", ("r",))
def _(t):
    z = S.z_score(_res(t), G, "residual")
    return S.label_repeats(_pairs(t, z, "z", min_len=10).withColumn("no", F.col("session") + 1), "movie", "no", ["m0", "m1"]).drop("no")


@query("s10_averaged_isc", W + """, c AS (SELECT roi, subject, movie, min(e) AS e FROM (SELECT roi, subject, movie, session, max(t) AS e FROM series GROUP BY ALL) GROUP BY ALL), a AS (SELECT roi, subject, movie, 0 AS session, t, avg(value) AS v FROM series JOIN c USING (roi, subject, movie) WHERE t <= e GROUP BY ALL),
  g AS (SELECT roi, subject, movie, avg(v) AS m, stddev_pop(v) AS sd FROM a GROUP BY ALL), avgd AS (SELECT a.*, CASE WHEN sd > 0 THEN (v - m) / sd ELSE v END AS value FROM a JOIN g USING (roi, subject, movie))""" + PAIR.format(s="avgd", v="value") + " SELECT roi, movie, member_a, member_b, n, r FROM pr WHERE n >= 10 AND r IS NOT NULL", ("r",))
def _(t):
    return S.pairwise(S.average_repetitions(t.series, ["roi", "subject", "movie"], "session"), ["roi", "movie"], "subject", ROSTER, min_len=10)


@query("s11_mean_similarity", W + P + " SELECT roi, movie, avg(r) AS mean_r, count(r) AS n_pairs FROM pr WHERE n >= 2 AND r IS NOT NULL GROUP BY ALL", ("mean_r",))
def _(t):
    return S.mean_similarity(_pairs(t), ["roi", "movie"])


@query("s12_tsnr_ratio", """WITH u AS (SELECT l_partkey, l_partkey % 12 AS roi, l_linestatus AS version, avg(l_quantity) / stddev_pop(l_quantity) AS tsnr FROM lineitem GROUP BY ALL HAVING stddev_pop(l_quantity) > 0),
  g AS (SELECT roi, avg(tsnr) FILTER (version = 'O') AS tsnr_base, avg(tsnr) FILTER (version = 'F') AS tsnr_other FROM u GROUP BY 1) SELECT *, tsnr_other / tsnr_base AS ratio FROM g""", ("tsnr_base", "tsnr_other", "ratio"))
def _(t):
    u = S.tsnr(t.lineitem, ["l_partkey", "l_linestatus"], "l_quantity").withColumn("roi", F.col("l_partkey") % 12)
    return S.tsnr_ratio(u, "roi", "l_linestatus", "O", "F")


@query("s13_autocorrelation", U + """, c AS (SELECT user_id, t, value - avg(value) OVER (PARTITION BY user_id) AS c FROM user_series), v AS (SELECT user_id, sum(c * c) AS v FROM c GROUP BY 1),
  p AS (SELECT a.user_id, k AS lag, sum(a.c * b.c) AS s FROM (SELECT *, unnest(range(1, 6)) AS k FROM c) a JOIN c b ON a.user_id = b.user_id AND b.t = a.t + k GROUP BY ALL)
  SELECT lag, avg(coalesce(s, 0) / CASE WHEN v > 1e-12 THEN v ELSE 1 END) AS acf FROM (SELECT v.*, unnest(range(1, 6)) AS lag FROM v) LEFT JOIN p USING (user_id, lag) GROUP BY lag""", ("acf",))
def _(t):
    return S.autocorrelation(t.user_series, "user_id", "t", "value")


@query("s14_lag_similarity", """WITH h AS (SELECT event_type AS movie, user_id % 40 AS unit, hour(ts) AS t, avg(value) FILTER (event_id % 2 = 0) AS a, avg(value) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY ALL),
  f AS (SELECT g.movie, g.unit, g.t, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT movie, unit, unnest(range(24)) AS t FROM (SELECT DISTINCT movie, unit FROM h)) g LEFT JOIN h ON g.movie = h.movie AND g.unit = h.unit AND g.t = h.t),
  c AS (SELECT movie, unit, t, a - avg(a) OVER w AS a, b - avg(b) OVER w AS b FROM f WINDOW w AS (PARTITION BY movie, unit)), n AS (SELECT movie, unit, sqrt(sum(a * a)) AS na, sqrt(sum(b * b)) AS nb FROM c GROUP BY ALL),
  r AS (SELECT x.movie, x.unit, k AS lag, sum(x.a * y.b) AS s FROM (SELECT *, unnest(range(24)) AS k FROM c) x JOIN c y ON x.movie = y.movie AND x.unit = y.unit AND y.t = (x.t + k) % 24 GROUP BY ALL)
  SELECT movie, CAST(lag AS INTEGER) AS lag, quantile_cont(s / CASE WHEN na < 1e-12 THEN 1 ELSE na END / CASE WHEN nb < 1e-12 THEN 1 ELSE nb END, 0.5) AS median_r FROM r JOIN n USING (movie, unit) GROUP BY ALL""", ("median_r",))
def _(t):
    e = F.col("event_id") % 2
    x = t.events.select(F.col("event_type").alias("movie"), (F.col("user_id") % 40).alias("unit"), F.hour("ts").alias("t"), F.when(e == 0, F.col("value")).alias("a"), F.when(e == 1, F.col("value")).alias("b"))
    return S.lag_similarity(x, ["movie"], "unit")


FRAMES = U + """, n AS (SELECT user_id, max(t) + 1 AS n, arg_max(value, t) AS last FROM user_series GROUP BY 1), q AS (SELECT user_id, t // 3 AS j FROM user_series WHERE t % 3 = 0)"""


def _frames(t):
    f = t.user_series.select("user_id", F.col("t").alias("idx"), "value")
    return f, f.where("idx % 3 = 0").select("user_id", F.floor(F.col("idx") / 3).alias("j"))


@query("s15_features_hrf", FRAMES + """, h0 AS (SELECT i, pow(i * 0.5, 5) * exp(-i * 0.5) / 120 - pow(i * 0.5, 15) * exp(-i * 0.5) / 1307674368000 / 6 AS h FROM range(65) r(i)), h AS (SELECT i, h / (SELECT sum(h) FROM h0) AS h FROM h0),
  conv AS (SELECT user_id, t + i AS m, sum(value * h) AS c FROM user_series, h GROUP BY ALL), p AS (SELECT q.*, least((j * 1.4 + 4.5) / 0.5, n + 63) AS p FROM q JOIN n USING (user_id)), l AS (SELECT *, CAST(floor(p) AS BIGINT) AS lo, p - floor(p) AS f FROM p)
  SELECT user_id, j, (1 - f) * a.c + f * coalesce(b.c, 0) AS value FROM l JOIN conv a USING (user_id) LEFT JOIN conv b ON b.user_id = l.user_id AND b.m = lo + 1 WHERE a.m = lo""".replace("SELECT user_id, j, (1", "SELECT l.user_id, j, (1").replace("JOIN conv a USING (user_id)", "JOIN conv a ON a.user_id = l.user_id"), ("value",))
def _(t):
    return S.features_at(*_frames(t), "user_id", "hrf", tr=1.4)


@query("s15_features_fixed", FRAMES + """, p AS (SELECT q.*, n, least(j * 1.4 / 0.5, n - 1) AS p FROM q JOIN n USING (user_id)), l AS (SELECT *, CAST(floor(p) AS BIGINT) AS lo, p - floor(p) AS f FROM p)
  SELECT l.user_id, j, (1 - f) * a.value + f * coalesce(b.value, 0) AS value FROM l JOIN user_series a ON a.user_id = l.user_id AND a.t = lo LEFT JOIN user_series b ON b.user_id = l.user_id AND b.t = lo + 1""", ("value",))
def _(t):
    return S.features_at(*_frames(t), "user_id", "fixed", tr=1.4)


@query("s15_features_chunkmean", FRAMES + """, c AS (SELECT user_id, CAST(floor(t * 0.5 / 4.5) AS BIGINT) AS j, avg(value) AS v FROM user_series GROUP BY ALL) SELECT q.user_id, q.j, coalesce(v, last) AS value FROM q JOIN n USING (user_id) LEFT JOIN c ON c.user_id = q.user_id AND c.j = q.j""", ("value",))
def _(t):
    return S.features_at(*_frames(t), "user_id", "chunkmean")


@query("s16_trial_patterns", U + """, tr AS (SELECT user_id, event_id AS trial, CAST(round_even(value / 10, 0) AS BIGINT) AS o FROM events) SELECT tr.user_id, trial, avg(value) AS value, count(value) AS n FROM tr JOIN user_series s ON s.user_id = tr.user_id AND s.t IN (o + 3, o + 4) GROUP BY ALL""", ("value",))
def _(t):
    tr = t.events.select("user_id", F.col("event_id").alias("trial"), F.rint(F.col("value") / 10).cast("long").alias("onset_tr"))
    return S.trial_patterns(t.user_series.select("user_id", "t", "value"), tr, ["user_id"], "trial")


@query("s16_movie_patterns", U + SEG.format(k=3) + " SELECT * FROM sg")
def _(t):
    return S.movie_patterns(t.user_series, _movies(t), ["user_id"], "movie", 1.5).select("user_id", "movie", "t", "pos", "value")


@query("s17_residual_check", W + RES + """ SELECT roi, subject, session, movie, CASE WHEN stddev_pop(residual) > 1e-9 * stddev_pop(value) AND stddev_pop(residual) * stddev_pop(x) > 1e-14 THEN abs(covar_pop(residual, x) / (stddev_pop(residual) * stddev_pop(x))) ELSE 0 END AS abs_r,
  CASE WHEN stddev_pop(value) * stddev_pop(x) > 1e-14 THEN abs(covar_pop(value, x) / (stddev_pop(value) * stddev_pop(x))) ELSE 0 END AS abs_r_before FROM res GROUP BY ALL""", ("abs_r", "abs_r_before"))
def _(t):
    res = _res(t)
    before = S.residual_correlation(res, G, "motion", residual="value").withColumnRenamed("abs_r", "abs_r_before")
    return S.residual_correlation(res, G, "motion").join(before, G)


@query("s17_length_check", U + SEG.format(k=3) + """, f AS (SELECT user_id, movie, count(*) AS n_found FROM sg GROUP BY ALL) SELECT user_id, movie, CAST(round_even(duration / 1.5, 0) AS BIGINT) AS n_expected, n_found, coalesce(n_found BETWEEN CAST(round_even(duration / 1.5, 0) AS BIGINT) - 3 AND CAST(round_even(duration / 1.5, 0) AS BIGINT), false) AS ok
  FROM ev LEFT JOIN f USING (user_id, movie)""")
def _(t):
    found = S.movie_patterns(t.user_series, _movies(t), ["user_id"], "movie", 1.5).groupBy("user_id", "movie").agg(F.count("*").alias("n_found"))
    return S.length_check(found, _movies(t).select("user_id", "movie", F.rint(F.col("duration") / 1.5).cast("long").alias("n_expected")), ["user_id", "movie"])
