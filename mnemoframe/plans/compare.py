"""Dataset comparison (D). The two versions are orders and a perturbed copy of them; a file is one customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import pad2
from ..operators import compare as D
from .registry import query
from .views import RUNS

GR = """gen AS (SELECT o_custkey AS file, o_orderkey AS row, o_orderstatus AS word, o_orderpriority AS resp, o_totalprice / 97 AS onset, o_totalprice / 1009 AS dur FROM orders WHERE o_custkey % 19 <> 0 AND NOT (o_custkey % 23 = 1 AND o_orderkey % 3 = 0)),
  ref AS (SELECT o_custkey AS file, o_orderkey AS row, CASE WHEN o_orderkey % 101 = 0 THEN 'X' ELSE o_orderstatus END AS word, CASE WHEN o_orderkey % 151 = 0 THEN NULL ELSE o_orderpriority END AS resp,
  o_totalprice / 97 + CASE WHEN o_orderkey % 67 = 0 THEN 0.02 ELSE 0.0005 END AS onset, CASE WHEN o_orderkey % 71 <> 0 THEN o_totalprice / 1009 END AS dur FROM orders WHERE o_custkey % 29 <> 0),
  pr AS (SELECT file, n_generated, n_reference FROM (SELECT file, count(*) AS n_generated FROM gen GROUP BY 1) FULL JOIN (SELECT file, count(*) AS n_reference FROM ref GROUP BY 1) USING (file)),
  j AS (SELECT file, row, g.word AS gw, r.word AS rw, g.resp AS gr, r.resp AS rr, g.onset AS go, r.onset AS ro, g.dur AS gd, r.dur AS rd FROM gen g FULL JOIN ref r USING (file, row) WHERE file IN (SELECT file FROM pr WHERE n_generated = n_reference))"""


def _sides(t):
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    base = [c.alias("file"), k.alias("row")]
    gen = t.orders.where((c % 19 != 0) & ~((c % 23 == 1) & (k % 3 == 0))).select(*base, F.col("o_orderstatus").alias("word"), F.col("o_orderpriority").alias("resp"), (p / 97).alias("onset"), (p / 1009).alias("dur"))
    ref = t.orders.where(c % 29 != 0).select(*base, F.when(k % 101 == 0, "X").otherwise(F.col("o_orderstatus")).alias("word"), F.when(k % 151 != 0, F.col("o_orderpriority")).alias("resp"),
                                            (p / 97 + F.when(k % 67 == 0, 0.02).otherwise(0.0005)).alias("onset"), F.when(k % 71 != 0, p / 1009).alias("dur"))
    return gen, ref


D1 = """d1 AS (SELECT pr.*, n_word, n_resp, n_onset, max_onset, n_dur, max_dur, CASE WHEN n_reference IS NULL THEN 'MISSING_REFERENCE' WHEN n_generated IS NULL THEN 'MISSING_GENERATED' WHEN n_generated <> n_reference OR n_word + n_resp + n_onset + n_dur > 0 THEN 'MISMATCH' ELSE 'MATCH' END AS status
  FROM pr LEFT JOIN (SELECT file, count(*) FILTER (gw IS DISTINCT FROM rw) AS n_word, count(*) FILTER (gr IS DISTINCT FROM rr) AS n_resp, count(*) FILTER (abs(go - ro) > 0.01) AS n_onset, max(abs(go - ro)) AS max_onset,
  count(*) FILTER (abs(gd - rd) > 0.01) AS n_dur, max(abs(gd - rd)) AS max_dur FROM j GROUP BY 1) USING (file))"""


def _d1(t):
    return D.compare_files(*_sides(t), "file", "row", ["word", "resp"], ["onset", "dur"])


@query("d01_compared_files", f"WITH {GR}, {D1} SELECT * FROM d1", ("max_onset", "max_dur"))
def _(t):
    return _d1(t)


@query("d02_sweep_counts", f"WITH {GR}, {D1} SELECT file % 20 AS subject, status, count(*) AS n FROM d1 GROUP BY ALL")
def _(t):
    return D.sweep_counts(_d1(t).withColumn("subject", F.col("file") % 20), ["subject"])


D3 = """d3 AS (SELECT file, 'onset' AS "column", count(*) FILTER (abs(go - ro) > 0.001) AS n_mismatch, count(*) FILTER ((go IS NULL) <> (ro IS NULL)) AS n_na_mismatch, coalesce(max(abs(go - ro)), 0) AS max_diff FROM j GROUP BY 1
  UNION ALL SELECT file, 'dur', count(*) FILTER (abs(gd - rd) > 0.001), count(*) FILTER ((gd IS NULL) <> (rd IS NULL)), coalesce(max(abs(gd - rd)), 0) FROM j GROUP BY 1
  UNION ALL SELECT file, 'word', count(*) FILTER (coalesce(gw, 'n/a') <> coalesce(rw, 'n/a')), 0, NULL FROM j GROUP BY 1 UNION ALL SELECT file, 'resp', count(*) FILTER (coalesce(gr, 'n/a') <> coalesce(rr, 'n/a')), 0, NULL FROM j GROUP BY 1)"""


@query("d03_compared_columns", f"WITH {GR}, {D3} SELECT *, CASE WHEN n_mismatch > 0 OR n_na_mismatch > 0 THEN 'MISMATCH' ELSE 'MATCH' END AS status FROM d3", ("max_diff",))
def _(t):
    return D.compare_columns(*_sides(t), "file", "row", ["onset"], ["word"], ["dur", "resp"])


@query("d04_offset_aware", f"""WITH {GR}, f AS (SELECT file, arg_min(g.onset, row) AS a FROM gen g GROUP BY 1), h AS (SELECT file, arg_min(r.onset, row) AS b FROM ref r GROUP BY 1), o AS (SELECT file, a - b AS off FROM f JOIN h USING (file)),
  k AS (SELECT j.*, go - off AS g2 FROM j JOIN o USING (file)) SELECT file, 'onset' AS "column", count(*) FILTER (abs(g2 - ro) > 0.001) AS n_mismatch, count(*) FILTER ((g2 IS NULL) <> (ro IS NULL)) AS n_na_mismatch, max(abs(g2 - ro)) AS max_diff,
  CASE WHEN count(*) FILTER (abs(g2 - ro) > 0.001) > 0 OR count(*) FILTER ((g2 IS NULL) <> (ro IS NULL)) > 0 THEN 'MISMATCH' ELSE 'MATCH' END AS status FROM k GROUP BY 1""", ("max_diff",))
def _(t):
    gen, ref = _sides(t)
    return D.compare_columns(D.align_clock(gen, ref, "file", "row", ["onset"]), ref, "file", "row", ["onset"], [])


RULES = ((r"^https?://m\.([^/]+)/", "mobile/$1/"), (r"^https?://blog\.([^/]+)/", "blog/$1/"), (r"^https://([^/]+)/en/", "secure/$1/"))


@query("d05_mapped_paths", r"""SELECT page_id, CASE WHEN regexp_matches(url, '^https?://m\.') THEN regexp_replace(url, '^https?://m\.([^/]+)/', 'mobile/\1/') WHEN regexp_matches(url, '^https?://blog\.') THEN regexp_replace(url, '^https?://blog\.([^/]+)/', 'blog/\1/')
  WHEN regexp_matches(url, '^https://([^/]+)/en/') THEN regexp_replace(url, '^https://([^/]+)/en/', 'secure/\1/') END AS mapped FROM pages""")
def _(t):
    return D.map_paths(t.pages, "url", RULES).select("page_id", "mapped")


@query("d05_unmatched_outputs", r"""SELECT page_id, 'mobile/' || split_part(split_part(url, '://', 2), 'm.', 2) AS url FROM pages WHERE 'mobile/' || split_part(split_part(url, '://', 2), 'm.', 2) NOT IN (SELECT regexp_replace(url, '^https?://m\.([^/]+)/', 'mobile/\1/') FROM pages WHERE regexp_matches(url, '^https?://m\.'))""")
def _(t):
    out = t.pages.select("page_id", F.concat(F.lit("mobile/"), F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("m."), F.lit(2))).alias("url"))
    return D.unmatched_outputs(out, D.map_paths(t.pages, "url", RULES), "url")


@query("d06_paired_files", """WITH l AS (SELECT o_custkey AS c, o_orderdate AS d, CASE WHEN o_orderkey % 3 <> 0 THEN printf('%02d', o_orderkey % 2 + 1) END AS run, 'a' || o_orderkey AS path FROM orders WHERE o_orderkey % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY c, d ORDER BY o_orderkey) = 1),
  r AS (SELECT o_custkey AS c, o_orderdate AS d, CASE WHEN o_orderkey % 5 <> 0 THEN printf('%02d', o_orderkey % 2 + 1) END AS run, 'b' || o_orderkey AS path FROM orders WHERE o_orderkey % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY c, d ORDER BY o_orderkey) = 1),
  x AS (SELECT l.c, l.d, l.path AS lp, r.path AS rp, CASE WHEN l.run IS NOT DISTINCT FROM r.run THEN 'exact' ELSE 'run' END AS match FROM l JOIN r ON l.c = r.c AND l.d = r.d AND (l.run IS NOT DISTINCT FROM r.run OR (l.run IS NULL AND r.run = '01') OR (r.run IS NULL AND l.run = '01')))
  SELECT c, lp AS left_path, rp AS right_path, match FROM x UNION ALL SELECT c, path, NULL, 'left only' FROM l WHERE path NOT IN (SELECT lp FROM x) UNION ALL SELECT c, NULL, path, 'right only' FROM r WHERE path NOT IN (SELECT rp FROM x)""")
def _(t):
    k = F.col("o_orderkey")

    def side(mod, miss, tag):
        first = t.orders.where(k % mod != 0).groupBy(F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("d")).agg(F.min("o_orderkey").alias("o_orderkey"))
        return first.select("c", "d", F.when(k % miss != 0, pad2(k % 2 + 1)).alias("run"), F.concat(F.lit(tag), k.cast("string")).alias("path"))

    return D.pair_files(side(4, 3, "a"), side(7, 5, "b"), ["c", "d"]).drop("d")


@query("d06_offset_consistency", f"""WITH {GR} SELECT file, count(*) AS n_rows, min(g.onset - r.onset) AS min_offset, max(g.onset - r.onset) AS max_offset, avg(g.onset - r.onset) AS mean_offset, max(g.onset - r.onset) - min(g.onset - r.onset) < 0.001 AS constant
  FROM gen g JOIN ref r USING (file, row) GROUP BY 1""", {"min_offset": 5, "max_offset": 5, "mean_offset": 5})
def _(t):
    return D.offset_consistency(*_sides(t), "file", "row")
