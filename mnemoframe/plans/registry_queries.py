"""Registry, reference data and design tables (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import pad2
from ..operators import registry as R
from .registry import query
from .views import VOLUMES

TOK = r"list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(replace(replace(replace(lower(title), 'é', 'e '), '&', ' and '), '''', ''), '[^a-z0-9]+', ' ', 'g')), '\b(the|a|an|of)\b', '', 'g'), '\s+', ' ', 'g'), '([a-z0-9]) s( |$)', '\1s\2', 'g')), ' '), lambda x: x <> '')"
TITLES = f"""ti AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'The ' || p_name WHEN 1 THEN p_name || ' & a ' || p_brand WHEN 2 THEN replace(p_name, 'e', 'é') WHEN 3 THEN p_name || '''s box s' ELSE p_name END AS title FROM part)"""


def _titles(t):
    n, k = F.col("p_name"), F.col("p_partkey") % 5
    title = (F.when(k == 0, F.concat(F.lit("The "), n)).when(k == 1, F.concat(n, F.lit(" & a "), F.col("p_brand"))).when(k == 2, F.regexp_replace(n, "e", "é"))
             .when(k == 3, F.concat(n, F.lit("'s box s"))).otherwise(n))
    return t.part.select("p_partkey", title.alias("title"))


@query("r01_title_tokens", f"WITH {TITLES} SELECT p_partkey, array_to_string({TOK}, '-') AS slug, len({TOK}) AS n_tokens FROM ti")
def _(t):
    return _titles(t).select("p_partkey", R.slug("title").alias("slug"), F.size(R.norm_tokens("title")).cast("long").alias("n_tokens"))


@query("r02_title_match", f"""WITH {TITLES}, k AS (SELECT p_partkey, {TOK} AS tokens FROM ti), a AS (SELECT * FROM k), f AS (SELECT tokens AS ft, 'file' || printf('%09d', p_partkey) AS file FROM k),
  s AS (SELECT p_partkey, file, CASE WHEN tokens = ft THEN 3 WHEN ft[1:len(tokens)] = tokens OR tokens[1:len(ft)] = ft THEN 2 WHEN list_has_all(ft, tokens) OR list_has_all(tokens, ft) THEN 1 END AS score FROM a, f),
  b0 AS (SELECT p_partkey, score, count(*) AS n, min(file) AS file FROM s WHERE score IS NOT NULL GROUP BY ALL), b AS (SELECT * FROM b0 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC) = 1)
  SELECT p_partkey, CAST(score AS INTEGER) AS score, n AS n_best, CASE WHEN n = 1 THEN file END AS file FROM a LEFT JOIN b USING (p_partkey)""")
def _(t):
    k = _titles(t).select("p_partkey", R.norm_tokens("title").alias("tokens"))
    f = k.select("tokens", F.concat(F.lit("file"), F.format_string("%09d", "p_partkey")).alias("file"))
    return R.match_titles(k, f).select("p_partkey", "score", "n_best", "file")


@query("r03_canonical_spellings", """WITH d AS (SELECT CASE doc_id % 3 WHEN 0 THEN upper(source) WHEN 1 THEN source ELSE 'S' || substr(source, 2) END AS s, CASE WHEN source = 'src7' THEN doc_id % 2 ELSE length(source) END AS len FROM documents),
  c AS (SELECT lower(s) AS key, s, count(*) AS n FROM d GROUP BY ALL), l AS (SELECT lower(s) AS key, count(DISTINCT len) AS n_lengths, min(len)::DOUBLE AS length FROM d GROUP BY 1)
  SELECT key, first(s ORDER BY n DESC, s DESC) AS canonical, array_to_string(list(s ORDER BY n DESC, s DESC)[2:], '|') AS variants, CAST(sum(n) AS BIGINT) AS n, any_value(n_lengths) AS n_lengths, any_value(length) AS length, any_value(n_lengths) > 1 AS conflict FROM c JOIN l USING (key) GROUP BY key""")
def _(t):
    k = F.col("doc_id") % 3
    s = F.when(k == 0, F.upper("source")).when(k == 1, F.col("source")).otherwise(F.concat(F.lit("S"), F.expr("substr(source, 2)")))
    d = t.documents.select(s.alias("name"), F.when(F.col("source") == "src7", F.col("doc_id") % 2).otherwise(F.length("source")).alias("len"))
    return R.canonical_spellings(d, "name", "len")


@query("r04_registry_integrity", """SELECT count(*) AS n_rows, count(DISTINCT p_partkey) AS n_unique, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)) AS n_missing_files,
  count(*) = 2000 AND count(DISTINCT p_partkey) = count(*) AND (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)) = 0 AS ok FROM part""")
def _(t):
    return R.registry_integrity(t.part, "p_partkey", t.lineitem.select(F.col("l_partkey").alias("p_partkey")), 2000)


@query("r05_unresolved_references", """SELECT 'l_partkey' AS "column", l_partkey AS value, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 40 <> 0) GROUP BY 2
  UNION ALL SELECT 'l_suppkey', l_suppkey, count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 9 <> 0) GROUP BY 2
  UNION ALL SELECT 'l_orderkey', l_orderkey, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 2""")
def _(t):
    return R.unresolved_references(t.lineitem, {"l_partkey": (t.part.where("p_partkey % 40 <> 0"), "p_partkey"), "l_suppkey": (t.supplier.where("s_suppkey % 9 <> 0"), "s_suppkey"),
                                                "l_orderkey": (t.orders.where("o_orderstatus <> 'P'"), "o_orderkey")})


@query("r06_shared_items", """WITH x AS (SELECT printf('%02d', l_suppkey % 20) AS subject, l_partkey % 150 AS pairId, l_partkey % 300 AS imageId, CASE WHEN l_partkey % 150 < 75 THEN 3 ELSE 2 END AS enCon FROM lineitem)
  SELECT subject, pairId, count(*) AS n_presentations, min(imageId) AS imageId, min(enCon) AS enCon, count(DISTINCT imageId) = 1 AND count(DISTINCT enCon) = 1 AS stable, CASE min(enCon) WHEN 3 THEN 'triplet' ELSE 'single' END AS role, CASE min(enCon) WHEN 3 THEN pairId ELSE 0 END AS position FROM x GROUP BY subject, pairId""")
def _(t):
    k = F.col("l_partkey")
    x = t.lineitem.select(pad2(F.col("l_suppkey") % 20).alias("subject"), (k % 150).alias("pairId"), (k % 300).alias("imageId"), F.when(k % 150 < 75, 3).otherwise(2).alias("enCon"))
    return R.shared_items(x, ["subject"], "pairId", ["imageId", "enCon"])


@query("r07_verified_inputs", """WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT o_orderpriority, max(o_totalprice) - min(o_totalprice) AS d FROM orders GROUP BY 1)
  SELECT 'orders per customer' AS check_name, count(*) AS n_checked, count(*) FILTER (n < 2) AS n_bad, CASE WHEN count(*) FILTER (n < 2) = 0 THEN 'OK' ELSE 'FAIL' END AS status FROM c
  UNION ALL SELECT 'price spread', count(*), count(*) FILTER (d <= 0.05), CASE WHEN count(*) FILTER (d <= 0.05) = 0 THEN 'OK' ELSE 'FAIL' END FROM p
  UNION ALL SELECT 'known priority', count(*), count(*) FILTER (o_orderpriority NOT LIKE '%-%'), CASE WHEN count(*) FILTER (o_orderpriority NOT LIKE '%-%') = 0 THEN 'OK' ELSE 'FAIL' END FROM orders""")
def _(t):
    per = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    sp = t.orders.groupBy("o_orderpriority").agg((F.max("o_totalprice") - F.min("o_totalprice")).alias("d"))
    return R.verify({"orders per customer": (per, F.col("n") >= 2), "price spread": (sp, F.col("d") > 0.05), "known priority": (t.orders, F.col("o_orderpriority").contains("-"))})


@query("r08_clock_values", """WITH x AS (SELECT p_partkey, p_partkey // 90 AS m, p_partkey % 90 AS s FROM part)
  SELECT p_partkey, CASE WHEN p_partkey % 8 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN m * 60.0e0 + s WHEN s <= 59 THEN m * 60.0e0 + s END AS seconds, p_partkey % 8 <> 0 AND p_partkey % 3 <> 0 AND s > 59 AS bad FROM x""")
def _(t):
    k = F.col("p_partkey")
    m, s = F.floor(k / 90).cast("string"), (k % 90)
    txt = F.when(k % 8 == 0, " ").when(k % 3 == 0, F.concat(m, F.lit(":"), s.cast("string"))).otherwise(F.concat(m, F.lit("."), pad2(s)))
    value, bad = R.parse_clock("c")
    return t.part.select("p_partkey", txt.alias("c")).select("p_partkey", value.alias("seconds"), bad.alias("bad"))


ANN = """ann AS (SELECT o_orderkey, 'B' AS level, CAST(o_orderkey % 200 AS DOUBLE) AS onset, CAST(o_custkey % 300 AS DOUBLE) AS "offset" FROM orders WHERE o_orderkey % 4 <> 0
  UNION ALL SELECT o_orderkey, 'C', CAST(o_orderkey % 150 AS DOUBLE), CAST(o_custkey % 250 AS DOUBLE) FROM orders),
  cor AS (SELECT o_orderkey, 'C' AS level, CASE WHEN o_orderkey % 2 = 0 THEN 'onset' ELSE 'offset' END AS field, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 150 + o_orderkey % 3 ELSE o_custkey % 250 END AS DOUBLE) AS old, 7.0e0 AS new FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL SELECT o_orderkey, 'B', 'onset', CAST(o_orderkey % 200 AS DOUBLE), 9.0e0 FROM orders WHERE o_orderkey % 11 = 0)"""


def _ann(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    wide = t.orders.select("o_orderkey", F.when(k % 4 != 0, k % 200).alias("B_onset"), F.when(k % 4 != 0, c % 300).alias("B_offset"), (k % 150).alias("C_onset"), (c % 250).alias("C_offset"))
    cor = (t.orders.where(k % 5 == 0).select("o_orderkey", F.lit("C").alias("level"), F.when(k % 2 == 0, "onset").otherwise("offset").alias("field"),
                                             F.when(k % 2 == 0, k % 150 + k % 3).otherwise(c % 250).cast("double").alias("old"), F.lit(7.0).alias("new"))
           .unionByName(t.orders.where(k % 11 == 0).select("o_orderkey", F.lit("B").alias("level"), F.lit("onset").alias("field"), (k % 200).cast("double").alias("old"), F.lit(9.0).alias("new"))))
    return R.annotations_long(wide, ["o_orderkey"], ["B", "C"]), cor


AK = ["o_orderkey", "level"]


@query("r09_annotations_long", f"""WITH {ANN} SELECT *, "offset" - onset AS duration FROM ann""")
def _(t):
    return _ann(t)[0]


@query("r10_corrected_annotations", f"""WITH {ANN}, j AS (SELECT a.*, c.field, c.old, c.new, CASE c.field WHEN 'onset' THEN a.onset = c.old WHEN 'offset' THEN a."offset" = c.old ELSE false END AS hit FROM ann a LEFT JOIN cor c USING (o_orderkey, level)),
  n AS (SELECT o_orderkey, level, CASE WHEN hit AND field = 'onset' THEN new ELSE onset END AS onset, CASE WHEN hit AND field = 'offset' THEN new ELSE "offset" END AS "offset", hit AS corrected FROM j) SELECT *, "offset" - onset AS duration FROM n""")
def _(t):
    return R.apply_corrections(*_ann(t), AK)


@query("r10_refused_corrections", f"""WITH {ANN} SELECT o_orderkey, level, field, old, CASE WHEN a.onset IS NULL THEN 'no such segment' ELSE 'source differs' END AS reason FROM cor LEFT JOIN ann a USING (o_orderkey, level)
  WHERE a.onset IS NULL OR CASE field WHEN 'onset' THEN a.onset ELSE a."offset" END <> old""")
def _(t):
    return R.refused_corrections(*_ann(t), AK).select("o_orderkey", "level", "field", "old", "reason")


@query("r11_checked_annotations", f"""WITH {ANN}, x AS (SELECT o_orderkey % 100 AS movie, level, max("offset") AS last_offset, count(*) FILTER ("offset" < onset) AS n_negative FROM ann GROUP BY ALL)
  SELECT *, CAST(240 + movie AS DOUBLE) AS length, abs(last_offset - (240 + movie)) > 20 OR n_negative > 0 AS problem FROM x""")
def _(t):
    long = _ann(t)[0].withColumn("movie", F.col("o_orderkey") % 100)
    lengths = t.orders.select((F.col("o_orderkey") % 100).alias("movie")).distinct().withColumn("length", (F.col("movie") + 240).cast("double"))
    return R.check_annotations(long, lengths, ["movie"], 20.0)


CAP = "cap AS (SELECT conv_id, turn, 'c' || length(text) || ' ' AS caption FROM conversations), w AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 3 <> 0), x AS (SELECT cap.*, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM cap JOIN w USING (conv_id))"


def _captions(t):
    return (t.conversations.select("conv_id", "turn", F.concat(F.lit("c"), F.length("text").cast("string"), F.lit(" ")).alias("caption")),
            t.conversations.where("conv_id % 3 <> 0").select("conv_id"))


@query("r12_caption_table", f"WITH {CAP} SELECT conv_id, count(*) AS n_captions, " + ", ".join(f"coalesce(max(trim(caption)) FILTER (i = {i}), '') AS caption_{i}" for i in range(1, 6)) + " FROM x GROUP BY conv_id")
def _(t):
    return R.caption_table(*_captions(t), "conv_id", "turn", 5)


@query("r12_caption_rows", f"WITH {CAP} SELECT conv_id, i AS caption_index, trim(caption) AS caption FROM x")
def _(t):
    return R.caption_rows(*_captions(t), "conv_id", "turn")


@query("r12_instance_summary", """WITH c AS (SELECT conv_id, role AS c, substr(role, 1, 1) AS g, count(*) AS n FROM conversations GROUP BY ALL)
  SELECT conv_id, array_to_string(list(c ORDER BY c), '; ') AS categories, array_to_string(list(c || ':' || n ORDER BY c), '; ') AS counts, array_to_string(list_sort(list(DISTINCT g)), '; ') AS groups, CAST(sum(n) AS BIGINT) AS n_instances, count(*) AS n_categories FROM c GROUP BY 1""")
def _(t):
    return R.instance_summary(t.conversations.withColumn("g", F.substring("role", 1, 1)), "conv_id", "role", "g")


@query("r13_join_completeness", """SELECT (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)) AS n_matched,
  (SELECT count(*) FROM documents WHERE doc_id % 3 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels)) AS n_without_rows, (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)) AS n_unknown""")
def _(t):
    return R.join_completeness(t.labels, t.documents.where("doc_id % 3 <> 0"), "doc_id")


@query("r13_silent_items", """SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def _(t):
    return R.transcript_union(t.documents, t.labels.withColumn("text", F.when(F.col("quality") == 1, "x").otherwise(" ")), "doc_id", "text")[1]


@query("r14_session_table", r"""WITH l AS (SELECT o_orderkey, o_custkey AS subject, printf('%02d', o_orderkey % 90) AS session, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS earbud,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'a b' END AS note FROM orders), q AS (SELECT c_custkey AS subject, CAST(o_orderdate AS DATE) AS d, c_nationkey / 2 AS sleep FROM customer JOIN (SELECT o_custkey, min(o_orderdate) AS o_orderdate FROM orders GROUP BY 1) ON o_custkey = c_custkey),
  e AS (SELECT c_custkey AS subject, '05' AS session, 'late' AS exception, 'yes' AS verified FROM customer WHERE c_custkey % 2 = 0)
  SELECT o_orderkey, l.subject, l.session, strftime(l.d, '%Y-%m-%d') AS acq_date, earbud, coalesce(CASE WHEN sleep = floor(sleep) THEN CAST(CAST(sleep AS BIGINT) AS VARCHAR) ELSE CAST(sleep AS VARCHAR) END, 'n/a') AS sleep, note, coalesce(exception, '') AS exception, CASE WHEN exception IS NOT NULL THEN verified ELSE 'n/a' END AS verified
  FROM l LEFT JOIN q USING (subject, d) LEFT JOIN e USING (subject, session)""")
def _(t):
    k = F.col("o_orderkey")
    log = t.orders.select("o_orderkey", F.col("o_custkey").alias("subject"), pad2(k % 90).alias("session"), F.col("o_orderdate").alias("acq_time"),
                          F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("earbud"), F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, "a\nb ").otherwise(" a b\r").alias("note"))
    q = (t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("filled_at")).join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
         .select(F.col("c_custkey").alias("subject"), "filled_at", (F.col("c_nationkey") / 2).alias("sleep")))
    e = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("subject"), F.lit("05").alias("session"), F.lit("late").alias("exception"), F.lit("yes").alias("verified"))
    return R.session_table(log, q, e, ["earbud"], ["sleep"]).drop("acq_time")


@query("r15_phenotype", """SELECT 'sub-' || p_partkey AS participant_id, CAST(p_size AS DOUBLE) AS item_1, CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_partkey % 5 AS DOUBLE) END AS item_2, p_size + coalesce(CASE WHEN p_partkey % 6 <> 0 THEN p_partkey % 5 END, 0)::DOUBLE AS total FROM part WHERE p_partkey % 2 = 0""")
def _(t):
    k = F.col("p_partkey")
    df = t.part.select("p_partkey", F.col("p_size").alias("Q 1"), F.when(k % 6 == 0, "skipped").otherwise((k % 5).cast("string")).alias("Q 2"))
    ids = t.part.where("p_partkey % 2 = 0").select("p_partkey", F.concat(F.lit("sub-"), k.cast("string")).alias("participant_id"))
    return R.phenotype(df, ids, "p_partkey", {"Q 1": "item_1", "Q 2": "item_2"}, "total")


@query("r15_clean_text", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN 'n/a' ELSE p_name || ' x' END AS text FROM part")
def _(t):
    k = F.col("p_partkey") % 4
    x = t.part.select("p_partkey", F.when(k == 0, " nan ").when(k == 1, F.lit(None)).otherwise(F.concat(F.lit(" "), "p_name", F.lit("  \n x"))).alias("c"))
    return x.select("p_partkey", R.clean_text("c").alias("text"))


COND = """tr AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_partkey % 700 AS VARCHAR) || '_' || l_returnflag AS condition, l_orderkey * 8 + l_linenumber AS ord, l_quantity * 7 AS onset FROM lineitem),
  cm AS (SELECT condition, min(ord) AS first_seen, count(*) AS n_presentations FROM tr GROUP BY 1), cond AS (SELECT *, row_number() OVER (ORDER BY first_seen, condition) - 1 AS col_index FROM cm)"""


def _cond(t):
    tr = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", R.condition_id(F.concat((F.col("l_partkey") % 700).cast("string"), F.lit(".0")), F.col("l_returnflag")).alias("condition"),
                           (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), (F.col("l_quantity") * 7).alias("onset"))
    g = tr.groupBy("condition").agg(F.min("ord").alias("first_seen"), F.count("*").alias("n_presentations"))
    from ..functions.scan import id_block, row_index
    return tr, row_index(g, [], ["first_seen", "condition"], id_block("first_seen"), "col_index")


@query("r16_condition_map", f"WITH {COND} SELECT * FROM cond")
def _(t):
    return _cond(t)[1]


@query("r16_condition_map_by_item", """WITH c AS (SELECT o_custkey, min(o_orderkey) AS first_seen, count(*) AS n_presentations FROM orders GROUP BY 1) SELECT *, row_number() OVER (ORDER BY first_seen) - 1 AS col_index FROM c""")
def _(t):
    return R.condition_map(t.orders, "o_custkey", "o_orderkey")


@query("r16_repetition_histogram", f"WITH {COND} SELECT n_presentations, count(*) AS n_conditions FROM cond GROUP BY 1")
def _(t):
    return R.repetition_histogram(_cond(t)[1])


CH = """g AS (SELECT user_id, floor(min(value + 20) / 4.5)::BIGINT AS n_chunks, min(event_id) AS f, count(*) AS n_presentations FROM events GROUP BY 1), ch AS (SELECT user_id, n_chunks, n_presentations, unnest(range(n_chunks)) AS chunk_idx, f FROM g WHERE n_chunks >= 1),
  chunks AS (SELECT * EXCLUDE f, row_number() OVER (ORDER BY f, chunk_idx) - 1 AS col_index FROM ch)"""


def _chunks(t):
    x = t.events.withColumn("duration", F.col("value") + 20)
    from ..functions.scan import id_block, row_index
    return R.chunk_conditions(x, "user_id", "duration", "event_id")


@query("r17_chunk_conditions", f"WITH {CH} SELECT * FROM chunks")
def _(t):
    return _chunks(t)


@query("r18_design_rows", f"""WITH {COND}, v AS (SELECT l_orderkey, 40 + count(*) * 30 AS n_volumes FROM tr GROUP BY 1), d AS (SELECT tr.l_orderkey, ord, l_suppkey, col_index, CAST(round_even(onset / 1.5, 0) AS BIGINT) AS onset_vol, n_volumes FROM tr JOIN cond USING (condition) JOIN v USING (l_orderkey))
  SELECT l_orderkey, ord, l_suppkey, col_index, onset_vol, onset_vol >= 0 AND onset_vol < n_volumes AS inside, count(*) OVER (PARTITION BY l_orderkey, col_index) = 1 AS unique_in_run FROM d""")
def _(t):
    tr, cond = _cond(t)
    v = tr.groupBy("l_orderkey").agg((F.count("*") * 30 + 40).alias("n_volumes"))
    return R.design_rows(tr, cond, "condition", v, "l_orderkey", 1.5).select("l_orderkey", "ord", "l_suppkey", "col_index", "onset_vol", "inside", "unique_in_run")


@query("r18_chunk_design_rows", f"""WITH {CH}, v AS (SELECT day(ts) AS run, 300 AS n_volumes FROM events GROUP BY 1), d AS (SELECT day(ts) AS run, event_id, col_index, CAST(round_even(value / 1.5, 0) AS BIGINT) + 3 * chunk_idx AS onset_vol FROM events JOIN chunks USING (user_id))
  SELECT run, event_id, col_index, onset_vol, onset_vol >= 0 AND onset_vol < 300 AS inside, count(*) OVER (PARTITION BY run, col_index) = 1 AS unique_in_run FROM d""")
def _(t):
    run = F.dayofmonth("ts").cast("long").alias("run")
    tr = t.events.select(run, "event_id", "user_id", F.col("value").alias("onset"))
    return R.design_rows(tr, _chunks(t), "user_id", t.events.select(run).distinct().withColumn("n_volumes", F.lit(300)), "run", 1.5, chunked=True).select(
        "run", "event_id", "col_index", "onset_vol", "inside", "unique_in_run")


@query("r19_spike_regressors", f"WITH {VOLUMES} SELECT subject, session, volume, row_number() OVER (PARTITION BY subject, session ORDER BY volume) - 1 AS spike FROM volumes WHERE fd > 0.9")
def _(t):
    return R.spike_regressors(t.volumes, ["subject", "session"], "volume", "framewise_displacement", 0.9)


@query("r20_cue_purity", """SELECT user_id, day, count(DISTINCT event_type) AS n_cues, min(event_type) AS cue, count(*) AS n_trials FROM (SELECT user_id, CAST(day(ts) AS BIGINT) AS day, event_type FROM events WHERE event_type <> 'error') GROUP BY ALL""")
def _(t):
    x = t.events.select("user_id", F.dayofmonth("ts").cast("long").alias("day"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("c"))
    return R.cue_purity(x, ["user_id", "day"], "c")


@query("r20_runs_with_cue", """SELECT event_id, user_id FROM (SELECT *, min(event_type) OVER (PARTITION BY user_id, day(ts)) AS a, max(event_type) OVER (PARTITION BY user_id, day(ts)) AS b FROM events) WHERE a = 'view' AND b = 'view'""")
def _(t):
    x = t.events.withColumn("day", F.dayofmonth("ts"))
    return R.runs_with_cue(x, ["user_id", "day"], "event_type", "view").select("event_id", "user_id")
