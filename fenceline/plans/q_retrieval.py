"""Retrieval, ranking and the learning loop over documents, benchmark passages and embeddings."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as Q
from ..sources import files as S
from . import q_text as T, views as V
from .registry import query

TOK = r"regexp_extract_all(lower(text), '[a-z0-9][a-z0-9._-]*')"
BM = f"""dt AS (SELECT doc_id, {TOK} AS toks FROM documents), p AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM dt), tf AS (SELECT doc_id, term, count(*) AS tf, max(dl) AS dl FROM p GROUP BY 1, 2),
 st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM dt), i0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), st),
 idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i0) ELSE idf END AS idf FROM i0), qt AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOK}) AS term FROM benchmark) GROUP BY 1, 2),
 bm AS (SELECT qt.query_id, tf.doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM qt JOIN tf ON tf.term = qt.term JOIN idf ON idf.term = qt.term, st GROUP BY 1, 2),
 bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id) AS rank FROM bm)"""


def _bench(spark, sf):
    return V.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _docs(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", "text")


@query("bm25", f"WITH {BM} SELECT query_id, doc_id, round(bm25, 6) AS bm25, rank FROM bmr WHERE rank <= 10")
def bm25(spark, sf):
    return Q.bm25(_bench(spark, sf), _docs(spark, sf), 10).select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"), "rank")


WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^0-9a-z_]+'), lambda x: length(x) >= 2)"


@query("tfidf_cosine", f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), q AS (SELECT item_id AS query_id, {WORDS} AS w FROM benchmark),
 g AS (SELECT doc_id, unnest(w || CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])) ELSE [] END) AS term FROM d), tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2),
 qg AS (SELECT query_id, unnest(w || CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])) ELSE [] END) AS term FROM q), qf AS (SELECT query_id, term, count(*) AS tf FROM qg GROUP BY 1, 2),
 idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1), dn AS (SELECT doc_id, sqrt(sum((tf * idf) * (tf * idf))) AS norm FROM tf JOIN idf USING (term) GROUP BY 1),
 qn AS (SELECT query_id, sqrt(sum((tf * idf) * (tf * idf))) AS norm FROM qf JOIN idf USING (term) GROUP BY 1), dot AS (SELECT query_id, doc_id, sum(qf.tf * tf.tf * idf * idf) AS s FROM qf JOIN tf USING (term) JOIN idf USING (term) GROUP BY 1, 2)
 SELECT query_id, doc_id, round(s / (dn.norm * qn.norm), 6) AS cosine FROM dot JOIN dn USING (doc_id) JOIN qn USING (query_id) WHERE s / (dn.norm * qn.norm) > 0.3""")
def tfidf_cosine(spark, sf):
    toks = lambda c: F.split(F.lower(c), r"[^0-9a-z_]+")
    return Q.tfidf_scores(_bench(spark, sf), _docs(spark, sf), toks, above=0.3).select("query_id", "doc_id", F.round("cosine", 6).alias("cosine"))


DENSE = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS double)) AS e FROM embeddings), u AS (SELECT vec_id, label, list_transform(e, lambda x: x / (sqrt(list_sum(list_transform(e, lambda y: y * y))) + 1e-9)) AS e FROM v),
 s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, d.label, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * d.e[i])) AS sim FROM u q, u d WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, doc_id) AS rank FROM s)"""


def _dense(spark, sf, k=25):
    e = V.table(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return Q.dense_rank(q, e.select(F.col("vec_id").alias("doc_id"), "embedding"), k)


@query("dense_rank", f"WITH {DENSE} SELECT query_id, doc_id, round(sim, 6) AS sim, rank FROM r WHERE rank <= 5")
def dense_rank(spark, sf):
    return _dense(spark, sf, 5).select("query_id", "doc_id", F.round("sim", 6).alias("sim"), "rank")


@query("match_confidence", f"""WITH {DENSE}, c AS (SELECT *, CASE WHEN rank = 1 THEN coalesce(sim - lead(sim) OVER (PARTITION BY query_id ORDER BY rank), 0) ELSE 0 END AS m FROM r WHERE rank <= 5)
 SELECT query_id, doc_id, round(100 * (0.45 * greatest(0, least(1, sim)) + 0.55 * greatest(0, least(1, 4 * m))) * CASE WHEN label % 2 = 0 THEN 1.0 ELSE 0.55 END, 6) AS confidence FROM c""")
def match_confidence(spark, sf):
    lab = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("label") % 2 == 0, 1.0).otherwise(0.55).alias("type_mult"))
    return Q.confidence(_dense(spark, sf, 5).join(lab, "doc_id")).select("query_id", "doc_id", F.round("confidence", 6).alias("confidence"))


@query("rrf_fuse", f"""WITH {BM}, a AS (SELECT query_id, doc_id, rank FROM bmr WHERE rank <= 60), b AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY (doc_id * 7919 + query_id * 31) % 1009, doc_id) AS rank FROM a),
 f AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE rank <= 20) GROUP BY 1, 2) SELECT query_id, doc_id, round(rrf, 8) AS rrf FROM f WHERE rrf >= 0.0150""")
def rrf_fuse(spark, sf):
    from pyspark.sql import Window
    a = Q.bm25(_bench(spark, sf), _docs(spark, sf), 60).select("query_id", "doc_id", "rank")
    w = Window.partitionBy("query_id").orderBy((F.col("doc_id") * 7919 + F.col("query_id") * 31) % 1009, "doc_id")
    b = a.select("query_id", "doc_id", F.row_number().over(w).alias("rank")).where("rank <= 20")
    return Q.rrf_fuse(a, b, min_rrf=Q.MIN_RRF).select("query_id", "doc_id", F.round("rrf", 8).alias("rrf"))


@query("needs_rerank", f"WITH {DENSE}, t AS (SELECT query_id, sim, lead(sim) OVER (PARTITION BY query_id ORDER BY rank) AS s2, rank FROM r WHERE rank <= 3) SELECT query_id, (sim - s2) / sim < 0.25 AS needs_rerank FROM t WHERE rank = 1")
def needs_rerank(spark, sf):
    return Q.needs_rerank(_dense(spark, sf, 3).withColumnRenamed("sim", "score"))


@query("collapse_duplicates", """WITH h AS (SELECT lang AS query_id, source AS framework, 'c' AS control_id, lower(text) AS t, doc_id, n_chars FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, framework, t ORDER BY n_chars DESC, doc_id) AS k, count(*) OVER (PARTITION BY query_id, framework, t) AS n FROM h)
 SELECT query_id, framework, doc_id, n - 1 AS also_in FROM r WHERE k = 1""")
def collapse_duplicates(spark, sf):
    d = V.table(spark, sf, "documents").select(F.col("lang").alias("query_id"), F.col("source").alias("framework"), F.lit("c").alias("control_id"), F.lit("").alias("title"), "text", "doc_id", F.col("n_chars").alias("rrf"))
    return Q.collapse(d).select("query_id", "framework", "doc_id", "also_in")


@query("filter_before_rank", f"WITH {BM}, f AS (SELECT b.query_id, b.doc_id, row_number() OVER (PARTITION BY b.query_id ORDER BY round(bm25, 9) DESC, b.doc_id) AS rank FROM bm b JOIN documents d ON d.doc_id = b.doc_id WHERE d.lang IN ('en', 'de')) SELECT * FROM f WHERE rank <= 3")
def filter_before_rank(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("framework"), F.lit(None).cast("string").alias("platform"))
    keep = Q.filter_before_rank(d, ["en", "de"], "any")
    return Q.bm25(_bench(spark, sf), _docs(spark, sf), 3, keep).select("query_id", "doc_id", "rank")


@query("training_queue", """WITH r AS (SELECT CAST(o_custkey % 40 AS string) AS device_id, o_orderkey AS ord, concat(CASE o_orderkey % 3 WHEN 0 THEN 'adminTimeout' WHEN 1 THEN 'snmpHost' ELSE 'widgetColour' END) AS name, CAST(o_custkey % 7 AS string) AS value FROM orders),
 v AS (SELECT device_id, name, value, count(*) AS n, min(ord) AS at FROM r WHERE name <> 'widgetColour' AND value <> '0' GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY device_id, name ORDER BY at) AS k FROM v)
 SELECT device_id, name, CAST(sum(n) AS bigint) AS occurrences, min(at) AS evidence_at, string_agg(CASE WHEN k <= 5 THEN value END, ',' ORDER BY k) AS samples, CASE WHEN name = 'snmpHost' THEN 'APPROVED' ELSE 'PENDING' END AS status FROM k GROUP BY 1, 2""".replace(" AS at", " AS fat").replace("min(at)", "min(fat)").replace("ORDER BY at", "ORDER BY fat"))
def training_queue(spark, sf):
    o = V.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    name = F.when(k % 3 == 0, "adminTimeout").when(k % 3 == 1, "snmpHost").otherwise("widgetColour")
    r = o.select((F.col("o_custkey") % 40).cast("string").alias("device_id"), F.lit("p").alias("platform"), k.alias("ordinal"), F.concat(name, F.lit("_"), (k % 50).cast("string")).alias("path"), (F.col("o_custkey") % 7).cast("string").alias("value"), F.lit("raw").alias("raw"))
    dec = spark.createDataFrame([("p", "snmpHost", "approved"), ("p", "gone", "rejected")], "platform string, name string, decision string")
    return Q.training_queue(r, dec).select("device_id", "name", "occurrences", "evidence_at", F.array_join("samples", ",").alias("samples"), "status")


@query("json_table_records", """SELECT event_id, 'T_A' AS name, event_type AS value, 'keys' AS kind FROM events UNION ALL SELECT event_id, 'T_A.*.k', CAST(json_extract(props, '$.k') AS string), 'value' FROM events UNION ALL SELECT event_id, 'flat.u', CAST(user_id AS string), 'value' FROM events UNION ALL SELECT event_id, 'plain', 'x', 'value' FROM events""")
def json_table_records(spark, sf):
    e = V.table(spark, sf, "events")
    doc = F.concat(F.lit('{"_note": "c", "T_A": {"'), "event_type", F.lit('": '), "props", F.lit('}, "flat": {"u": '), F.col("user_id").cast("string"), F.lit('}, "plain": "x"}'))
    return Q.json_table_records(e.select(F.col("event_id").alias("device_id"), doc.alias("content"))).select(F.col("device_id").alias("event_id"), "name", "value", "kind")


@query("golden_verification", """WITH e AS (SELECT o_custkey AS c, o_orderpriority AS k, max(o_orderstatus) AS s FROM orders GROUP BY 1, 2), a AS (SELECT o_custkey AS c, o_orderpriority AS k, min(o_orderstatus) AS s FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1, 2)
 SELECT CASE WHEN e.c % 9 = 0 THEN 'no_config' WHEN a.s IS NULL THEN 'missing' WHEN a.s <> e.s THEN 'mismatch' ELSE 'ok' END AS result, count(*) AS n FROM e LEFT JOIN a ON a.c = e.c AND a.k = e.k GROUP BY 1""")
def golden_verification(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("case"), F.col("o_orderpriority").alias("control_id"), F.col("o_orderstatus").alias("s"), "o_orderkey")
    e = o.groupBy("case", "control_id").agg(F.max("s").alias("state"))
    a = o.where("o_orderkey % 3 != 0").groupBy("case", "control_id").agg(F.min("s").alias("state"))
    return Q.verify_golden(e, a, o.where("case % 9 != 0").select("case").distinct()).groupBy("result").agg(F.count(F.lit(1)).alias("n"))


GATE = "CASE o_orderstatus WHEN 'O' THEN 'PASS' WHEN 'F' THEN 'FAIL' ELSE 'UNKNOWN' END"


@query("regression_gate", f"""WITH t AS (SELECT {GATE} AS e, CASE WHEN o_orderkey % 5 = 0 THEN 'PARTIAL' ELSE {GATE} END AS b, CASE WHEN o_orderkey % 7 = 0 THEN 'PASS' ELSE {GATE} END AS a FROM orders)
 SELECT count(*) FILTER (b = e AND a <> e) AS broken, count(*) FILTER (b = e AND e = 'FAIL' AND a = 'PASS') AS flipped, round(100.0 * count(*) FILTER (b = 'PASS') / count(*) FILTER (b IN ('PASS','FAIL','PARTIAL')), 6) AS pass_rate_before,
  round(100.0 * count(*) FILTER (a = 'PASS') / count(*) FILTER (a IN ('PASS','FAIL','PARTIAL')), 6) AS pass_rate_after, false AS allowed, true AS direction_alert FROM t""")
def regression_gate(spark, sf):
    st = F.when(F.col("o_orderstatus") == "O", "PASS").when(F.col("o_orderstatus") == "F", "FAIL").otherwise("UNKNOWN")
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("case"), F.lit("C").alias("control_id"), st.alias("state"))
    b = o.withColumn("state", F.when(F.col("case") % 5 == 0, "PARTIAL").otherwise(F.col("state")))
    a = o.withColumn("state", F.when(F.col("case") % 7 == 0, "PASS").otherwise(F.col("state")))
    return Q.regression_gate(o, b, a).select("broken", "flipped", F.round("pass_rate_before", 6).alias("pass_rate_before"), F.round("pass_rate_after", 6).alias("pass_rate_after"), "allowed", "direction_alert")


@query("mapping_snapshot_diff", """WITH o AS (SELECT c_custkey AS s, 'f1' AS f, c_mktsegment AS v FROM customer WHERE c_custkey % 10 <> 0), n AS (SELECT c_custkey AS s, 'f1' AS f, CASE WHEN c_custkey % 3 = 0 THEN 'X' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 11 <> 0)
 SELECT coalesce(o.s, n.s) AS sample, CASE WHEN o.s IS NULL OR n.s IS NULL THEN '' ELSE 'f1' END AS field, CASE WHEN o.s IS NULL THEN 'new_sample' WHEN n.s IS NULL THEN 'removed_sample' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.s = n.s WHERE o.s IS NULL OR n.s IS NULL OR o.v <> n.v""")
def mapping_snapshot_diff(spark, sf):
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("sample"), F.lit("f1").alias("field"), F.col("c_mktsegment").alias("value"))
    return Q.diff_mapping_snapshots(c.where("sample % 10 != 0"), c.where("sample % 11 != 0").withColumn("value", F.when(F.col("sample") % 3 == 0, "X").otherwise(F.col("value"))))


@query("topk_accuracy", f"""WITH {DENSE}, rk AS (SELECT query_id, doc_id % 3 AS field, rank FROM r WHERE rank <= 25), g AS (SELECT vec_id AS query_id, vec_id % 3 AS field, CAST(label AS string) AS fold FROM embeddings WHERE vec_id % 50 = 0),
 h AS (SELECT g.query_id, g.fold, min(rk.rank) AS r FROM g LEFT JOIN rk ON rk.query_id = g.query_id AND rk.field = g.field GROUP BY 1, 2) SELECT CASE WHEN GROUPING(fold) = 1 THEN 'ALL' ELSE fold END AS fold, count(*) AS n, count(*) FILTER (r = 1) AS top1, count(*) FILTER (r <= 5) AS top5 FROM h GROUP BY GROUPING SETS ((fold), ())""")
def topk_accuracy(spark, sf):
    ranked = _dense(spark, sf, 25).select("query_id", (F.col("doc_id") % 3).alias("field"), "rank")
    gold = V.table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("fold"), (F.col("vec_id") % 3).alias("field"))
    return Q.topk_accuracy(ranked, gold, "fold")


PRED = "pd AS (SELECT n_chars % 101 AS c, quality = 1 AS ok FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def _pred(spark, sf):
    return V.table(spark, sf, "documents").join(V.table(spark, sf, "labels"), "doc_id").select((F.col("n_chars") % 101).alias("confidence"), (F.col("quality") == 1).alias("correct"))


@query("precision_by_band", f"WITH {PRED}, b AS (SELECT CASE WHEN c >= 80 THEN 80 WHEN c >= 60 THEN 60 WHEN c >= 40 THEN 40 WHEN c >= 20 THEN 20 ELSE 0 END AS low, ok FROM pd), g AS (SELECT low, count(*) AS n, count(*) FILTER (ok) AS correct FROM b GROUP BY 1) SELECT low, n, correct, CAST(sum(n) OVER (ORDER BY low DESC) AS bigint) AS seen FROM g")
def precision_by_band(spark, sf):
    return Q.precision_by_band(_pred(spark, sf))


@query("threshold_curve", f"WITH {PRED} SELECT t AS threshold, count(*) FILTER (c >= t) AS n, count(*) FILTER (c >= t AND ok) AS correct, count(*) FILTER (c < t) AS remaining FROM pd, (SELECT unnest([80, 70, 60, 50, 40, 30]) AS t) GROUP BY 1")
def threshold_curve(spark, sf):
    return Q.threshold_curve(_pred(spark, sf))


@query("leave_one_vendor_out", "SELECT h.label AS held_out, count(*) AS train FROM (SELECT DISTINCT label FROM embeddings) h JOIN embeddings e ON e.label <> h.label GROUP BY 1")
def leave_one_vendor_out(spark, sf):
    return Q.leave_one_out(V.table(spark, sf, "embeddings"), "label").groupBy("held_out").agg(F.count(F.lit(1)).alias("train"))


@query("verify_chain", """WITH r AS (SELECT o_custkey % 50 AS log_id, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS rn FROM orders)
 SELECT log_id, min(seq) FILTER (rn = 2) AS first_broken, count(*) AS records, count(*) < 2 AS intact FROM r GROUP BY 1""")
def verify_chain(spark, sf):
    o = V.table(spark, sf, "orders")
    from pyspark.sql import Window
    a = o.select((F.col("o_custkey") % 50).alias("log_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("field"), F.concat(F.lit("line "), F.col("o_orderkey").cast("string")).alias("line"), F.lit("p").alias("platform"), F.lit("v").alias("vendor"),
                 F.col("o_orderstatus").alias("value"), F.lit("me").alias("approved_by"), F.lit("2024").alias("approved_at"))
    # every record is hashed as if it were the first, so each log breaks at its second record
    seed = a.withColumn("prev_hash", F.lit("")).withColumn("record_hash", Q.record_hash())
    # short stretches, so that logs go over many of them
    return Q.verify_chain(seed.withColumn("prev_hash", F.coalesce(F.lag("record_hash").over(Window.partitionBy("log_id").orderBy("seq")), F.lit(""))), stretch=2048)


@query("approval_conflicts", """WITH a AS (SELECT concat('cmd', o_custkey % 60) AS l, concat('f', CASE WHEN o_custkey % 2 = 0 THEN o_orderkey % 3 ELSE o_custkey % 3 END) AS f FROM orders), g AS (SELECT l, f, count(*) AS n FROM a GROUP BY 1, 2), k AS (SELECT l, count(*) AS fields, min(f) AS first_field FROM g GROUP BY 1 HAVING count(*) > 1)
 SELECT g.l AS key, g.f AS field, n, fields, first_field FROM g JOIN k ON k.l = g.l""")
def approval_conflicts(spark, sf):
    o = V.table(spark, sf, "orders")
    field = F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderkey") % 3).otherwise(F.col("o_custkey") % 3)
    return Q.conflicts(o.select(F.concat(F.lit("set Cmd"), (F.col("o_custkey") % 60).cast("string"), F.lit(" 12")).alias("line"), F.concat(F.lit("f"), field.cast("string")).alias("field"))).withColumn("key", F.col("key"))


@query("corpus_from_packs", f"WITH {T.CFG} SELECT count(*) AS n, count(DISTINCT text) AS lines FROM (SELECT DISTINCT trim(text) AS text, 'h' AS f FROM ln WHERE line = 1 UNION ALL SELECT DISTINCT trim(text), 's' FROM ln WHERE line IN (13, 14) UNION ALL SELECT DISTINCT trim(text), 'e' FROM ln WHERE line IN (13, 14))")
def corpus_from_packs(spark, sf):
    m = spark.createDataFrame([(0, "device.hostname", r"^hostname (\S+)"), (1, "logging.servers", r"^logging host (\S+)"), (2, "logging.enabled", r"^logging host")], "ordinal int, field string, regex string")
    c = Q.corpus_from_packs(T.config_lines(spark, sf), m)
    return c.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("line").alias("lines"))


@query("disambiguate_examples", f"WITH {T.CFG} SELECT DISTINCT trim(text) AS line, CASE WHEN line = 1 THEN 'device.hostname' ELSE 'logging.host_servers' END AS field FROM ln WHERE line IN (1, 13, 14)")
def disambiguate_examples(spark, sf):
    m = spark.createDataFrame([(0, "device.hostname", r"^hostname (\S+)"), (1, "logging.enabled_flag", r"^logging host"), (2, "logging.host_servers", r"^logging host (\S+)")], "ordinal int, field string, regex string")
    return Q.disambiguate(Q.corpus_from_packs(T.config_lines(spark, sf), m)).select("line", "field")


@query("build_probes", """WITH s AS (SELECT concat('management.ssh_f', p_size) AS field, p_partkey AS o, p_name AS raw FROM part) SELECT field, 'management' AS domain, count(*) AS n_syntax, concat_ws(' ', replace(replace(field, '.', ' '), '_', ' '), 'ssh secure shell remote administrative access', string_agg(raw, ' ' ORDER BY o)) AS query_text FROM s GROUP BY 1""")
def build_probes(spark, sf):
    p = V.table(spark, sf, "part").select(F.concat(F.lit("management.ssh_f"), F.col("p_size").cast("string"), F.lit("[x]")).alias("field"), F.col("p_name").alias("raw"), F.col("p_partkey").alias("ordinal"))
    return Q.build_probes(p)


@query("route_lines", """SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 11 = 0 THEN 4 WHEN o_custkey % 5 = 0 THEN 1 WHEN o_orderkey % 100 >= 60 THEN 2 WHEN o_orderkey % 100 >= 20 THEN 3 ELSE 4 END AS tier FROM orders""")
def route_lines(spark, sf):
    o = V.table(spark, sf, "orders")
    l = o.select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("ip Knob"), F.substring(F.lit("abcde"), (F.col("o_custkey") % 5 + 1).cast("int"), F.lit(1))).alias("text"), (F.col("o_orderkey") % 11 == 0).alias("quarantined"))
    h = o.select(F.col("o_orderkey").alias("query_id"), F.lit(1).alias("rank"), (F.col("o_orderkey") % 100 / 100).alias("score"), F.lit("f").alias("field"))
    r = spark.createDataFrame([("p", "set knoba", "known.field")], "platform string, text string, field string")
    return Q.route(l, r, h).select("query_id", "tier")


@query("validate_proposals", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'abstained' WHEN o_orderkey % 5 = 0 THEN 'field not whitelisted' WHEN o_orderkey % 3 = 0 THEN 'evidence not anchored' WHEN o_orderkey % 2 = 0 THEN 'value not coercible' END AS rejected_reason FROM orders""")
def validate_proposals(spark, sf):
    k = F.col("o_orderkey")
    p = V.table(spark, sf, "orders").select("o_orderkey", F.when(k % 7 != 0, F.when(k % 5 == 0, "no.such").otherwise("management.ssh.version")).alias("field"), F.lit("ip ssh version 2").alias("line"),
                                            F.when(k % 3 == 0, "version 9").otherwise(" ssh version ").alias("evidence"), F.when(k % 2 == 0, "two").otherwise("v2").alias("value"))
    f = spark.createDataFrame([("management.ssh.version", "int")], "field string, type string")
    return Q.validate_proposals(p, f).select("o_orderkey", "rejected_reason")


@query("exportable", "SELECT doc_id, CASE WHEN source = (SELECT min(source) FROM documents) THEN length(text) END AS n FROM documents")
def exportable(spark, sf):
    d = V.table(spark, sf, "documents")
    first = d.agg(F.min("source").alias("s")).scalar()
    x = d.select("doc_id", "text", F.lit("t").alias("title"), F.when(F.col("source") == first, "public_domain").otherwise("identifier_only").alias("license"))
    return Q.assert_exportable(Q.exportable(x)).select("doc_id", F.length("text").alias("n"))


@query("fleet_summary", """SELECT CAST(c_custkey AS string) AS device_id, CAST(c_nationkey AS double) AS score_pct, max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 100 END) AS cis, max(CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey % 100 END) AS stig FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def fleet_summary(spark, sf):
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("device_id"), F.col("c_nationkey").cast("double").alias("score_pct"))
    o = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("device_id"), F.when(F.col("o_orderkey") % 2 == 0, "cis").otherwise("stig").alias("framework")).agg(F.max(F.col("o_orderkey") % 100).alias("framework_score_pct"))
    return Q.fleet(c.select("device_id"), c, o, ["cis", "stig"])
