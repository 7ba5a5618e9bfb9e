"""Policy resolution, exposure, hygiene and reachability over the fleet views."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import controls as C, policy as G, topology as N
from . import views as V
from .registry import query

RULES = V.duck_cte("px_rules", "px_policies") + """,
 rr AS (SELECT *, CASE WHEN s_any THEN ['*'] ELSE list_sort([concat('10.0.', s1, '.0/24'), concat('10.0.', s1, '.0-10.0.', s2, '.255')]) END AS S,
   CASE WHEN d_any THEN ['*'] ELSE [concat('10.1.', d1, '.0/24')] END AS D, CASE WHEN v_any THEN ['*'] ELSE [concat('tcp/', p1, '-', p2)] END AS V,
   NOT s_bad AND NOT v_bad AS readable FROM px_rules)"""

COVER = RULES + """,
 pairs AS (SELECT l.device_id, l.id, l.name, l.action, l.hit_count, l.ord, e.name AS ename, e.id AS eid, e.action AS eaction,
    row_number() OVER (PARTITION BY l.device_id, l.id ORDER BY e.ord, e.id) AS k
  FROM rr l JOIN rr e ON l.device_id = e.device_id AND e.ord < l.ord AND l.family = e.family JOIN px_policies p ON p.device_id = l.device_id
  WHERE l.enabled AND e.enabled AND l.readable AND e.readable AND NOT p.unordered AND l.zs = e.zs AND l.zd = e.zd
   AND (list_contains(e.S, '*') OR list_has_all(e.S, l.S)) AND (list_contains(e.D, '*') OR list_has_all(e.D, l.D)) AND (list_contains(e.V, '*') OR list_has_all(e.V, l.V))),
 cov AS (SELECT device_id, id, name, hit_count, ename, CASE WHEN hit_count > 0 THEN 'disputed_shadow' WHEN eaction = action THEN 'redundant_rule' ELSE 'shadowed_rule' END AS kind FROM pairs WHERE k = 1),
 hyg AS (
  SELECT device_id, 'unused_rule' AS kind, name AS rule, id AS rule_id, 'low' AS severity, '' AS related, hit_count FROM rr WHERE enabled AND hit_count = 0
  UNION ALL SELECT device_id, 'disabled_rule', name, id, 'low', '', hit_count FROM rr WHERE NOT enabled
  UNION ALL SELECT device_id, 'overly_permissive', name, id, CASE WHEN s_any AND d_any AND v_any THEN 'high' ELSE 'medium' END, '', hit_count FROM rr
    WHERE readable AND enabled AND action = 'allow' AND CAST(s_any AS int) + CAST(d_any AS int) + CAST(v_any AS int) >= 2
  UNION ALL SELECT device_id, kind, name, id, CASE WHEN kind = 'shadowed_rule' THEN 'high' ELSE 'low' END, ename, hit_count FROM cov
  UNION ALL SELECT device_id, 'unevaluable', name, id, 'info', CASE WHEN s_bad AND v_bad THEN 'GONE-NET, GONE-SVC' WHEN s_bad THEN 'GONE-NET' ELSE 'GONE-SVC' END, hit_count FROM rr WHERE NOT readable)"""


@query("rule_hygiene", f"WITH {COVER} SELECT * FROM hyg")
def rule_hygiene(spark, sf):
    return G.hygiene(V.resolved_rules(spark, sf), V.policies(spark, sf))


@query("covered_rules", f"WITH {COVER} SELECT device_id, id, kind, ename AS related FROM cov")
def covered_rules(spark, sf):
    return G.covered(V.resolved_rules(spark, sf), V.policies(spark, sf)).select("device_id", "id", "kind", "related")


@query("hygiene_summary", f"""WITH {COVER}, ex AS (SELECT device_id, count(*) AS rules_examined, count(*) FILTER (readable) AS rules_resolved FROM rr GROUP BY 1),
 k AS (SELECT device_id, {", ".join(f"count(*) FILTER (kind = '{x}') AS {x}" for x in ("unused_rule", "disabled_rule", "overly_permissive", "redundant_rule", "shadowed_rule", "disputed_shadow", "unevaluable", "orphaned_objects"))} FROM hyg GROUP BY 1)
 SELECT ex.device_id, rules_examined, rules_resolved, {", ".join(f"coalesce({x}, 0) AS {x}" for x in ("unused_rule", "disabled_rule", "overly_permissive", "redundant_rule", "shadowed_rule", "disputed_shadow", "unevaluable", "orphaned_objects"))}
 FROM ex LEFT JOIN k ON k.device_id = ex.device_id""")
def hygiene_summary(spark, sf):
    r = V.resolved_rules(spark, sf)
    return G.hygiene_summary(r, G.hygiene(r, V.policies(spark, sf)))


# ------------------------------------------------------------------ resolution

def _graph(spark, sf):
    """Customer groups nested in nations, regions and a root, with a cycle, a missing name and an unpublished group."""
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("k"), "c_custkey", "c_nationkey")
    n, r = V.table(spark, sf, "nation"), V.table(spark, sf, "region")
    dev = F.lit("fleet").alias("device_id")
    attrs = F.create_map(F.lit("x"), F.lit("y"))
    none = F.array().cast("array<string>")
    leaf = c.select(dev, F.concat(F.lit("c"), "k").alias("name"), F.lit("address").alias("kind"),
                    F.when(F.col("c_custkey") % 50 == 0, none).otherwise(F.array(F.concat(F.lit("10.2."), (F.col("c_custkey") % 250).cast("string"), F.lit(".1")))).alias("values"), attrs.alias("attrs"))
    gn = n.select(dev, F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"), F.lit("address_group").alias("kind"), none.alias("values"), attrs.alias("attrs"))
    gr = r.select(dev, F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("name"), F.lit("address_group").alias("kind"), none.alias("values"), attrs.alias("attrs"))
    root = r.limit(1).select(dev, F.explode(F.array(F.lit("root"), F.lit("loop1"), F.lit("loop2"), F.lit("cloud"), F.lit("mixed"))).alias("name"), F.lit("address_group").alias("kind"), none.alias("values"))
    root = root.withColumn("attrs", F.when(F.col("name") == "cloud", F.create_map(F.lit("members_unknown"), F.lit("true"))).otherwise(attrs))
    objects = leaf.unionByName(gn).unionByName(gr).unionByName(root)
    m = (c.where("c_custkey % 50 != 0").select(dev, F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"), F.concat(F.lit("c"), "k").alias("child"), F.col("c_custkey").alias("ordinal"))
         .unionByName(n.select(dev, F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"), F.col("n_nationkey").cast("bigint").alias("ordinal")))
         .unionByName(n.where("n_nationkey = 7").select(dev, F.lit("n7").alias("parent"), F.lit("lost").alias("child"), F.lit(-1).cast("bigint").alias("ordinal")))
         .unionByName(r.select(dev, F.lit("root").alias("parent"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("child"), F.col("r_regionkey").cast("bigint").alias("ordinal")))
         .unionByName(spark.createDataFrame([("fleet", "loop1", "loop2", 1), ("fleet", "loop2", "loop1", 1), ("fleet", "mixed", "cloud", 2), ("fleet", "mixed", "any", 1)],
                                            "device_id string, parent string, child string, ordinal bigint")))
    return objects, m


GRAPH = """WITH RECURSIVE obj AS (SELECT concat('c', c_custkey) AS name, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE concat('10.2.', c_custkey % 250, '.1') END AS v FROM customer),
 edge AS (SELECT concat('n', c_nationkey) AS p, concat('c', c_custkey) AS c FROM customer WHERE c_custkey % 50 <> 0 UNION ALL SELECT concat('r', n_regionkey), concat('n', n_nationkey) FROM nation
   UNION ALL SELECT 'n7', 'lost' FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'root', concat('r', r_regionkey) FROM region),
 walk AS (SELECT p AS name, c, 1 AS d FROM edge UNION SELECT w.name, e.c, w.d + 1 FROM walk w JOIN edge e ON e.p = w.c WHERE w.d < 10),
 grp AS (SELECT w.name, bool_or(w.c = 'lost') AS broken, count(DISTINCT o.v) AS n FROM walk w LEFT JOIN obj o ON o.name = w.c GROUP BY 1),
 res AS (SELECT name, CASE WHEN broken THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS state, CASE WHEN broken THEN 0 ELSE n END AS n_values FROM grp
  UNION ALL SELECT name, CASE WHEN v IS NULL THEN 'UNRESOLVED' ELSE 'RESOLVED' END, CASE WHEN v IS NULL THEN 0 ELSE 1 END FROM obj
  UNION ALL SELECT * FROM (VALUES ('lost', 'UNRESOLVED', 0), ('loop1', 'CYCLIC', 0), ('loop2', 'CYCLIC', 0), ('cloud', 'UNSUPPORTED', 0), ('mixed', 'UNSUPPORTED', 0), ('any', 'RESOLVED', 1)) t(name, state, n))"""


@query("resolve_objects", GRAPH + " SELECT name, state, n_values FROM res")
def resolve_objects(spark, sf):
    r = G.resolve_objects(*_graph(spark, sf))
    return r.select("name", "state", F.size("values").alias("n_values"))


@query("unresolved_names", GRAPH + ", f AS (SELECT name, state FROM res WHERE state <> 'RESOLVED') SELECT * FROM f")
def unresolved_names(spark, sf):
    return G.unresolved(G.resolve_objects(*_graph(spark, sf))).select("name", "state")


@query("resolve_rules", f"""WITH {RULES} SELECT device_id, id, CASE WHEN readable THEN 'RESOLVED' ELSE 'UNEVALUABLE' END AS side_state,
 concat_ws(',', CASE WHEN s_bad THEN 'GONE-NET' END, CASE WHEN v_bad THEN 'GONE-SVC' END) AS bad, len(S) AS n_src, CASE WHEN d_any THEN '0.0.0.0/0' ELSE D[1] END AS dst FROM rr""")
def resolve_rules(spark, sf):
    raw = V.raw_rules(spark, sf)
    none = spark.createDataFrame([], "device_id string, name string, kind string, values array<string>, attrs map<string,string>")
    edges = spark.createDataFrame([], "device_id string, parent string, child string, ordinal bigint")
    res = G.resolve_objects(none, edges)
    r = G.side_state(G.resolve_rules(raw, res))
    return r.select("device_id", "id", "side_state", F.array_join("bad_names", ",").alias("bad"), F.size("src").cast("bigint").alias("n_src"), F.array_join("dst", ",").alias("dst"))


@query("graph_summary", """SELECT 'fleet' AS device_id, (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + 5 AS objects,
 (SELECT count(*) FROM customer) AS address, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + 5 AS address_group, 0 AS service, 0 AS service_group, 0 AS zone, 0 AS interface,
 (SELECT count(*) FROM customer WHERE c_custkey % 50 <> 0) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + 5 AS relationships, (SELECT count(*) FROM lineitem) AS rules""")
def graph_summary(spark, sf):
    o, m = _graph(spark, sf)
    return G.graph_summary(o, m, V.raw_rules(spark, sf).withColumn("device_id", F.lit("fleet")))


@query("orphaned_objects", """SELECT concat('c', c_custkey) AS name, 'address' AS kind FROM customer WHERE c_custkey % 50 = 0 UNION ALL SELECT * FROM (VALUES ('root', 'address_group'), ('mixed', 'address_group')) t(name, kind)""")
def orphaned_objects(spark, sf):
    o, m = _graph(spark, sf)
    return G.orphaned_objects(o, m, V.raw_rules(spark, sf)).select("name", "kind")


# ------------------------------------------------------------------ exposure

EXPO = RULES + """,
 ex AS (SELECT r.*, r.zs = p.uz AS outside, coalesce(v_any OR (22 BETWEEN p1 AND p2) OR (23 BETWEEN p1 AND p2), false) AS admin FROM rr r JOIN px_policies p ON p.device_id = r.device_id WHERE enabled AND action = 'allow')"""


@query("admin_exposure", f"""WITH {EXPO} SELECT device_id, id AS rule_id, CASE WHEN s_bad OR v_bad THEN 'skipped' ELSE 'hit' END AS status,
 CASE WHEN s_bad OR v_bad THEN NULL WHEN v_any THEN '22,23,80,161,443,3389,5900' ELSE concat_ws(',', CASE WHEN 22 BETWEEN p1 AND p2 THEN '22' END, CASE WHEN 23 BETWEEN p1 AND p2 THEN '23' END) END AS ports
 FROM ex WHERE s_bad OR v_bad OR (outside AND admin)""")
def admin_exposure(spark, sf):
    e = G.exposure(V.resolved_rules(spark, sf), V.policies(spark, sf), "admin")
    return e.select("device_id", "rule_id", "status", F.array_join(F.col("ports").cast("array<string>"), ",").alias("ports"))


@query("any_any_rules", f"WITH {EXPO} SELECT device_id, id AS rule_id, CASE WHEN s_bad OR v_bad THEN 'skipped' ELSE 'hit' END AS status FROM ex WHERE s_bad OR v_bad OR (s_any AND d_any AND v_any)")
def any_any_rules(spark, sf):
    return G.exposure(V.resolved_rules(spark, sf), V.policies(spark, sf), "any_any").select("device_id", "rule_id", "status")


@query("sensitive_exposure", f"WITH {EXPO} SELECT device_id, id AS rule_id, CASE WHEN s_bad OR v_bad THEN 'skipped' ELSE 'hit' END AS status FROM ex WHERE s_bad OR v_bad OR (outside AND v_any)")
def sensitive_exposure(spark, sf):
    return G.exposure(V.resolved_rules(spark, sf), V.policies(spark, sf), "sensitive").select("device_id", "rule_id", "status")


@query("exposure_state", f"""WITH {EXPO}, a AS (SELECT device_id, count(*) FILTER (NOT (s_bad OR v_bad)) AS hits, count(*) FILTER (s_bad OR v_bad) AS skipped FROM ex WHERE s_bad OR v_bad OR (outside AND admin) GROUP BY 1)
 SELECT p.device_id, coalesce(hits, 0) AS hits, coalesce(skipped, 0) AS skipped, CASE WHEN coalesce(hits, 0) > 0 THEN 'OBSERVED' WHEN coalesce(skipped, 0) > 0 THEN 'UNPARSED' ELSE 'DEFAULT_ASSUMED' END AS state
 FROM px_policies p LEFT JOIN a ON a.device_id = p.device_id""")
def exposure_state(spark, sf):
    r, p = V.resolved_rules(spark, sf), V.policies(spark, sf)
    return G.fact_status(r, G.exposure(r, p, "admin"), p)


@query("policy_observations", f"""WITH {EXPO}, o AS (
 SELECT 'firewall.rules.id' AS field, 'OBSERVED' AS state, count(*) AS n FROM rr GROUP BY ALL UNION ALL SELECT 'firewall.rules.action', 'OBSERVED', count(*) FROM rr GROUP BY ALL
 UNION ALL SELECT 'firewall.rules.position', 'OBSERVED', count(*) FROM rr GROUP BY ALL UNION ALL SELECT 'firewall.rules.direction', 'OBSERVED', count(*) FROM rr GROUP BY ALL
 UNION ALL SELECT 'firewall.rules.source', CASE WHEN s_bad THEN 'UNPARSED' ELSE 'OBSERVED' END, count(*) FROM rr GROUP BY ALL UNION ALL SELECT 'firewall.rules.destination', 'OBSERVED', count(*) FROM rr GROUP BY ALL
 UNION ALL SELECT 'firewall.rules.service', CASE WHEN v_bad THEN 'UNPARSED' ELSE 'OBSERVED' END, count(*) FROM rr GROUP BY ALL
 UNION ALL SELECT 'firewall.default_action', 'DEFAULT_ASSUMED', count(*) FROM px_policies WHERE default_action_observed GROUP BY ALL
 UNION ALL SELECT f, st, count(*) FROM (SELECT p.device_id, 'exposure.admin_ports_open_to_internet' AS f, CASE WHEN count(*) FILTER (NOT (s_bad OR v_bad) AND outside AND admin) > 0 THEN 'OBSERVED' WHEN count(*) FILTER (s_bad OR v_bad) > 0 THEN 'UNPARSED' ELSE 'DEFAULT_ASSUMED' END AS st FROM px_policies p LEFT JOIN ex ON ex.device_id = p.device_id GROUP BY 1
   UNION ALL SELECT p.device_id, 'exposure.any_any_rules', CASE WHEN count(*) FILTER (NOT (s_bad OR v_bad) AND s_any AND d_any AND v_any) > 0 THEN 'OBSERVED' WHEN count(*) FILTER (s_bad OR v_bad) > 0 THEN 'UNPARSED' ELSE 'DEFAULT_ASSUMED' END FROM px_policies p LEFT JOIN ex ON ex.device_id = p.device_id GROUP BY 1
   UNION ALL SELECT p.device_id, 'exposure.unrestricted_ingress', CASE WHEN count(*) FILTER (NOT (s_bad OR v_bad) AND outside AND v_any) > 0 THEN 'OBSERVED' WHEN count(*) FILTER (s_bad OR v_bad) > 0 THEN 'UNPARSED' ELSE 'DEFAULT_ASSUMED' END FROM px_policies p LEFT JOIN ex ON ex.device_id = p.device_id GROUP BY 1) GROUP BY 1, 2)
 SELECT * FROM o""")
def policy_observations(spark, sf):
    o = G.policy_observations(V.resolved_rules(spark, sf), V.policies(spark, sf))
    return o.groupBy("field", "state").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ reachability

REACH = V.duck_cte("px_rules", "px_policies", "px_queries") + """,
 cand AS (SELECT q.device_id, q.port IS NULL AS noport, r.id, r.ord, r.name, r.action,
    CASE WHEN r.s_any OR (NOT q.a_any AND q.a BETWEEN r.s1 AND greatest(r.s1, r.s2)) THEN true WHEN r.s_bad THEN NULL ELSE false END AS sm,
    r.d_any OR q.b = r.d1 AS dm, CASE WHEN r.v_bad THEN NULL ELSE r.v_any OR q.port IS NULL OR q.port BETWEEN r.p1 AND r.p2 END AS vm,
    r.program IS NOT NULL AND q.port IS NOT NULL AS pskip, q.source_zone = '' OR q.destination_zone = '' AS za
  FROM px_queries q JOIN px_rules r ON r.device_id = q.device_id WHERE r.enabled AND (q.source_zone = '' OR q.source_zone = r.zs) AND (q.destination_zone = '' OR q.destination_zone = r.zd)),
 dec AS (SELECT device_id, min(ord) AS ord FROM cand WHERE NOT pskip AND sm AND dm AND vm GROUP BY 1),
 cnt AS (SELECT c.device_id, count(*) FILTER (d.ord IS NULL OR c.ord <= d.ord) AS evaluated, count(*) FILTER ((d.ord IS NULL OR c.ord < d.ord) AND (pskip OR sm IS NULL OR vm IS NULL)) AS unevaluable
   FROM cand c LEFT JOIN dec d ON d.device_id = c.device_id GROUP BY 1),
 ans AS (SELECT q.device_id AS query_id, CASE WHEN r.ord IS NOT NULL THEN r.action = 'allow' WHEN p.default_action_observed THEN p.default_action = 'allow' END AS permitted,
   CASE WHEN r.ord IS NOT NULL THEN r.name WHEN p.default_action_observed THEN 'default policy' ELSE '' END AS decided_by, coalesce(cnt.evaluated, 0) AS evaluated, coalesce(cnt.unevaluable, 0) AS unevaluable,
   coalesce(r.ord IS NOT NULL AND (q.source_zone = '' OR q.destination_zone = ''), false) AS zone_assumed
  FROM px_queries q JOIN px_policies p ON p.device_id = q.device_id LEFT JOIN dec d ON d.device_id = q.device_id LEFT JOIN px_rules r ON r.device_id = d.device_id AND r.ord = d.ord LEFT JOIN cnt ON cnt.device_id = q.device_id)"""


@query("reachability", f"WITH {REACH} SELECT * FROM ans")
def reachability(spark, sf):
    return G.reach(V.reach_queries(spark, sf), V.resolved_rules(spark, sf), V.policies(spark, sf)).select("query_id", "permitted", "decided_by", "evaluated", "unevaluable", "zone_assumed")


STD = V.duck_cte("px_rules", "px_policies") + """,
 ask AS (SELECT p.device_id, port FROM px_policies p, (SELECT unnest([22, 23, 80, 443, 3389, 445, 1433, 3306]) AS port) t),
 dec AS (SELECT q.device_id, q.port, min(r.ord) AS ord FROM ask q JOIN px_rules r ON r.device_id = q.device_id WHERE r.enabled AND r.zs = 'z1' AND r.program IS NULL AND r.s_any AND r.d_any AND NOT r.v_bad AND (r.v_any OR q.port BETWEEN r.p1 AND r.p2) GROUP BY 1, 2)"""


@query("audit_standard_queries", f"""WITH {STD} SELECT a.port, CASE WHEN r.ord IS NOT NULL THEN r.action = 'allow' WHEN p.default_action_observed THEN p.default_action = 'allow' END AS permitted, count(*) AS n
 FROM ask a JOIN px_policies p ON p.device_id = a.device_id LEFT JOIN dec d ON d.device_id = a.device_id AND d.port = a.port LEFT JOIN px_rules r ON r.device_id = a.device_id AND r.ord = d.ord GROUP BY 1, 2""")
def audit_standard_queries(spark, sf):
    p = V.policies(spark, sf)
    return G.reach(G.standard_queries(p, "z1"), V.resolved_rules(spark, sf), p).groupBy("port", "permitted").agg(F.count(F.lit(1)).alias("n"))


@query("zone_flows", V.duck_cte("px_rules", "px_policies").join(["WITH ", """ SELECT r.device_id, zs AS from_zone, zd AS to_zone, count(*) AS rules, count(*) FILTER (s_any AND d_any AND v_any AND NOT s_bad AND NOT v_bad) AS any_any,
  max(zs = uz) AND NOT max(zd = uz) AS escalates FROM px_rules r JOIN px_policies p ON p.device_id = r.device_id WHERE enabled AND action = 'allow' AND zs <> zd GROUP BY 1, 2, 3"""]))
def zone_flows(spark, sf):
    return G.zone_flows(V.raw_rules(spark, sf), V.policies(spark, sf)).drop("latent")


@query("cross_check", f"""WITH {RULES}, a AS (SELECT DISTINCT device_id, name AS rule FROM rr WHERE enabled AND hit_count = 0), b AS (SELECT DISTINCT device_id, name AS rule FROM rr WHERE p2 - p1 >= 5)
 SELECT coalesce(a.device_id, b.device_id) AS device_id, coalesce(a.rule, b.rule) AS rule, CASE WHEN a.rule IS NOT NULL AND b.rule IS NOT NULL THEN 'agreed' WHEN a.rule IS NOT NULL THEN 'only_ours' ELSE 'only_theirs' END AS verdict
 FROM a FULL JOIN b ON a.device_id = b.device_id AND a.rule = b.rule""")
def cross_check(spark, sf):
    r = V.resolved_rules(spark, sf)
    ours = G.unused(r).select("device_id", F.col("name").alias("rule"))
    theirs = V.view(spark, sf, "px_rules").where("p2 - p1 >= 5").select("device_id", F.col("name").alias("rule"))
    return G.cross_check(ours, theirs)


@query("parser_agreement", """WITH a AS (SELECT CAST(o_custkey AS string) AS device_id, concat('x/', o_orderpriority, '/', o_orderkey % 3) AS path FROM orders WHERE o_orderstatus <> 'F'),
 b AS (SELECT CAST(o_custkey AS string) AS device_id, concat('x/', o_orderpriority, '/', o_orderkey % 3) AS path FROM orders WHERE o_orderstatus <> 'O'),
 px AS (SELECT DISTINCT concat('x/', o_orderpriority) AS prefix FROM orders), ha AS (SELECT DISTINCT device_id, prefix FROM a JOIN px ON starts_with(path, prefix)), hb AS (SELECT DISTINCT device_id, prefix FROM b JOIN px ON starts_with(path, prefix))
 SELECT coalesce(ha.device_id, hb.device_id) AS device_id, coalesce(ha.prefix, hb.prefix) AS prefix, CASE WHEN ha.prefix IS NOT NULL AND hb.prefix IS NOT NULL THEN 'both' WHEN ha.prefix IS NOT NULL THEN 'only_ours' ELSE 'only_theirs' END AS found_by
 FROM ha FULL JOIN hb ON ha.device_id = hb.device_id AND ha.prefix = hb.prefix""")
def parser_agreement(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("device_id"), "o_orderstatus", F.concat(F.lit("x/"), "o_orderpriority").alias("prefix"),
                                            F.concat(F.lit("x/"), "o_orderpriority", F.lit("/"), (F.col("o_orderkey") % 3).cast("string")).alias("path"))
    return G.parser_agreement(o.where("o_orderstatus != 'F'"), o.where("o_orderstatus != 'O'"), o.select("prefix"))


@query("twin_rules", f"""WITH {RULES}, g AS (SELECT *, count(*) FILTER (NOT enabled) OVER w AS n_disabled, count(*) FILTER (enabled) OVER w AS n_open FROM rr WINDOW w AS (PARTITION BY device_id, action, zs, zd, S, D, V, s_bad, v_bad))
 SELECT device_id, id AS rule, CASE WHEN enabled THEN 'still_open' ELSE 'disabled' END AS role, n_disabled, n_open FROM g WHERE n_disabled > 0 AND n_open > 0""")
def twin_rules(spark, sf):
    r = V.raw_rules(spark, sf)
    return C.twins(r, r.where("not enabled").select("device_id", F.col("id").alias("rule"))).drop("twin_class")


# ------------------------------------------------------------------ topology

def _ifaces(spark, sf):
    s = V.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    base = k * 64
    i = s.select(F.concat(F.lit("s"), (k % 40).cast("string")).alias("device_id"), k.alias("ordinal"), F.concat(F.lit("eth"), k.cast("string")).alias("name"),
                 F.concat(F.lit("10.3."), F.floor(base / 256 % 256).cast("string"), F.lit("."), (base % 256).cast("string")).alias("address"),
                 F.when(k % 3 == 0, "255.255.255.0").when(k % 3 == 1, "255.255.255.192").otherwise("255.255.252.0").alias("netmask"),
                 F.concat(F.lit("z"), (k % 4).cast("string")).alias("zone"), (k % 10 != 9).alias("enabled"), F.lit("").alias("description"), k.alias("line"))
    return N.with_network(i)


IFACES = """ifc AS (SELECT concat('s', s_suppkey % 40) AS device_id, s_suppkey AS k, concat('eth', s_suppkey) AS name, concat('z', s_suppkey % 4) AS zone, s_suppkey % 10 <> 9 AS enabled,
  CASE s_suppkey % 3 WHEN 0 THEN 24 WHEN 1 THEN 26 ELSE 22 END AS plen, 10 * 16777216 + 3 * 65536 + (s_suppkey * 64) % 65536 AS a FROM supplier),
 itf AS (SELECT *, a - a % CAST(pow(2, 32 - plen) AS bigint) AS lo, a - a % CAST(pow(2, 32 - plen) AS bigint) + CAST(pow(2, 32 - plen) AS bigint) - 1 AS hi FROM ifc)"""


@query("adjacency", f"""WITH {IFACES}, n AS (SELECT device_id, lo, hi, plen, min(name) AS name FROM itf WHERE enabled GROUP BY 1, 2, 3, 4)
 SELECT x.device_id AS a, y.device_id AS b, x.name AS a_interface, y.name AS b_interface, x.lo AS a_lo, x.plen AS a_len, y.lo AS b_lo, y.plen AS b_len FROM n x JOIN n y ON x.device_id < y.device_id AND x.lo <= y.hi AND y.lo <= x.hi""")
def adjacency(spark, sf):
    return N.adjacency(_ifaces(spark, sf))


@query("shared_subnets", f"""WITH {IFACES}, n AS (SELECT DISTINCT device_id, lo, hi, plen FROM itf WHERE enabled), b AS (SELECT DISTINCT lo, hi, plen FROM n)
 SELECT b.lo AS net_lo, b.plen AS prefixlen, count(DISTINCT n.device_id) AS devices FROM b JOIN n ON n.lo >= b.lo AND n.hi <= b.hi GROUP BY 1, 2 HAVING count(DISTINCT n.device_id) > 1""")
def shared_subnets(spark, sf):
    return N.shared_subnets(_ifaces(spark, sf))


ADDR = """ad AS (SELECT DISTINCT concat('10.3.', CAST(floor(o_custkey % 7000 / 256) AS bigint), '.', o_custkey % 256) AS address, 10 * 16777216 + 3 * 65536 + CAST(floor(o_custkey % 7000 / 256) AS bigint) * 256 + o_custkey % 256 AS n FROM orders)"""


def _addresses(spark, sf, col="o_custkey"):
    o = V.table(spark, sf, "orders")
    k = F.col(col)
    return F.concat(F.lit("10.3."), F.floor(k % 7000 / 256).cast("string"), F.lit("."), (k % 256).cast("string")), o


@query("zone_for_address", f"""WITH {IFACES}, {ADDR}, f AS (SELECT ad.address, i.device_id, i.zone, i.plen, row_number() OVER (PARTITION BY ad.address, i.device_id ORDER BY i.plen DESC, i.k) AS rn
 FROM ad JOIN itf i ON i.enabled AND ad.n BETWEEN i.lo AND i.hi) SELECT address, device_id, zone, plen AS prefixlen FROM f WHERE rn = 1""")
def zone_for_address(spark, sf):
    a, o = _addresses(spark, sf)
    return N.zone_for(o.select(a.alias("address")), _ifaces(spark, sf))


BLAST = V.duck_cte("px_rules", "px_policies") + """,
 probe AS (SELECT DISTINCT r.device_id, r.zd FROM px_rules r WHERE r.zd <> 'z0'), pp AS (SELECT p.device_id, p.zd, t.port, t.admin, t.proto FROM probe p, (VALUES (22, true, 'tcp'), (23, true, 'tcp'), (3389, true, 'tcp'), (5985, true, 'tcp'), (445, true, 'tcp'), (135, true, 'tcp'),
  (161, true, 'udp'), (443, false, 'tcp'), (80, false, 'tcp'), (3306, false, 'tcp'), (5432, false, 'tcp'), (1433, false, 'tcp'), (27017, false, 'tcp'), (6379, false, 'tcp'), (9200, false, 'tcp'), (389, false, 'tcp')) t(port, admin, proto)),
 cand AS (SELECT p.*, r.ord, r.action, CASE WHEN r.s_any THEN true WHEN r.s_bad THEN NULL ELSE false END AS sm, r.d_any AS dm, CASE WHEN r.v_bad THEN NULL ELSE r.v_any OR (p.proto = 'tcp' AND p.port BETWEEN r.p1 AND r.p2) END AS vm, r.program IS NOT NULL AS pskip
   FROM pp p JOIN px_rules r ON r.device_id = p.device_id AND r.zd = p.zd WHERE r.enabled AND r.zs = 'z0'),
 dec AS (SELECT device_id, zd, port, min(ord) AS ord FROM cand WHERE NOT pskip AND sm AND dm AND vm GROUP BY 1, 2, 3),
 sk AS (SELECT c.device_id, c.zd, c.port, count(*) FILTER ((d.ord IS NULL OR c.ord < d.ord) AND (pskip OR sm IS NULL OR vm IS NULL)) AS n FROM cand c LEFT JOIN dec d ON d.device_id = c.device_id AND d.zd = c.zd AND d.port = c.port GROUP BY 1, 2, 3),
 ans AS (SELECT p.*, CASE WHEN r.ord IS NOT NULL THEN r.action = 'allow' WHEN o.default_action_observed THEN o.default_action = 'allow' END AS permitted, coalesce(sk.n, 0) AS n
   FROM pp p JOIN px_policies o ON o.device_id = p.device_id LEFT JOIN dec d ON d.device_id = p.device_id AND d.zd = p.zd AND d.port = p.port LEFT JOIN px_rules r ON r.device_id = d.device_id AND r.ord = d.ord LEFT JOIN sk ON sk.device_id = p.device_id AND sk.zd = p.zd AND sk.port = p.port)"""


@query("blast_radius", f"""WITH {BLAST} SELECT device_id, zd AS zone, count(*) FILTER (permitted) AS open, count(*) FILTER (NOT permitted) AS blocked, count(*) FILTER (permitted IS NULL) AS undecidable,
 count(*) FILTER (permitted AND admin) AS administrative, count(*) FILTER (permitted AND n > 0) AS uncertain, count(*) FILTER (permitted IS NULL) = count(*) AS fully_undecidable FROM ans GROUP BY 1, 2""")
def blast_radius(spark, sf):
    p = V.policies(spark, sf)
    origins = p.select("device_id", F.lit("z0").alias("origin_zone"), F.lit("any").alias("origin_address"))
    return N.blast_radius(origins, V.resolved_rules(spark, sf), p).drop("origin_zone", "latent")


def _paths(spark, sf):
    a, o = _addresses(spark, sf)
    b, _ = _addresses(spark, sf, "o_orderkey")
    return o.select(F.col("o_orderkey").alias("path_id"), a.alias("source"), b.alias("destination"), F.lit(22).alias("port"), F.lit("tcp").alias("protocol"))


@query("devices_between", f"""WITH {IFACES}, p AS (SELECT o_orderkey AS path_id, 10 * 16777216 + 3 * 65536 + CAST(floor(o_custkey % 7000 / 256) AS bigint) * 256 + o_custkey % 256 AS s, 10 * 16777216 + 3 * 65536 + CAST(floor(o_orderkey % 7000 / 256) AS bigint) * 256 + o_orderkey % 256 AS d FROM orders),
 fs AS (SELECT DISTINCT path_id, device_id FROM p JOIN itf i ON i.enabled AND p.s BETWEEN i.lo AND i.hi), fd AS (SELECT DISTINCT path_id, device_id FROM p JOIN itf i ON i.enabled AND p.d BETWEEN i.lo AND i.hi)
 SELECT coalesce(fs.path_id, fd.path_id) AS path_id, coalesce(fs.device_id, fd.device_id) AS device_id FROM fs FULL JOIN fd ON fs.path_id = fd.path_id AND fs.device_id = fd.device_id""")
def devices_between(spark, sf):
    return N.devices_between(_paths(spark, sf), _ifaces(spark, sf)).select("path_id", "device_id")
