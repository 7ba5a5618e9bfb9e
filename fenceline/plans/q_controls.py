"""Control evaluation, scores, risk, remediation, what-if and frameworks over the fleet views."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import controls as C, frameworks as W
from ..session import cut_lineage
from ..types import tval_py
from . import views as V
from .registry import query

# The whole evaluation in SQL: one CASE per control, no use of the library's rules.
WORST = "CASE st WHEN 'FAIL' THEN 0 WHEN 'PARTIAL' THEN 1 WHEN 'UNKNOWN' THEN 2 WHEN 'ERROR' THEN 3 WHEN 'PASS' THEN 4 ELSE 5 END"
FINDINGS = V.duck_cte("px_devices", "px_scoped", "px_plain") + """,
 sc AS (SELECT device_id, field, ordinal, CASE
     WHEN field = '1-URGENT' THEN CASE WHEN n IS NULL THEN 'UNKNOWN' WHEN n >= 100000 THEN 'PASS' WHEN state = 'DEFAULT_ASSUMED' THEN 'UNKNOWN' ELSE 'FAIL' END
     WHEN field = '2-HIGH' THEN CASE WHEN n IS NULL THEN 'UNKNOWN' WHEN n <= 250000 THEN 'PASS' WHEN state = 'DEFAULT_ASSUMED' THEN 'UNKNOWN' ELSE 'FAIL' END
     WHEN field = '3-MEDIUM' THEN CASE WHEN n IS NULL THEN 'FAIL' ELSE 'PASS' END
     WHEN field = '5-LOW' THEN 'PASS' END AS st, scope FROM px_scoped WHERE field <> '4-NOT SPECIFIED'),
 worst AS (SELECT device_id, field, min(""" + WORST + """) AS rk, count(*) AS n FROM sc GROUP BY 1, 2),
 ws AS (SELECT device_id, field, CASE rk WHEN 0 THEN 'FAIL' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'UNKNOWN' WHEN 3 THEN 'ERROR' ELSE 'PASS' END AS st FROM worst),
 base AS (SELECT d.device_id, d.platform, p.c_custkey AS k, p.bal, p.nat, p.seg,
     CASE WHEN p.c_custkey % 9 = 0 THEN NULL ELSE p.c_custkey % 3 <> 0 END AS snmp_on,
     CASE WHEN p.c_custkey % 7 = 0 THEN 'UNPARSED' WHEN p.c_custkey % 5 = 0 THEN 'DEFAULT' ELSE 'OBS' END AS sv_state,
     CASE WHEN p.c_custkey % 4 = 0 THEN '2c' WHEN p.c_custkey % 4 = 1 THEN '1' ELSE '3' END AS sv,
     CASE WHEN p.c_custkey % 13 = 0 THEN 0 ELSE least(p.c_custkey % 4, 3) END AS nlog,
     p.c_custkey % 10 = 0 AS no_ciph, p.nat % 3 = 0 AS weak FROM px_devices d JOIN px_plain p ON d.device_id = p.device_id),
 per AS (
   SELECT b.device_id, b.platform, 'F-01' AS control_id, 'critical' AS severity, coalesce(w.st, 'UNKNOWN') AS state FROM base b LEFT JOIN ws w ON w.device_id = b.device_id AND w.field = '1-URGENT'
   UNION ALL SELECT b.device_id, b.platform, 'F-02', 'high', coalesce(w.st, 'UNKNOWN') FROM base b LEFT JOIN ws w ON w.device_id = b.device_id AND w.field = '2-HIGH'
   UNION ALL SELECT b.device_id, b.platform, 'F-03', 'medium', coalesce(w.st, 'UNKNOWN') FROM base b LEFT JOIN ws w ON w.device_id = b.device_id AND w.field = '3-MEDIUM'
   UNION ALL SELECT b.device_id, b.platform, 'F-04', 'low', CASE WHEN b.platform NOT IN ('BUILDING', 'MACHINERY') THEN 'NOT_APPLICABLE' ELSE coalesce(w.st, 'UNKNOWN') END
             FROM base b LEFT JOIN ws w ON w.device_id = b.device_id AND w.field = '5-LOW'
   UNION ALL SELECT device_id, platform, 'F-05', 'high', CASE WHEN snmp_on = false THEN 'NOT_APPLICABLE' WHEN sv_state = 'UNPARSED' THEN 'UNKNOWN' WHEN sv = '3' THEN 'PASS'
             WHEN sv_state = 'DEFAULT' THEN 'UNKNOWN' ELSE 'FAIL' END FROM base
   UNION ALL SELECT device_id, platform, 'F-06', 'medium', CASE WHEN k % 11 = 0 THEN 'UNKNOWN' WHEN bal % 1000 <= 600 THEN 'PASS' ELSE 'FAIL' END FROM base
   UNION ALL SELECT device_id, platform, 'F-07', 'critical', CASE WHEN k % 2 = 1 THEN 'PASS' WHEN k % 6 = 0 THEN 'UNKNOWN' ELSE 'FAIL' END FROM base
   UNION ALL SELECT device_id, platform, 'F-08', 'high', CASE WHEN nlog >= 2 THEN 'PASS' WHEN nlog = 1 THEN 'PARTIAL' ELSE 'FAIL' END FROM base
   UNION ALL SELECT device_id, platform, 'F-09', 'high', CASE WHEN no_ciph THEN 'UNKNOWN' WHEN weak THEN 'FAIL' ELSE 'PASS' END FROM base
   UNION ALL SELECT device_id, platform, 'F-10', 'medium', CASE WHEN no_ciph THEN 'UNKNOWN' WHEN weak THEN 'PARTIAL' ELSE 'PASS' END FROM base
   UNION ALL SELECT device_id, platform, 'F-11', 'low', CASE WHEN k % 8 = 0 OR k % 3 = 1 THEN 'FAIL' ELSE 'PASS' END FROM base
   UNION ALL SELECT device_id, platform, 'F-12', 'low', CASE WHEN k % 8 = 0 OR k % 3 = 1 THEN 'FAIL' WHEN seg IN ('MACHINERY', 'BUILDING') THEN 'PASS' ELSE 'FAIL' END FROM base
   UNION ALL SELECT device_id, platform, 'F-13', 'low', CASE WHEN nlog <= 2 THEN 'PASS' ELSE 'FAIL' END FROM base
   UNION ALL SELECT device_id, platform, 'F-14', 'medium', CASE WHEN sv_state = 'UNPARSED' THEN 'UNKNOWN' WHEN sv = '3' THEN 'PASS' WHEN sv_state = 'DEFAULT' THEN 'UNKNOWN' ELSE 'FAIL' END FROM base
   UNION ALL SELECT device_id, platform, 'F-15', 'medium', CASE WHEN platform = 'AUTOMOBILE' THEN 'NOT_APPLICABLE' ELSE 'UNKNOWN' END FROM base
   UNION ALL SELECT device_id, platform, 'F-16', 'low', CASE WHEN platform IN ('FURNITURE', 'MACHINERY') THEN 'NOT_APPLICABLE' ELSE 'UNKNOWN' END FROM base
   UNION ALL SELECT device_id, platform, 'F-17', 'low', CASE WHEN k % 8 = 0 THEN 'ERROR' ELSE 'ERROR' END FROM base)"""
LABELS = """labels_t AS (SELECT * FROM (VALUES """ + ", ".join(
    f"('{c['id']}', '{fw}', '{i}')" for c in V.CONTROLS for fw, ids in (c.get("frameworks") or {}).items() for i in ids) + """) t(control_id, framework, rid))"""
PROFILES = [("stig", "F-06", "BUILDING", 300), ("stig", "F-06", "MACHINERY", 900), ("cis", "F-07", "FURNITURE", True)]
WT = "CASE severity WHEN 'critical' THEN 10.0 WHEN 'high' THEN 6.0 WHEN 'medium' THEN 3.0 ELSE 1.0 END"


def profiles(spark):
    from ..types import TVAL
    from pyspark.sql import types as T
    s = T.StructType([T.StructField("framework", T.StringType()), T.StructField("control_id", T.StringType()), T.StructField("platform", T.StringType()), T.StructField("expected", TVAL)])
    return spark.createDataFrame([(a, b, c, tval_py(d)) for a, b, c, d in PROFILES], s)


@query("evaluate_controls", f"WITH {FINDINGS} SELECT device_id, platform, control_id, severity, state FROM per")
def evaluate_controls(spark, sf):
    return V.findings(spark, sf).select("device_id", "platform", "control_id", "severity", "state")


@query("worst_of_scopes", f"""WITH {FINDINGS}, f AS (SELECT s.device_id, s.field, s.st, s.ordinal, s.scope, w.n, w.rk, row_number() OVER (PARTITION BY s.device_id, s.field ORDER BY s.ordinal) AS k
 FROM sc s JOIN worst w ON w.device_id = s.device_id AND w.field = s.field WHERE ({WORST.replace('st', 's.st', 1)}) = w.rk)
 SELECT device_id, CASE field WHEN '1-URGENT' THEN 'F-01' WHEN '2-HIGH' THEN 'F-02' WHEN '3-MEDIUM' THEN 'F-03' ELSE 'F-04' END AS control_id, max(st) AS state,
  concat('worst of ', max(n), ' scoped instance(s); ', max(st), ' at ', string_agg(scope, ', ' ORDER BY k)) AS reason FROM f WHERE k <= 3 GROUP BY device_id, field""")
def worst_of_scopes(spark, sf):
    return C.scoped_worst(C.latest(V.observations(spark, sf)), V.controls(spark)).select("device_id", "control_id", "state", "reason")


@query("weighted_score", f"""WITH {FINDINGS}, a AS (SELECT device_id, sum(CASE state WHEN 'PASS' THEN {WT} WHEN 'PARTIAL' THEN {WT} * 0.5 ELSE 0 END) AS w_pass,
 sum(CASE state WHEN 'FAIL' THEN {WT} WHEN 'PARTIAL' THEN {WT} * 0.5 ELSE 0 END) AS w_fail FROM per GROUP BY 1)
 SELECT device_id, CAST(w_pass AS double) AS w_pass, CAST(w_fail AS double) AS w_fail FROM a""")
def weighted_score(spark, sf):
    return C.score(V.findings(spark, sf)).select("device_id", "w_pass", "w_fail")


@query("coverage", f"""WITH {FINDINGS} SELECT device_id, count(*) AS controls_total, count(*) FILTER (state = 'NOT_APPLICABLE') AS not_applicable,
 count(*) FILTER (state IN ('PASS','FAIL','PARTIAL')) AS controls_decided, count(*) FILTER (state IN ('UNKNOWN','ERROR')) AS controls_undecided,
 count(*) FILTER (state = 'PASS') AS passed, count(*) FILTER (state <> 'NOT_APPLICABLE') AS controls_applicable FROM per GROUP BY 1""")
def coverage(spark, sf):
    return C.coverage(V.findings(spark, sf)).drop("assessed_pct", "score_pct")


@query("state_counts", f"WITH {FINDINGS} SELECT device_id, " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in C.RESULT_STATES) + " FROM per GROUP BY 1")
def state_counts(spark, sf):
    return C.state_counts(V.findings(spark, sf))


@query("select_controls", "SELECT concat('P', p_partkey) AS control_id, CASE p_size % 3 WHEN 0 THEN 'core' ELSE 'extra' END AS tier FROM part WHERE p_partkey % 4 IN (0, 1) AND p_partkey % 9 <> 0 AND p_size % 3 <> 2")
def select_controls(spark, sf):
    k = F.col("p_partkey")
    fw = F.when(k % 4 == 0, "stig").when(k % 4 == 1, "iso_27001").when(k % 4 == 2, "cis").otherwise("nist_800_53")
    ids = F.when(k % 9 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("p_brand")))
    tier = F.when(F.col("p_size") % 3 == 0, "core").when(F.col("p_size") % 3 == 1, "extra").otherwise("draft")
    c = V.table(spark, sf, "part").select(F.concat(F.lit("P"), k.cast("string")).alias("control_id"), tier.alias("tier"), F.create_map(fw, ids).alias("frameworks"))
    kept, _ = C.select_controls(c, tiers=["core", "extra"], frameworks=["stig", "iso_27001", "pci"])
    return kept.select("control_id", "tier")


@query("na_justified", f"WITH {FINDINGS} SELECT control_id, count(*) AS n FROM per WHERE state = 'NOT_APPLICABLE' GROUP BY 1")
def na_justified(spark, sf):
    f = cut_lineage(V.findings(spark, sf).where("state = 'NOT_APPLICABLE'").select("device_id", "control_id", "state", "reason"))  # evaluated once for both sides
    return f.join(C.na_unjustified(f).select("device_id", "control_id"), ["device_id", "control_id"], "left_anti").groupBy("control_id").agg(F.count(F.lit(1)).alias("n"))


@query("framework_coverage", f"""WITH {FINDINGS}, {LABELS},
 fs AS (SELECT p.device_id, p.control_id, l.framework, l.rid, CASE
   WHEN p.state IN ('PASS','FAIL','PARTIAL') AND l.framework = 'stig' AND p.control_id = 'F-06' AND p.platform = 'BUILDING' THEN CASE WHEN b.bal % 1000 <= 300 THEN 'PASS' ELSE 'FAIL' END
   WHEN p.state IN ('PASS','FAIL','PARTIAL') AND l.framework = 'stig' AND p.control_id = 'F-06' AND p.platform = 'MACHINERY' THEN CASE WHEN b.bal % 1000 <= 900 THEN 'PASS' ELSE 'FAIL' END
   WHEN p.state IN ('PASS','FAIL','PARTIAL') AND l.framework = 'cis' AND p.control_id = 'F-07' AND p.platform = 'FURNITURE' THEN CASE WHEN b.k % 2 = 0 THEN 'PASS' ELSE 'FAIL' END
   ELSE p.state END AS st, p.state AS old FROM per p JOIN base b ON b.device_id = p.device_id JOIN labels_t l ON l.control_id = p.control_id),
 chk AS (SELECT device_id, framework, count(*) AS controls, count(*) FILTER (st IN ('PASS','FAIL','PARTIAL')) AS decided, count(*) FILTER (st = 'PASS') AS passed,
   count(*) FILTER (st <> old) AS profiled_controls FROM (SELECT DISTINCT device_id, control_id, framework, st, old FROM fs) GROUP BY 1, 2),
 req AS (SELECT device_id, framework, rid, CASE WHEN count(*) FILTER (st IN ('FAIL','PARTIAL')) > 0 THEN 'NOT_MET' WHEN count(*) FILTER (st = 'PASS') = count(*) THEN 'MET' ELSE 'UNDECIDED' END AS rs,
   count(*) FILTER (st IN ('PASS','FAIL','PARTIAL')) AS d FROM fs WHERE st <> 'NOT_APPLICABLE' GROUP BY 1, 2, 3),
 r AS (SELECT device_id, framework, count(*) AS requirements, count(*) FILTER (d > 0) AS requirements_decided, count(*) FILTER (rs = 'MET') AS requirements_met,
   count(*) FILTER (rs = 'NOT_MET') AS requirements_not_met, coalesce(string_agg(CASE WHEN rs = 'NOT_MET' THEN rid END, ',' ORDER BY rid), '') AS not_met FROM req GROUP BY 1, 2)
 SELECT c.device_id, c.framework, controls, decided, passed, profiled_controls, coalesce(requirements, 0) AS requirements, coalesce(requirements_decided, 0) AS requirements_decided,
  coalesce(requirements_met, 0) AS requirements_met, coalesce(requirements_not_met, 0) AS requirements_not_met, coalesce(not_met, '') AS not_met
 FROM chk c LEFT JOIN r ON r.device_id = c.device_id AND r.framework = c.framework""")
def framework_coverage(spark, sf):
    c = W.framework_coverage(V.findings(spark, sf), profiles(spark))
    return c.select("device_id", "framework", "controls", "decided", "passed", "profiled_controls", "requirements", "requirements_decided", "requirements_met", "requirements_not_met",
                    F.coalesce(F.array_join("not_met_ids", ","), F.lit("")).alias("not_met"))
