"""Reading, mapping and detecting over configuration lines composed from the tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X, version as VV, net, values as NV
from ..operators import detect as D, mapping as M, topology as N
from ..sources import files as S
from ..types import spread
from . import views as V
from .registry import query

# ------------------------------------------------------------------ lines of a customer's device, in one string per file

CFG = """cfg AS (SELECT c_custkey AS k, CAST(c_custkey AS string) AS device_id FROM customer),
 ln AS (SELECT device_id, k, t.line, CASE t.line WHEN 1 THEN concat('hostname d', k) WHEN 2 THEN '! comment' WHEN 3 THEN concat('snmp-server community ', CASE k % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'private1' ELSE 'corp77' END, ' RO')
   WHEN 4 THEN CASE WHEN k % 2 = 0 THEN 'ip http server' ELSE 'no ip http server' END WHEN 5 THEN 'line vty 0 4' WHEN 6 THEN CASE WHEN k % 5 = 0 THEN ' transport input telnet ssh' ELSE ' transport input ssh' END WHEN 7 THEN concat(' exec-timeout ', k % 30, ' 0')
   WHEN 8 THEN concat('interface Eth', k % 7) WHEN 9 THEN concat(' ip address 10.4.', k % 200, '.1 255.255.255.0') WHEN 10 THEN CASE WHEN k % 4 = 0 THEN ' shutdown' ELSE concat(' description link ', k) END
   WHEN 11 THEN concat('username u', k, ' password ', CASE k % 4 WHEN 0 THEN concat('Secret', k) WHEN 1 THEN '$1$abcdef' WHEN 2 THEN 'abc' ELSE concat('plain', k, ' encrypted') END)
   WHEN 12 THEN concat('crypto transform esp-', CASE k % 3 WHEN 0 THEN 'des' WHEN 1 THEN 'aes' ELSE '3des' END) WHEN 13 THEN concat('logging host 10.5.0.', k % 9) WHEN 14 THEN concat('logging host 10.6.0.', k % 9)
   ELSE concat('access-list 1 permit ', CASE WHEN k % 6 = 0 THEN 'any any' ELSE 'host 10.0.0.1' END) END AS text FROM cfg, (SELECT unnest(range(1, 16)) AS line) t)"""


def config_files(spark, sf):
    """One file per customer, the lines joined by newlines."""
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    L = F.lit
    lines = [F.concat(L("hostname d"), s(k)), L("! comment"), F.concat(L("snmp-server community "), F.when(k % 3 == 0, "public").when(k % 3 == 1, "private1").otherwise("corp77"), L(" RO")),
             F.when(k % 2 == 0, "ip http server").otherwise("no ip http server"), L("line vty 0 4"), F.when(k % 5 == 0, " transport input telnet ssh").otherwise(" transport input ssh"),
             F.concat(L(" exec-timeout "), s(k % 30), L(" 0")), F.concat(L("interface Eth"), s(k % 7)), F.concat(L(" ip address 10.4."), s(k % 200), L(".1 255.255.255.0")),
             F.when(k % 4 == 0, " shutdown").otherwise(F.concat(L(" description link "), s(k))),
             F.concat(L("username u"), s(k), L(" password "), F.when(k % 4 == 0, F.concat(L("Secret"), s(k))).when(k % 4 == 1, "$1$abcdef").when(k % 4 == 2, "abc").otherwise(F.concat(L("plain"), s(k), L(" encrypted")))),
             F.concat(L("crypto transform esp-"), F.when(k % 3 == 0, "des").when(k % 3 == 1, "aes").otherwise("3des")), F.concat(L("logging host 10.5.0."), s(k % 9)), F.concat(L("logging host 10.6.0."), s(k % 9)),
             F.concat(L("access-list 1 permit "), F.when(k % 6 == 0, "any any").otherwise("host 10.0.0.1"))]
    keys = spread(V.table(spark, sf, "customer").select("c_custkey"), "c_custkey")  # a key becomes a file of 15 lines
    return keys.select(s(k).alias("device_id"), F.lit("ios").alias("platform"), F.array_join(F.array(*lines), "\n").alias("content"))


def config_lines(spark, sf):
    return S.read_indented_config(S.explode_lines(config_files(spark, sf)))


@query("significant_lines", f"WITH {CFG} SELECT device_id, count(*) AS lines, max(line) AS last_line, sum(length(text)) AS chars FROM ln WHERE text NOT LIKE '!%' GROUP BY 1")
def significant_lines(spark, sf):
    return S.explode_lines(config_files(spark, sf)).groupBy("device_id").agg(F.count(F.lit(1)).alias("lines"), F.max("line").alias("last_line"), F.sum(F.length("text")).alias("chars"))


@query("indented_parents", f"WITH {CFG} SELECT device_id, line, CASE WHEN line IN (6, 7) THEN 'line vty 0 4' WHEN line IN (9, 10) THEN concat('interface Eth', k % 7) END AS parent FROM ln WHERE text NOT LIKE '!%'")
def indented_parents(spark, sf):
    return config_lines(spark, sf).select("device_id", "line", "parent")


@query("interfaces_from_lines", f"WITH {CFG} SELECT device_id, concat('Eth', k % 7) AS name, concat('10.4.', k % 200, '.1') AS address, k % 4 <> 0 AS enabled, CASE WHEN k % 4 = 0 THEN '' ELSE concat('link ', k) END AS description, 167772160 + 4 * 65536 + (k % 200) * 256 AS net_lo, 24 AS prefixlen FROM cfg")
def interfaces_from_lines(spark, sf):
    return N.interfaces(S.explode_lines(config_files(spark, sf))).select("device_id", "name", "address", "enabled", "description", "net_lo", "prefixlen")


# ------------------------------------------------------------------ detection

DET = CFG + """, hit AS (SELECT device_id, line, 'default_snmp_community' AS detector FROM ln WHERE line = 3 AND k % 3 = 0 UNION ALL SELECT device_id, line, 'cleartext_credential' FROM ln WHERE line = 3
  UNION ALL SELECT device_id, line, 'cleartext_http_mgmt' FROM ln WHERE line = 4 AND k % 2 = 0 UNION ALL SELECT device_id, line, 'telnet_enabled' FROM ln WHERE line = 6 AND k % 5 = 0 UNION ALL SELECT device_id, line, 'cleartext_credential' FROM ln WHERE line = 11 AND k % 4 = 0
  UNION ALL SELECT device_id, line, 'weak_crypto' FROM ln WHERE line = 12 AND k % 3 <> 1 UNION ALL SELECT device_id, line, 'any_any_permit' FROM ln WHERE line = 15 AND k % 6 = 0)"""


@query("detect_lines", f"WITH {DET} SELECT * FROM hit")
def detect_lines(spark, sf):
    return D.detect(S.explode_lines(config_files(spark, sf))).select("device_id", "line", "detector")


@query("one_finding_per_line", f"WITH {DET}, r AS (SELECT *, row_number() OVER (PARTITION BY device_id, line ORDER BY CASE detector WHEN 'default_snmp_community' THEN 0 WHEN 'weak_crypto' THEN 1 WHEN 'cleartext_credential' THEN 2 ELSE 9 END) AS k FROM hit) SELECT device_id, line, detector FROM r WHERE k = 1")
def one_finding_per_line(spark, sf):
    return D.one_finding_per_line(D.detect(S.explode_lines(config_files(spark, sf)))).select("device_id", "line", "detector")


SEV = "CASE detector WHEN 'ftp_enabled' THEN 'medium' WHEN 'weak_crypto' THEN 'high' WHEN 'telnet_enabled' THEN 'high' WHEN 'cleartext_http_mgmt' THEN 'high' ELSE 'critical' END"


@query("summarise_detections", f"WITH {DET} SELECT detector, severity, count(*) AS n FROM (SELECT detector, {SEV} AS severity FROM hit) GROUP BY GROUPING SETS ((detector), (severity), ())")
def summarise_detections(spark, sf):
    return D.summarise(D.detect(S.explode_lines(config_files(spark, sf))))


@query("detector_cap", f"WITH {DET}, g AS (SELECT k % 5 AS g, k, t.detector FROM (SELECT CAST(device_id AS bigint) AS k, detector FROM hit) t), r AS (SELECT *, row_number() OVER (PARTITION BY g, detector ORDER BY k) AS n FROM g) SELECT g, detector, count(*) AS n, max(k) AS last FROM r WHERE n <= 25 OR detector = 'cleartext_credential' GROUP BY 1, 2")
def detector_cap(spark, sf):
    l = S.explode_lines(config_files(spark, sf))
    k = F.col("device_id").cast("bigint")
    merged = l.select((k % 5).alias("device_id"), (k * 100 + F.col("line")).alias("line"), "text")
    return D.detect(merged, cap=D.CAP).groupBy(F.col("device_id").alias("g"), "detector").agg(F.count(F.lit(1)).alias("n"), F.floor(F.max("line") / 100).alias("last"))


@query("prescan_injection", """SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'forged system turn' ELSE 'forged assistant turn' END AS label FROM conversations WHERE role = 'system' OR role = 'assistant' OR regexp_matches(text, '(?i)\\bassistant\\s*:\\s*')""")
def prescan_injection(spark, sf):
    c = V.table(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws(": ", "role", "text").alias("text"))
    hits, _ = D.prescan(c)
    return hits.select("conv_id", "turn", "label")


# ------------------------------------------------------------------ mapping

MAPPINGS = [
    {"platform": "ios", "field": "device.hostname", "regex": r"^hostname (\S+)"},
    {"platform": "ios", "field": "management.http.enabled", "regex": r"^(no )?ip http server", "value": {"invert": True}},
    {"platform": "ios", "field": "management.vty.exec_timeout", "parent": "^line vty", "regex": r"exec-timeout (\d+)", "value": {"scale": 60}},
    {"platform": "ios", "field": "logging.servers", "regex": r"^logging host (\S+)", "collect": True},
    {"platform": "ios", "field": "snmp.communities", "regex": r"^snmp-server community (\S+) RW", "if_absent": []},
    {"platform": "ios", "field": "banner.login", "regex": r"^banner login (.+)"},
    {"platform": "ios", "field": "device.vendor", "const": "acme"},
    {"platform": "ios", "field": "authentication.password_encryption", "regex": r"^username \S+ password \S+ encrypted", "value": {"const": True}},
    {"platform": "ios", "field": "authentication.password_encryption", "regex": r"^username \S+ password Secret", "value": {"const": False}},
    {"platform": "ios", "field": "management.ssh.version", "regex": r"^interface Eth(\S+)"},
    {"platform": "ios", "field": "crypto.rsa_modulus", "regex": r"^crypto transform (\S+)"},
]
TYPES = {"management.vty.exec_timeout": "int", "logging.servers": "list", "snmp.communities": "list", "authentication.password_encryption": "bool", "management.http.enabled": "bool", "management.ssh.version": "int", "crypto.rsa_modulus": "int"}


@query("apply_line_mappings", f"""WITH {CFG} SELECT device_id, 'device.hostname' AS field, 'OBSERVED' AS state, concat('d', k) AS value FROM cfg UNION ALL SELECT device_id, 'management.http.enabled', 'OBSERVED', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END FROM cfg
 UNION ALL SELECT device_id, 'management.vty.exec_timeout', 'OBSERVED', CAST((k % 30) * 60 AS string) FROM cfg UNION ALL SELECT device_id, 'logging.servers', 'OBSERVED', concat('10.5.0.', k % 9, ',10.6.0.', k % 9) FROM cfg
 UNION ALL SELECT device_id, 'snmp.communities', 'DEFAULT_ASSUMED', '' FROM cfg UNION ALL SELECT device_id, 'banner.login', 'NOT_OBSERVED', NULL FROM cfg UNION ALL SELECT device_id, 'device.vendor', 'DEFAULT_ASSUMED', 'acme' FROM cfg
 UNION ALL SELECT device_id, 'authentication.password_encryption', CASE WHEN k % 4 IN (0, 3) THEN 'OBSERVED' ELSE 'NOT_OBSERVED' END, CASE k % 4 WHEN 3 THEN 'true' WHEN 0 THEN 'false' END FROM cfg
 UNION ALL SELECT device_id, 'management.ssh.version', 'OBSERVED', CAST(k % 7 AS string) FROM cfg UNION ALL SELECT device_id, 'crypto.rsa_modulus', 'UNPARSED', NULL FROM cfg""")
def apply_line_mappings(spark, sf):
    l = config_lines(spark, sf)
    o = M.apply_mappings(config_files(spark, sf).select("device_id", "platform"), M.mappings_df(spark, MAPPINGS, TYPES), lines=l)
    v = F.col("value")
    text = F.when(v["kind"] == "num", v["n"].cast("bigint").cast("string")).when(v["kind"] == "bool", v["b"].cast("string")).when(v["kind"] == "list", F.array_join(v["l"], ",")).otherwise(v["s"])
    return o.select("device_id", "field", "state", text.alias("value"))


PATHS = """pr AS (SELECT CAST(o_custkey AS string) AS device_id, o_orderkey AS ordinal, CASE o_orderkey % 4 WHEN 0 THEN concat('sys/if/', o_orderkey % 3, '/access') WHEN 1 THEN 'sys/ssh/ciphers' WHEN 2 THEN 'sys/log/server' ELSE concat('sys/radius/', o_orderkey % 2, '/state') END AS path,
  CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_custkey % 3 = 0 THEN 'ping telnet' ELSE 'ping ssh' END WHEN 1 THEN CASE WHEN o_orderkey % 8 = 1 THEN '[ aes256 arcfour ]' ELSE 'aes128' END WHEN 2 THEN CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '10.0.0.9' END ELSE CASE WHEN o_orderkey % 7 = 0 THEN 'on' ELSE 'off' END END AS value FROM orders)"""


def path_records(spark, sf):
    o = V.table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    path = F.when(k % 4 == 0, F.concat(F.lit("sys/if/"), (k % 3).cast("string"), F.lit("/access"))).when(k % 4 == 1, "sys/ssh/ciphers").when(k % 4 == 2, "sys/log/server").otherwise(F.concat(F.lit("sys/radius/"), (k % 2).cast("string"), F.lit("/state")))
    val = (F.when(k % 4 == 0, F.when(c % 3 == 0, "ping telnet").otherwise("ping ssh")).when(k % 4 == 1, F.when(k % 8 == 1, "[ aes256 arcfour ]").otherwise("aes128"))
           .when(k % 4 == 2, F.when(k % 5 == 0, "").otherwise("10.0.0.9")).otherwise(F.when(k % 7 == 0, "on").otherwise("off")))
    return o.select(c.cast("string").alias("device_id"), F.lit("blk").alias("platform"), k.alias("ordinal"), k.cast("int").alias("line"), path.alias("path"), val.alias("value"), F.concat_ws("=", path, val).alias("raw"))


@query("apply_path_mappings", f"""WITH {PATHS}, d AS (SELECT DISTINCT device_id FROM pr), s AS (SELECT device_id, min_by(value, ordinal) AS v FROM pr WHERE path = 'sys/log/server' GROUP BY 1), c AS (SELECT device_id, string_agg(value, '|' ORDER BY ordinal) AS v FROM pr WHERE path = 'sys/ssh/ciphers' GROUP BY 1)
 SELECT d.device_id, 'logging.server' AS field, NULL AS scope, CASE WHEN s.device_id IS NULL OR v = '' THEN 'NOT_OBSERVED' ELSE 'OBSERVED' END AS state, NULLIF(v, '') AS value FROM d LEFT JOIN s ON s.device_id = d.device_id
 UNION ALL SELECT d.device_id, 'crypto.list', NULL, CASE WHEN c.device_id IS NULL THEN 'NOT_OBSERVED' ELSE 'OBSERVED' END, v FROM d LEFT JOIN c ON c.device_id = d.device_id
 UNION ALL SELECT device_id, 'interfaces.access', CAST(ordinal % 3 AS string), 'OBSERVED', min_by(value, ordinal) FROM pr WHERE path LIKE 'sys/if/%' GROUP BY 1, 3
 UNION ALL SELECT device_id, 'interfaces.access', NULL, 'NOT_OBSERVED', NULL FROM d WHERE device_id NOT IN (SELECT device_id FROM pr WHERE path LIKE 'sys/if/%')""")
def apply_path_mappings(spark, sf):
    r = path_records(spark, sf)
    m = M.mappings_df(spark, [{"platform": "blk", "field": "logging.server", "path": "sys/log/server"}, {"platform": "blk", "field": "crypto.list", "path": "ssh/ciphers", "as_type": "list"},
                              {"platform": "blk", "field": "interfaces.access", "path": "sys/if/*/access"}])
    o = M.apply_mappings(r.select("device_id", "platform").distinct(), m, records=r)
    return o.select("device_id", "field", "scope", "state", F.when(F.col("value.kind") == "list", F.array_join("value.l", "|")).otherwise(F.col("value.s")).alias("value"))


@query("derive_weak_tokens", f"WITH {PATHS} SELECT device_id, count(*) AS n_evidence, count(*) FILTER (value LIKE '%arcfour%') AS weak FROM pr WHERE path = 'sys/ssh/ciphers' GROUP BY 1")
def derive_weak_tokens(spark, sf):
    return M.path_weak_tokens(path_records(spark, sf), [("sys/ssh/ciphers", "aes|3des")]).select("device_id", "n_evidence", F.size("value").cast("bigint").alias("weak"))


@query("derive_token_any", f"WITH {PATHS} SELECT device_id, bool_or(value LIKE '%telnet%') AS value, CASE WHEN bool_or(value LIKE '%telnet%') THEN count(*) FILTER (value LIKE '%telnet%') ELSE count(*) END AS n_evidence FROM pr WHERE path LIKE 'sys/if/%/access' GROUP BY 1")
def derive_token_any(spark, sf):
    return M.path_token_any(path_records(spark, sf), ["sys/if/*/access"], "telnet")


@query("derive_any_true", f"WITH {PATHS} SELECT device_id, bool_or(value = 'on') AS value, count(*) FILTER (value = 'on') AS n_evidence FROM pr WHERE path LIKE 'sys/radius/%' GROUP BY 1")
def derive_any_true(spark, sf):
    return M.path_any_true(path_records(spark, sf), ["sys/radius/*/state"])


@query("derive_non_empty", f"WITH {PATHS} SELECT device_id, max_by(value, ordinal) <> '' AS value FROM pr WHERE path = 'sys/log/server' GROUP BY 1")
def derive_non_empty(spark, sf):
    return M.path_non_empty(path_records(spark, sf), "sys/log/server")


@query("derive_present", f"WITH {PATHS} SELECT device_id, bool_or(path LIKE 'sys/ssh/%') AS value FROM pr GROUP BY 1")
def derive_present(spark, sf):
    r = path_records(spark, sf)
    return M.path_present(r.select("device_id").distinct(), r, "sys/ssh/*").select("device_id", "value")


@query("derive_any_present", f"WITH {PATHS} SELECT device_id, '2c' AS value, min(ordinal) AS first_at FROM pr WHERE path LIKE 'sys/radius/%' GROUP BY 1")
def derive_any_present(spark, sf):
    return M.path_any_present(path_records(spark, sf), "sys/radius/*", "2c")


@query("derive_telnet_reachable", f"WITH {CFG} SELECT device_id, k % 5 = 0 AS value, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS n_evidence FROM cfg")
def derive_telnet_reachable(spark, sf):
    return M.telnet_reachable(config_lines(spark, sf))


PERMS = """pm AS (SELECT CAST(l_orderkey AS string) AS device_id, concat('sg', l_linenumber) AS gid, l_partkey AS k, CASE l_partkey % 5 WHEN 0 THEN '-1' ELSE 'tcp' END AS proto, CAST(l_suppkey % 30 AS int) AS f, CAST(l_suppkey % 30 + l_quantity AS int) AS t, l_partkey % 3 = 0 AS world FROM lineitem)"""


@query("world_exposure", f"WITH {PERMS} SELECT gid AS group_id, CASE WHEN proto = '-1' THEN 'all' ELSE proto END AS protocol, proto = '-1' AS any_any, count(*) AS n, sum(CASE WHEN proto = '-1' THEN 8 ELSE CAST(21 BETWEEN f AND t AS int) + CAST(22 BETWEEN f AND t AS int) + CAST(23 BETWEEN f AND t AS int) END) AS ports FROM pm WHERE world GROUP BY 1, 2, 3")
def world_exposure(spark, sf):
    l = V.table(spark, sf, "lineitem")
    k = F.col("l_partkey")
    p = l.select(F.col("l_orderkey").cast("string").alias("device_id"), F.concat(F.lit("sg"), F.col("l_linenumber").cast("string")).alias("group_id"), F.lit("g").alias("group_name"), k.cast("string").alias("perm"),
                 F.when(k % 5 == 0, "-1").otherwise("tcp").alias("protocol"), (F.col("l_suppkey") % 30).cast("int").alias("from_port"), (F.col("l_suppkey") % 30 + F.col("l_quantity")).cast("int").alias("to_port"),
                 F.when(k % 3 == 0, F.array(F.lit("10.0.0.0/8"), F.lit("0.0.0.0/0"))).otherwise(F.array(F.lit("10.0.0.0/8"))).alias("cidrs"))
    return M.world_exposure(p).groupBy("group_id", "protocol", "any_any").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("admin_ports")).alias("ports"))


@query("account_records", f"WITH {CFG} SELECT device_id, 14 AS total, 9 + CASE WHEN k % 4 IN (0, 3) THEN 1 ELSE 0 END - 2 AS mapped, 14 - (9 + CASE WHEN k % 4 IN (0, 3) THEN 1 ELSE 0 END - 2) AS parsed, 0 AS quarantined, true AS balances FROM cfg")
def account_records(spark, sf):
    l = config_lines(spark, sf)
    return M.account(l, M.line_hits(l, M.mappings_df(spark, MAPPINGS, TYPES)))


@query("unrecognised_records", f"WITH {CFG} SELECT device_id, count(*) AS n FROM ln WHERE line IN (3, 5, 6, 9, 10, 15) OR (line = 11 AND k % 4 IN (1, 2)) GROUP BY 1")
def unrecognised_records(spark, sf):
    l = config_lines(spark, sf)
    return M.unrecognised(l, M.line_hits(l, M.mappings_df(spark, MAPPINGS, TYPES))).groupBy("device_id").agg(F.count(F.lit(1)).alias("n"))


@query("reconcile_fields", """WITH f AS (SELECT DISTINCT concat('f', p_size) AS field, p_size AS z FROM part), w AS (SELECT concat('f', s_suppkey % 30) AS field, count(DISTINCT s_nationkey) AS n FROM supplier GROUP BY 1), r AS (SELECT concat('f', 2 * n_nationkey) AS field, count(DISTINCT n_regionkey) AS n FROM nation GROUP BY 1)
 SELECT f.field, coalesce(w.n, 0) AS writers, coalesce(r.n, 0) AS readers, CASE WHEN w.n > 0 AND r.n > 0 THEN 'ACTIVE' WHEN w.n > 0 THEN 'UNUSED' WHEN r.n > 0 THEN 'ORPHAN' WHEN z % 3 = 0 THEN 'ROADMAP' ELSE 'DEAD' END AS status FROM f LEFT JOIN w ON w.field = f.field LEFT JOIN r ON r.field = f.field""")
def reconcile_fields(spark, sf):
    name = lambda c: F.concat(F.lit("f"), c.cast("string")).alias("field")
    f = V.table(spark, sf, "part").select(name(F.col("p_size")), "p_size").distinct()
    w = V.table(spark, sf, "supplier").select(name(F.col("s_suppkey") % 30), F.col("s_nationkey").alias("writer"))
    r = V.table(spark, sf, "nation").select(name(F.col("n_nationkey") * 2), F.col("n_regionkey").alias("reader"))
    return M.reconcile_fields(f.select("field"), w, r, f.where("p_size % 3 = 0").select("field"))


@query("enrich_identity", """WITH j AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('h', c_custkey % 5) END AS h, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('m', c_custkey % 2) END AS m, concat('h', c_custkey % 7 % 5) AS fh, concat('m', c_custkey % 3 % 2) AS fm FROM customer),
 c AS (SELECT *, coalesce(CAST(h <> fh AS int), 0) + coalesce(CAST(m <> fm AS int), 0) AS conflicts FROM j)
 SELECT CAST(k AS string) AS device_id, CASE WHEN h IS NULL AND conflicts < 2 THEN fh ELSE h END AS hostname, CASE WHEN m IS NULL AND conflicts < 2 THEN fm ELSE m END AS model, CASE WHEN conflicts < 2 THEN concat('S', k) END AS serial, conflicts FROM c""")
def enrich_identity(spark, sf):
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    c = V.table(spark, sf, "customer")
    d = c.select(k.cast("string").alias("device_id"), none.alias("serial"), F.when(k % 4 != 0, F.concat(F.lit("m"), (k % 2).cast("string"))).alias("model"), none.alias("version"), none.alias("os"), F.when(k % 3 != 0, F.concat(F.lit("h"), (k % 5).cast("string"))).alias("hostname"))
    f = c.select(k.cast("string").alias("device_id"), F.concat(F.lit("S"), k.cast("string")).alias("serial"), F.concat(F.lit("m"), (k % 3 % 2).cast("string")).alias("model"), none.alias("version"), none.alias("os"), F.concat(F.lit("h"), (k % 7 % 5).cast("string")).alias("hostname"))
    return M.enrich(d, f).select("device_id", "hostname", "model", "serial", F.col("conflicts").cast("bigint").alias("conflicts"))


# ------------------------------------------------------------------ scalar functions

@query("keyvalue_export", """SELECT CAST(o_custkey AS string) AS device_id, concat('key_', o_orderkey % 5) AS path, max_by(concat(o_orderpriority, ' & ', o_orderkey), o_orderkey) AS value FROM orders GROUP BY 1, 2""")
def keyvalue_export(spark, sf):
    o = V.table(spark, sf, "orders")
    pair = F.concat(F.lit("key_"), (F.col("o_orderkey") % 5).cast("string"), F.lit("="), F.url_encode(F.concat("o_orderpriority", F.lit(" & "), F.col("o_orderkey").cast("string"))))
    files = o.groupBy(F.col("o_custkey").cast("string").alias("device_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", pair.alias("p")))), lambda x: x["p"]), "&").alias("content"))
    return S.last_values(S.read_keyvalue_export(files, redact=False)).select("device_id", "path", "value")


@query("block_config", """SELECT CAST(l_orderkey AS string) AS device_id, concat('firewall policy/', CAST(l_linenumber AS string), '/', k.leaf) AS path, count(*) AS n, max(CASE k.leaf WHEN 'action' THEN l_returnflag ELSE l_linestatus END) AS value
 FROM lineitem, (VALUES ('action'), ('status')) k(leaf) GROUP BY 1, 2""")
def block_config(spark, sf):
    l = V.table(spark, sf, "lineitem")
    body = F.concat(F.lit(" edit "), F.col("l_linenumber").cast("string"), F.lit("\n  set action "), "l_returnflag", F.lit("\n  set status \""), "l_linestatus", F.lit("\"\n next"))
    files = l.groupBy(F.col("l_orderkey").cast("string").alias("device_id")).agg(F.concat(F.lit("config firewall policy\n"), F.array_join(F.collect_list(body), "\n"), F.lit("\nend\n# done\nconfig system global\nend")).alias("content"))
    r = S.read_block_config(S.explode_lines(files))
    return r.groupBy("device_id", "path").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("value"))


@query("braces_config", """SELECT CAST(c_custkey AS string) AS device_id, p.path, CASE p.i WHEN 0 THEN CAST(c_nationkey AS string) WHEN 1 THEN concat('10.0.', c_custkey % 200, '.0/24') WHEN 2 THEN c_mktsegment WHEN 3 THEN 'v2' WHEN 4 THEN '' ELSE '5' END AS value FROM customer,
 (VALUES (0, 'system/limit'), (1, 'system/net/a1/address/WEB'), (2, 'system/net/a1/tag'), (3, 'system/services/ssh/protocol-version'), (4, 'system/services/ssh/protocol-version/v2'), (5, 'login/class/ops/idle-timeout')) p(i, path)""")
def braces_config(spark, sf):
    c = V.table(spark, sf, "customer")
    k = F.col("c_custkey")
    content = F.concat(F.lit("system {\n  limit "), F.col("c_nationkey").cast("string"), F.lit("; ## SECRET-DATA\n  net a1 {\n    address WEB 10.0."), (k % 200).cast("string"), F.lit(".0/24;\n    tag \""), "c_mktsegment",
                       F.lit("\";\n  }\n}\nset system services ssh protocol-version v2\nlogin { class ops { idle-timeout 5; } }\n# end"))
    return S.read_braces_config(S.explode_lines(c.select(k.cast("string").alias("device_id"), content.alias("content")))).select("device_id", "path", "value")


@query("json_leaves", """SELECT event_id, 'k' AS path, CAST(json_extract(props, '$.k') AS string) AS value FROM events UNION ALL SELECT event_id, 'tags.[0]', event_type FROM events UNION ALL SELECT event_id, 'none', '{}' FROM events""")
def json_leaves(spark, sf):
    e = V.table(spark, sf, "events")
    doc = F.concat(F.expr("substr(props, 1, length(props) - 1)"), F.lit(', "tags": ["'), "event_type", F.lit('"], "none": {}}'))
    return S.read_json_leaves(e.select(F.col("event_id").alias("device_id"), doc.alias("content"))).select(F.col("device_id").alias("event_id"), "path", "value")


XML_SQL = """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey AS string) AS device_id, CAST(o_custkey AS string) AS c, o_orderpriority AS p, o_orderkey % 7 = 3 AS broken FROM orders)
 SELECT device_id, 0 AS ordinal, '' AS path, NULL AS value, 'not well-formed XML' AS error FROM o WHERE broken
 UNION ALL SELECT device_id, 1, 'cfg/@ver', concat('v', k % 3), NULL FROM o WHERE NOT broken UNION ALL SELECT device_id, 2, 'sys/host', concat('h ', c, ' & co'), NULL FROM o WHERE NOT broken
 UNION ALL SELECT device_id, 3, 'sys/telnet', '<present>', NULL FROM o WHERE NOT broken UNION ALL SELECT device_id, 4, concat('sys/user[u%2F', c, ']/level'), p, NULL FROM o WHERE NOT broken
 UNION ALL SELECT device_id, 5, concat('sys/rule[r', k % 5, ']/name'), concat('r', k % 5), NULL FROM o WHERE NOT broken UNION ALL SELECT device_id, 6, concat('sys/rule[r', k % 5, ']/note'), concat('<', c, '>'), NULL FROM o WHERE NOT broken
 UNION ALL SELECT device_id, 7, 'policy[a>b]/from-zone-name', 'a', NULL FROM o WHERE NOT broken UNION ALL SELECT device_id, 8, 'policy[a>b]/to-zone-name', 'b', NULL FROM o WHERE NOT broken"""


@query("xml_leaves", XML_SQL)
def xml_leaves(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    doc = F.concat(F.lit('<?xml version="1.0"?>\n<cfg ver="v'), (k % 3).cast("string"), F.lit('">\n <!-- a <b> --> <ns:sys>\n  <host>h '), c, F.lit(" &amp; co</host><telnet/>\n  <user name='u/"), c, F.lit("'><level>"), F.col("o_orderpriority"),
                   F.lit("</level></user><rule><name>r"), (k % 5).cast("string"), F.lit("</name><note><![CDATA[<"), c, F.lit(">]]></note></rule></ns:sys>\n<policy><from-zone-name>a</from-zone-name><to-zone-name>b</to-zone-name></policy>"),
                   F.when(k % 7 == 3, "</sys>").otherwise("</cfg>"))
    o = V.table(spark, sf, "orders").select(k.cast("string").alias("device_id"), doc.alias("content"))
    return S.read_xml_leaves(o).select("device_id", "ordinal", "path", "value", "error")


@query("normalise_values", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN true WHEN o_orderstatus = 'F' THEN false END AS as_bool, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey WHEN o_orderkey % 3 = 1 THEN o_custkey % 9 END AS as_int,
 CASE WHEN o_orderkey % 3 = 2 THEN 2 ELSE 1 END AS n_list FROM orders""")
def normalise_values(spark, sf):
    o = V.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    b = F.when(F.col("o_orderstatus") == "O", " Enable").when(F.col("o_orderstatus") == "F", "DISABLED").otherwise("maybe")
    i = F.when(k % 3 == 0, F.col("o_custkey").cast("string")).when(k % 3 == 1, F.concat(F.lit("version v"), (F.col("o_custkey") % 9).cast("string"))).otherwise("vty 2")
    return o.select("o_orderkey", NV.normalise(b, F.lit("bool"))["b"].alias("as_bool"), NV.normalise(i, F.lit("int"))["n"].cast("bigint").alias("as_int"), F.size(NV.normalise(F.when(k % 3 == 2, i).otherwise("one"), F.lit("list"))["l"]).cast("bigint").alias("n_list"))


@query("classify_settings", """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'empty or default-off' WHEN 1 THEN 'security-relevant' WHEN 2 THEN 'GUI / display state' WHEN 3 THEN 'other device state' WHEN 4 THEN 'security-relevant' WHEN 5 THEN 'other device state' ELSE 'security-relevant' END AS category FROM part""")
def classify_settings(spark, sf):
    k = F.col("p_partkey")
    i = F.concat(F.lit("_"), k.cast("string"))
    name = F.concat(F.when(k % 7 == 0, "adminPassword").when(k % 7 == 1, "prefsParamEncryptMethod").when(k % 7 == 2, "guiWidgetColumn").when(k % 7 == 3, "policyTimeCreated").when(k % 7 == 4, "sslVersion").when(k % 7 == 5, "guestProfileObjSessLife").otherwise("snmpTrapHost"), i)
    return V.table(spark, sf, "part").select("p_partkey", X.classify_setting(name, F.when(k % 7 == 0, "0").otherwise("x1")).alias("category"))


@query("version_order", """SELECT s_suppkey, CASE WHEN a > b THEN 1 WHEN a < b THEN -1 WHEN c > d THEN 1 WHEN c < d THEN -1 WHEN s_suppkey % 4 = 0 THEN 0 WHEN s_suppkey % 5 = 0 THEN NULL WHEN e > f THEN 1 WHEN e < f THEN -1 ELSE 0 END AS sign
 FROM (SELECT s_suppkey, s_suppkey % 3 AS a, s_suppkey % 2 AS b, s_suppkey % 7 % 2 AS c, s_suppkey % 5 % 2 AS d, s_suppkey % 11 AS e, s_suppkey % 13 AS f FROM supplier)""")
def version_order(spark, sf):
    k = F.col("s_suppkey")
    s = lambda c: c.cast("string")
    dev = F.concat(s(k % 3), F.lit("."), s(k % 7 % 2), F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("-"), s(k % 11), F.lit("-R8"))))
    bound = F.concat(s(k % 2), F.lit("."), s(k % 5 % 2), F.lit(".0"), F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("-"), s(k % 13), F.lit("n"))))
    return V.table(spark, sf, "supplier").select("s_suppkey", VV.compare_versions(VV.version_key(dev), VV.version_key(bound)).alias("sign"))


@query("address_containment", """SELECT o_orderkey, o_custkey % 256 BETWEEN (o_orderkey % 256) - (o_orderkey % 256) % 64 AND (o_orderkey % 256) - (o_orderkey % 256) % 64 + 63 AS inside FROM orders""")
def address_containment(spark, sf):
    o = V.table(spark, sf, "orders")
    d = o.select("o_orderkey", F.concat(F.lit("10.0.0."), (F.col("o_orderkey") % 256).cast("string"), F.lit("/26")).alias("v"), F.concat(F.lit("10.0.0."), (F.col("o_custkey") % 256).cast("string")).alias("c"))
    return d.select("o_orderkey", net.addr_in("v", "c").alias("inside"))


@query("pseudonymise", """WITH a AS (SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN concat('10.0.0.', o_custkey % 250) ELSE concat('8.8.', o_custkey % 20, '.', o_custkey % 30) END AS ip FROM orders), f AS (SELECT ip, row_number() OVER (ORDER BY min(o_orderkey)) AS n FROM a WHERE ip LIKE '8.%' GROUP BY 1)
 SELECT o_orderkey, CASE WHEN f.n IS NULL THEN a.ip ELSE concat('public-IP-', f.n) END AS ip FROM a LEFT JOIN f ON f.ip = a.ip""")
def pseudonymise(spark, sf):
    o = V.table(spark, sf, "orders")
    c = F.col("o_custkey")
    ip = F.when(c % 4 == 0, F.concat(F.lit("10.0.0."), (c % 250).cast("string"))).otherwise(F.concat(F.lit("8.8."), (c % 20).cast("string"), F.lit("."), (c % 30).cast("string")))
    return N.pseudonymise(o.select("o_orderkey", ip.alias("ip")), "ip", "o_orderkey")


@query("evidence_anchor", """SELECT d.doc_id, position('the' IN d.text) > 0 AS anchored FROM documents d""")
def evidence_anchor(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", X.anchored(F.lit(" the "), F.col("text")).alias("anchored"))


@query("canonical_nist_ids", "SELECT p_partkey, concat('AC-', p_size, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('.', p_partkey % 9 + 1) END) AS id FROM part")
def canonical_nist_ids(spark, sf):
    k = F.col("p_partkey")
    raw = F.concat(F.lit("AC-0"), F.col("p_size").cast("string"), F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("(0"), (k % 9 + 1).cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("."), (k % 9 + 1).cast("string"))))
    return V.table(spark, sf, "part").select("p_partkey", X.canonical_nist_id(raw).alias("id"))


@query("redact_values", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'on' WHEN 1 THEN '<REDACTED>' WHEN 2 THEN concat('host 10.', o_custkey % 9, '.1.x up') ELSE '<REDACTED>' END AS value FROM orders""")
def redact_values(spark, sf):
    k = F.col("o_orderkey")
    key = F.when(k % 4 == 2, "peer").when(k % 4 == 3, "note").otherwise("sharedSecret")
    val = F.when(k % 4 == 0, "on").when(k % 4 == 1, "hunter2").when(k % 4 == 2, F.concat(F.lit("host 172."), (F.col("o_custkey") % 9).cast("string"), F.lit(".1.44 up"))).otherwise("0123456789abcdef0123")
    return V.table(spark, sf, "orders").select("o_orderkey", X.redact(key, val).alias("value"))
