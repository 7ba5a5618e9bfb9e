"""Identification and choice of packs over files composed from customers."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import identify as I, retrieval as R
from . import views as V
from .registry import query

# the same nine kinds of file in both dialects; k is the customer
FORMS_SQL = """fl AS (SELECT CAST(c_custkey AS string) AS device_id, c_custkey AS k, c_custkey % 9 AS m FROM customer)"""
SEEN = """CASE m WHEN 0 THEN 'cisco_iosxe_router' WHEN 1 THEN 'cisco_asa' WHEN 2 THEN 'cisco_iosxe_router' WHEN 4 THEN 'security_groups' WHEN 5 THEN 'juniper_srx_xml' WHEN 6 THEN 'sonicwall_sonicos'
 WHEN 7 THEN 'fortinet_fortios' WHEN 8 THEN CASE WHEN k % 2 = 1 THEN 'acme' ELSE 'UNKNOWN' END ELSE 'UNKNOWN' END"""


def files(spark, sf):
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    t = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else s(p) for p in parts])
    forms = [
        t("version 17.3\nhostname r", k, "\nline vty 0 4\n"), t(": Saved\nASA Version 9.", k % 10, "(2)\nhostname a", k, "\n"), t("service password-encryption\naaa new-model\nhostname w", k), t("aaa new-model\nsomething ", k),
        t('[{"GroupId": "sg-', k, '", "IpPermissions": []}]'), t("<rpc-reply><version>21.", k % 7, "</version><host-name>j", k, "</host-name></rpc-reply>"),
        t("shortProdName=NSA%203700&buildNum=7.", k % 5, "&firewallName=fw", k, "&serialNumber=", F.when(k % 2 == 0, "000000").otherwise(s(k))),
        t("#config-version=FG100-7.", k % 4, ".1\nconfig system global\n    set hostname \"f", k, "\"\nend\n"), t("proprietary thing ", k, "\nacme-os ", k % 2, "\n"),
    ]
    content = F.element_at(F.array(*forms), (k % 9).cast("int") + 1)
    return V.table(spark, sf, "customer").select(s(k).alias("device_id"), content.alias("content"))


def taught(spark):
    return spark.createDataFrame([("acme", "acme", "indented", "^acme-os 1"), ("acme", "acme", "indented", "proprietary"), ("other", "other", "indented", "proprietary"), ("other", "other", "indented", "never there")],
                                 "platform string, vendor string, reader string, signature string")


def identified(spark, sf):
    return I.fingerprint(files(spark, sf), taught(spark))


@query("fingerprint", f"""WITH {FORMS_SQL} SELECT device_id, {SEEN} AS platform, CASE m WHEN 2 THEN 0.5 WHEN 3 THEN 0.25 WHEN 8 THEN CASE WHEN k % 2 = 1 THEN 1.0 ELSE 0.0 END ELSE 1.0 END AS confidence,
 CASE m WHEN 0 THEN '17.3' WHEN 1 THEN concat('9.', k % 10, '(2)') WHEN 5 THEN concat('21.', k % 7) WHEN 6 THEN concat('7.', k % 5) WHEN 7 THEN concat('7.', k % 4, '.1') END AS version,
 CASE m WHEN 0 THEN concat('r', k) WHEN 1 THEN concat('a', k) WHEN 2 THEN concat('w', k) WHEN 5 THEN concat('j', k) WHEN 6 THEN concat('fw', k) WHEN 7 THEN concat('f', k) END AS hostname FROM fl""")
def fingerprint(spark, sf):
    return identified(spark, sf).select("device_id", "platform", "confidence", "version", "hostname")


@query("fingerprint_structured", f"WITH {FORMS_SQL} SELECT device_id, CASE m WHEN 4 THEN 'json' WHEN 5 THEN 'xml' ELSE 'sonicos_exp' END AS reader, CASE WHEN m = 6 AND k % 2 = 1 THEN CAST(k AS string) END AS serial, CASE WHEN m = 6 THEN 'NSA 3700' END AS model FROM fl WHERE m IN (4, 5, 6)")
def fingerprint_structured(spark, sf):
    return identified(spark, sf).where("reader in ('json', 'xml', 'sonicos_exp')").select("device_id", "reader", "serial", "model")


@query("learned_fingerprint", f"WITH {FORMS_SQL} SELECT device_id, 'acme' AS platform FROM fl WHERE m = 8 AND k % 2 = 1")
def learned_fingerprint(spark, sf):
    return identified(spark, sf).where("platform = 'acme'").select("device_id", "platform")


@query("select_pack", f"WITH {FORMS_SQL} SELECT device_id, CASE WHEN m IN (0, 1, 2) THEN 'ios' WHEN m = 6 THEN 'sonic-exp' WHEN m = 7 THEN 'forti-kin' END AS pack FROM fl")
def select_pack(spark, sf):
    packs = spark.createDataFrame([("ios", 1, "cisco_iosxe_router", "cisco", "indented"), ("nx", 2, "cisco_nxos", "cisco", "indented"), ("sonic-cli", 3, "sonicwall_sonicos", "sonicwall", "fortinet_block"),
                                   ("sonic-exp", 4, "sonicwall_sonicos", "sonicwall", "sonicos_exp"), ("forti-kin", 5, "fortinet_switch", "fortinet", "fortinet_block")], "pack string, ordinal int, platform string, vendor string, reader string")
    return I.select_pack(identified(spark, sf), packs).select("device_id", "pack")


@query("detect_grammar", """WITH g AS (SELECT CAST(o_orderkey AS string) AS device_id, o_orderkey % 5 AS m, CAST(3 + o_orderkey % 6 AS double) AS r FROM orders)
 SELECT device_id, 1 AS rank, CASE m WHEN 0 THEN 'indented' WHEN 1 THEN 'braces' WHEN 2 THEN 'fortinet_block' WHEN 3 THEN 'pathstyle' ELSE 'indented' END AS reader,
  round(least(1.0, CASE m WHEN 0 THEN 0.3 + r / (r + 1) WHEN 1 THEN 2 * r / (3 * r) WHEN 2 THEN 2 / (r + 2) * 3 WHEN 3 THEN r / (r + 4) * 2 ELSE 0.15 END), 6) AS confidence FROM g""")
def detect_grammar(spark, sf):
    k = F.col("o_orderkey")
    n = (k % 6 + 3).cast("int")
    times = lambda text: F.repeat(F.lit(text), n)
    forms = [F.concat(F.lit("interface e1\n"), times(" ip address 1.1.1.1\n")), F.concat(times("a b {\n"), times("c d;\n"), times("}\n")), F.concat(F.lit("config sys\n"), times("set a b\n"), F.lit("end\n")),
             F.concat(times("/cfg/sys/ssh on\n"), F.lit("x\ny\n\nz\nw\n")), F.concat(F.lit("hostname h\n"), times("plain words\n"))]
    f = V.table(spark, sf, "orders").select(k.cast("string").alias("device_id"), F.element_at(F.array(*forms), (k % 5).cast("int") + 1).alias("content"))
    return I.detect_grammar(f).select("device_id", "rank", "reader", F.round("confidence", 6).alias("confidence"))


@query("guess_reader", f"WITH {FORMS_SQL} SELECT device_id, CASE m WHEN 4 THEN 'json' WHEN 5 THEN 'xml' ELSE 'indented' END AS reader FROM fl")
def guess_reader(spark, sf):
    return files(spark, sf).select("device_id", I.guess_reader(F.col("content")).alias("reader"))


@query("unscoped_paths", """SELECT o_orderkey, concat('sys', CASE o_orderkey % 3 WHEN 0 THEN '.if' ELSE '' END, '.mode') AS plain, CASE WHEN o_orderkey % 3 = 2 THEN 'sys.mode' WHEN o_orderkey % 3 = 1 THEN concat('a', o_custkey) ELSE concat('x[y[z', o_custkey) END AS label FROM orders""")
def unscoped_paths(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    path = F.when(k % 3 == 0, F.concat(F.lit("sys[x[y[z"), c, F.lit("]]].if[w[v[u[t]]]].mode"))).when(k % 3 == 1, F.concat(F.lit("sys[a"), c, F.lit("].mode"))).otherwise("sys.mode")
    return V.table(spark, sf, "orders").select("o_orderkey", X.unscope(path).alias("plain"), X.scope_label(path).alias("label"))


@query("value_types", """WITH v AS (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS string) WHEN 1 THEN 'Enabled' WHEN 2 THEN concat('10.0.0.', p_size) WHEN 3 THEN concat(p_brand, ',', p_size) WHEN 4 THEN p_name ELSE '' END AS v FROM part)
 SELECT k, CASE k % 6 WHEN 0 THEN CASE WHEN v = '1' THEN 'bool' ELSE 'int' END WHEN 1 THEN 'bool' WHEN 2 THEN 'ip' WHEN 3 THEN 'list' WHEN 4 THEN 'str' ELSE 'unknown' END AS type,
 CASE k % 6 WHEN 0 THEN CASE WHEN v = '1' THEN 0.2 ELSE 1.0 END WHEN 1 THEN 0.2 WHEN 2 THEN 0.15 WHEN 3 THEN 0.2 WHEN 4 THEN 0.35 ELSE 1.0 END AS multiplier FROM v""")
def value_types(spark, sf):
    k = F.col("p_partkey")
    size = F.col("p_size").cast("string")
    v = F.when(k % 6 == 0, size).when(k % 6 == 1, "Enabled").when(k % 6 == 2, F.concat(F.lit("10.0.0."), size)).when(k % 6 == 3, F.concat("p_brand", F.lit(","), size)).when(k % 6 == 4, F.col("p_name")).otherwise("")
    t = V.table(spark, sf, "part").select(k.alias("k"), X.infer_type(v).alias("type"))
    return t.withColumn("multiplier", F.round(X.type_multiplier(F.col("type"), F.lit("int")), 6))


@query("automatability", """SELECT p_partkey AS k, CASE p_partkey % 7 WHEN 0 THEN 'procedural' WHEN 1 THEN 'config' WHEN 2 THEN 'procedural' WHEN 3 THEN 'procedural' WHEN 4 THEN 'config' WHEN 5 THEN 'unknown' ELSE 'unknown' END AS kind FROM part""")
def automatability(spark, sf):
    k = F.col("p_partkey")
    pick = lambda *xs: F.element_at(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs]), (k % 7).cast("int") + 1)
    long = F.concat(F.repeat(F.lit("filler words "), 60), F.lit("review and update it"))
    fw = pick("nist_800_53", "nist_800_53", "nist_800_53", "stig", "stig", "stig", "iso_27001")
    return V.table(spark, sf, "part").select(k.alias("k"), X.automatability(fw, pick("pm-3", "ac-7", "ac-7", "V-1", "V-2", "V-3", "A.1"), F.lit("title"), pick("", "lock out", long, "interview the ISSO", "text", "text", "text"),
                                                                            pick("", "", "", "", "R1(config)# no ip http server", "look", "")).alias("kind"))


@query("semantic_sanity", """SELECT o_orderkey AS k, o_orderkey % 4 IN (0, 3) AS sane FROM orders""")
def semantic_sanity(spark, sf):
    k = F.col("o_orderkey")
    line = F.when(k % 4 == 2, "banner motd hello").otherwise(F.concat(F.lit("ntp server 10.0.0."), (k % 200).cast("string")))
    value = F.when(k % 4 == 0, F.concat(F.lit("10.0.0."), (k % 200).cast("string"))).when(k % 4 == 1, "192.168.1.1")
    return V.table(spark, sf, "orders").select(k.alias("k"), R.semantic_sanity(line, F.lit("ntp.servers"), value).alias("sane"))
