"""The fleet seen in the star-schema tables: orders as devices, line items as rules, events as log lines.

Each view is one SQL text in a common subset of both dialects; LIST(...) stands for the array constructor.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..types import TVAL_DDL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations"]

VIEWS: dict[str, str] = {
    # rules: a device is an order, a rule a line item; addresses are /24s and ranges of 10.0 and 10.1
    "px_rules": """
        SELECT CAST(l_orderkey AS string) AS device_id, CAST(rn AS int) AS ord,
               concat('r', CAST(rn AS string)) AS id,
               concat(CASE WHEN l_suppkey % 2 = 0 THEN 'v6 ' ELSE 'ip ' END, 'rule ', CAST(rn AS string)) AS name,
               CASE WHEN l_suppkey % 2 = 0 THEN 'v6' ELSE 'v4' END AS family,
               l_linestatus = 'O' AS enabled, CASE WHEN l_returnflag = 'R' THEN 'deny' ELSE 'allow' END AS action,
               CAST(l_partkey % 20 AS bigint) AS s1, CAST(l_partkey % 20 + l_quantity % 4 AS bigint) AS s2, l_discount >= 0.09 AS s_any,
               CAST(l_suppkey % 5 AS bigint) AS d1, l_discount <= 0.01 AS d_any,
               CAST(20 + l_suppkey % 5 AS bigint) AS p1, CAST(20 + l_suppkey % 5 + round(l_discount * 100) AS bigint) AS p2, l_tax = 0 AS v_any,
               concat('z', CAST(l_suppkey % 4 AS string)) AS zs, concat('z', CAST(l_partkey % 3 AS string)) AS zd,
               l_partkey % 17 = 0 AS s_bad, l_partkey % 23 = 0 AS v_bad,
               CASE WHEN l_tax >= 0.06 THEN NULL WHEN l_tax < 0.02 THEN 0 ELSE CAST(l_quantity AS bigint) END AS hit_count,
               CASE WHEN l_partkey % 31 = 0 THEN 'app' END AS program
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn
              FROM {lineitem}) t""",
    "px_queries": """
        SELECT CAST(o_orderkey AS string) AS device_id, CAST(o_custkey % 24 AS bigint) AS a, CAST(o_orderkey % 6 AS bigint) AS b,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(20 + o_orderkey % 15 AS int) END AS port,
               CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('z', CAST(o_custkey % 4 AS string)) END AS source_zone,
               CASE WHEN o_orderkey % 4 <> 0 THEN '' ELSE concat('z', CAST(o_custkey % 3 AS string)) END AS destination_zone,
               o_orderkey % 13 = 0 AS a_any
        FROM {orders}""",
    "px_policies": """
        SELECT CAST(o_orderkey AS string) AS device_id, CASE WHEN o_orderkey % 7 = 0 THEN 'allow' ELSE 'deny' END AS default_action,
               o_orderkey % 5 < 3 AS default_action_observed, o_orderkey % 29 = 0 AS unordered, concat('z', CAST(o_custkey % 5 AS string)) AS uz
        FROM {orders}""",
    # settings: every order is one scoped setting of its customer; each customer also has plain settings
    "px_devices": """
        SELECT CAST(c_custkey AS string) AS device_id, c_mktsegment AS platform, CAST(c_nationkey AS string) AS site FROM {customer}""",
    "px_scoped": """
        SELECT CAST(o_custkey AS string) AS device_id, o_orderpriority AS field, CAST(o_orderkey AS string) AS scope, o_orderkey AS ordinal,
               CASE o_orderstatus WHEN 'O' THEN 'OBSERVED' WHEN 'F' THEN 'NOT_OBSERVED' ELSE 'DEFAULT_ASSUMED' END AS state,
               CASE WHEN o_orderstatus = 'F' THEN NULL ELSE floor(o_totalprice) END AS n
        FROM {orders}""",
    "px_plain": """
        SELECT CAST(c_custkey AS string) AS device_id, c_custkey, CAST(floor(c_acctbal) AS bigint) AS bal, c_mktsegment AS seg, c_nationkey AS nat
        FROM {customer}""",
    # logs: one key=value line per event
    "px_log_lines": """
        SELECT event_id, ts, user_id, event_type,
               CASE WHEN event_id % 10 = 9 THEN concat('heartbeat ', CAST(event_id AS string))
                    WHEN event_id % 10 = 8 THEN concat('fw01 drop src=10.0.0.', CAST(user_id % 250 AS string), ' dport=', CAST(event_id % 1000 AS string))
                    ELSE concat('rule=', CAST(user_id AS string), ' action=', event_type, ' dst="10.1.', CAST(event_id % 9 AS string), '.7" proto=tcp dstport=', CAST(event_id % 1000 AS string)) END AS tail
        FROM {events}""",
    "px_snapshots": """
        SELECT CAST(o_custkey AS string) AS device_key, o_orderkey AS snapshot_id, o_orderdate AS taken_at, o_orderstatus AS st, o_orderpriority AS pr,
               CAST(floor(o_totalprice / 1000) AS bigint) AS sc, CAST(o_orderkey % 4 AS string) AS cfg, CAST(o_orderkey % 3 AS string) AS ana
        FROM {orders}""",
}


def spark_sql_text(name: str) -> str:
    return VIEWS[name].replace("LIST(", "array(")


def duck_cte(*names: str) -> str:
    """`name AS (...)` items for a WITH clause, the tables under their own names."""
    out = []
    for n in names:
        text = VIEWS[n].replace("LIST(", "list_value(")
        for t in TABLES:
            text = text.replace("{" + t + "}", t)
        out.append(f"{n} AS ({text})")
    return ",\n".join(out)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    text = spark_sql_text(name)
    used = {t: table(spark, sf, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


# ------------------------------------------------------------------ library-shaped tables

def _addr(net2: int, third):
    return F.concat(F.lit(f"10.{net2}."), third.cast("string"), F.lit(".0/24"))


def raw_rules(spark, sf) -> DataFrame:
    """px_rules as the rule table of the library: sides hold names and literals."""
    r = view(spark, sf, "px_rules")
    any1 = F.array(F.lit("any"))
    src = F.when(F.col("s_any"), any1).otherwise(F.array(_addr(0, F.col("s1")), F.concat(
        F.lit("10.0."), F.col("s1").cast("string"), F.lit(".0-10.0."), F.col("s2").cast("string"), F.lit(".255"))))
    src = F.when(F.col("s_bad"), F.concat(src, F.array(F.lit("GONE-NET")))).otherwise(src)
    dst = F.when(F.col("d_any"), any1).otherwise(F.array(_addr(1, F.col("d1"))))
    svc = F.when(F.col("v_any"), any1).otherwise(F.array(F.concat(F.lit("tcp/"), F.col("p1").cast("string"), F.lit("-"), F.col("p2").cast("string"))))
    svc = F.when(F.col("v_bad"), F.concat(svc, F.array(F.lit("GONE-SVC")))).otherwise(svc)
    ev = F.array(F.struct(F.concat(F.lit("dev-"), "device_id").alias("file"), F.col("ord").alias("line"), F.concat(F.lit("rule "), "id").alias("raw"), F.lit(None).cast("string").alias("record_id")))
    return r.select("device_id", "id", "name", "ord", "enabled", "action", src.alias("source"), dst.alias("destination"), svc.alias("services"),
                    F.array("zs").alias("source_zones"), F.array("zd").alias("destination_zones"), F.lit(None).cast("boolean").alias("logging"),
                    "hit_count", "program", ev.alias("evidence"))


def resolved_rules(spark, sf) -> DataFrame:
    """The rule table with its sides resolved: literals stand for themselves, the two missing names do not resolve."""
    r = raw_rules(spark, sf)
    gone = ["GONE-NET", "GONE-SVC"]

    def ok(c):
        return F.transform(F.filter(c, lambda x: ~x.isin(gone)), lambda x: F.when(x == "any", "0.0.0.0/0").otherwise(x))

    def bad(c):
        return F.filter(c, lambda x: x.isin(gone))

    for k, c in (("src", "source"), ("dst", "destination"), ("svc", "services")):
        r = r.withColumn(k, ok(F.col(c))).withColumn(f"{k}_bad", bad(F.col(c)))
    return r


def policies(spark, sf) -> DataFrame:
    return view(spark, sf, "px_policies").select("device_id", "default_action", "default_action_observed", "unordered", F.array("uz").alias("untrusted_zones"))


def reach_queries(spark, sf) -> DataFrame:
    q = view(spark, sf, "px_queries")
    return q.select(F.col("device_id").alias("query_id"), "device_id",
                    F.when(F.col("a_any"), "any").otherwise(F.concat(F.lit("10.0."), F.col("a").cast("string"), F.lit(".9"))).alias("source"),
                    F.concat(F.lit("10.1."), F.col("b").cast("string"), F.lit(".9")).alias("destination"), "port", F.lit("tcp").alias("protocol"), "source_zone", "destination_zone")


EV0 = "array<struct<file:string,line:int,raw:string,record_id:string>>"


def observations(spark, sf) -> DataFrame:
    """px_scoped and px_plain as the observation table of the library."""
    from ..types import spread, tv_bool, tv_list, tv_num, tv_str
    s = view(spark, sf, "px_scoped")
    ev = F.array(F.struct(F.lit("export").alias("file"), F.col("ordinal").cast("int").alias("line"), F.concat(F.lit("line "), F.col("ordinal").cast("string")).alias("raw"), F.lit(None).cast("string").alias("record_id")))
    none = F.lit(None).cast(EV0)
    s = s.select("device_id", "field", "scope", F.col("ordinal").cast("bigint").alias("ordinal"), "state", tv_num(F.col("n")).alias("value"), F.lit(1.0).alias("confidence"),
                 F.when(F.col("state") == "OBSERVED", ev).otherwise(none).alias("evidence"))
    p = spread(view(spark, sf, "px_plain"), "device_id")
    k = F.col("c_custkey")

    def row(field, state, value):
        return F.struct(F.lit(field).alias("field"), state.alias("state"), F.when(~state.isin("NOT_OBSERVED", "UNPARSED"), value).alias("value"))

    obs, dflt = F.lit("OBSERVED"), F.lit("DEFAULT_ASSUMED")
    rows = [
        row("snmp.enabled", F.when(k % 9 == 0, "NOT_OBSERVED").otherwise(obs), tv_bool(k % 3 != 0)),
        row("snmp.version", F.when(k % 7 == 0, "UNPARSED").when(k % 5 == 0, dflt).otherwise(obs), tv_str(F.when(k % 4 == 0, "2c").when(k % 4 == 1, "1").otherwise("3"))),
        row("management.timeout", F.when(k % 11 == 0, "NOT_OBSERVED").otherwise(obs), tv_num(F.col("bal") % 1000)),
        row("management.telnet.enabled", F.when(k % 6 == 0, dflt).otherwise(obs), tv_bool(k % 2 == 0)),
        row("logging.servers", F.when(k % 13 == 0, "NOT_OBSERVED").otherwise(obs), tv_list(F.slice(F.array(F.lit("10.9.0.1"), F.lit("10.9.0.2"), F.lit("10.9.0.3")), 1, (k % 4).cast("int")))),
        row("crypto.ciphers", obs, tv_list(F.when(F.col("nat") % 3 == 0, F.array(F.lit("AES256"), F.lit("3des"))).otherwise(F.array(F.lit("aes256"), F.lit("sha2"))))),
        row("banner.login", F.when(k % 8 == 0, "NOT_OBSERVED").otherwise(obs), tv_str(F.when(k % 3 == 1, " ").otherwise(F.concat(F.lit("Authorised use, "), "seg")))),
    ]
    p = p.select("device_id", F.posexplode(F.array(*rows)).alias("i", "o")).where(~((F.col("o.field") == "crypto.ciphers") & (F.col("device_id").cast("bigint") % 10 == 0)))
    evp = F.array(F.struct(F.lit("export").alias("file"), F.col("i").alias("line"), F.col("o.field").alias("raw"), F.lit(None).cast("string").alias("record_id")))
    p = p.select("device_id", "o.field", F.lit(None).cast("string").alias("scope"), F.col("i").cast("bigint").alias("ordinal"), "o.state", F.col("o.value").cast(TVAL_DDL).alias("value"),
                 F.when(F.col("o.state") == "DEFAULT_ASSUMED", 0.9).otherwise(1.0).alias("confidence"), F.when(F.col("o.state") == "OBSERVED", evp).otherwise(none).alias("evidence"))
    return s.unionByName(p)


CONTROLS = [
    {"id": "F-01", "field": "1-URGENT", "operator": "gte", "expected": 100000, "severity": "critical", "frameworks": {"nist_800_53": ["AC-2", "AC-17(2)"], "cis": ["1.1"]},
     "remediation": {"default": {"commands": ["set limit 100000"], "phase": 20}}},
    {"id": "F-02", "field": "2-HIGH", "operator": "lte", "expected": 250000, "severity": "high", "frameworks": {"nist_800_53": ["AC-2", "AU-4"], "stig": ["V-1"]},
     "remediation": {"BUILDING": {"commands": ["cap it"], "phase": 40}}},
    {"id": "F-03", "field": "3-MEDIUM", "operator": "min_count", "expected": 1, "severity": "medium", "frameworks": {"nist_800_53": ["AU-4"], "cis": ["1.1", "1.2"]}},
    {"id": "F-04", "field": "5-LOW", "operator": "not_equals", "expected": 5, "severity": "low", "applies_to": ["BUILDING", "MACHINERY"], "frameworks": {"nist_800_53": ["SC-8"]}},
    {"id": "F-05", "field": "snmp.version", "operator": "not_in", "expected": ["1", "2c"], "severity": "high", "tier": "extended",
     "requires": [{"field": "snmp.enabled", "equals": True, "because": "SNMP is switched off"}], "frameworks": {"nist_800_53": ["SC-8", "IA-2"], "stig": ["V-1", "V-2"]}},
    {"id": "F-06", "field": "management.timeout", "operator": "lte", "expected": 600, "severity": "medium", "frameworks": {"nist_800_53": ["AC-12"], "stig": ["V-3"]},
     "remediation": {"default": {"commands": ["exec-timeout 10"], "verify": "show line"}}},
    {"id": "F-07", "field": "management.telnet.enabled", "operator": "equals", "expected": False, "severity": "critical", "frameworks": {"nist_800_53": ["AC-17"], "cis": ["2.1"]},
     "remediation": {"default": {"commands": ["no telnet"], "management_impact": "disables_telnet"}}},
    {"id": "F-08", "field": "logging.servers", "operator": "min_count", "expected": 2, "severity": "high", "frameworks": {"nist_800_53": ["AU-4"], "iso_27001": ["A.8.15"]}},
    {"id": "F-09", "field": "crypto.ciphers", "operator": "contains_none", "expected": ["3DES", "rc4"], "severity": "high", "frameworks": {"nist_800_53": ["SC-13"], "iso_27001": ["A.8.24"]}},
    {"id": "F-10", "field": "crypto.ciphers", "operator": "contains_all", "expected": ["aes256", "sha2"], "severity": "medium", "frameworks": {"nist_800_53": ["SC-13"], "cis": ["3.1"]}},
    {"id": "F-11", "field": "banner.login", "operator": "is_set", "severity": "low", "frameworks": {"nist_800_53": ["AC-8"]}},
    {"id": "F-12", "field": "banner.login", "operator": "matches", "expected": "authorised.*(machinery|building)", "severity": "low", "tier": "extended", "frameworks": {"nist_800_53": ["AC-8"], "iso_27001": ["A.8.15"]}},
    {"id": "F-13", "field": "logging.servers", "operator": "max_count", "expected": 2, "severity": "low"},
    {"id": "F-14", "field": "snmp.version", "operator": "in", "expected": ["3"], "severity": "medium", "requires": [{"field": "snmp.version", "not_in": ["disabled"]}], "frameworks": {"stig": ["V-2"]}},
    {"id": "F-15", "field": "routing.auth", "operator": "equals", "expected": True, "severity": "medium", "frameworks": {"nist_800_53": ["AC-17"]}},
    {"id": "F-16", "field": "cloud.groups", "operator": "max_count", "expected": 0, "severity": "low", "frameworks": {"cis": ["4.1"]}},
    {"id": "F-17", "field": "banner.login", "operator": "no_such_operator", "expected": 1, "severity": "low"},
]
NA_FIELDS = [("AUTOMOBILE", "routing.auth", "no routing on this platform")]
NA_DOMAINS = [("FURNITURE", "cloud", "not a cloud platform"), ("MACHINERY", "cloud", "not a cloud platform")]


def controls(spark) -> DataFrame:
    from ..operators.controls import controls_df
    return controls_df(spark, CONTROLS)


def devices(spark, sf) -> DataFrame:
    return view(spark, sf, "px_devices")


def findings(spark, sf) -> DataFrame:
    """Every control on every device."""
    from ..operators.controls import evaluate
    return evaluate(devices(spark, sf), controls(spark), observations(spark, sf),
                    spark.createDataFrame(NA_FIELDS, "platform string, field string, reason string"),
                    spark.createDataFrame(NA_DOMAINS, "platform string, domain string, reason string"))
