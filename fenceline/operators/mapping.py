"""Mapping packs: records to observations, derivations, accounting, coverage.

records(device_id, platform, ordinal, line, path, value, raw)
lines(device_id, platform, line, text, parent_line, parent)
documents(device_id, platform, content)
mappings(platform, ordinal, field, path, regex, parent, scope_from, jsonpath, scope, collect, const, as_type, if_absent, value)
  with value struct(group, invert, scale, const, empty_is_true)
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions.text import unscope
from ..session import cut_lineage
from . import literals
from .jsonpath import path_values, text_of, understood
from ..functions.values import normalise
from ..types import TVAL, TVAL_DDL, shuffled, small_side, num_text, tval_py, tv_bool, tv_list, tv_num, tv_str

MAX_MAPPINGS = 200000
MAPPING = T.StructType([
    T.StructField("platform", T.StringType()), T.StructField("ordinal", T.IntegerType()), T.StructField("field", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("glob", T.StringType()), T.StructField("regex", T.StringType()), T.StructField("n_groups", T.IntegerType()), T.StructField("parent", T.StringType()),
    T.StructField("scope_from", T.IntegerType()), T.StructField("collect", T.BooleanType()), T.StructField("const", TVAL), T.StructField("as_type", T.StringType()),
    T.StructField("if_absent", TVAL), T.StructField("grp", T.IntegerType()), T.StructField("invert", T.BooleanType()), T.StructField("scale", T.DoubleType()),
    T.StructField("vconst", TVAL), T.StructField("empty_is_true", T.BooleanType()), T.StructField("jsonpath", T.StringType()), T.StructField("scope_path", T.StringType()),
    T.StructField("from_keys", T.BooleanType())])


def glob_regex(pattern: str) -> str:
    """`a/*/b` matches one segment; a trailing `*` matches the rest of the path."""
    esc = re.escape(pattern)
    if esc.endswith(r"/\*"):
        return "^" + esc[:-3].replace(r"\*", "[^/]+") + "/[^/]+(?:/.*)?$"
    return "^" + esc.replace(r"\*", "[^/]+") + "$"


def _groups(regex: str | None) -> int | None:
    """How many groups a pattern has; NULL for one that cannot be read, which is then reported and not used."""
    try:
        return re.compile(regex).groups if regex else None
    except re.error:
        return None


def mappings_df(spark: SparkSession, rows: list[dict], field_types: dict[str, str] | None = None) -> DataFrame:
    """Authored mapping rows (plain dicts, pack order) as the typed mapping table."""
    out, types = [], field_types or {}
    for i, m in enumerate(rows):
        v, path = m.get("value") or {}, m.get("path")
        wild = path is not None and "*" in path
        segs = (path or "").split("/")
        out.append({"platform": m["platform"], "ordinal": m.get("ordinal", i), "field": m["field"], "path": None if wild else path, "glob": glob_regex(path) if wild else None,
                    "regex": m.get("regex"), "n_groups": _groups(m.get("regex")), "parent": m.get("parent"),
                    "scope_from": m.get("scope_from", segs.index("*") if wild and "*" in segs else 0), "collect": bool(m.get("collect")), "const": tval_py(m.get("const")),
                    "as_type": m.get("as_type") or types.get(re.sub(r"\[[^\]]*\]", "", m["field"]), "str"), "if_absent": tval_py(m.get("if_absent")), "grp": v.get("group", 1), "invert": bool(v.get("invert")),
                    "scale": None if v.get("scale") is None else float(v["scale"]), "vconst": tval_py(v.get("const")), "empty_is_true": bool(v.get("empty_is_true")),
                    "jsonpath": m.get("jsonpath"), "scope_path": m.get("scope"), "from_keys": v.get("from") == "keys"})
    return spark.createDataFrame(out, MAPPING)


def _maps(mappings: DataFrame, cond: str) -> DataFrame:
    return small_side(mappings.where(cond).withColumnRenamed("ordinal", "mord"), MAX_MAPPINGS)


def _scaled(v: Column) -> Column:
    return F.when(F.col("scale").isNotNull() & (v["kind"] == "num"), tv_num(v["n"] * F.col("scale"))).otherwise(v)


def line_value(text: Column) -> Column:
    """M4: the requested group; a group that took no part is NULL, not the whole line."""
    g = F.expr("regexp_extract_all(text, regex, grp)")
    got = F.when(F.col("n_groups") >= F.col("grp"), F.nullif(F.get(g, F.lit(0)), F.lit(""))).otherwise(F.trim(text))
    v = _scaled(normalise(got, F.when(F.col("collect"), "str").otherwise(F.col("as_type"))))
    return F.when(F.col("vconst").isNotNull(), F.col("vconst")).when(F.col("invert"), tv_bool(got.isNull())).otherwise(v)


def path_value(val: Column) -> Column:
    """M4 for path readers: an empty value is not TRUE unless the mapping says presence is."""
    v = normalise(val, F.col("as_type"))
    return (F.when(F.col("vconst").isNotNull(), F.col("vconst")).when(F.col("invert"), tv_bool(F.coalesce(normalise(val, F.lit("bool"))["b"] == F.lit(False), F.lit(False))))
            .when((val == "") & F.col("empty_is_true"), tv_bool(F.lit(True))).otherwise(v))


def _members(v: Column) -> Column:
    """A value as list members, for collecting several hits into one list."""
    return (F.when(v["kind"] == "list", v["l"]).when(v["kind"] == "num", F.array(num_text(v["n"]))).when(v["kind"] == "bool", F.array(F.when(v["b"], "True").otherwise("False")))
            .when(v["kind"] == "str", F.array(v["s"])).otherwise(F.array().cast("array<string>")))


def evidence() -> Column:
    return F.struct(F.lit(None).cast("string").alias("file"), F.col("line").cast("int").alias("line"), F.col("raw").alias("raw"), F.lit(None).cast("string").alias("record_id"))

def listy() -> Column:
    return F.col("collect") | (F.col("as_type") == "list")


def _fold(hits: DataFrame) -> DataFrame:
    """M2: one observation per (device, mapping, scope): first hit in file order, or every hit for a list."""
    key = ["device_id", "mord", "field", "scope"]
    a = hits.groupBy(*key).agg(
        F.min_by(F.struct("v", "empty"), "at").alias("first"), F.min("at").alias("at"), F.first("listy").alias("listy"),
        F.sort_array(F.collect_list(F.when(F.col("listy"), F.struct("at", _members(F.col("v")).alias("m"))))).alias("all"),
        F.min_by("ev", "at").alias("ev"))
    val = F.when(F.col("listy"), tv_list(F.flatten(F.transform("all", lambda x: x["m"])))).otherwise(F.col("first.v"))
    st = F.when(F.col("listy"), "OBSERVED").when(F.col("first.empty"), "NOT_OBSERVED").when(F.col("first.v").isNull(), "UNPARSED").otherwise("OBSERVED")
    return a.select(*key, "at", st.alias("state"), val.alias("value"), F.array("ev").alias("evidence"))


def _called_up(rows: DataFrame, text: Column, mappings: DataFrame, pattern: str) -> DataFrame:
    """rows with the mappings of their platform whose pattern may match the text."""
    m = mappings.where(F.col(pattern).isNotNull()).withColumnRenamed("ordinal", "mord")
    return literals.called_up(rows, text, literals.indexed(m, pattern), ["platform"])


def line_hits(lines: DataFrame, mappings: DataFrame) -> DataFrame:
    """M1 over indented lines: regex anywhere, or regex under a parent matching another. A line meets only the patterns its words call up."""
    l = lines.withColumn("at", F.array(F.col("line").cast("bigint")))
    m = mappings.where("const is null and (parent is null or coalesce(try_reflect('java.util.regex.Pattern', 'compile', parent), '') <> '')")
    met = _called_up(l.withColumnRenamed("parent", "ptext"), F.col("text"), m, "regex")
    hit = met.where(F.expr("rlike(text, regex) and (parent is null or (ptext is not null and rlike(ptext, parent)))")).withColumn("scope", F.when(F.col("parent").isNotNull(), F.trim("ptext")))
    cols = ["device_id", "mord", "field", "scope", "line", "at", F.col("text").alias("raw"), line_value(F.col("text")).alias("v"), listy().alias("listy"), F.lit(False).alias("empty")]
    return hit.select(*cols).withColumn("ev", evidence())


def path_hits(records: DataFrame, mappings: DataFrame) -> DataFrame:
    """M1 over path records: exact paths are an equi-join; only wildcard mappings need the pattern test.

    A path an export wraps in one more level is found by its unambiguous suffix: exactly one stored path may end so.
    """
    r = records.withColumn("at", F.array(F.col("ordinal").cast("bigint")))
    m = _maps(mappings, "path is not null and const is null")
    exact = r.join(m.drop("glob", "parent", "regex"), ["platform", "path"])
    segs = F.split("path", "/")
    tails = r.select("device_id", "platform", "path").distinct().withColumn("n", F.explode(F.sequence(F.lit(2), F.greatest(F.size(segs), F.lit(2))))).where(F.col("n") <= F.size(segs))
    tails = tails.withColumn("tail", F.array_join(F.slice(segs, F.col("n"), F.greatest(F.size(segs) - F.col("n") + 1, F.lit(1))), "/"))
    want = m.select("platform", F.col("path").alias("tail"), "mord", "field")
    cand = (tails.join(want, ["platform", "tail"]).join(exact.select("device_id", "mord").distinct(), ["device_id", "mord"], "left_anti")
            .groupBy("device_id", "mord").agg(F.count_distinct("path").alias("n"), F.min("path").alias("path")).where("n = 1").drop("n"))
    suffix = r.join(cand, ["device_id", "path"]).join(m.drop("path", "glob", "parent", "regex", "platform"), "mord")
    g = _called_up(r, F.col("path"), mappings.where("const is null").drop("path", "parent", "regex"), "glob").where(F.expr("rlike(path, glob)"))
    seg = F.get(F.split("path", "/"), F.col("scope_from"))
    sid = F.url_decode(F.regexp_replace(F.coalesce(F.nullif(F.regexp_extract(seg, r"^[A-Za-z0-9_.-]+\[(.*)\]$", 1), F.lit("")), seg), r"\+", "%2B"))
    # a list field keeps the raw text of each hit
    val = F.when(F.col("as_type") == "list", tv_list(F.array("value"))).otherwise(path_value(F.col("value")))
    blank = (F.col("value") == "") & F.col("vconst").isNull() & ~F.col("invert") & ~F.col("empty_is_true") & (F.col("as_type") != "list")
    cols = ["device_id", "mord", "field", "scope", "line", "at", "raw", val.alias("v"), (F.col("as_type") == "list").alias("listy"), blank.alias("empty")]
    none = F.lit(None).cast("string")
    out = exact.withColumn("scope", none).select(*cols).unionByName(suffix.withColumn("scope", none).select(*cols)).unionByName(g.withColumn("scope", F.coalesce(sid, F.col("path"))).select(*cols))
    return out.withColumn("ev", evidence())


def json_hits(documents: DataFrame, mappings: DataFrame) -> DataFrame:
    """M1 and M3 over JSON documents(device_id, platform, content): what the path of a mapping reaches, or the keys of what it reaches.

    A mapping with a scope path is scoped by containment: the scope's values name the containers they stand in, and a hit belongs to the innermost
    container around it, found by the places it lies in. A hit in none is `unscoped`.
    """
    m = mappings.where("jsonpath is not null and const is null").withColumnRenamed("ordinal", "mord")
    docs = documents.select("device_id", F.col("platform").alias("group"), "content")
    want = m.select(F.col("platform").alias("group"), F.explode(F.array_compact(F.array("jsonpath", "scope_path"))).alias("expr")).distinct()
    got = cut_lineage(path_values(docs, want))
    hits = got.join(small_side(m.select(F.col("platform").alias("group"), F.col("jsonpath").alias("expr"), *[c for c in m.columns if c not in ("platform", "jsonpath", "path", "glob", "regex", "parent")]), MAX_MAPPINGS), ["group", "expr"])
    keyed = hits.where(F.col("from_keys") & F.schema_of_variant("v").startswith("OBJECT<")).alias("h")
    keyed = keyed.lateralJoin(hits.sparkSession.tvf.variant_explode(F.col("h.v").outer()).alias("e")).select(*[F.col(f"h.{c}").alias(c) for c in hits.columns if c not in ("path", "ord", "v")], F.concat_ws(".", F.nullif("h.path", F.lit("")), "e.key").alias("path"),
                                                                                                   F.concat("h.ord", F.array("e.pos")).alias("ord"), F.col("e.key").alias("text"), F.lit(True).alias("word"))
    plain = hits.where("not from_keys").withColumn("text", text_of(F.col("v"))).withColumn("word", F.lit(True)).drop("v")
    every = keyed.unionByName(plain)

    around = lambda ord_: F.transform(F.sequence(F.lit(0), F.size(ord_)), lambda n: F.slice(ord_, F.lit(1), n))
    places = every.where("scope_path is not null").select("device_id", "group", "scope_path", "ord").distinct().withColumn("inside", F.explode(around(F.col("ord"))))
    holds = got.select("device_id", "group", F.col("expr").alias("scope_path"), F.slice("ord", F.lit(1), F.size("ord") - 1).alias("inside"), F.struct("ord", text_of(F.col("v")).alias("id")).alias("s"))
    holds = holds.groupBy("device_id", "group", "scope_path", "inside").agg(F.min("s").alias("s"))
    inner = places.join(holds, ["device_id", "group", "scope_path", "inside"]).groupBy("device_id", "group", "scope_path", "ord").agg(F.max_by(F.col("s.id"), F.size("inside")).alias("scope"))
    d = every.join(inner, ["device_id", "group", "scope_path", "ord"], "left").withColumn("scope", F.when(F.col("scope_path").isNotNull(), F.coalesce("scope", F.lit("unscoped"))))
    val = F.when(F.col("as_type") == "list", tv_list(F.array("text"))).otherwise(normalise(F.col("text"), F.col("as_type")))
    cols = ["device_id", "mord", "field", "scope", F.lit(None).cast("int").alias("line"), F.transform("ord", lambda x: x.cast("bigint")).alias("at"), F.concat(F.col("path"), F.lit(" = "), F.col("text")).alias("raw"), val.alias("v"),
            (F.col("as_type") == "list").alias("listy"), F.lit(False).alias("empty")]
    return d.select(*cols).withColumn("ev", evidence())


def mapping_problems(mappings: DataFrame) -> DataFrame:
    """(platform, ordinal, field, error): patterns that cannot be compiled and paths that are not understood. Such mappings find nothing."""
    key = ["platform", "ordinal", "field", "error"]
    out = literals.bad_patterns(mappings, "regex").select(*key).unionByName(literals.bad_patterns(mappings, "parent").select(*key))
    for path in ("jsonpath", "scope_path"):
        odd = mappings.where(F.col(path).isNotNull() & ~understood(F.col(path)))
        out = out.unionByName(odd.withColumn("error", F.concat(F.lit("path not understood: "), F.col(path))).select(*key))
    return out


def apply_mappings(devices: DataFrame, mappings: DataFrame, lines: DataFrame | None = None, records: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """M1-M4: observations of every device and mapping of its platform, non-hits kept.

    Several mappings of one field: a plain regex or exact path that finds nothing never erases a value already read;
    otherwise the later mapping stands. devices(device_id, platform).
    """
    from functools import reduce
    parts = [read(rows, mappings) for read, rows in ((line_hits, lines), (path_hits, records), (json_hits, documents)) if rows is not None]
    got = _fold(reduce(DataFrame.unionByName, parts))
    m = _maps(mappings, "true")
    grid = devices.select("device_id", "platform").join(m.select("platform", "mord", "field", "const", "if_absent", (F.col("parent").isNotNull() | F.col("glob").isNotNull()).alias("scoped"), F.col("jsonpath").isNotNull().alias("json")), "platform")
    hit = got.select("device_id", "mord").distinct().withColumn("hit", F.lit(True))
    miss = grid.join(shuffled(hit), ["device_id", "mord"], "left").where("hit is null")
    val = F.when(F.col("const").isNotNull(), F.col("const")).when(~F.col("scoped"), F.col("if_absent"))
    none_ev = F.lit(None).cast("array<struct<file:string,line:int,raw:string,record_id:string>>")
    soft = F.col("const").isNull() & ~F.col("scoped") & ~F.col("json")
    absent = miss.select("device_id", "mord", "field", F.lit(None).cast("string").alias("scope"), F.array().cast("array<bigint>").alias("at"),
                         F.when(val.isNotNull(), "DEFAULT_ASSUMED").otherwise("NOT_OBSERVED").alias("state"), val.alias("value"), none_ev.alias("evidence"), soft.alias("soft"))
    every = got.withColumn("soft", F.lit(False)).unionByName(absent)
    # A soft miss gives way to an OBSERVED value an earlier mapping of the field put in place and nothing replaced since.
    w = W.partitionBy("device_id", "field", "scope").orderBy("mord").rowsBetween(W.unboundedPreceding, -1)
    prior = F.last(F.when(~F.col("soft"), F.col("state")), ignorenulls=True).over(w)
    kept = every.withColumn("drop", F.col("soft") & F.coalesce(prior == "OBSERVED", F.lit(False))).where("not drop")
    last = kept.groupBy("device_id", "field", "scope").agg(F.max_by(F.struct("state", "value", "evidence", "at"), "mord").alias("o"), F.max("mord").alias("mord"))
    # the mapping's order goes before the place in the file, whatever the size of either
    order = F.row_number().over(W.partitionBy("device_id", "field").orderBy("mord", "o.at", "scope")).cast("bigint")
    return last.select("device_id", "field", "scope", order.alias("ordinal"), "o.state", F.lit("parser").alias("source"), F.lit(1.0).alias("confidence"), "o.value", "o.evidence")


# ------------------------------------------------------------------ derivations (M5-M9)
# Each gives (device_id, seen, value, n_evidence); a device without a row was not evaluated.

def _devices_with(hits: DataFrame, *aggs) -> DataFrame:
    return hits.groupBy("device_id").agg(*aggs)


def path_matches(records: DataFrame, patterns: list[str]) -> DataFrame:
    """Records whose path is one of the exact or wildcard patterns."""
    exact = [p for p in patterns if "*" not in p]
    cond = F.col("path").isin(exact) if exact else F.lit(False)
    for p in patterns:
        if "*" in p:
            cond = cond | F.col("path").rlike(glob_regex(p))
    return records.where(cond)


def path_weak_tokens(records: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """M5: names in the listed settings that fail their "strong" pattern; no setting present means no row."""
    from functools import reduce
    parts = []
    for path, strong in rules:
        t = F.filter(F.split(F.regexp_replace("value", r"[\[\]]", " "), r"\s+"), lambda x: x != "")
        parts.append(records.where(F.col("path") == path).select("device_id", "ordinal", F.filter(t, lambda x: ~x.rlike("(?i)" + strong)).alias("weak")))
    h = reduce(DataFrame.unionByName, parts)
    return h.groupBy("device_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "weak"))), lambda x: x["weak"])).alias("value"), F.count(F.lit(1)).alias("n_evidence"))


def path_token_any(records: DataFrame, patterns: list[str], token: str, in_path: bool = True) -> DataFrame:
    """M6: is a word in any of several settings, as a value or as the last path segment? FALSE cites every setting read."""
    h = path_matches(records, patterns)
    found = F.array_contains(F.split(F.lower("value"), r"\s+"), token.lower())
    if in_path:
        found = found | (F.lower(F.element_at(F.split("path", "/"), -1)) == token.lower())
    h = h.withColumn("f", found)
    yes = F.bool_or("f")
    return h.groupBy("device_id").agg(yes.alias("value"), F.when(yes, F.count_if("f")).otherwise(F.count(F.lit(1))).alias("n_evidence"))


def path_present(devices: DataFrame, records: DataFrame, pattern: str) -> DataFrame:
    """M7: presence; absence is a default without evidence, which can pass a control and never fail one."""
    h = path_matches(records, [pattern]).groupBy("device_id").agg(F.count(F.lit(1)).alias("n"))
    return devices.select("device_id").join(h, "device_id", "left").select("device_id", F.col("n").isNotNull().alias("value"), F.when(F.col("n").isNotNull(), 1).otherwise(0).alias("n_evidence"))


def path_any_present(records: DataFrame, pattern: str, value: str) -> DataFrame:
    """M7: a fact established by presence alone; otherwise not evaluated."""
    return path_matches(records, [pattern]).groupBy("device_id").agg(F.lit(value).alias("value"), F.min("ordinal").alias("first_at"))


def path_non_empty(records: DataFrame, path: str, blank: list[str] | None = None) -> DataFrame:
    """M7: a key that is there with a value; there but blank is FALSE; not there is not evaluated. The last write counts."""
    words = [""] + [b.strip().lower() for b in blank or []]
    return records.where(F.col("path") == path).groupBy("device_id").agg((~F.lower(F.trim(F.max_by("value", "ordinal"))).isin(words)).alias("value"))


def path_any_true(records: DataFrame, patterns: list[str]) -> DataFrame:
    """M7: on when any of several keys is on; none present is not evaluated."""
    on = F.lower(F.trim("value")).isin("on", "1", "true", "yes", "enable", "enabled")
    return path_matches(records, patterns).groupBy("device_id").agg(F.bool_or(on).alias("value"), F.count_if(on).alias("n_evidence"))


def telnet_reachable(lines: DataFrame) -> DataFrame:
    """M8: telnet is reachable when any vty block lets it in."""
    toks = F.split(F.trim(F.split_part("text", F.lit("transport input"), F.lit(2))), r"\s+")
    h = lines.where(F.col("parent").rlike(r"^line vty") & F.col("text").contains("transport input")).withColumn("t", F.array_contains(toks, "telnet") | F.array_contains(toks, "all"))
    return h.groupBy("device_id").agg(F.bool_or("t").alias("value"), F.count_if("t").alias("n_evidence"))


# Fragments of weak algorithm names.
WEAK_SSH = ["sha1", "-cbc", "3des", "arcfour", "md5", "group1", "diffie-hellman-group14-sha1"]
WEAK_TRANSFORM = ["esp-des", "esp-3des", "esp-md5-hmac", "esp-sha-hmac", "ah-md5-hmac", "esp-null"]
SNMP_WEAK = [("auth md5", "snmpv3-auth-md5"), ("auth sha ", "snmpv3-auth-sha1"), ("priv des", "snmpv3-priv-des"), ("priv 3des", "snmpv3-priv-3des")]


def weak_ssh_crypto(lines: DataFrame) -> DataFrame:
    """M8: weak algorithms stated for SSH, SNMPv3 users and IPsec transforms; nothing stated is not evaluated."""
    t = F.col("text")
    toks = F.split(F.trim(t), r"\s+")

    def weak(x):
        c = F.lit(False)
        for w in WEAK_SSH:
            c = c | F.lower(x).contains(w)
        return c

    ssh = F.when(t.rlike(r"^ip ssh server algorithm"), F.filter(F.slice(toks, 5, 10000), weak))
    snmp = F.when(t.rlike(r"^snmp-server user \S+ \S+ v3"), F.filter(F.array(*[F.when(F.lower(t).contains(k), F.lit(v)) for k, v in SNMP_WEAK]), lambda x: x.isNotNull()))
    ips = F.when(t.rlike(r"^crypto ipsec transform-set"), F.filter(F.slice(toks, 4, 10000), lambda x: F.lower(x).isin(WEAK_TRANSFORM)))
    h = lines.select("device_id", "line", F.when(ssh.isNotNull(), 1).when(snmp.isNotNull(), 2).when(ips.isNotNull(), 3).alias("k"), F.coalesce(ssh, snmp, ips).alias("found")).where("k is not null")
    a = h.groupBy("device_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "line", "found"))), lambda x: x["found"])).alias("value"), F.count_if("k = 1").alias("stated"))
    return a.where("size(value) > 0 or stated > 0").select("device_id", "value")


def keyed_snmp_version(records: DataFrame) -> DataFrame:
    """M8: the effective SNMP version of an export that has no version key."""
    keys = ["snmp_Enable", "Snmp3_Mand_Required", "snmp_GetCommunity"]
    p = records.where(F.col("path").isin(keys)).groupBy("device_id").pivot("path", keys).agg(F.max_by("value", "ordinal"))
    v = (F.when(F.lower("snmp_Enable").isin("off", "0", "false"), "disabled").when(F.lower("Snmp3_Mand_Required").isin("on", "1", "true"), "3").when(F.col("snmp_GetCommunity") != "", "2c"))
    return p.select("device_id", v.alias("value")).where("value is not null")


# Parts of an algorithm name that make it weak.
WEAK_PARTS = ["sha1", "-cbc", "3des", "arcfour", "md5", "group1-", "diffie-hellman-group1"]


def keyed_weak_ssh(records: DataFrame, path: str = "sshCipherControlConfig") -> DataFrame:
    """M8: enabled weak algorithms of a JSON policy of sections, each a list of {algorithm: 0 or 1}."""
    doc = F.from_json("value", "map<string,array<map<string,string>>>")
    r = records.where(F.col("path") == path).groupBy("device_id").agg(F.max_by("value", "ordinal").alias("value")).withColumn("d", doc)
    x = r.select("device_id", F.explode("d").alias("section", "entries")).select("device_id", "section", F.explode("entries").alias("e")).select("device_id", "section", F.explode("e").alias("alg", "flag"))
    weak = F.lit(False)
    for w in WEAK_PARTS:
        weak = weak | F.lower("alg").contains(w)
    return x.where(weak & ~F.lower("flag").isin("0", "false", "null", "")).groupBy("device_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "section", "alg"))).alias("value"))


WORLD = ["0.0.0.0/0", "::/0"]
# Ports asked about when a cloud group is open to the world.
WORLD_PORTS = [21, 22, 23, 1433, 3306, 3389, 5432, 27017]


def world_exposure(permissions: DataFrame, ports: list[int] | None = None) -> DataFrame:
    """M9: per permission open to the world: admin ports reached, all-protocol flag and range text.

    permissions(device_id, group_id, group_name, perm, protocol, from_port, to_port, cidrs).
    """
    w = permissions.withColumn("world", F.get(F.filter("cidrs", lambda c: c.isin(WORLD)), F.lit(0))).where("world is not null")
    every = F.col("protocol") == "-1"
    ps = F.array(*[F.lit(p) for p in sorted(ports or WORLD_PORTS)])
    hit = F.when(every, ps).when(F.col("from_port").isNull(), F.array().cast("array<int>")).otherwise(F.filter(ps, lambda p: p.between(F.col("from_port"), F.col("to_port"))))
    rng = F.when(every, "all").when(F.col("from_port").eqNullSafe(F.col("to_port")), F.coalesce(F.col("from_port").cast("string"), F.lit("None"))).otherwise(F.concat_ws("-", F.col("from_port").cast("string"), F.col("to_port").cast("string")))
    return w.select("device_id", "group_id", "group_name", "perm", F.when(every, "all").otherwise(F.col("protocol")).alias("protocol"), hit.alias("admin_ports"), every.alias("any_any"), rng.alias("range"), "world")


def default_group_in_use(permissions: DataFrame) -> DataFrame:
    """M9: default groups that carry rules."""
    return permissions.where("group_name = 'default' and perm is not null").select("device_id", "group_id").distinct()


# ------------------------------------------------------------------ accounting and coverage

def account(records: DataFrame, consumed: DataFrame, quarantined: DataFrame | None = None) -> DataFrame:
    """Fates per device. consumed(device_id, line) is what a mapping or builder read; the total must equal the sum of fates."""
    c = consumed.select("device_id", "line").distinct().withColumn("c", F.lit(True))
    r = records.join(shuffled(c), ["device_id", "line"], "left")
    if quarantined is not None:
        r = r.join(shuffled(quarantined.select("device_id", "line").distinct().withColumn("q", F.lit(True))), ["device_id", "line"], "left")
    else:
        r = r.withColumn("q", F.lit(None).cast("boolean"))
    fate = F.when(F.col("q"), "QUARANTINED").when(F.col("c"), "MAPPED").otherwise("PARSED")
    a = r.withColumn("fate", fate).groupBy("device_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("fate") == f).alias(f.lower()) for f in ("MAPPED", "PARSED", "QUARANTINED")])
    return a.withColumn("balances", F.col("total") == F.col("mapped") + F.col("parsed") + F.col("quarantined"))


def unrecognised(records: DataFrame, consumed: DataFrame) -> DataFrame:
    """Records nothing read."""
    return records.join(shuffled(consumed.select("device_id", "line").distinct()), ["device_id", "line"], "left_anti")


def merge_learned(mappings: DataFrame, learned: DataFrame) -> DataFrame:
    """Learned mappings only add fields the authored pack of the platform lacks."""
    base = lambda df: df.withColumn("__b", F.split_part("field", F.lit("["), F.lit(1)))
    new = base(learned).join(base(mappings).select("platform", "__b").distinct(), ["platform", "__b"], "left_anti").select(*mappings.columns)
    return mappings.unionByName(new.withColumn("ordinal", F.col("ordinal") + 1000000))


def reconcile_fields(fields: DataFrame, writers: DataFrame, readers: DataFrame, roadmap: DataFrame) -> DataFrame:
    """Is each declared field written, read, planned or dead?"""
    w = writers.groupBy("field").agg(F.count_distinct("writer").alias("writers"))
    r = readers.groupBy("field").agg(F.count_distinct("reader").alias("readers"))
    j = fields.join(w, "field", "left").join(r, "field", "left").join(roadmap.select("field", F.lit(True).alias("planned")).distinct(), "field", "left").na.fill(0, ["writers", "readers"])
    st = (F.when((F.col("writers") > 0) & (F.col("readers") > 0), "ACTIVE").when(F.col("writers") > 0, "UNUSED").when(F.col("readers") > 0, "ORPHAN").when(F.col("planned"), "ROADMAP").otherwise("DEAD"))
    return j.select("field", "writers", "readers", st.alias("status"))


def enrich(devices: DataFrame, facts: DataFrame) -> DataFrame:
    """Identity gaps filled from operational output; the configuration wins; two disagreements mean the wrong device."""
    cols = ["serial", "model", "version", "os", "hostname"]
    f = facts.select("device_id", *[F.col(c).alias(f"f_{c}") for c in cols])
    j = devices.join(f, "device_id", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    n = sum(F.when(~blank(f"f_{c}") & ~blank(c) & (F.col(c) != F.col(f"f_{c}")), 1).otherwise(0) for c in ("hostname", "model", "version"))
    j = j.withColumn("conflicts", n).withColumn("wrong_device", F.col("conflicts") >= 2)
    keep = {c: F.when(blank(c) & ~F.col("wrong_device"), F.nullif(F.col(f"f_{c}"), F.lit(""))).otherwise(F.col(c)) for c in cols}
    return j.select(*[c for c in devices.columns if c not in cols], *[keep[c].alias(c) for c in cols], "conflicts", "wrong_device")


def baseline(devices: DataFrame, observations: DataFrame, findings: DataFrame) -> DataFrame:
    """One nested document per device. Observation counts are exact; the fields themselves nest per device."""
    from ..functions.text import scoped_path
    o = observations.withColumn("path", scoped_path(F.col("field"), F.col("scope")))
    of = o.groupBy("device_id").agg(F.array_sort(F.collect_list(F.struct("path", "state", "value", "confidence", "evidence"))).alias("fields"), F.count(F.lit(1)).alias("fields_populated"),
                                    *[F.count_if(F.col("state") == s).alias(s.lower()) for s in ("OBSERVED", "DEFAULT_ASSUMED", "NOT_OBSERVED", "UNPARSED")])
    ff = findings.groupBy("device_id").agg(F.array_sort(F.collect_list(F.struct("control_id", "state", "severity", "field", "observed", "reason"))).alias("findings"))
    return devices.join(of, "device_id", "left").join(ff, "device_id", "left")
