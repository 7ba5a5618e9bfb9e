"""Policy tables from cloud exports, host firewalls, keyed exports and path records.

Every builder gives a dict of rules, objects, members and policies in the shapes of operators.policy.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.net import net_of
from ..functions.text import looks_like_literal
from ..session import cut_lineage

def no_strings() -> Column:
    return F.array().cast("array<string>")


def no_attrs() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))

RULE = ["device_id", "id", "name", "ord", "enabled", "action", "source", "destination", "services", "source_zones", "destination_zones", "logging", "hit_count", "program", "evidence"]
# Zone names that face outside.
OUTSIDE = ["untrust", "untrusted", "internet", "wan", "outside", "public", "external"]


def _ev(raw: Column, line: Column | None = None) -> Column:
    return F.array(F.struct(F.col("device_id").alias("file"), (line if line is not None else F.lit(None)).cast("int").alias("line"), F.substring(raw, 1, 200).alias("raw"), F.lit(None).cast("string").alias("record_id")))


def _finish(rules: DataFrame, objects: DataFrame, members: DataFrame | None, policies: DataFrame) -> dict[str, DataFrame]:
    fill = {"logging": F.lit(None).cast("boolean"), "hit_count": F.lit(None).cast("bigint"), "program": F.lit(None).cast("string"), "evidence": _ev(F.col("id"))}
    for k, v in fill.items():
        if k not in rules.columns:
            rules = rules.withColumn(k, v)
    if members is None:
        members = rules.sparkSession.createDataFrame([], "device_id string, parent string, child string, ordinal bigint")
    return {"rules": rules.select(*RULE), "objects": objects.select("device_id", "name", "kind", "values", "attrs"), "members": members.select("device_id", "parent", "child", "ordinal"),
            "policies": policies.select("device_id", "default_action", "default_action_observed", "unordered", "untrusted_zones")}


def _named_protocols(rules: DataFrame) -> DataFrame:
    """A protocol without ports (icmp, esp) is a known service, not a missing name."""
    s = rules.select("device_id", F.explode("services").alias("name")).where(~F.col("name").contains("/") & (F.lower("name") != "any")).distinct()
    return s.select("device_id", "name", F.lit("service").alias("kind"), F.array("name").alias("values"), no_attrs().alias("attrs"))


def _policy(devices: DataFrame, action: str, observed: bool, unordered: bool, untrusted: DataFrame | None = None) -> DataFrame:
    p = devices.select("device_id", F.lit(action).alias("default_action"), F.lit(observed).alias("default_action_observed"), F.lit(unordered).alias("unordered"))
    if untrusted is None:
        return p.withColumn("untrusted_zones", no_strings())
    u = untrusted.groupBy("device_id").agg(F.array_sort(F.collect_set("zone")).alias("untrusted_zones"))
    return p.join(u, "device_id", "left").withColumn("untrusted_zones", F.coalesce("untrusted_zones", no_strings()))


# ------------------------------------------------------------------ cloud

PERM = "array<struct<IpProtocol:string,FromPort:int,ToPort:int,IpRanges:array<struct<CidrIp:string>>,Ipv6Ranges:array<struct<CidrIpv6:string>>,UserIdGroupPairs:array<struct<GroupId:string>>,PrefixListIds:array<struct<PrefixListId:string>>>>"
AWS = f"array<struct<GroupId:string,GroupName:string,VpcId:string,Description:string,IpPermissions:{PERM},IpPermissionsEgress:{PERM}>>"


def _field(c: Column, names: str) -> Column:
    return F.filter(F.transform(F.coalesce(c, F.array().cast(f"array<struct<{names}:string>>")), lambda x: x[names]), lambda x: x.isNotNull() & (x != ""))


def aws_rules(files: DataFrame) -> dict[str, DataFrame]:
    """Security groups: allow-only and unordered; a group stands for its identifier, a referenced group or list is unknown."""
    body = F.when(F.trim("content").startswith("["), F.from_json("content", AWS)).otherwise(F.from_json("content", f"SecurityGroups {AWS}")["SecurityGroups"])
    g = files.select("device_id", F.posexplode(body).alias("gi", "g")).withColumn("gid", F.coalesce(F.nullif(F.col("g.GroupId"), F.lit("")), F.col("g.GroupName"))).where("coalesce(gid, '') != ''")
    name = F.coalesce("g.GroupName", "gid")
    sides = F.array(F.struct(F.lit(0).alias("k"), F.lit("IpPermissions").alias("key"), F.col("g.IpPermissions").alias("ps")), F.struct(F.lit(1).alias("k"), F.lit("IpPermissionsEgress").alias("key"), F.col("g.IpPermissionsEgress").alias("ps")))
    p = g.select("device_id", "gi", "gid", name.alias("gname"), F.explode(sides).alias("s")).select("device_id", "gi", "gid", "gname", "s.k", "s.key", F.posexplode("s.ps").alias("i", "p"))
    proto = F.lower(F.trim(F.coalesce("p.IpProtocol", F.lit(""))))
    svc = (F.when(proto.isin("-1", "", "all"), F.array(F.lit("any"))).when(F.col("p.FromPort").isNull() & F.col("p.ToPort").isNull(), F.array(proto))
           .when(F.col("p.FromPort") == F.col("p.ToPort"), F.array(F.concat(proto, F.lit("/"), F.col("p.FromPort").cast("string"))))
           .otherwise(F.array(F.concat(proto, F.lit("/"), F.col("p.FromPort").cast("string"), F.lit("-"), F.col("p.ToPort").cast("string")))))
    refs = F.concat(_field(F.col("p.UserIdGroupPairs"), "GroupId"), _field(F.col("p.PrefixListIds"), "PrefixListId"))
    far = F.concat(_field(F.col("p.IpRanges"), "CidrIp"), _field(F.col("p.Ipv6Ranges"), "CidrIpv6"), refs)
    inb, own = F.col("k") == 0, F.array("gid")
    pos = F.row_number().over(W.partitionBy("device_id").orderBy("gi", "k", "i"))
    r = p.withColumn("far", far).withColumn("refs", refs).withColumn("services", svc).withColumn("ord", pos)
    rules = r.select("device_id", F.concat("gid", F.lit(":"), "key", F.lit("["), F.col("i").cast("string"), F.lit("]")).alias("id"),
                     F.concat("gname", F.when(inb, " ingress ").otherwise(" egress "), F.array_join("services", "/")).alias("name"), "ord", F.lit(True).alias("enabled"), F.lit("allow").alias("action"),
                     F.when(inb, F.col("far")).otherwise(own).alias("source"), F.when(inb, own).otherwise(F.col("far")).alias("destination"), "services",
                     F.when(inb, no_strings()).otherwise(own).alias("source_zones"), F.when(inb, own).otherwise(no_strings()).alias("destination_zones"))
    zones = g.select("device_id", F.col("gid").alias("name"), F.lit("zone").alias("kind"), F.array("gid").alias("values"), no_attrs().alias("attrs")).dropDuplicates(["device_id", "name"])
    ref = (r.select("device_id", F.explode("refs").alias("name")).distinct().join(zones.select("device_id", "name"), ["device_id", "name"], "left_anti")
           .select("device_id", "name", F.lit("address_group").alias("kind"), no_strings().alias("values"), F.create_map(F.lit("members_unknown"), F.lit("true")).alias("attrs")))
    u = g.where(F.lower(name) == "default").select("device_id", F.col("gid").alias("zone"))
    return _finish(rules, zones.unionByName(ref).unionByName(_named_protocols(rules)), None, _policy(files, "deny", True, True, u))


_AZ = ("name:string,priority:int,direction:string,access:string,protocol:string,sourceAddressPrefix:string,sourceAddressPrefixes:array<string>,destinationAddressPrefix:string,destinationAddressPrefixes:array<string>,"
       "sourceApplicationSecurityGroups:array<struct<id:string>>,destinationApplicationSecurityGroups:array<struct<id:string>>,destinationPortRange:string,destinationPortRanges:array<string>")
AZ_RULE = f"struct<{_AZ},properties:struct<{_AZ}>>"
AZ_NSG = f"struct<name:string,id:string,location:string,securityRules:array<{AZ_RULE}>,defaultSecurityRules:array<{AZ_RULE}>,properties:struct<securityRules:array<{AZ_RULE}>,defaultSecurityRules:array<{AZ_RULE}>>>"
# Service tags that are internal by definition.
AZ_INTERNAL = ["virtualnetwork", "azureloadbalancer"]


def azure_rules(files: DataFrame) -> dict[str, DataFrame]:
    """Network security groups: each direction in priority order, tags and application groups by what the file can tell."""
    t = F.trim("content")
    body = F.when(t.startswith("["), F.from_json("content", f"array<{AZ_NSG}>")).otherwise(F.coalesce(F.from_json("content", f"value array<{AZ_NSG}>")["value"], F.array(F.from_json("content", AZ_NSG))))
    n = files.select("device_id", F.posexplode(body).alias("ni", "n")).withColumn("nsg", F.coalesce("n.name", F.concat(F.lit("nsg-"), F.col("ni").cast("string"))))
    lists = F.array(F.struct(F.lit(False).alias("d"), F.coalesce("n.securityRules", "n.properties.securityRules").alias("rs")), F.struct(F.lit(True).alias("d"), F.coalesce("n.defaultSecurityRules", "n.properties.defaultSecurityRules").alias("rs")))
    x = n.select("device_id", "ni", "nsg", F.posexplode(lists).alias("li", "l")).select("device_id", "ni", "nsg", "li", F.posexplode("l.rs").alias("i", "r"))
    g = lambda f: F.coalesce(F.col(f"r.{f}"), F.col(f"r.properties.{f}"))
    x = x.select("device_id", "ni", "nsg", "li", "i", F.coalesce(F.col("r.name"), F.col("r.properties.name")).alias("rn"), *[g(f).alias(f) for f in ("priority", "direction", "access", "protocol", "sourceAddressPrefix", "sourceAddressPrefixes",
                 "destinationAddressPrefix", "destinationAddressPrefixes", "sourceApplicationSecurityGroups", "destinationApplicationSecurityGroups", "destinationPortRange", "destinationPortRanges")])

    def side(s):
        vals = F.filter(F.concat(F.array(F.col(f"{s}AddressPrefix")), F.coalesce(f"{s}AddressPrefixes", no_strings())), lambda v: v.isNotNull() & (F.trim(v) != ""))
        asg = F.transform(F.coalesce(f"{s}ApplicationSecurityGroups", F.array().cast("array<struct<id:string>>")), lambda a: F.element_at(F.split(a["id"], "/"), -1))
        return F.concat(F.transform(vals, lambda v: F.when(F.trim(v) == "*", "any").otherwise(F.trim(v))), asg)

    ports = F.filter(F.concat(F.array("destinationPortRange"), F.coalesce("destinationPortRanges", no_strings())), lambda v: v.isNotNull() & (F.trim(v) != ""))
    pr = F.lower(F.coalesce("protocol", F.lit("*")))
    some = F.when(F.size("ports") > 0, F.col("ports")).otherwise(F.array(F.lit("*")))
    span = lambda q: F.transform(some, lambda v: F.concat(F.lit(q + "/"), F.when(v == "*", "0-65535").otherwise(v)))
    svc = (F.when(pr.isin("*", "any"), F.when((F.size("ports") == 0) | (F.array_join("ports", ",") == "*"), F.array(F.lit("any"))).otherwise(F.concat(span("tcp"), span("udp"))))
           .when(pr == "tcp", span("tcp")).when(pr == "udp", span("udp")).otherwise(F.array(pr)))
    x = x.withColumn("ports", ports).withColumn("services", svc).withColumn("source", side("source")).withColumn("destination", side("destination"))
    pos = F.row_number().over(W.partitionBy("device_id").orderBy("ni", F.lower(F.coalesce("direction", F.lit(""))), F.coalesce("priority", F.lit(65535)), "li", "i"))
    inb = F.lower("direction") == "inbound"
    x = x.withColumn("ord", pos)
    rules = x.select("device_id", F.concat("nsg", F.lit(":"), F.coalesce("rn", F.concat(F.lit("rule-"), F.col("ord").cast("string")))).alias("id"),
                     F.concat("nsg", F.lit("/"), F.coalesce("rn", F.lit("rule")), F.lit(" (priority "), F.coalesce(F.col("priority").cast("string"), F.lit("None")), F.lit(")")).alias("name"), "ord", F.lit(True).alias("enabled"),
                     F.when(F.lower("access") == "allow", "allow").otherwise("deny").alias("action"), "source", "destination", "services",
                     F.when(inb, no_strings()).otherwise(F.array("nsg")).alias("source_zones"), F.when(inb, F.array("nsg")).otherwise(no_strings()).alias("destination_zones"))
    zones = n.select("device_id", F.col("nsg").alias("name"), F.lit("zone").alias("kind"), F.array("nsg").alias("values"), no_attrs().alias("attrs")).dropDuplicates(["device_id", "name"])
    asgs = x.select("device_id", F.explode(F.concat(*[F.transform(F.coalesce(f"{s}ApplicationSecurityGroups", F.array().cast("array<struct<id:string>>")), lambda a: F.element_at(F.split(a["id"], "/"), -1)) for s in ("source", "destination")])).alias("name")).distinct()
    asgs = asgs.withColumn("asg", F.lit(True))
    names = rules.select("device_id", F.explode(F.concat("source", "destination")).alias("name")).distinct().where((F.col("name") != "any") & ~looks_like_literal(F.col("name")))
    tags = names.join(asgs, ["device_id", "name"], "left").join(zones.select("device_id", "name"), ["device_id", "name"], "left_anti")
    low = F.lower("name")
    tags = tags.select("device_id", "name", F.when(low == "internet", "address").otherwise("address_group").alias("kind"),
                       F.when(F.col("asg"), F.array(F.concat(F.lit("asg:"), "name"))).when(low == "internet", F.array(F.lit("0.0.0.0/0"))).when(low.isin(AZ_INTERNAL), F.array(F.concat(F.lit("tag:"), "name"))).otherwise(no_strings()).alias("values"),
                       F.when(F.col("asg").isNull() & (low != "internet") & ~low.isin(AZ_INTERNAL), F.create_map(F.lit("members_unknown"), F.lit("true"))).otherwise(no_attrs()).alias("attrs"))
    return _finish(rules, zones.unionByName(tags).unionByName(_named_protocols(rules)), None, _policy(files, "deny", True, False))


GCP = ("array<struct<name:string,network:string,direction:string,priority:int,disabled:boolean,sourceRanges:array<string>,destinationRanges:array<string>,sourceTags:array<string>,sourceServiceAccounts:array<string>,"
       "targetTags:array<string>,targetServiceAccounts:array<string>,allowed:array<struct<IPProtocol:string,ports:array<string>>>,denied:array<struct<IPProtocol:string,ports:array<string>>>,logConfig:struct<enable:boolean>>>")


def gcp_rules(files: DataFrame) -> dict[str, DataFrame]:
    """VPC firewall rules by priority, deny before allow on a tie; an unstated source is unknown, never everyone."""
    body = F.when(F.trim("content").startswith("["), F.from_json("content", GCP)).otherwise(F.from_json("content", f"items {GCP}")["items"])
    x = files.select("device_id", F.posexplode(body).alias("i", "r")).select("device_id", "i", "r.*")
    deny = F.coalesce(F.size("denied") > 0, F.lit(False))
    e = F.when(F.coalesce(F.size("allowed") > 0, F.lit(False)), F.col("allowed")).otherwise(F.col("denied"))
    proto = lambda a: F.lower(F.coalesce(a["IPProtocol"], F.lit("")))
    svc = F.flatten(F.transform(e, lambda a: F.when(proto(a).isin("tcp", "udp", "sctp"), F.when(F.coalesce(F.size(a["ports"]), F.lit(0)) <= 0, F.array(F.concat(proto(a), F.lit("/0-65535")))).otherwise(
        F.transform(a["ports"], lambda p: F.concat(proto(a), F.lit("/"), p)))).otherwise(F.array(proto(a)))))
    svc = F.when(F.exists(e, lambda a: proto(a).isin("all", "")), F.array(F.lit("any"))).otherwise(F.coalesce(svc, no_strings()))
    mark = lambda c, t: F.transform(F.coalesce(c, no_strings()), lambda v: F.concat(F.lit(t), v))
    x = x.withColumn("net", F.coalesce(F.nullif(F.regexp_extract("network", r"([^/]+)/*$", 1), F.lit("")), F.lit("network"))).withColumn("services", svc)
    tgt = F.concat(mark("targetTags", "tag:"), mark("targetServiceAccounts", "sa:"))
    src = F.concat(F.coalesce("sourceRanges", no_strings()), mark("sourceTags", "tag:"), mark("sourceServiceAccounts", "sa:"))
    x = x.withColumn("local", F.when(F.size(tgt) > 0, tgt).otherwise(F.array("net"))).withColumn("far", F.when(F.size(src) > 0, src).otherwise(F.array(F.lit("unstated-source"))))
    inb = F.upper(F.coalesce("direction", F.lit("INGRESS"))) == "INGRESS"
    out = F.when(F.coalesce(F.size("destinationRanges"), F.lit(0)) > 0, F.col("destinationRanges")).otherwise(F.array(F.lit("any")))
    pos = F.row_number().over(W.partitionBy("device_id").orderBy(F.coalesce("priority", F.lit(1000)), F.when(deny, 0).otherwise(1), "i"))
    nm = F.coalesce("name", F.concat(F.lit("rule-"), F.col("i").cast("string")))
    rules = x.select("device_id", F.concat("net", F.lit(":"), nm).alias("id"), F.concat(nm, F.lit(" (priority "), F.coalesce("priority", F.lit(1000)).cast("string"), F.lit(")")).alias("name"), pos.alias("ord"),
                     (~F.coalesce("disabled", F.lit(False))).alias("enabled"), F.when(deny, "deny").otherwise("allow").alias("action"), F.when(inb, F.col("far")).otherwise(F.col("local")).alias("source"),
                     F.when(inb, F.col("local")).otherwise(out).alias("destination"), "services", F.when(inb, no_strings()).otherwise(F.array("net")).alias("source_zones"), F.when(inb, F.array("net")).otherwise(no_strings()).alias("destination_zones"),
                     F.col("logConfig.enable").alias("logging"))
    zones = x.select("device_id", F.col("net").alias("name"), F.lit("zone").alias("kind"), F.array("net").alias("values"), no_attrs().alias("attrs")).dropDuplicates(["device_id", "name"])
    ids = rules.select("device_id", F.explode(F.concat("source", "destination")).alias("name")).distinct().where(F.col("name").rlike("^(tag|sa):") | (F.col("name") == "unstated-source"))
    known = F.col("name") != "unstated-source"
    ids = ids.select("device_id", "name", F.lit("address_group").alias("kind"), F.when(known, F.array("name")).otherwise(no_strings()).alias("values"), F.when(known, no_attrs()).otherwise(F.create_map(F.lit("members_unknown"), F.lit("true"))).alias("attrs"))
    return _finish(rules, zones.unionByName(ids).unionByName(_named_protocols(rules)), None, _policy(files, "deny", False, False))


# ------------------------------------------------------------------ host firewalls

def iptables_rules(lines: DataFrame) -> dict[str, DataFrame]:
    """`iptables-save` lines: chain policies give the default, rules are unordered; the far side of inbound traffic is its source."""
    t = F.trim("text")
    opt = lambda f: F.regexp_extract(t, rf"(?:^|\s){f}\s+(\S+)", 1)
    r = lines.where(t.rlike(r"^-A\s+\S+\s+.*$")).withColumn("chain", F.regexp_extract(t, r"^-A\s+(\S+)", 1))
    r = r.withColumn("n", F.row_number().over(W.partitionBy("device_id").orderBy("line")) - 1)
    inb = F.upper("chain").isin("INPUT", "FORWARD")
    val = lambda c: F.when(F.lower(c).isin("", "any", "*", "0.0.0.0", "::"), F.array(F.lit("any"))).otherwise(F.filter(F.transform(F.split(c, ","), lambda y: F.trim(y)), lambda x: x != ""))
    port = F.when(inb, opt("--dport")).otherwise(opt("--sport"))
    proto = F.lower(opt("-p"))
    svc = (F.when(proto.isin("", "any", "all"), F.when(port == "", F.array(F.lit("any"))).otherwise(F.array(F.concat(F.lit("tcp/"), port))))
           .when(~proto.isin("tcp", "udp", "icmp", "icmpv4", "icmpv6"), F.array(F.concat(F.lit("proto:"), proto))).when(port == "", F.array(F.concat(proto, F.lit("/1-65535")))).otherwise(F.array(F.concat(proto, F.lit("/"), port))))
    rules = r.select("device_id", F.concat("chain", F.lit("#"), F.col("n").cast("string")).alias("id"), F.substring(t, 1, 120).alias("name"), F.lit(0).alias("ord"), F.lit(True).alias("enabled"),
                     F.when(F.lower(opt("-j")).isin("allow", "accept"), "allow").otherwise("deny").alias("action"), val(opt("-s")).alias("source"), val(opt("-d")).alias("destination"), svc.alias("services"),
                     F.when(inb, F.array("chain")).otherwise(no_strings()).alias("source_zones"), F.when(inb, no_strings()).otherwise(F.array("chain")).alias("destination_zones"), _ev(t, F.col("line")).alias("evidence"))
    c = lines.where(t.rlike(r"^:\S+\s+\S+")).select("device_id", F.regexp_extract(t, r"^:(\S+)\s+(\S+)", 1).alias("name"), F.lower(F.regexp_extract(t, r"^:(\S+)\s+(\S+)", 2)).alias("p"))
    zones = c.select("device_id", "name", F.lit("zone").alias("kind"), no_strings().alias("values"), no_attrs().alias("attrs"))
    d = c.groupBy("device_id").agg(F.every(F.col("p").isin("block", "blockinbound")).alias("b"), F.bool_or(F.col("p") == "allow").alias("a"))
    pol = lines.select("device_id").distinct().join(d, "device_id", "left").select("device_id", F.when(F.col("a") & ~F.col("b"), "allow").otherwise("deny").alias("default_action"), F.coalesce(F.col("b") | F.col("a"), F.lit(False)).alias("default_action_observed"),
                                                                                  F.lit(True).alias("unordered"), no_strings().alias("untrusted_zones"))
    return _finish(rules, zones, None, pol)


# ------------------------------------------------------------------ indexed key=value tables

# An export's type codes and protocol numbers.
KV_PROTO = {"6": "tcp", "17": "udp", "1": "icmp", "58": "icmpv6"}


def _indexed(values: DataFrame, bases: list[str]) -> DataFrame:
    rx = r"^(.*?)_(\d+)$"
    r = values.select("device_id", F.regexp_extract("path", rx, 1).alias("k"), F.regexp_extract("path", rx, 2).try_cast("int").alias("idx"), "value").where(F.col("k").isin(bases))
    return r.groupBy("device_id", "idx").pivot("k", bases).agg(F.first("value"))


def keyvalue_rules(values: DataFrame, group_type: str = "8") -> dict[str, DataFrame]:
    """Policy tables spread over `name_N` keys. values(device_id, path, value): the last value of each key."""
    a = _indexed(values, ["addrObjId", "addrObjType", "addrObjIp1", "addrObjIp2", "addrObjZone"]).where("addrObjId != ''")
    v1, v2 = F.coalesce("addrObjIp1", F.lit("")), F.coalesce("addrObjIp2", F.lit(""))
    av = F.when((F.coalesce("addrObjType", F.lit("")) == group_type) | v1.isin("", "0.0.0.0"), no_strings()).when(v2.isin("", "0.0.0.0") | (v1 == v2), F.array(v1)).otherwise(F.array(F.concat_ws("-", v1, v2)))
    m = _indexed(values, ["addro_atomToGrp", "addro_grpToGrp"]).where("addro_atomToGrp != '' and addro_grpToGrp != ''")
    members = m.select("device_id", F.col("addro_grpToGrp").alias("parent"), F.col("addro_atomToGrp").alias("child"), F.col("idx").cast("bigint").alias("ordinal"))
    addr = a.select("device_id", F.col("addrObjId").alias("name"), F.when(F.col("addrObjType") == group_type, "address_group").otherwise("address").alias("kind"), av.alias("values"), no_attrs().alias("attrs"), "idx")
    grp = members.select("device_id", F.col("parent").alias("name")).distinct().select("device_id", "name", F.lit("address_group").alias("kind"), no_strings().alias("values"), no_attrs().alias("attrs"), F.lit(0).alias("idx"))
    s = _indexed(values, ["svcObjId", "svcObjType", "svcObjPort1", "svcObjPort2", "svcObjIpType"]).where("svcObjId != ''")
    proto = reduce(lambda c, kv: c.when(F.col("svcObjIpType") == kv[0], kv[1]), KV_PROTO.items(), F.when(F.lit(False), ""))
    p1, p2 = F.coalesce("svcObjPort1", F.lit("")), F.coalesce("svcObjPort2", F.lit(""))
    sv = F.when(p1.isin("", "0"), no_strings()).when((p2 == "") | (p1 == p2), F.array(F.concat_ws("/", "proto", p1))).otherwise(F.array(F.concat(F.col("proto"), F.lit("/"), p1, F.lit("-"), p2)))
    s = s.withColumn("proto", proto)
    group = F.coalesce(F.col("svcObjType") == "2", F.lit(False))
    svc = s.select("device_id", F.col("svcObjId").alias("name"), F.when(group, "service_group").otherwise("service").alias("kind"), F.when(group | F.col("proto").isNull(), no_strings()).otherwise(sv).alias("values"),
                   F.when(group, F.create_map(F.lit("members_unknown"), F.lit("true"))).when(F.col("proto").isNull(), F.create_map(F.lit("protocol_unknown"), F.coalesce("svcObjIpType", F.lit("")))).otherwise(no_attrs()).alias("attrs"), "idx")
    z = _indexed(values, ["zoneObjId"]).where("zoneObjId != ''")
    zones = z.select("device_id", F.col("zoneObjId").alias("name"), F.lit("zone").alias("kind"), no_strings().alias("values"), no_attrs().alias("attrs"), "idx")
    # an address object keeps its name over a service or zone of the same name; membership makes it a group
    every = addr.withColumn("p", F.lit(0)).unionByName(grp.withColumn("p", F.lit(1))).unionByName(svc.withColumn("p", F.lit(2))).unionByName(zones.withColumn("p", F.lit(3)))
    o = every.groupBy("device_id", "name").agg(F.min_by(F.struct("kind", "values", "attrs"), F.struct("p", F.when(F.size("values") > 0, 0).otherwise(1), "idx")).alias("o"), F.bool_or(F.col("p") == 1).alias("isg"))
    objects = o.select("device_id", "name", F.when(F.col("isg") & (F.col("o.kind") == "address"), "address_group").otherwise(F.col("o.kind")).alias("kind"), "o.values", "o.attrs")
    parts = []
    for suf, fam in (("", "IPv4"), ("V6", "IPv6")):
        cols = ["Name", "Action", "Enabled", "Log", "SrcZone", "DstZone", "SrcNet", "DstNet", "DstSvc", "Priority", "HitCount"]
        p = _indexed(values, [f"policy{c}{suf}" for c in cols]).toDF("device_id", "idx", *cols).where("Name != ''")
        side = lambda c: F.when(F.coalesce(c, F.lit("")).isin("4294967295", "-1", ""), F.array(F.lit("any"))).otherwise(F.array(c))
        zone = lambda c: F.when(F.coalesce(c, F.lit("")) == "", no_strings()).otherwise(F.array(c))
        parts.append(p.select("device_id", F.concat(F.lit(f"policy{suf}_"), F.col("idx").cast("string")).alias("id"), F.concat("Name", F.lit(f" [{fam}#"), F.col("idx").cast("string"), F.lit("]")).alias("name"),
                              F.coalesce(F.nullif(F.col("Priority").try_cast("int"), F.lit(0)), F.col("idx")).alias("ord"), F.coalesce(F.col("Enabled") == "1", F.lit(False)).alias("enabled"), F.when(F.col("Action") == "2", "allow").otherwise("deny").alias("action"),
                              side("SrcNet").alias("source"), side("DstNet").alias("destination"), side("DstSvc").alias("services"), zone("SrcZone").alias("source_zones"), zone("DstZone").alias("destination_zones"),
                              F.coalesce(F.col("Log") == "1", F.lit(False)).alias("logging"), F.when(F.col("HitCount").rlike(r"^\d+$"), F.col("HitCount").try_cast("bigint")).alias("hit_count")))
    rules = parts[0].unionByName(parts[1])
    u = z.where(F.lower("zoneObjId").isin("wan", "untrust", "internet", "public", "wlan")).select("device_id", F.col("zoneObjId").alias("zone"))
    return _finish(rules, objects, members, _policy(values.select("device_id").distinct(), "deny", False, False, u))


# ------------------------------------------------------------------ path records

# Services a platform defines without writing them into the configuration.
PREDEFINED = {
    "fortios": {"ALL": ["all"], "ALL_TCP": ["tcp/1-65535"], "ALL_UDP": ["udp/1-65535"], "ALL_ICMP": ["icmp"], "PING": ["icmp"], "HTTP": ["tcp/80"], "HTTPS": ["tcp/443"], "SSH": ["tcp/22"], "TELNET": ["tcp/23"], "FTP": ["tcp/21"],
                "SMTP": ["tcp/25"], "POP3": ["tcp/110"], "IMAP": ["tcp/143"], "DNS": ["tcp/53", "udp/53"], "NTP": ["udp/123"], "SNMP": ["udp/161", "udp/162"], "SYSLOG": ["udp/514"], "LDAP": ["tcp/389"], "RDP": ["tcp/3389"],
                "SAMBA": ["tcp/139"], "SMB": ["tcp/445"], "MS-SQL": ["tcp/1433"], "MYSQL": ["tcp/3306"]},
    "panos": {"service-http": ["tcp/80", "tcp/8080"], "service-https": ["tcp/443"]},
    "junos_xml": {"junos-http": ["tcp/80"], "junos-https": ["tcp/443"], "junos-ssh": ["tcp/22"], "junos-telnet": ["tcp/23"], "junos-ftp": ["tcp/21"], "junos-smtp": ["tcp/25"], "junos-dns-udp": ["udp/53"], "junos-dns-tcp": ["tcp/53"],
                  "junos-ntp": ["udp/123"], "junos-snmp": ["udp/161"], "junos-ldap": ["tcp/389"], "junos-ms-rdp": ["tcp/3389"], "junos-ping": ["icmp"]},
}


def _with_predefined(rules: DataFrame, objects: DataFrame, members: DataFrame, table: dict, groups: bool = True) -> DataFrame:
    """Only names a rule or service group refers to, never over an object the device defines."""
    spark = rules.sparkSession
    used = rules.select("device_id", F.explode("services").alias("name"))
    if groups:
        sg = objects.where("kind = 'service_group'").select("device_id", F.col("name").alias("parent"))
        used = used.unionByName(members.join(sg, ["device_id", "parent"], "left_semi").select("device_id", F.col("child").alias("name")))
    p = F.broadcast(spark.createDataFrame(list(table.items()), "name string, values array<string>"))
    add = used.distinct().join(p, "name").join(objects.select("device_id", "name"), ["device_id", "name"], "left_anti")
    return objects.unionByName(add.select("device_id", "name", F.lit("service").alias("kind"), "values", F.create_map(F.lit("predefined"), F.lit("true")).alias("attrs")))


def _quoted(c: Column) -> Column:
    v = F.trim(F.coalesce(c, F.lit("")))
    return F.when(v == "", no_strings()).when(v.contains('"'), F.filter(F.regexp_extract_all(v, F.lit('"([^"]*)"'), F.lit(1)), lambda x: x != "")).otherwise(F.array(v))


def fortios_rules(records: DataFrame) -> dict[str, DataFrame]:
    """Block-form policies: document order, absent status is enabled, absent action is deny, negation and schedules undecidable."""
    records = cut_lineage(records)  # every table below reads them
    def table(section, leaves):
        rx = rf"^{section}/([^/]+)/(.+)$"
        r = records.where(F.col("path").rlike(rx)).select("device_id", F.regexp_extract("path", rx, 1).alias("name"), F.regexp_extract("path", rx, 2).alias("leaf"), "value", "ordinal")
        first = r.groupBy("device_id", "name").agg(F.min("ordinal").alias("at"))
        return r.where(F.col("leaf").isin(leaves)).groupBy("device_id", "name").pivot("leaf", leaves).agg(F.max_by("value", "ordinal")).join(first, ["device_id", "name"], "right")

    a = table("firewall address", ["type", "subnet", "start-ip", "end-ip", "fqdn", "wildcard"])
    kind = F.coalesce("type", F.lit("ipmask"))
    ip, mask = F.split_part("subnet", F.lit(" "), F.lit(1)), F.when(F.col("subnet").contains(" "), F.split_part("subnet", F.lit(" "), F.lit(2)))
    ip, mask = F.when(F.col("subnet").contains("/"), F.split_part("subnet", F.lit("/"), F.lit(1))).otherwise(ip), F.when(F.col("subnet").contains("/"), F.split_part("subnet", F.lit("/"), F.lit(2))).otherwise(mask)
    n = net_of(ip, mask)
    dotted = F.concat_ws(".", *[F.shiftright(n["lo"], s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])
    cidr = F.when(n.isNotNull() & (F.col("subnet").contains(" ") | F.col("subnet").contains("/")), F.array(F.concat_ws("/", dotted, n["prefixlen"].cast("string")))).otherwise(no_strings())
    av = (F.when((kind == "iprange") & F.col("start-ip").isNotNull(), F.array(F.concat_ws("-", "start-ip", F.coalesce("end-ip", "start-ip")))).when((kind == "fqdn") & F.col("fqdn").isNotNull(), F.array("fqdn"))
          .when((kind == "wildcard") & F.col("wildcard").isNotNull(), F.array("wildcard")).when(F.col("subnet").isNotNull(), cidr).otherwise(no_strings()))
    addr = a.select("device_id", "name", F.lit("address").alias("kind"), av.alias("values"), F.create_map(F.lit("form"), kind).alias("attrs"))

    def group(section, k):
        g = table(section, ["member"]).where("member is not null")
        return (g.select("device_id", "name", F.lit(k).alias("kind"), no_strings().alias("values"), no_attrs().alias("attrs")), g.select("device_id", F.col("name").alias("parent"), F.posexplode(_quoted(F.col("member"))).alias("ordinal", "child")))

    ag, agm = group("firewall addrgrp", "address_group")
    sg, sgm = group("firewall service group", "service_group")
    s = table("firewall service custom", ["tcp-portrange", "udp-portrange", "sctp-portrange", "protocol", "protocol-number"])
    rng = lambda p: F.transform(F.filter(F.split(F.coalesce(F.col(f"{p}-portrange"), F.lit("")), r"\s+"), lambda x: F.split_part(x, F.lit(":"), F.lit(1)) != ""), lambda x: F.concat(F.lit(p + "/"), F.split_part(x, F.lit(":"), F.lit(1))))
    svc = s.select("device_id", "name", F.lit("service").alias("kind"), F.concat(rng("tcp"), rng("udp"), rng("sctp")).alias("values"), no_attrs().alias("attrs"))
    z = table("system zone", ["interface"]).where("interface is not null")
    claim = z.select("device_id", F.col("name").alias("zone"), F.explode(_quoted(F.col("interface"))).alias("iface"))
    zones = z.select("device_id", "name", F.lit("zone").alias("kind"), no_strings().alias("values"), no_attrs().alias("attrs"))
    i = table("system interface", ["role"])
    ifs = i.select("device_id", "name", F.lit("interface").alias("kind"), no_strings().alias("values"), no_attrs().alias("attrs"))
    out_if = i.where((F.lower("role") == "wan") | F.lower("name").isin(OUTSIDE)).join(claim.withColumnRenamed("iface", "name"), ["device_id", "name"], "left").select("device_id", F.coalesce("zone", "name").alias("zone"))
    untrusted = out_if.unionByName(z.where(F.lower("name").isin(OUTSIDE)).select("device_id", F.col("name").alias("zone")))
    leaves = ["name", "status", "action", "srcaddr", "dstaddr", "service", "srcintf", "dstintf", "logtraffic", "srcaddr-negate", "dstaddr-negate", "service-negate", "schedule"]
    p = table("firewall policy", [f"{x}" for x in leaves if x != "name"])
    nm = records.where(F.col("path").rlike(r"^firewall policy/[^/]+/name$")).groupBy("device_id", F.regexp_extract("path", r"^firewall policy/([^/]+)/name$", 1).alias("name")).agg(F.max_by("value", "ordinal").alias("title"))
    p = p.join(nm, ["device_id", "name"], "left").withColumn("ord", F.row_number().over(W.partitionBy("device_id").orderBy("at")))
    side = lambda c: F.when(F.size(_quoted(F.col(c))) > 0, _quoted(F.col(c))).otherwise(F.array(F.lit("any")))
    zmap = claim.groupBy("device_id").agg(F.map_from_entries(F.collect_set(F.struct("iface", "zone"))).alias("zm"))
    p = p.join(zmap, "device_id", "left")
    scope = lambda c: F.transform(_quoted(F.col(c)), lambda x: F.coalesce(F.when(F.col("zm").isNotNull(), F.element_at("zm", x)), x))
    sched = F.regexp_replace(F.trim(F.coalesce("schedule", F.lit("always"))), '^"+|"+$', "")
    neg = lambda c, lab: F.when(F.lower(F.trim(F.col(c))) == "enable", F.lit(lab))
    und = F.concat_ws("; ", neg("srcaddr-negate", "negate-source"), neg("dstaddr-negate", "negate-destination"), neg("service-negate", "negate-service"), F.when((sched != "") & (F.lower(sched) != "always"), F.concat(F.lit("schedule:"), sched)))
    log = F.lower(F.trim(F.coalesce("logtraffic", F.lit(""))))
    rules = p.select("device_id", F.concat(F.lit("policy:"), "name").alias("id"), F.concat(F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("policy "), "name")), F.lit(" [#"), "name", F.lit("]")).alias("name"), "ord",
                     (F.lower(F.trim(F.coalesce("status", F.lit("enable")))) != "disable").alias("enabled"), F.when(F.lower(F.trim("action")).isin("accept", "allow", "permit"), "allow").otherwise("deny").alias("action"),
                     side("srcaddr").alias("source"), side("dstaddr").alias("destination"), side("service").alias("services"), scope("srcintf").alias("source_zones"), scope("dstintf").alias("destination_zones"),
                     F.when(~log.isin("", "disable"), F.lit(True)).alias("logging"), F.nullif(und, F.lit("")).alias("program"))
    members = agm.unionByName(sgm).withColumn("ordinal", F.col("ordinal").cast("bigint"))
    objects = reduce(DataFrame.unionByName, [addr, ag, svc, sg, zones, ifs]).dropDuplicates(["device_id", "name"])
    return _finish(rules, _with_predefined(rules, objects, members, PREDEFINED["fortios"]), members, _policy(records.select("device_id").distinct(), "deny", False, False, untrusted))


def junos_rules(records: DataFrame) -> dict[str, DataFrame]:
    """Zone-pair policies of brace or set-line records, in the order first written."""
    records = cut_lineage(records)  # every table below reads them
    r, p = records, F.col("path")

    def got(rx, *groups):
        return r.where(p.rlike(rx)).select("device_id", "ordinal", "value", "raw", *[F.regexp_extract(p, rx, i + 1).alias(g) for i, g in enumerate(groups)])

    book = r"^security/address-book/(?:[^/]+/)?"
    a1 = got(book + r"address/([^/]+)$", "name").where("value != ''")
    a2 = got(book + r"address/([^/]+)/(dns-name|range-address|ip-prefix|wildcard-address)$", "name", "form")
    addr = a1.select("device_id", "name", "value", "ordinal").unionByName(a2.select("device_id", "name", "value", "ordinal")).groupBy("device_id", "name").agg(F.array(F.max_by("value", "ordinal")).alias("values"))
    addr = addr.select("device_id", "name", F.lit("address").alias("kind"), "values", no_attrs().alias("attrs"))
    sets = got(book + r"address-set/([^/]+)/(?:address|address-set)$", "name")
    apps = got(r"^applications/application/([^/]+)/(?:term/[^/]+/)?(?:custom-options/)?(protocol|destination-port|port)$", "name", "leaf")
    ap = apps.groupBy("device_id", "name").agg(F.max_by("value", F.when(F.col("leaf") == "protocol", F.col("ordinal"))).alias("proto"), F.max_by("value", F.when(F.col("leaf") != "protocol", F.col("ordinal"))).alias("port"))
    app = ap.select("device_id", "name", F.lit("service").alias("kind"), F.when(F.coalesce("port", F.lit("")) != "", F.array(F.concat_ws("/", F.coalesce("proto", F.lit("tcp")), "port"))).otherwise(no_strings()).alias("values"), no_attrs().alias("attrs"))
    asets = got(r"^applications/application-set/([^/]+)/application$", "name")
    z = got(r"^security/zones/security-zone/([^/]+)/interfaces(?:/([^/]+))?$", "name", "i")
    grp = lambda d, k: d.select("device_id", "name").distinct().select("device_id", "name", F.lit(k).alias("kind"), no_strings().alias("values"), no_attrs().alias("attrs"))
    mem = lambda d, c=F.col("value"): d.where(c != "").groupBy("device_id", F.col("name").alias("parent"), c.alias("child")).agg(F.min("ordinal").alias("ordinal"))
    members = mem(sets).unionByName(mem(asets)).unionByName(mem(z, F.coalesce(F.nullif("i", F.lit("")), F.col("value"))))
    q = got(r"^security/policies/from-zone/([^/]+)/to-zone/([^/]+)/policy/([^/]+)/(.+)$", "sz", "dz", "name", "leaf")
    lst = lambda suffix: F.transform(F.array_sort(F.collect_list(F.when(F.col("leaf").endswith(suffix), F.struct("ordinal", "value")))), lambda x: x["value"])
    act = F.when(F.col("leaf").contains("permit"), "allow").when(F.col("leaf").contains("deny") | F.col("leaf").contains("reject"), "deny")
    side = F.col("leaf").rlike("(source-address|destination-address|application)$")
    g = q.groupBy("device_id", "sz", "dz", "name").agg(F.min("ordinal").alias("at"), lst("source-address").alias("source"), lst("destination-address").alias("destination"), lst("application").alias("services"),
                                                       F.max_by(act, F.when(~side & act.isNotNull(), F.col("ordinal"))).alias("action"), F.bool_or(~side & act.isNull() & F.col("leaf").contains("log")).alias("logged"))
    ord_ = F.row_number().over(W.partitionBy("device_id").orderBy("at"))
    rules = g.select("device_id", F.concat("sz", F.lit("->"), "dz", F.lit(":"), "name").alias("id"), "name", ord_.alias("ord"), F.lit(True).alias("enabled"), F.coalesce("action", F.lit("deny")).alias("action"), "source", "destination", "services",
                     F.array("sz").alias("source_zones"), F.array("dz").alias("destination_zones"), F.when(F.col("logged"), F.lit(True)).alias("logging"))
    d = r.where(p.rlike(r"security/policies/default-policy(/(permit-all|deny-all))?$")).groupBy("device_id").agg(F.bool_or(p.endswith("permit-all") | F.lower(F.concat("value", "raw")).contains("permit")).alias("permit"))
    u = z.where(F.lower("name").isin(OUTSIDE)).select("device_id", F.col("name").alias("zone"))
    pol = _policy(r.select("device_id").distinct(), "deny", False, False, u).join(d, "device_id", "left").withColumn("default_action", F.when(F.col("permit"), "allow").otherwise("deny")).withColumn("default_action_observed", F.col("permit").isNotNull())
    objects = reduce(DataFrame.unionByName, [addr, grp(sets, "address_group"), app, grp(asets, "service_group"), grp(z, "zone")]).dropDuplicates(["device_id", "name"])
    return _finish(rules, objects, members, pol)


def _unesc(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "%2F", "/"), "%5D", "]"), "%25", "%")


def panos_rules(records: DataFrame) -> dict[str, DataFrame]:
    """XML rulebases: pre, local and post in that order; what App-ID, negation or default ports decide is undecidable here."""
    records = cut_lineage(records)  # every table below reads them
    r, p = records, F.col("path")

    def entry(section):
        rx = rf"^.*/{section}/entry\[([^\]]*)\]/(.+)$"
        return r.where(p.rlike(rx)).select("device_id", "ordinal", "value", _unesc(F.regexp_extract(p, rx, 1)).alias("name"), F.regexp_extract(p, rx, 2).alias("leaf"))

    a = entry("address").where(F.col("leaf").isin("ip-netmask", "ip-range", "fqdn", "ip-wildcard")).groupBy("device_id", "name").agg(F.array(F.max_by("value", "ordinal")).alias("values"))
    addr = a.select("device_id", "name", F.lit("address").alias("kind"), "values", no_attrs().alias("attrs"))
    ag, sg, z = entry("address-group"), entry("service-group"), entry("zone")
    dyn = ag.groupBy("device_id", "name").agg(F.bool_or(F.col("leaf").startswith("dynamic")).alias("dyn"))
    agrp = dyn.select("device_id", "name", F.lit("address_group").alias("kind"), no_strings().alias("values"), F.when(F.col("dyn"), F.create_map(F.lit("members_unknown"), F.lit("true"))).otherwise(no_attrs()).alias("attrs"))
    mem = lambda d, cond: d.where(cond).where("value != ''").groupBy("device_id", F.col("name").alias("parent"), F.col("value").alias("child")).agg(F.min("ordinal").alias("ordinal"))
    members = mem(ag, F.col("leaf").isin("member", "static/member")).unionByName(mem(sg, F.col("leaf").endswith("member"))).unionByName(mem(z, F.col("leaf").rlike(r"^network/(?:layer3|layer2|virtual-wire|tap)/member$")))
    s = entry("service").where(F.col("leaf").rlike(r"^protocol/(tcp|udp|sctp)/port$")).withColumn("v", F.explode(F.split("value", ","))).where("trim(v) != ''")
    svc = s.groupBy("device_id", "name").agg(F.collect_set(F.concat(F.split_part("leaf", F.lit("/"), F.lit(2)), F.lit("/"), F.trim("v"))).alias("values")).select("device_id", "name", F.lit("service").alias("kind"), "values", no_attrs().alias("attrs"))
    named = lambda d, k: d.select("device_id", "name").distinct().select("device_id", "name", F.lit(k).alias("kind"), no_strings().alias("values"), no_attrs().alias("attrs"))
    rx = r"^(.*?)/(rulebase|pre-rulebase|post-rulebase)/security/rules/entry\[([^\]]*)\]/(.+)$"
    q = r.where(p.rlike(rx)).select("device_id", "ordinal", "value", F.regexp_extract(p, rx, 1).alias("base"), F.regexp_extract(p, rx, 2).alias("book"), _unesc(F.regexp_extract(p, rx, 3)).alias("name"), F.regexp_extract(p, rx, 4).alias("leaf"))
    many = lambda leaf: F.transform(F.array_sort(F.collect_list(F.when(F.col("leaf") == leaf, F.struct("ordinal", "value")))), lambda x: x["value"])
    one = lambda leaf: F.lower(F.trim(F.coalesce(F.min_by("value", F.when(F.col("leaf") == leaf, F.col("ordinal"))), F.lit(""))))
    g = q.groupBy("device_id", "base", "book", "name").agg(F.min("ordinal").alias("at"), *[many(f"{x}/member").alias(x) for x in ("source", "destination", "service", "application", "from", "to")],
                                                           *[one(x).alias(x.replace("-", "_")) for x in ("disabled", "action", "log-end", "negate-source", "negate-destination")])
    g = g.withColumn("ord", F.row_number().over(W.partitionBy("device_id").orderBy(F.when(F.col("book") == "pre-rulebase", 0).when(F.col("book") == "rulebase", 1).otherwise(2), "at")))
    dflt = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit("any")))
    zone = lambda c: F.filter(c, lambda x: (x != "") & (x != "any"))
    apps = F.filter("application", lambda x: (x != "") & (x != "any"))
    und = F.concat_ws("; ", F.when(F.size(apps) > 0, F.concat(F.lit("app-id:"), F.array_join(F.slice(apps, 1, 6), ","))), F.when(F.col("negate_source") == "yes", "negate-source"), F.when(F.col("negate_destination") == "yes", "negate-destination"),
                      F.when(F.array_contains("service", "application-default"), "application-default"))
    rules = g.select("device_id", F.concat_ws(":", "book", "name").alias("id"), F.concat("name", F.lit(" ["), "book", F.lit("#"), F.col("ord").cast("string"), F.lit("]")).alias("name"), "ord", (F.col("disabled") != "yes").alias("enabled"),
                     F.when(F.col("action").isin("allow", "permit"), "allow").otherwise("deny").alias("action"), dflt("source").alias("source"), dflt("destination").alias("destination"), dflt("service").alias("services"),
                     zone("from").alias("source_zones"), zone("to").alias("destination_zones"), F.when(F.col("log_end") == "yes", F.lit(True)).alias("logging"), F.nullif(und, F.lit("")).alias("program"))
    u = z.where(F.lower("name").isin(OUTSIDE)).select("device_id", F.col("name").alias("zone"))
    objects = reduce(DataFrame.unionByName, [addr, agrp, svc, named(sg, "service_group"), named(z, "zone")]).dropDuplicates(["device_id", "name"])
    return _finish(rules, _with_predefined(rules, objects, members, PREDEFINED["panos"]), members, _policy(r.select("device_id").distinct(), "deny", False, False, u))


def junos_xml_rules(records: DataFrame) -> dict[str, DataFrame]:
    """Zone-pair policies of an XML export, keyed by pair and rule, in document order."""
    records = cut_lineage(records)  # every table below reads them
    r, p = records, F.col("path")
    base = r"configuration/security/policies"
    rx = base + r"/policy\[([^\]]*)\]/policy\[([^\]]*)\]/(.+)$"
    q = r.where(p.rlike(rx)).select("device_id", "ordinal", "value", F.regexp_extract(p, rx, 1).alias("pair"), F.regexp_extract(p, rx, 2).alias("rk"), F.regexp_extract(p, rx, 3).alias("leaf"))
    zr = base + r"/policy\[([^\]]*)\]/(from-zone-name|to-zone-name)$"
    z = r.where(p.rlike(zr)).select("device_id", F.regexp_extract(p, zr, 1).alias("pair"), F.regexp_extract(p, zr, 2).alias("side"), "value", "ordinal")
    zp = z.groupBy("device_id", "pair").agg(F.min_by("value", F.when(F.col("side") == "from-zone-name", F.col("ordinal"))).alias("sz"), F.min_by("value", F.when(F.col("side") == "to-zone-name", F.col("ordinal"))).alias("dz"), F.min("ordinal").alias("pat"))
    many = lambda leaf: F.transform(F.array_sort(F.collect_list(F.when(F.col("leaf") == leaf, F.struct("ordinal", "value")))), lambda x: x["value"])
    g = q.groupBy("device_id", "pair", "rk").agg(F.min("ordinal").alias("at"), F.min_by("value", F.when(F.col("leaf") == "name", F.col("ordinal"))).alias("nm"), *[many(f"match/{x}").alias(x.replace("-", "_")) for x in ("source-address", "destination-address", "application")],
                                                 F.bool_or(F.col("leaf").rlike(r"^then/permit")).alias("permit"), F.bool_or(F.col("leaf").isin("then/log/session-close", "then/log/session-init")).alias("logged")).join(zp, ["device_id", "pair"], "left")
    dflt = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit("any")))
    zone = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.array(c)).otherwise(no_strings())
    nm = F.coalesce("nm", _unesc(F.col("rk")))
    rules = g.select("device_id", F.concat(F.coalesce("sz", F.lit("")), F.lit("->"), F.coalesce("dz", F.lit("")), F.lit(":"), nm).alias("id"), nm.alias("name"), F.row_number().over(W.partitionBy("device_id").orderBy("pat", "at")).alias("ord"), F.lit(True).alias("enabled"),
                     F.when(F.col("permit"), "allow").otherwise("deny").alias("action"), dflt("source_address").alias("source"), dflt("destination_address").alias("destination"), dflt("application").alias("services"),
                     zone("sz").alias("source_zones"), zone("dz").alias("destination_zones"), F.when(F.col("logged"), F.lit(True)).alias("logging"))
    ar = r"/address-book.*/address\[([^\]]*)\]/ip-prefix$"
    a = r.where(p.rlike(ar)).groupBy("device_id", _unesc(F.regexp_extract(p, ar, 1)).alias("name")).agg(F.array(F.min_by("value", "ordinal")).alias("values")).select("device_id", "name", F.lit("address").alias("kind"), "values", no_attrs().alias("attrs"))
    zn = z.select("device_id", F.col("value").alias("name")).where("name != ''").distinct()
    zones = zn.select("device_id", "name", F.lit("zone").alias("kind"), no_strings().alias("values"), no_attrs().alias("attrs"))
    d = r.where(p.rlike(base + r"/default-policy/(permit-all|deny-all)$")).groupBy("device_id").agg(F.bool_or(p.endswith("permit-all")).alias("permit"))
    pol = _policy(r.select("device_id").distinct(), "deny", False, False, zn.where(F.lower("name").isin(OUTSIDE)).select("device_id", F.col("name").alias("zone"))).join(d, "device_id", "left")
    pol = pol.withColumn("default_action", F.when(F.col("permit"), "allow").otherwise("deny")).withColumn("default_action_observed", F.col("permit").isNotNull())
    objects = zones.unionByName(a).dropDuplicates(["device_id", "name"])
    none = rules.sparkSession.createDataFrame([], "device_id string, parent string, child string, ordinal bigint")
    return _finish(rules, _with_predefined(rules, objects, none, PREDEFINED["junos_xml"], groups=False), none, pol)
