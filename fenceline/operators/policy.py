"""Policy graph: object resolution, exposure, hygiene and first-match reachability.

Tables
  objects(device_id, name, kind, values[], attrs{}), members(device_id, parent, child, ordinal)
  rules(device_id, id, name, ord, enabled, action, source[], destination[], services[], source_zones[],
        destination_zones[], logging, hit_count, program, evidence)
  policies(device_id, default_action, default_action_observed, unordered, untrusted_zones[])
  resolved rules: rules plus src/dst/svc (values) and src_bad/dst_bad/svc_bad (names that did not resolve)
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import net
from ..functions.text import looks_like_literal
from ..session import BROADCAST_ROWS, cut_lineage
from ..types import ALLOW_WORDS, shuffled, small_side

def no_strings() -> Column:
    return F.array().cast("array<string>")

SIDES = [("src", "source"), ("dst", "destination"), ("svc", "services")]


def allows(action: Column) -> Column:
    return F.lower(action).isin(ALLOW_WORDS)


def rule_name(name="name", rid="id") -> Column:
    return F.coalesce(F.when(F.col(name) != "", F.col(name)), F.col(rid))


# ------------------------------------------------------------------ resolution

def leaf_resolution(name: Column, found: Column, values: Column, attrs: Column, has_members: Column) -> Column:
    """State of a name that needs no recursion; NULL for a group with members."""
    unknown = F.coalesce(attrs["members_unknown"] == "true", F.lit(False))
    proto = F.coalesce(attrs["protocol_unknown"].isNotNull(), F.lit(False)) & (F.coalesce(F.size(values), F.lit(0)) <= 0)
    return (F.when(F.lower(name).isin(net.ANY_NAMES), "RESOLVED")
            .when(~found, F.when(looks_like_literal(name), "RESOLVED").otherwise("UNRESOLVED"))
            .when(unknown & ~has_members, "UNSUPPORTED").when(proto, "UNSUPPORTED")
            .when(has_members, F.lit(None)).when(F.coalesce(F.size(values), F.lit(0)) <= 0, "UNRESOLVED").otherwise("RESOLVED"))


def resolve_objects(objects: DataFrame, members: DataFrame, names: DataFrame | None = None,
                    propagate_unsupported: bool = True) -> DataFrame:
    """G1: every name's state, values and path, group membership followed to the leaves.

    Worked from the leaves up, one round per level of nesting: a group is decided once its members are, or as
    soon as the first bad member in order is known. What never gets decided runs into a cycle. No path is ever
    enumerated, so a diamond-shaped membership costs one row per edge.
    """
    objs = objects.groupBy("device_id", "name").agg(F.first("values").alias("values"), F.first("attrs").alias("attrs"))
    edges = members.groupBy("device_id", F.col("parent").alias("name"), "child").agg(F.min("ordinal").alias("pos"))
    parents = edges.select("device_id", "name").distinct().withColumn("has_members", F.lit(True))
    asked = objs.select("device_id", "name").unionByName(edges.select("device_id", F.col("child").alias("name")))
    if names is not None:
        asked = asked.unionByName(names.select("device_id", "name"))
    n = (asked.distinct().join(objs.withColumn("found", F.lit(True)), ["device_id", "name"], "left")
         .join(parents, ["device_id", "name"], "left"))
    found, hm = F.coalesce("found", F.lit(False)), F.coalesce("has_members", F.lit(False))
    n = n.withColumn("hm", found & hm).withColumn("state", leaf_resolution(F.col("name"), found, F.col("values"), F.col("attrs"), hm))
    vals = (F.when(F.col("state") != "RESOLVED", no_strings()).when(F.lower("name").isin(net.ANY_NAMES), F.array(F.lit("0.0.0.0/0")))
            .when(found, F.col("values")).otherwise(F.array("name")))
    done = cut_lineage(n.where("state is not null").select("device_id", "name", "state", vals.alias("values"), F.array("name").alias("path")))
    groups = n.where("state is null").select("device_id", "name")
    todo = cut_lineage(edges.join(groups, ["device_id", "name"], "left_semi").select("device_id", "name", "pos", "child"))
    parts = [done]
    bad = ["CYCLIC", "UNRESOLVED"] + (["UNSUPPORTED"] if propagate_unsupported else [])
    while True:  # one round per level of nesting, however deep
        known = reduce(DataFrame.unionByName, parts)
        j = todo.join(known.select("device_id", F.col("name").alias("child"), "state", F.col("values").alias("v"),
                                   F.col("path").alias("cp")), ["device_id", "child"], "left")
        agg = j.groupBy("device_id", "name").agg(
            F.min(F.when(F.col("state").isNull(), F.col("pos"))).alias("open"),
            F.min(F.when(F.col("state").isin(bad), F.col("pos"))).alias("badpos"),
            F.min_by(F.struct("state", "cp"), F.when(F.col("state").isin(bad), F.col("pos"))).alias("b"),
            F.collect_list(F.when(F.col("state").isNotNull(), F.struct("pos", "child", "v"))).alias("kids"))
        agg = agg.where("open is null or badpos < open")
        kids = F.array_sort("kids")
        flat = F.array_distinct(F.flatten(F.transform(kids, lambda k: F.coalesce(k["v"], no_strings()))))
        st = (F.when(F.col("badpos").isNotNull(), F.when(F.col("b.state") == "CYCLIC", "CYCLIC").otherwise(F.col("b.state")))
              .when(F.size(flat) == 0, "UNRESOLVED").otherwise("RESOLVED"))
        new = cut_lineage(agg.select(
            "device_id", "name", st.alias("state"),
            F.when(F.col("badpos").isNotNull(), no_strings()).otherwise(flat).alias("values"),
            F.when(F.col("badpos").isNotNull(), F.concat(F.array("name"), "b.cp"))
            .otherwise(F.concat(F.array("name"), F.transform(kids, lambda k: k["child"]))).alias("path")))
        if new.isEmpty():
            break
        parts.append(new)
        todo = cut_lineage(todo.join(new, ["device_id", "name"], "left_anti"))
    known = reduce(DataFrame.unionByName, parts)
    left = todo.join(known.select("device_id", F.col("name").alias("child")), ["device_id", "child"], "left_anti")
    if left.isEmpty():
        return known
    # What remains follows its first undecided member until it meets itself.
    step = cut_lineage(left.groupBy("device_id", "name").agg(F.min_by("child", "pos").alias("next")))
    walk = step.select("device_id", "name", F.array("name", "next").alias("path"))
    closed = []
    while True:
        looped = F.size(F.array_distinct("path")) < F.size("path")
        closed.append(walk.where(looped))
        walk = cut_lineage(walk.where(~looped).join(step.select("device_id", F.col("name").alias("at"), "next"),
                                                    (F.element_at("path", -1) == F.col("at")) & (walk["device_id"] == step["device_id"]))
                           .select(walk["device_id"], walk["name"], F.concat("path", F.array("next")).alias("path")))
        if walk.isEmpty():
            break
    cyc = reduce(DataFrame.unionByName, closed).select("device_id", "name", F.lit("CYCLIC").alias("state"), no_strings().alias("values"), "path")
    return known.unionByName(cyc)


def rule_names(rules: DataFrame) -> DataFrame:
    return rules.select("device_id", F.explode(F.concat("source", "destination", "services")).alias("name")).distinct()


def resolve_rules(rules: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Each side's values and the names on it that did not resolve.

    A name that the resolutions do not hold is no object: a literal stands for itself, anything else does not resolve. So names are looked up
    where a device has objects, rules that name one get theirs as a map, and all else is worked out within the rule.
    """
    known = small_side(resolutions.select("device_id", "name", "state", "values"), 100000)
    refs = rules.select("device_id", "id", F.explode(F.array_distinct(F.concat(*[F.coalesce(c, no_strings()) for _, c in SIDES]))).alias("name"))
    held = refs.join(known, ["device_id", "name"]).groupBy("device_id", "id").agg(
        F.map_from_entries(F.collect_set(F.struct("name", F.struct("state", "values")))).alias("__held"))
    out = rules.join(small_side(cut_lineage(held), 10000), ["device_id", "id"], "left")

    def state(n):
        return F.coalesce(F.element_at("__held", n)["state"], F.when(F.lower(n).isin(net.ANY_NAMES) | looks_like_literal(n), "RESOLVED"), F.lit("UNRESOLVED"))

    def values(n):
        alone = F.when(F.lower(n).isin(net.ANY_NAMES), F.array(F.lit("0.0.0.0/0"))).otherwise(F.array(n))
        return F.when(F.element_at("__held", n)["state"].isNotNull(), F.coalesce(F.element_at("__held", n)["values"], no_strings())).otherwise(alone)

    for k, c in SIDES:
        ok = F.array_distinct(F.flatten(F.transform(F.filter(c, lambda n: state(n) == "RESOLVED"), values)))
        out = out.withColumn(f"{k}_bad", F.coalesce(F.filter(c, lambda n: state(n) != "RESOLVED"), no_strings())).withColumn(k, F.coalesce(ok, no_strings()))
    return out.drop("__held")


def side_state(r: DataFrame) -> DataFrame:
    """How complete each rule is."""
    bad = F.size("src_bad") + F.size("dst_bad") + F.size("svc_bad")
    return r.withColumn("side_state", F.when(bad == 0, "RESOLVED").otherwise("UNEVALUABLE")).withColumn(
        "bad_names", F.concat("src_bad", "dst_bad", "svc_bad"))


def unresolved(resolutions: DataFrame) -> DataFrame:
    """Every name that is not RESOLVED, with its path."""
    return resolutions.where("state != 'RESOLVED'").select("device_id", "name", "state", "path")


# ------------------------------------------------------------------ exposure

# Ports that administer a device, and ports that hold data.
ADMIN_PORTS = {22: "ssh", 23: "telnet", 3389: "rdp", 5900: "vnc", 161: "snmp", 443: "https-mgmt", 80: "http-mgmt"}
SENSITIVE_PORTS = {3306: "mysql", 5432: "postgres", 1433: "mssql", 27017: "mongodb", 6379: "redis",
                   9200: "elasticsearch", 445: "smb", 135: "rpc", 389: "ldap"}
# Zone names that are untrusted unless told otherwise.
UNTRUSTED_DEFAULT = ["wan", "untrust", "internet", "public", "wlan", "sslvpn"]


def rule_ports(svc: Column, ports: dict, any_service_is_all: bool = True) -> Column:
    """Which of the given ports a list of services covers. Ranges are intersected, never expanded."""
    def covers(p):
        def one(v):
            s = net.service(v)
            hit = F.coalesce(s["proto"].isin("tcp", "udp") & F.lit(p).between(s["lo"], s["hi"]), F.lit(False))
            words = ["any", "all"] + (net.INTERNET if any_service_is_all else [])
            return hit | F.lower(v).isin(words)
        return F.exists(svc, one)
    return F.filter(F.array(*[F.when(covers(p), F.lit(p)) for p in sorted(ports)]), lambda x: x.isNotNull())


def _with_untrusted(r: DataFrame, policies: DataFrame) -> DataFrame:
    u = policies.select("device_id", F.transform("untrusted_zones", F.lower).alias("u"))
    r = r.join(small_side(u, BROADCAST_ROWS), "device_id", "left")
    named = F.when(F.coalesce(F.size("u"), F.lit(0)) > 0, F.col("u")).otherwise(F.array(*[F.lit(z) for z in UNTRUSTED_DEFAULT]))
    zones = F.transform("source_zones", F.lower)
    wide = F.exists("src", lambda v: v.isin(net.INTERNET))
    return r.withColumn("from_untrusted", F.when(F.coalesce(F.size("source_zones"), F.lit(0)) > 0, F.arrays_overlap(zones, named)).otherwise(wide)).drop("u")


def _exposed_by(fact: str, any_service_is_all: bool) -> tuple[list[str], Column, Column]:
    """Of one exposure fact: the sides that must be readable, the ports a rule opens, and whether it is a hit but for where it is open from."""
    bad = {"admin": ["src_bad", "dst_bad", "svc_bad"], "any_any": ["src_bad", "dst_bad", "svc_bad"]}.get(fact, ["src_bad", "svc_bad"])
    if fact == "any_any":
        svc_any = F.exists("svc", lambda v: F.lower(v).isin(["any", "all"] + (net.INTERNET if any_service_is_all else []))) | (F.size("services") == 0)
        return bad, F.array().cast("array<int>"), F.array_contains("src", "0.0.0.0/0") & F.array_contains("dst", "0.0.0.0/0") & svc_any
    ports = rule_ports(F.col("svc"), SENSITIVE_PORTS if fact == "sensitive" else ADMIN_PORTS, any_service_is_all)
    return bad, ports, F.size(ports) > 0


def _exposure_status(fact: str, unread: Column, has: Column, no_dst: Column) -> Column:
    """skipped, hit or NULL."""
    hit = has if fact == "any_any" else F.col("from_untrusted") & has
    return F.when(unread | (hit & no_dst) if fact == "admin" else unread, "skipped").when(hit, "hit")


def _unread(bad: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.size(b) > 0 for b in bad])


def exposure(resolved: DataFrame, policies: DataFrame, fact: str, any_service_is_all: bool = True) -> DataFrame:
    """Rule rows of one exposure fact with status hit | skipped. Rules that do neither are absent.

    fact: admin (admin ports from outside) | admin_source (unrestricted management source) |
    sensitive (data ports from outside) | any_any.
    """
    r = _with_untrusted(resolved.where(F.col("enabled") & allows(F.col("action"))), policies)
    bad, ports, has = _exposed_by(fact, any_service_is_all)
    return (r.withColumn("status", _exposure_status(fact, _unread(bad), has, F.size("dst") == 0)).where("status is not null")
            .select("device_id", F.col("id").alias("rule_id"), rule_name().alias("rule"), "status",
                    F.when(F.col("status") == "hit", ports).alias("ports"), F.array_sort("dst").alias("dst"),
                    F.slice(F.concat(*bad), 1, 3).alias("unread")))


def fact_status(resolved: DataFrame, exposed: DataFrame, policies: DataFrame) -> DataFrame:
    """A fact per device: OBSERVED hits, UNPARSED when only unreadable rules remain, clean otherwise."""
    a = exposed.groupBy("device_id").agg(F.count_if(F.col("status") == "hit").alias("hits"), F.count_if(F.col("status") == "skipped").alias("skipped"))
    d = policies.select("device_id").join(a, "device_id", "left").na.fill(0, ["hits", "skipped"])
    return d.withColumn("state", F.when(F.col("hits") > 0, "OBSERVED").when(F.col("skipped") > 0, "UNPARSED").otherwise("DEFAULT_ASSUMED"))


def policy_observations(resolved: DataFrame, policies: DataFrame, zones: DataFrame | None = None,
                        any_service_is_all: bool = True) -> DataFrame:
    """Rule leaves, the default action and the exposure facts as observations."""
    from ..types import tv_bool, tv_list, tv_num, tv_str
    scope = rule_name()
    ev = F.coalesce("evidence", F.array().cast("array<struct<file:string,line:int,raw:string,record_id:string>>"))
    has_ev = F.size(ev) > 0

    def leaf(name, value, state=None):
        st = F.when(has_ev, "OBSERVED").otherwise("DEFAULT_ASSUMED") if state is None else state
        return F.struct(F.lit(f"firewall.rules.{name}").alias("field"), st.alias("state"), value.alias("value"))

    def side(name, k):
        bad = F.size(f"{k}_bad") > 0
        return leaf(name, F.when(~bad, tv_list(F.col(k))), F.when(bad, "UNPARSED").otherwise("OBSERVED"))

    direction = F.concat(F.array_join("source_zones", ","), F.lit("->"), F.array_join("destination_zones", ","))
    zoned = (F.size("source_zones") + F.size("destination_zones")) > 0
    leaves = [leaf("id", tv_str(F.col("id"))), leaf("action", tv_str(F.col("action"))), leaf("position", tv_num(F.col("ord"))),
              F.when(F.col("logging").isNotNull(), leaf("log", tv_bool(F.col("logging")))),
              side("source", "src"), side("destination", "dst"), side("service", "svc"),
              F.when(zoned, leaf("direction", tv_str(direction)))]
    out = (resolved.select("device_id", scope.alias("scope"), F.col("ord").cast("long").alias("ordinal"), ev.alias("evidence"),
                           F.explode(F.array(*leaves)).alias("o")).where("o is not null")
           .select("device_id", "o.field", "scope", "ordinal", "o.state", "o.value", "evidence"))
    none = F.array().cast("array<struct<file:string,line:int,raw:string,record_id:string>>")
    default = policies.where("default_action_observed").select(
        "device_id", F.lit("firewall.default_action").alias("field"), F.lit(None).cast("string").alias("scope"),
        F.lit(0).cast("long").alias("ordinal"), F.lit("DEFAULT_ASSUMED").alias("state"),
        tv_str(F.when(allows(F.col("default_action")), "permit").otherwise(F.col("default_action"))).alias("value"), none.alias("evidence"))
    return reduce(DataFrame.unionByName, [out, default]).withColumn("source", F.lit("parser")).withColumn("confidence", F.lit(1.0)).unionByName(exposure_observations(resolved, policies, any_service_is_all))


#: The fields that are worked out from a device's whole policy, by exposure fact.
EXPOSURE_FIELDS = {"admin": "exposure.admin_ports_open_to_internet", "any_any": "exposure.any_any_rules", "sensitive": "exposure.unrestricted_ingress"}


def exposure_observations(resolved: DataFrame, policies: DataFrame, any_service_is_all: bool = True) -> DataFrame:
    """The exposure facts of every device with a policy as observations."""
    from ..types import tv_list
    none = F.array().cast("array<struct<file:string,line:int,raw:string,record_id:string>>")
    # all facts of a device come out of one pass over its rules, of which only what the facts need is moved
    r = resolved.where(F.col("enabled") & allows(F.col("action"))).select(
        "device_id", "source_zones", F.filter("src", lambda v: v.isin(net.INTERNET)).alias("src"), (F.size("dst") == 0).alias("no_dst"),
        *[F.struct(_unread(bad).alias("unread"), has.alias("has"), F.when(F.size(ports) > 0, F.concat("id", F.lit(":"), F.array_join(ports.cast("array<string>"), "/"))).otherwise(F.col("id")).alias("text")).alias(fact)
          for fact in EXPOSURE_FIELDS for bad, ports, has in [_exposed_by(fact, any_service_is_all)]])
    r = _with_untrusted(r, policies)
    status = {fact: _exposure_status(fact, F.col(f"{fact}.unread"), F.col(f"{fact}.has"), F.col("no_dst")) for fact in EXPOSURE_FIELDS}
    a = r.groupBy("device_id").agg(*[F.struct(F.count_if(c == "hit").alias("hits"), F.count_if(c == "skipped").alias("skipped"), F.array_sort(F.collect_list(F.when(c == "hit", F.col(f"{fact}.text")))).alias("h")).alias(fact)
                                     for fact, c in status.items()])

    def observed(fact):
        state = F.when(F.col(f"{fact}.hits") > 0, "OBSERVED").when(F.col(f"{fact}.skipped") > 0, "UNPARSED").otherwise("DEFAULT_ASSUMED")
        return F.struct(F.lit(EXPOSURE_FIELDS[fact]).alias("field"), state.alias("state"), F.when(state != "UNPARSED", tv_list(F.coalesce(f"{fact}.h", no_strings()))).alias("value"))

    d = policies.select("device_id").join(shuffled(a), "device_id", "left").select("device_id", F.explode(F.array(*[observed(f) for f in EXPOSURE_FIELDS])).alias("o"))
    return d.select("device_id", "o.field", F.lit(None).cast("string").alias("scope"), F.lit(0).cast("long").alias("ordinal"), "o.state", "o.value", none.alias("evidence")).withColumn("source", F.lit("parser")).withColumn("confidence", F.lit(1.0))


# ------------------------------------------------------------------ hygiene

def _universe(values: Column) -> Column:
    wide = (F.size(values) == 0) | F.exists(values, lambda v: v.isin("0.0.0.0/0", "::/0", "any", "all"))
    return F.when(wide, F.array(F.lit("*"))).otherwise(F.array_sort(F.array_distinct(values)))


def _zone_set(z: Column) -> Column:
    low = F.array_sort(F.array_distinct(F.transform(z, F.lower)))
    return F.when(F.coalesce(F.size(z), F.lit(0)) <= 0, F.array(F.lit("*"))).otherwise(low)


def _prepared(resolved: DataFrame) -> DataFrame:
    ident = F.lower(F.concat_ws(" ", "id", "name"))
    ok = (F.size("src_bad") + F.size("dst_bad") + F.size("svc_bad")) == 0
    return (resolved.withColumn("family", F.when(ident.contains("v6"), "v6").otherwise("v4")).withColumn("readable", ok)
            .withColumn("S", _universe(F.col("src"))).withColumn("D", _universe(F.col("dst"))).withColumn("V", _universe(F.col("svc")))
            .withColumn("Zs", _zone_set(F.col("source_zones"))).withColumn("Zd", _zone_set(F.col("destination_zones"))))


def unused(resolved: DataFrame) -> DataFrame:
    """Enabled and counted zero; an unpublished counter is not zero."""
    return resolved.where(F.col("enabled") & (F.col("hit_count") == 0))


def overly_permissive(resolved: DataFrame) -> DataFrame:
    """An enabled allow with at least two sides open."""
    wide = sum(F.array_contains(k, "*").cast("int") for k in ("S", "D", "V"))
    return (_prepared(resolved).where(F.col("readable") & F.col("enabled") & allows(F.col("action"))).withColumn("wide", wide)
            .where("wide >= 2").withColumn("severity", F.when(F.col("wide") == 3, "high").otherwise("medium")))


FEW = 32  # groups of a device's family up to this size are compared rule by rule
BIG = 16  # sets above this size are matched without indexing their members


def covered(resolved: DataFrame, policies: DataFrame) -> DataFrame:
    """Rules an earlier rule fully covers, with the first such rule.

    Small groups are compared within themselves. In others copies are folded first: rules with equal sets share one signature, and only a signature's earliest rule can
    be the first coverer. Signatures are then matched through an index on set members instead of pairwise: a
    coverer posts its members, a covered set probes with its rarest member, so a popular member costs little.
    """
    p = _prepared(resolved).where("readable and enabled").join(
        policies.where("unordered").select("device_id"), "device_id", "left_anti")
    sizes = cut_lineage(p.groupBy("device_id", "family").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    r = _covered_among_few(p, sizes.where(F.col("n") <= FEW).select("device_id", "family"))
    crowded = sizes.where(F.col("n") > FEW).select("device_id", "family")
    if not crowded.isEmpty():
        r = r.unionByName(_covered_by_index(p.join(crowded, ["device_id", "family"], "left_semi").select(*p.columns)))
    same = F.lower("c.action") == F.lower("action")
    kind = F.when(F.col("hit_count") > 0, "disputed_shadow").when(same, "redundant_rule").otherwise("shadowed_rule")
    return (r.withColumn("kind", kind).withColumn("severity", F.when(F.col("kind") == "shadowed_rule", "high").otherwise("low"))
            .withColumn("related", F.col("c.nm")).withColumn("related_id", F.col("c.id")).drop("c"))


def _covered_among_few(p: DataFrame, groups: DataFrame) -> DataFrame:
    """Prepared rules of groups of FEW rules at most, each with its first coverer c: every rule beside its group's rules, which are one bounded array."""
    sides = ["S", "D", "V", "Zs", "Zd"]
    few = p.where(" and ".join(f"{k} is not null" for k in sides)).join(groups, ["device_id", "family"], "left_semi")
    held = few.groupBy("device_id", "family").agg(F.collect_list(F.struct("ord", "id", rule_name().alias("nm"), "action", *sides)).alias("g"))

    def covers(e):
        earlier = (e["ord"] < F.col("ord")) | ((e["ord"] == F.col("ord")) & (e["id"] < F.col("id")))
        return reduce(lambda a, b: a & b, [earlier, *[F.array_contains(e[k], "*") | (F.size(F.array_except(F.col(k), e[k])) == 0) for k in sides]])

    first = F.array_min(F.transform(F.filter("g", covers), lambda e: F.struct(e["ord"].alias("ord"), e["id"].alias("id"), e["nm"].alias("nm"), e["action"].alias("action"))))
    return few.join(held, ["device_id", "family"]).withColumn("c", first).where("c is not null").select(*p.columns, "c")


def _covered_by_index(p: DataFrame) -> DataFrame:
    """Prepared rules of any groups, each with its first coverer c."""
    key = ["device_id", "family", "S", "D", "V", "Zs", "Zd"]
    sig = p.groupBy(*key).agg(F.min_by(F.struct("ord", "id", rule_name().alias("nm"), "action"), F.struct("ord", "id")).alias("f"))
    sig = sig.withColumn("sid", F.struct(F.xxhash64(*key).alias("a"), F.hash(*key).alias("b")))
    mode = {k: F.when(F.array_contains(k, "*"), "*").when(F.size(k) > BIG, "+").otherwise("e") for k in "SDV"}
    post = sig.withColumn("pat", F.concat(*[mode[k] for k in "SDV"]))
    for k in "SDV":
        post = post.withColumn(f"k{k}", F.explode(F.when(mode[k] == "e", F.col(k)).otherwise(F.array(mode[k]))))
    pats = post.groupBy("device_id", "family").agg(F.collect_set("pat").alias("pats"))
    # the rarest member of each set, by how many signatures of the policy hold it
    mem = reduce(DataFrame.unionByName, [sig.select("device_id", "family", "sid", F.lit(k).alias("dim"), F.explode(k).alias("m")) for k in "SDV"])
    freq = mem.groupBy("device_id", "family", "dim", "m").count()
    rare = (mem.join(freq, ["device_id", "family", "dim", "m"]).groupBy("device_id", "family", "sid")
            .pivot("dim", list("SDV")).agg(F.min_by("m", F.struct("count", "m"))))
    rare = rare.select("device_id", "family", "sid", *[F.col(k).alias(f"r{k}") for k in "SDV"])
    probe = sig.join(rare, ["device_id", "family", "sid"]).join(pats, ["device_id", "family"]).withColumn("pat", F.explode("pats")).drop("pats")
    for i, k in enumerate("SDV"):
        at = F.substring("pat", i + 1, 1)
        probe = probe.withColumn(f"k{k}", F.when(at == "e", F.col(f"r{k}")).otherwise(at))
    # an open side is covered only by an open side
    probe = probe.where(reduce(lambda a, b: a & b, [(F.col(f"r{k}") != "*") | (F.col(f"k{k}") == "*") for k in "SDV"]))
    e = post.select("device_id", "family", "pat", "kS", "kD", "kV", F.col("f").alias("ef"), *[F.col(k).alias(f"e{k}") for k in ("S", "D", "V", "Zs", "Zd")])
    j = probe.join(e, ["device_id", "family", "pat", "kS", "kD", "kV"]).where("ef.ord < f.ord or (ef.ord = f.ord and ef.id <= f.id)")
    inside = reduce(lambda a, b: a & b, [F.array_contains(f"e{k}", "*") | (F.size(F.array_except(k, f"e{k}")) == 0) for k in ("S", "D", "V", "Zs", "Zd")])
    first = j.where(inside).groupBy(*key).agg(F.min_by("ef", F.struct("ef.ord", "ef.id")).alias("c"))
    # the signature's own earliest rule covers its later copies too
    return p.join(first, key).where("c.ord < ord or (c.ord = ord and c.id < id)").select(*p.columns, "c")


def orphaned_objects(objects: DataFrame, members: DataFrame, rules: DataFrame) -> DataFrame:
    """Objects no rule and no group refers to."""
    used = rules.select("device_id", F.explode(F.concat("source", "destination", "services", "source_zones", "destination_zones")).alias("name")).unionByName(
        members.select("device_id", F.col("child").alias("name"))).distinct()
    return objects.where(~F.col("kind").isin("zone", "interface")).join(used, ["device_id", "name"], "left_anti").select("device_id", "name", "kind").distinct()


def hygiene(resolved: DataFrame, policies: DataFrame, objects: DataFrame | None = None, members: DataFrame | None = None,
            rules: DataFrame | None = None) -> DataFrame:
    """Every hygiene finding of the fleet in one table."""
    def rows(df, kind, severity, related=F.lit("")):
        k = F.lit(kind) if isinstance(kind, str) else kind
        s = F.lit(severity) if isinstance(severity, str) else severity
        return df.select("device_id", k.alias("kind"), rule_name().alias("rule"), F.col("id").alias("rule_id"), s.alias("severity"),
                         related.alias("related"), F.col("hit_count").cast("bigint").alias("hit_count"))

    bad = side_state(resolved).where("side_state = 'UNEVALUABLE'")
    parts = [rows(unused(resolved), "unused_rule", "low"), rows(resolved.where("not enabled"), "disabled_rule", "low"),
             rows(overly_permissive(resolved), "overly_permissive", F.col("severity")),
             rows(covered(resolved, policies), F.col("kind"), F.col("severity"), F.col("related")),
             rows(bad, "unevaluable", "info", F.array_join(F.slice("bad_names", 1, 3), ", "))]
    if objects is not None:
        o = orphaned_objects(objects, members, rules if rules is not None else resolved)
        parts.append(o.select("device_id", F.lit("orphaned_objects").alias("kind"), F.col("name").alias("rule"), F.col("name").alias("rule_id"),
                              F.lit("low").alias("severity"), F.col("kind").alias("related"), F.lit(None).cast("bigint").alias("hit_count")))
    return reduce(DataFrame.unionByName, parts)


def hygiene_summary(resolved: DataFrame, findings: DataFrame) -> DataFrame:
    """Per device, rules examined and readable, and findings by kind."""
    ex = resolved.groupBy("device_id").agg(F.count(F.lit(1)).alias("rules_examined"),
                                           F.count_if((F.size("src_bad") + F.size("dst_bad") + F.size("svc_bad")) == 0).alias("rules_resolved"))
    kinds = ["unused_rule", "disabled_rule", "overly_permissive", "redundant_rule", "shadowed_rule", "disputed_shadow", "unevaluable", "orphaned_objects"]
    by = findings.groupBy("device_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    return ex.join(by, "device_id", "left").na.fill(0)


# ------------------------------------------------------------------ reachability

POST_LIMIT = 4096  # a rule with more source-destination value pairs is matched on its wider side without indexing it


def _posted(r: DataFrame, sides: list[str]) -> DataFrame:
    """One row per indexed value (pair of values); a side too large to pair is posted whole, as '+'."""
    big = (F.size("src_iv") * F.size("dst_iv") > POST_LIMIT) if len(sides) == 2 else F.lit(False)
    whole = F.array(F.struct(*[F.lit(None).cast(t).alias(c) for c, t in (("t", "string"), ("any", "boolean"), ("rng", "boolean"), ("lo", "string"), ("hi", "string"))],
                             F.lit("+").alias("m"), F.lit("+").alias("k")))
    for n, s in enumerate(sides):
        other = sides[1 - n] if len(sides) == 2 else s
        wider = (F.size(f"{s}_iv") > F.size(f"{other}_iv")) if n == 0 else (F.size(f"{s}_iv") >= F.size(f"{other}_iv"))
        r = r.withColumn(f"{s}_v", F.explode(F.when(big & wider, whole).otherwise(F.col(f"{s}_iv"))))
    return r


def _candidates(rules: DataFrame, q: DataFrame, sides: list[str]) -> DataFrame:
    """(question, rule) rows where the rule's named sides hold the asked addresses, found through the block index.

    A question looks up only the index modes its device has: '*' (any), 'bN' (its own enclosing block of N digits),
    '=' (the same text) and '+' (sides posted whole).
    """
    post = _posted(rules, sides).withColumn("pat", F.concat_ws("|", *[F.col(f"{s}_v.m") for s in sides]))
    pats = post.groupBy("device_id").agg(F.collect_set("pat").alias("pats"))
    p = q.join(pats, "device_id").withColumn("pat", F.explode("pats")).drop("pats")
    for i, s in enumerate(sides):
        m, c = f"split_part(pat, '|', {i + 1})", f"{s}_q"
        p = p.withColumn(f"{s}_k", F.expr(f"""CASE WHEN {m} IN ('*', '+') THEN {m} WHEN {m} = '=' THEN if({c}.any, NULL, {c}.t)
            WHEN {c}.m LIKE 'b%' AND cast(substr({m}, 2) AS int) <= length({c}.k) THEN substr({c}.k, 1, cast(substr({m}, 2) AS int)) END""")).where(f"{s}_k is not null")
    post = post.select("*", *[F.col(f"{s}_v.k").alias(f"{s}_k") for s in sides])
    j = p.join(post, ["device_id", "pat", *[f"{s}_k" for s in sides]])
    for s in sides:
        one, whole = net.covers(f"{s}_v", f"{s}_q"), net.covers("v", f"{s}_q")
        j = j.where(F.expr(f"if({s}_v.m = '+', exists({s}_iv, v -> {whole}), {one})"))
    return j


def _zone_ok(rule_zones: Column, want: Column) -> Column:
    return ((F.coalesce(want, F.lit("")) == "") | (F.coalesce(F.size(rule_zones), F.lit(0)) <= 0)
            | F.coalesce(F.array_contains(F.transform(rule_zones, F.lower), F.lower(want)), F.lit(False)))


def _positions(rules: DataFrame, asked: DataFrame, unordered: DataFrame) -> DataFrame:
    """Running counts over the rules open to each asked zone pair, in policy order.

    Two levels: counts per stretch of positions, then within the stretch, so a device holding a large share of all
    rules is spread over many tasks.
    """
    def keys(z):
        return F.when(F.coalesce(F.size(z), F.lit(0)) <= 0, F.array(F.lit("*"), F.lit("?"))).otherwise(
            F.array_distinct(F.concat(F.transform(z, F.lower), F.array(F.lit("?")))))

    def probes(z):
        return F.when(F.coalesce(z, F.lit("")) == "", F.array(F.lit("?"))).otherwise(F.array(F.lower(z), F.lit("*")))

    a = asked.withColumn("zs", F.explode(probes(F.col("source_zone")))).withColumn("zd", F.explode(probes(F.col("destination_zone"))))
    r = rules.select("device_id", "ord", "id", "may_skip", F.col("program").isNotNull().alias("prog"), F.size("svc_bad").alias("nsb"),
                     "source_zones", "destination_zones")
    r = r.withColumn("zs", F.explode(keys(F.col("source_zones")))).withColumn("zd", F.explode(keys(F.col("destination_zones"))))
    zp = ["device_id", "source_zone", "destination_zone"]
    c = a.join(r, ["device_id", "zs", "zd"]).join(small_side(unordered.withColumn("un", F.lit(True)), BROADCAST_ROWS), "device_id", "left")
    stretch = F.when(F.col("un"), F.struct(F.col("ord").cast("bigint").alias("a"), F.substring("id", 1, 6).alias("b"))).otherwise(
        F.struct(F.floor(F.col("ord") / 4096).alias("a"), F.lit("").alias("b")))
    # with a port asked, a rule tied to one program is unreadable too
    c = c.select(*zp, "ord", "id", stretch.alias("st"), F.col("may_skip").cast("int").alias("s0"),
                 (F.col("may_skip") | F.col("prog")).cast("int").alias("s1"))
    w_in = W.partitionBy(*zp, "st").orderBy("ord", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    w_st = W.partitionBy(*zp).orderBy("st").rowsBetween(W.unboundedPreceding, -1)
    per = c.groupBy(*zp, "st").agg(F.count(F.lit(1)).alias("n"), F.sum("s0").alias("n0"), F.sum("s1").alias("n1"))
    base = per.select(*zp, "st", *[F.coalesce(F.sum(x).over(w_st), F.lit(0)).alias(f"b{x}") for x in ("n", "n0", "n1")])
    out = c.select(*zp, "ord", "id", "st", F.count(F.lit(1)).over(w_in).alias("n"), F.sum("s0").over(w_in).alias("n0"), F.sum("s1").over(w_in).alias("n1"))
    out = out.join(base, [*zp, "st"]).select(*zp, "ord", "id", *[(F.col(x) + F.col(f"b{x}")).alias(x) for x in ("n", "n0", "n1")])
    tot = per.groupBy(*zp).agg(*[F.sum(x).alias(f"t{x}") for x in ("n", "n0", "n1")])
    return out, tot


def reach(queries: DataFrame, resolved: DataFrame, policies: DataFrame) -> DataFrame:
    """What the policy does with each question; first match wins, unreadable rules are counted, never guessed.

    queries(query_id, device_id, source, destination, port, protocol, source_zone, destination_zone).
    permitted is TRUE, FALSE or NULL (cannot be decided).
    """
    q = queries.select("query_id", "device_id", F.coalesce("source", F.lit("any")).alias("source"), F.coalesce("destination", F.lit("any")).alias("destination"),
                       "port", F.coalesce("protocol", F.lit("tcp")).alias("protocol"), F.coalesce("source_zone", F.lit("")).alias("source_zone"),
                       F.coalesce("destination_zone", F.lit("")).alias("destination_zone"))
    on = resolved.where("enabled").withColumn("may_skip", (F.size("src_bad") + F.size("dst_bad") + F.size("svc_bad")) > 0)
    on = on.withColumn("program", F.nullif(F.col("program"), F.lit("")))
    cols = ["device_id", "id", "name", "ord", "action", "src", "dst", "svc", "src_bad", "dst_bad", "svc_bad", "source_zones", "destination_zones", "program", "may_skip"]
    # rules and questions feed several branches; they are written once instead of being worked out for each
    r = on = cut_lineage(on.select(*cols, net.intervals("src").alias("src_iv"), net.intervals("dst").alias("dst_iv")))
    q = q.withColumn("pk", F.coalesce("port", F.lit(-1)))
    K = ["device_id", "source", "destination", "pk", "protocol", "source_zone", "destination_zone"]
    dq = q.select(*K).distinct().withColumn("port", F.when(F.col("pk") >= 0, F.col("pk")))
    dq = cut_lineage(dq.withColumn("src_q", net.interval("source")).withColumn("dst_q", net.interval("destination")))
    open_to = _zone_ok(F.col("source_zones"), F.col("source_zone")) & _zone_ok(F.col("destination_zones"), F.col("destination_zone"))
    prog_ok = F.col("program").isNull() | F.col("port").isNull()
    svc = F.exists("svc", lambda v: net.svc_matches(v, F.col("protocol"), F.col("port")) | net.is_any(v))
    hit = _candidates(r.where(F.size("svc_bad") == 0), dq, ["src", "dst"]).where(open_to & prog_ok & svc)
    first = hit.groupBy(*K).agg(F.min_by(F.struct("ord", "id", rule_name().alias("nm"), "action", "source_zones", "destination_zones"), F.struct("ord", "id")).alias("d"))
    # unreadable sides the asked address matches anyway are readable for this question
    part = r.where((F.size("svc_bad") == 0) & ((F.size("src_bad") + F.size("dst_bad")) > 0))
    saved = []
    for cond, sides in (("size(src_bad) > 0 and size(dst_bad) > 0", ["src", "dst"]), ("size(src_bad) > 0 and size(dst_bad) = 0", ["src"]),
                        ("size(src_bad) = 0 and size(dst_bad) > 0", ["dst"])):
        saved.append(_candidates(part.where(cond), dq, sides).where(open_to & prog_ok).select(*K, "ord", "id").distinct())
    saved = reduce(DataFrame.unionByName, saved).join(first.select(*K, "d"), K, "left").where(
        "d is null or ord < d.ord or (ord = d.ord and id < d.id)").groupBy(*K).agg(F.count(F.lit(1)).alias("saved"))
    zp = ["device_id", "source_zone", "destination_zone"]
    pos, tot = _positions(on, dq.select(*zp).distinct(), policies.where("unordered").select("device_id"))
    own = on.select("device_id", "id", F.col("may_skip").cast("int").alias("own"))
    # what is known of a question is put together for the few that some rule decides or concerns, and only then given to all questions
    known = (first.join(saved, K, "full").withColumn("ord", F.col("d.ord")).withColumn("id", F.col("d.id"))
             .join(pos, [*zp, "ord", "id"], "left").join(own, ["device_id", "id"], "left").select(*K, "d", "saved", "n", "n0", "n1", "own"))
    a = (q.join(shuffled(known), K, "left").join(shuffled(tot), zp, "left")
         .join(small_side(policies.select("device_id", "default_action", "default_action_observed"), BROADCAST_ROWS), "device_id", "left"))
    decided = F.col("d").isNotNull()
    stated = F.coalesce(F.col("default_action_observed") & (F.col("default_action") != ""), F.lit(False))
    skipped = F.when(F.col("port").isNull(), F.coalesce("n0", "tn0")).otherwise(F.coalesce("n1", "tn1"))
    # the deciding rule is counted in the running total and is readable for this question
    return a.select("query_id", "device_id", "source", "destination", "port", "protocol", "source_zone", "destination_zone",
                    F.when(decided, allows(F.col("d.action"))).when(stated, allows(F.col("default_action"))).alias("permitted"),
                    F.when(decided, F.col("d.nm")).when(stated, "default policy").otherwise("").alias("decided_by"),
                    F.when(decided, F.col("d.action")).when(stated, F.col("default_action")).otherwise("").alias("action"),
                    F.coalesce("n", "tn", F.lit(0)).alias("evaluated"),
                    (F.coalesce(skipped, F.lit(0)) - F.coalesce("saved", F.lit(0)) - F.coalesce("own", F.lit(0))).alias("unevaluable"),
                    F.coalesce(decided & (((F.size("d.source_zones") > 0) & (F.col("source_zone") == ""))
                                          | ((F.size("d.destination_zones") > 0) & (F.col("destination_zone") == ""))), F.lit(False)).alias("zone_assumed"))


# The questions worth asking of any firewall (tcp, from the outside zone).
STANDARD_PORTS = [22, 23, 80, 443, 3389, 445, 1433, 3306]


def standard_queries(policies: DataFrame, zone: str = "WAN") -> DataFrame:
    """The audit probes, one set per device."""
    return policies.select("device_id", F.explode(F.array(*[F.lit(p) for p in STANDARD_PORTS])).alias("port")).select(
        F.concat_ws(":", "device_id", "port").alias("query_id"), "device_id", F.lit("any").alias("source"), F.lit("any").alias("destination"),
        "port", F.lit("tcp").alias("protocol"), F.lit(zone).alias("source_zone"), F.lit("").alias("destination_zone"))


# ------------------------------------------------------------------ comparisons and summaries

def cross_check(ours: DataFrame, theirs: DataFrame, key: str = "rule") -> DataFrame:
    """What both analyses found, and what only one did."""
    a = ours.select("device_id", F.lower(key).alias(key)).distinct().withColumn("o", F.lit(True))
    b = theirs.select("device_id", F.lower(key).alias(key)).distinct().withColumn("t", F.lit(True))
    return a.join(b, ["device_id", key], "full").select("device_id", key, F.when(F.col("o") & F.col("t"), "agreed").when(F.col("o"), "only_ours").otherwise("only_theirs").alias("verdict"))


def parser_agreement(ours: DataFrame, theirs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Per device and mapped path prefix, which of two readers found it. Neither is not agreement.

    Paths are matched by cutting them to the (few) distinct prefix lengths in use, an equi-join.
    """
    from ..types import small_side
    px = prefixes.select("prefix").distinct()
    lens = small_side(px.select(F.length("prefix").alias("n")).distinct(), 1000)
    pb = small_side(px, 100000)

    def hits(df, flag):
        cut = df.select("device_id", "path").join(lens, F.length("path") >= F.col("n")).select("device_id", F.substring("path", F.lit(1), F.col("n")).alias("prefix"))
        return cut.join(pb, "prefix", "left_semi").distinct().withColumn(flag, F.lit(True))

    j = hits(ours, "a").join(hits(theirs, "b"), ["device_id", "prefix"], "full")
    return j.select("device_id", "prefix", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "only_ours").otherwise("only_theirs").alias("found_by"))


def graph_summary(objects: DataFrame, members: DataFrame, rules: DataFrame) -> DataFrame:
    """Objects by kind, relationships and rules per device."""
    o = objects.groupBy("device_id").agg(F.count(F.lit(1)).alias("objects"), *[F.count_if(F.col("kind") == k).alias(k) for k in
                                         ("address", "address_group", "service", "service_group", "zone", "interface")])
    m = members.groupBy("device_id").agg(F.count(F.lit(1)).alias("relationships"))
    r = rules.groupBy("device_id").agg(F.count(F.lit(1)).alias("rules"))
    return o.join(m, "device_id", "full").join(r, "device_id", "full").na.fill(0)


# Zone names by trust.
UNTRUSTED_NAMES = ["wan", "untrust", "internet", "public", "outside", "wlan"]
TRUSTED_NAMES = ["lan", "trust", "inside", "mgmt", "management"]
SEMI_NAMES = ["dmz"]


def trust_rank(zone: Column, declared_untrusted: Column) -> Column:
    z = F.lower(zone)
    return (F.when(F.coalesce(declared_untrusted, F.lit(False)) | z.isin(UNTRUSTED_NAMES), 0).when(z.isin(SEMI_NAMES), 2).when(z.isin(TRUSTED_NAMES), 3).otherwise(1))


def zone_flows(rules: DataFrame, policies: DataFrame, populated: DataFrame | None = None) -> DataFrame:
    """Zone to zone allow counts, wide-open rules, whether trust rises, whether the source zone is empty."""
    r = rules.where(F.col("enabled") & allows(F.col("action")))
    open_side = reduce(lambda a, b: a & b, [F.forall(c, lambda v: F.lower(v).isin("any", "all")) for c in ("source", "destination", "services")])
    x = (r.select("device_id", rule_name().alias("rule"), open_side.alias("wide"), F.explode("source_zones").alias("from_zone"), "destination_zones")
         .withColumn("to_zone", F.explode("destination_zones")).where("from_zone != '' and to_zone != '' and from_zone != to_zone"))
    f = x.groupBy("device_id", "from_zone", "to_zone").agg(F.count(F.lit(1)).alias("rules"), F.count_if("wide").alias("any_any"))
    u = policies.select("device_id", F.explode("untrusted_zones").alias("z")).distinct()
    for side in ("from", "to"):
        f = f.join(u.select("device_id", F.col("z").alias(f"{side}_zone"), F.lit(True).alias(f"{side}_u")), ["device_id", f"{side}_zone"], "left")
    f = f.withColumn("escalates", trust_rank(F.col("from_zone"), F.col("from_u")) < trust_rank(F.col("to_zone"), F.col("to_u"))).drop("from_u", "to_u")
    if populated is None:
        return f.withColumn("latent", F.lit(True))
    pz = populated.select("device_id", F.col("zone").alias("from_zone"), F.lit(True).alias("live")).distinct()
    return f.join(pz, ["device_id", "from_zone"], "left").withColumn("latent", F.col("live").isNull()).drop("live")
