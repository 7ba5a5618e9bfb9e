"""What a configuration file is: platform, reader and pack (P3-P7). Column expressions over whole files; no join but the taught one."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage
from ..sources.files import decode_export
from ..types import small_side
from . import literals
from .jsonpath import path_values, understood

# Platform, vendor, os, reader, patterns that decide, patterns that hint, and where version, hostname and serial stand.
SIGNATURES = [
    {"platform": "cisco_iosxe_router", "vendor": "cisco", "os": "IOS-XE", "reader": "indented",
     "strong": [r"^\s*boot system .*packages\.conf", r"^\s*version 1[6-7]\.\d"],
     "weak": [r"^\s*service password-encryption", r"^\s*line vty \d", r"^\s*ip ssh version", r"^\s*aaa new-model", r"^\s*interface GigabitEthernet"],
     "version": r"^\s*version (\d+\.\d+)", "hostname": r"^\s*hostname (\S+)", "serial": r"[Pp]rocessor board ID (\S+)"},
    {"platform": "cisco_asa", "vendor": "cisco", "os": "ASA", "reader": "indented",
     "strong": [r"^\s*nameif \S+", r"^ASA Version", r"^\s*security-level \d+"],
     "weak": [r"^\s*ssh \d+\.\d+\.\d+\.\d+ ", r"^\s*telnet timeout \d+", r"^\s*class-map inspection_default", r"^\s*names\s*$", r"^\s*dynamic-access-policy-record"],
     "version": r"^ASA Version ([\d.()]+)", "hostname": r"^\s*hostname (\S+)", "serial": r"[Ss]erial [Nn]umber:\s*(\S+)"},
    {"platform": "arista_eos", "vendor": "arista", "os": "EOS", "reader": "indented",
     "strong": [r"^\s*!\s*device:.*\(.*EOS", r"^\s*transceiver qsfp default-mode"],
     "weak": [r"^\s*management api http-commands", r"^\s*spanning-tree mode mstp", r"^\s*interface Ethernet\d"], "hostname": r"^\s*hostname (\S+)"},
    {"platform": "aruba_aoscx", "vendor": "hpe_aruba", "os": "AOS-CX", "reader": "indented",
     "strong": [r"^\s*!Version ArubaOS-CX"], "weak": [r"^\s*ssh server vrf", r"^\s*vlan \d+\s*$", r"^\s*aaa authentication"],
     "version": r"!Version ArubaOS-CX \S+ ([\d.]+)", "hostname": r"^\s*hostname (\S+)"},
    {"platform": "juniper_srx", "vendor": "juniper", "os": "Junos", "reader": "braces",
     "strong": [r"^\s*set system host-name", r"^system\s*\{"], "weak": [r"^\s*set security policies", r"^\s*set interfaces \S+ unit", r"protocol-version v2"],
     "version": r"^\s*## Last commit.*JUNOS ([\d.]+)", "hostname": r"^\s*set system host-name (\S+)"},
    {"platform": "fortinet_fortios", "vendor": "fortinet", "os": "FortiOS", "reader": "fortinet_block",
     "strong": [r"^#config-version=FG", r"^\s*config system global"], "weak": [r"^\s*set admintimeout", r"^\s*config firewall policy", r"^\s*next\s*$"],
     "version": r"^#config-version=\S+-([\d.]+)", "hostname": r'^\s*set hostname "?(\S+?)"?\s*$', "serial": r"^#.*[Ss]erial[- ]?[Nn]umber[=: ]+(\S+)"},
    {"platform": "sonicwall_sonicos", "vendor": "sonicwall", "os": "SonicOS", "reader": "fortinet_block",
     "strong": [r"^\s*config sonicos", r"^#SonicOS"], "weak": [r"^\s*administration", r"^\s*set gui", r"^\s*end\s*$"]},
    {"platform": "paloalto_panos", "vendor": "paloalto", "os": "PAN-OS", "reader": "xml",
     "strong": [r"<config[^>]*version=", r"<devices>"], "weak": [r'<entry name="localhost\.localdomain"', r"<deviceconfig>"],
     "version": r'<config[^>]*version="([\d.]+)"', "hostname": r"<hostname>([^<]+)</hostname>"},
]
# Weights, the confidence below which nothing is claimed, names in a key=value export, and serials that say nothing.
STRONG, WEAK, FLOOR = 1.0, 0.25, 0.5
EXPORT_MARKERS = ["shortProdName=", "buildNum=", "allowHttpMgmt=", "serialNumber="]
NO_SERIAL = r"^(0+|f+|F+|[0-]+|unknown|none|n/?a|not ?specified|default|\s*)$"

FIELDS = ["vendor", "platform", "os", "reader", "confidence", "version", "hostname", "serial", "model"]


def _claim(confidence: Column, **parts) -> Column:
    """One identification as a struct; what is not given is NULL."""
    value = {"confidence": confidence.cast("double"), **{k: (v if isinstance(v, Column) else F.lit(v)) for k, v in parts.items()}}
    return F.struct(*[value[f].cast("double" if f == "confidence" else "string").alias(f) if f in value else F.lit(None).cast("string").alias(f) for f in FIELDS])


def _first(text: Column, pattern: str | None) -> Column:
    return F.nullif(F.regexp_extract(text, "(?m)" + pattern, 1), F.lit("")) if pattern else F.lit(None).cast("string")


def signature_rank(text: Column, signatures: list[dict] = SIGNATURES) -> Column:
    """(confidence, place) of the best signature, place counted down so that the first listed wins a tie."""
    def score(s):
        hits = [F.when(text.rlike("(?m)" + p), w).otherwise(0.0) for w, ps in ((STRONG, s["strong"]), (WEAK, s["weak"])) for p in ps]
        return F.least(F.lit(1.0), reduce(lambda a, b: a + b, hits))

    return F.array_max(F.array(*[F.struct(score(s).alias("confidence"), F.lit(-i).alias("place")) for i, s in enumerate(signatures)]))


def by_signature(text: Column, top: Column, signatures: list[dict] = SIGNATURES) -> Column:
    """What the best signature says; UNKNOWN below the floor."""
    def pick(value) -> Column:
        return reduce(lambda c, i: c.when(top["place"] == -i, value(signatures[i])), range(1, len(signatures)), F.when(top["place"] == 0, value(signatures[0])))

    parts = {k: pick(lambda s, k=k: F.lit(s[k])) for k in ("vendor", "platform", "os", "reader")}
    parts |= {k: pick(lambda s, k=k: _first(text, s.get(k))) for k in ("version", "hostname", "serial")}
    return F.when(top["confidence"] >= FLOOR, _claim(top["confidence"], **parts)).otherwise(_claim(top["confidence"], vendor="UNKNOWN", platform="UNKNOWN"))


def by_json(content: Column) -> Column:
    """Exports in JSON by their keys. NULL where no rule knows the document."""
    has = lambda *path: F.get_json_object(content, "$" + "".join(path)).isNotNull()
    aws = _claim(F.lit(1.0), vendor="aws", platform="security_groups", reader="json", os="AWS EC2")
    azure = _claim(F.lit(1.0), vendor="azure", platform="network_security_groups", reader="json", os="Azure")
    gcp = _claim(F.lit(1.0), vendor="gcp", platform="gcp_firewall", reader="json", os="Google Cloud VPC")
    sonic = _claim(F.lit(1.0), vendor="sonic", platform="sonic", reader="json", os="SONiC")
    listed = F.trim(content).startswith("[")
    rule = (F.get_json_object(content, "$[0].kind") == "compute#firewall") | (has("[0].direction") & has("[0].network") & (has("[0].allowed") | has("[0].denied")))
    return (F.when(listed & has("[0].GroupId") & has("[0].IpPermissions"), aws)
            .when(listed & (has("[0].securityRules") | has("[0].properties.securityRules")), azure).when(listed & F.coalesce(rule, F.lit(False)), gcp)
            .when(~listed & has(".DEVICE_METADATA"), sonic).when(~listed & has(".SecurityGroups"), aws)
            .when(~listed & (has(".securityRules") | has(".properties.securityRules")), azure))


def by_xml(content: Column) -> Column:
    """Device exports in XML by their root. NULL for other documents."""
    junos = content.contains("xml.juniper.net") | content.contains("<rpc-reply")
    panos = content.rlike(r"<config[^>]*(urldb|version=)") | content.contains("<devices>")
    return (F.when(junos, _claim(F.lit(1.0), vendor="juniper", platform="juniper_srx_xml", reader="xml", os="Junos", version=_first(content, r"<version>([^<]+)</version>"), hostname=_first(content, r"<host-name>([^<]+)</host-name>")))
            .when(panos, _claim(F.lit(1.0), vendor="paloalto", platform="paloalto_panos", reader="xml", os="PAN-OS", version=_first(content, r'<config[^>]*version="([\d.]+)"'), hostname=_first(content, r"<hostname>([^<]+)</hostname>"))))


def by_export(content: Column) -> Column:
    """A key=value export by two of its own setting names, plain or in base64. NULL otherwise."""
    text = decode_export(content)
    hits = reduce(lambda a, b: a + b, [F.when(text.contains(m), 1).otherwise(0) for m in EXPORT_MARKERS])

    def grab(key):
        raw = F.regexp_extract(text, r"(?:^|[&\n])" + key + r"=([^&\n]*)", 1)
        return F.nullif(F.trim(F.coalesce(F.try_url_decode(raw), raw)), F.lit(""))

    serial = grab("serialNumber")
    return F.when(hits >= 2, _claim(F.least(F.lit(1.0), hits / 3), vendor="sonicwall", platform="sonicwall_sonicos", reader="sonicos_exp", os="SonicOS", version=grab("buildNum"),
                                    hostname=grab("firewallName"), serial=F.when(~serial.rlike(NO_SERIAL), serial), model=grab("shortProdName")))


def fingerprint(files: DataFrame, taught: DataFrame | None = None, signatures: list[dict] = SIGNATURES) -> DataFrame:
    """files(device_id, content) with vendor, platform, os, reader, confidence, version, hostname, serial and model.

    The order is JSON, XML, key=value export, signatures over the whole text. A JSON document that no rule knows is UNKNOWN and is not
    tried as text. taught(platform, vendor, reader, signature) speaks only for files that stay UNKNOWN.
    """
    c = F.col("__c")
    head = F.substring(F.regexp_replace(c, r"^\s+", ""), 1, 1)
    d = files.withColumn("__c", F.coalesce("content", F.lit(""))).withColumn("__head", head)
    d = d.withColumn("__json", F.col("__head").isin("{", "[") & F.try_parse_json(c).isNotNull())
    known = F.when(F.col("__json"), F.coalesce(by_json(c), _claim(F.lit(0.0), vendor="UNKNOWN", platform="UNKNOWN"))).otherwise(F.coalesce(F.when(F.col("__head") == "<", by_xml(c)), by_export(c)))
    d = d.withColumn("__known", known).withColumn("__top", F.when(F.col("__known").isNull(), signature_rank(c, signatures)))
    d = d.withColumn("__f", F.coalesce("__known", by_signature(c, F.col("__top"), signatures)))
    out = d.select(*files.columns, "__f.*")
    return out if taught is None else learned(cut_lineage(out), taught)  # written once, read three times


def taught_problems(taught: DataFrame) -> DataFrame:
    """(platform, signature, error): taught patterns that cannot be compiled and taught paths that are not understood. Their platforms are never named."""
    text = literals.bad_patterns(taught.where("reader is distinct from 'json'"), "signature").select("platform", "signature", "error")
    odd = taught.where((F.col("reader") == "json") & ~understood(F.col("signature")))
    return text.unionByName(odd.select("platform", "signature", F.concat(F.lit("path not understood: "), F.col("signature")).alias("error")))


def learned(files: DataFrame, taught: DataFrame) -> DataFrame:
    """P5: UNKNOWN files against taught signatures; a platform is named only if every one of its signatures matches, the first by name
    if several do. JSON signatures are paths, others patterns. taught(platform, vendor, reader, signature).

    A file calls up the signatures that share a word with it; only where all of a platform's are called up are its patterns tested on the content.
    """
    who = ["platform", "vendor", "reader"]
    sigs = cut_lineage(taught.where(F.trim("signature") != "").select(*who, "signature").distinct())
    of = sigs.groupBy(*who).agg(F.count(F.lit(1)).alias("n")).withColumn("who", F.struct(*who))
    c = F.coalesce(F.col("content"), F.lit(""))
    asked = cut_lineage(files.where("platform = 'UNKNOWN'").select("device_id", c.alias("content"), (F.trim(c).substr(1, 1).isin("{", "[") & F.try_parse_json(c).isNotNull()).alias("json")))

    index = literals.indexed(sigs.where("reader is distinct from 'json'").select(F.struct(*who).alias("who"), "signature"), "signature")
    kinds = index.agg(F.coalesce(F.bool_or(F.col("__key").startswith("g:")), F.lit(False)).alias("g"), F.coalesce(F.bool_or(F.col("__key") == ""), F.lit(False)).alias("e")).first()
    words = asked.where("not json").select("device_id", F.explode(literals.text_keys(F.col("content"), kinds["g"], kinds["e"])).alias("__key"))
    called = words.join(small_side(index.select("who", "signature", "__key"), literals.MAX_INDEXED), "__key").groupBy("device_id", "who").agg(F.collect_set("signature").alias("sigs"))
    able = called.join(of.select("who", "n"), "who").where(F.size("sigs") == F.col("n"))
    text = able.join(asked.select("device_id", "content"), "device_id").where(F.forall("sigs", lambda s: F.regexp_like(F.col("content"), F.concat(F.lit("(?m)"), s)))).select("device_id", "who")

    paths = sigs.where("reader = 'json'")
    got = path_values(asked.where("json").select("device_id", F.lit("").alias("group"), "content"), paths.select(F.lit("").alias("group"), F.col("signature").alias("expr")).distinct())
    fits = got.where(~F.is_variant_null("v")).select("device_id", F.col("expr").alias("signature")).distinct().join(paths, "signature").groupBy("device_id", F.struct(*who).alias("who")).agg(F.count(F.lit(1)).alias("m"))
    tree = fits.join(of.select("who", "n"), "who").where("m = n").select("device_id", "who")

    best = text.unionByName(tree).groupBy("device_id").agg(F.min("who").alias("t"))
    named = files.join(best, "device_id", "left")
    hit = F.col("t").isNotNull()
    new = {"platform": F.col("t.platform"), "vendor": F.coalesce("t.vendor", F.lit("learned")), "reader": F.col("t.reader"), "os": F.col("t.vendor"), "confidence": F.lit(1.0)}
    return named.select(*[F.when(hit, new[x]).otherwise(F.col(x)).alias(x) if x in new else F.col(x) for x in files.columns])


def select_pack(devices: DataFrame, packs: DataFrame) -> DataFrame:
    """The pack of each device: same platform and reader, else same platform, else same vendor, else NULL; the first of equal fit.
    packs(pack, ordinal, platform, vendor, reader); devices need device_id, platform, vendor and reader."""
    p = packs.select(F.col("pack"), F.col("ordinal").alias("__o"), *[F.col(x).alias(f"__{x}") for x in ("platform", "vendor", "reader")])
    same = devices.join(p, F.col("platform") == F.col("__platform")).select("device_id", F.when(F.col("reader") == F.col("__reader"), 0).otherwise(1).alias("__fit"), "__o", "pack")
    kin = devices.join(p, F.col("vendor") == F.col("__vendor")).select("device_id", F.lit(2).alias("__fit"), "__o", "pack")
    best = same.unionByName(kin).groupBy("device_id").agg(F.min_by("pack", F.struct("__fit", "__o")).alias("pack"))
    return devices.join(best, "device_id", "left")


def guess_reader(content: Column) -> Column:
    """The file format of a device that nothing recognises, by structure alone."""
    c = F.coalesce(content, F.lit(""))
    head = F.substring(F.regexp_replace(c, r"^\s+", ""), 1, 1)
    opens, closes = F.regexp_count(c, F.lit(r"(?m)\{\s*$")), F.regexp_count(c, F.lit(r"(?m)^\s*\}\s*$"))
    return F.when(head.isin("{", "["), "json").when(head == "<", "xml").when((opens >= 3) & (closes >= 3), "braces").otherwise("indented")


def detect_grammar(files: DataFrame) -> DataFrame:
    """(device_id, rank, reader, confidence): reader families that a file's shape allows, the likeliest first, ties in listed order."""
    c = F.coalesce(F.col("content"), F.lit(""))
    count = lambda p: F.regexp_count(c, F.lit(p)).cast("double")
    n = F.greatest(count(r"(?m)^.*\S.*$"), F.lit(1.0))
    opens, semis = count(r"(?m)\{[ \t]*$"), count(r"(?m);[ \t]*$")
    config, ends = count(r"(?im)^[ \t]*config[ \t]+\S"), count(r"(?im)^[ \t]*(end|next)[ \t]*$")
    indented, paths = count(r"(?m)^[ \t]+\S"), count(r"(?im)^[ \t]*/[a-z]+(/[a-z0-9_-]+){2,}")
    tags, pairs = count(r"<[A-Za-z/][^>]*>"), count(r"[A-Za-z_][A-Za-z0-9_]{2,}=")
    newlines = F.char_length(c) - F.char_length(F.replace(c, F.lit("\n"), F.lit("")))
    head = F.substring(F.regexp_replace(c, r"^\s+", ""), 1, 1)
    one = lambda cond, name, conf: F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(name).alias("reader"), F.least(F.lit(1.0), conf).alias("confidence")))
    found = F.array_compact(F.array(
        one(head.isin("{", "[") & F.try_parse_json(c).isNotNull(), "json", F.lit(1.0)),
        one(c.rlike(r"^\s*<\?xml|^\s*<[A-Za-z]") & (tags > 10), "xml", tags / 200),
        one((pairs > 50) & (newlines < pairs / 10), "keyvalue", pairs / 500),
        one((opens > 2) & (semis > 2), "braces", (opens + semis) / n),
        one((config > 0) & (ends > 0), "fortinet_block", (config + ends) / n * 3),
        one((indented > 2) & (opens == 0), "indented", F.lit(0.3) + indented / n),
        one(paths > 2, "pathstyle", paths / n * 2)))
    found = F.when(F.size(found) > 0, found).otherwise(F.array(F.struct(F.lit("indented").alias("reader"), F.lit(0.15).alias("confidence"))))
    x = files.select("device_id", F.posexplode(found).alias("__p", "g"))
    order = W.partitionBy("device_id").orderBy(F.col("g.confidence").desc(), "__p")
    return x.select("device_id", F.row_number().over(order).alias("rank"), "g.reader", "g.confidence")
