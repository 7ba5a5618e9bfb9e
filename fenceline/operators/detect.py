"""Vendor-agnostic detectors and injection pre-scan over configuration lines."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# A line that turns something off; a stored hash; a word that marks an encrypted credential.
NEGATION = r"(?i)(^|\s)(no|delete|unset|disable[d]?|deny|off|remove)(\s|$)|[=:]\s*(0|off|false|no|disable[d]?)\s*$"
HASHED = r"^(\$\d[a-z]?\$|\{[A-Z0-9]+\}|[0-9a-f]{32,}$|[A-Za-z0-9+/]{40,}={0,2}$|0x[0-9a-fA-F]{16,})"
ENCRYPTED = r"(?i)\b(encrypted|secret|hash|hashed|pbkdf2|bcrypt|scrypt|sha256|sha512|md5-hash|cipher|type\s*[5789])\b"
CREDENTIAL = r"""(?i)\b(password|passwd|pre-shared-key|psk|community|key-string|secret)\b\s+["']?([^\s"';]+)"""

# Fixed values: (name, severity, field it speaks about, pattern, must also match, must not match).
DETECTORS = [
    ("weak_crypto", "high", "crypto.weak_ciphers",
     r"(?i)(?<![a-z0-9-])(?:(?:esp|ah)-(?:des|3des|md5|sha1|null)(?:-hmac)?|(?:des-cbc|des-ede3|3des-cbc|rc4-md5|rc4-sha)|(?:des|3des|rc4|md5|sha1|wep|anon)(?![a-z0-9]|-[a-z])|"
     r"(?:dh-group[12]|diffie-hellman-group1|ssl-?v?3|sslv3|tls-?v?1\.?[01]?|null-cipher|export-grade)(?![a-z0-9]))",
     r"(?i)\b(cipher|crypto|encryption|key-exchange|kex|mac|hash|ssl|tls|ipsec|ike|transform|proposal|algorithm|digest|auth)\b", None),
    ("telnet_enabled", "high", "management.telnet.enabled", r"(?i)(?<![a-z-])telnet(?![a-z-])", None, r"(?i)\b(timeout|client|no-telnet|disable|deny|reverse)\b"),
    ("cleartext_http_mgmt", "high", "management.http.enabled", r"(?i)(?<![a-z-])http(?!s)(?![a-z-])", r"(?i)\b(server|management|mgmt|admin|web|gui|enable)\b",
     r"(?i)https?://|\bsecure[- ]?server\b|\bsecure\b|\bredirect\b|\bproxy\b|\burl\b"),
    ("snmp_v1_v2c", "high", "snmp.version", r"(?i)\b(v1|v2c|version\s*1|version\s*2c)\b", r"(?i)\bsnmp\b", None),
    ("default_snmp_community", "critical", "snmp.communities", r"(?i)\b(public|private)\b", r"(?i)\bsnmp[-_ ]?(server|community|agent)?\b", r"(?i)\b(public[-_]?(key|cert|ip|internet))\b"),
    ("any_any_permit", "critical", "firewall.rules.action", r"(?i)(any\s+any|0\.0\.0\.0/0|0\.0\.0\.0\s+0\.0\.0\.0|::/0)", r"(?i)\b(permit|allow|accept|pass|action)\b", None),
    ("ftp_enabled", "medium", "services.unused_enabled", r"(?i)(?<![a-z-])(ftp|tftp)(?![a-z-])", r"(?i)\b(server|enable|service|mode)\b", r"(?i)\b(passive|client|timeout|inspect)\b"),
]
# How specific a detector is; what it is trusted, and a report's limit.
SPECIFICITY = {"default_snmp_community": 0, "weak_crypto": 1, "cleartext_credential": 2}
CONFIDENCE = 0.8
CAP = 25


def significant(lines: DataFrame, text: str = "text") -> DataFrame:
    """Lines that are not blank and not comments in any of the usual styles."""
    t = F.trim(text)
    return lines.where((t != "") & ~t.rlike(r"^(!|#|//|;)"))


def _hit_struct(i, name, sev, field, matched, redacted=None) -> Column:
    return F.struct(F.lit(i).alias("emit"), F.lit(name).alias("detector"), F.lit(sev).alias("severity"), field.alias("field_hint"), matched.alias("matched"))


def hits_on_line(text: Column, detectors=DETECTORS, credentials: bool | None = None) -> Column:
    """Every detection on one line, as an array; the same expression serves batch and stream. credentials: only cleartext credentials, or all but them."""
    negated = text.rlike(NEGATION)
    out = []
    for i, (name, sev, field, pattern, requires, excludes) in enumerate(detectors if credentials is not True else []):
        c = text.rlike(pattern) & ~negated
        if requires:
            c = c & text.rlike(requires)
        if excludes:
            c = c & ~text.rlike(excludes)
        out.append(F.when(c, _hit_struct(i, name, sev, F.lit(field), F.regexp_extract(text, pattern, 0))))
    kw, val = F.lower(F.regexp_extract(text, CREDENTIAL, 1)), F.regexp_extract(text, CREDENTIAL, 2)
    plain = (text.rlike(CREDENTIAL) & ~negated & ~text.rlike(ENCRYPTED) & ~val.rlike(HASHED) & ~val.rlike(r"^(<|\$\(|\{\{)") & (F.length(val) >= 4) & ~F.lower(val).isin("none", "null", "disable"))
    hint = F.when(kw == "community", "snmp.communities").when(kw.isin("pre-shared-key", "psk", "key-string"), "crypto.ipsec_proposals").otherwise("authentication.password_encryption")
    said = F.concat(F.regexp_extract(text, CREDENTIAL, 1), F.lit(" <redacted:"), F.length(val).cast("string"), F.lit(" chars>"))
    if credentials is not False:
        out.append(F.when(plain, _hit_struct(len(detectors), "cleartext_credential", "critical", hint, said)))
    return F.filter(F.array(*out), lambda h: h.isNotNull())


def detect(lines: DataFrame, detectors=DETECTORS, cap: int | None = None) -> DataFrame:
    """lines(device_id, line, text) -> one row per detection. All are returned; cap is a report's limit per
    detector and file (credentials have none)."""
    def found(credentials: bool | None = None) -> DataFrame:
        return significant(lines).withColumn("h", F.explode(hits_on_line(F.col("text"), detectors, credentials))).select("device_id", "line", "text", "h.*").withColumn("confidence", F.lit(CONFIDENCE))

    if cap is None:
        return found()
    # only detectors that can exceed the cap are ranked, and the limit is applied before the shuffle
    k = F.row_number().over(W.partitionBy("device_id", "detector").orderBy("line"))
    ranked = found(credentials=False).withColumn("k", k).where(F.col("k") <= cap).drop("k")
    return ranked.unionByName(found(credentials=True))


def one_finding_per_line(detections: DataFrame) -> DataFrame:
    """The most specific detection of a line, the first emitted on a tie."""
    from ..types import lookup
    rank = lookup(F.col("detector"), SPECIFICITY, 9)
    cols = [c for c in detections.columns if c not in ("device_id", "line")]
    return detections.groupBy("device_id", "line").agg(F.min_by(F.struct(*cols), F.struct(rank.alias("r"), "emit")).alias("d")).select("device_id", "line", "d.*")


def ordered_report(detections: DataFrame) -> DataFrame:
    sev = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).when(F.col("severity") == "low", 3).otherwise(4)
    return detections.orderBy("device_id", sev, "line")


def summarise(detections: DataFrame, by: list[str] | None = None) -> DataFrame:
    """T5: counts by detector, by severity and in all, in one pass."""
    by = by or []
    g = detections.groupingSets([by + ["detector"], by + ["severity"], by], *by, "detector", "severity")
    return g.agg(F.count(F.lit(1)).alias("n"))


# Injection signatures (pattern, technique, label), first match wins.
INJECTION = [
    (r"ignore\s+(?:all\s+)?(?:previous|prior|above)\s+instructions", "AML.T0051.000", "direct instruction override"),
    (r"disregard\s+(?:the\s+)?(?:previous|prior|above|system)", "AML.T0051.000", "direct instruction override"),
    (r"you\s+are\s+now\s+(?:a|an|the)\b", "AML.T0051.000", "role reassignment"),
    (r"^\s*system\s*:", "AML.T0051.000", "forged system turn"),
    (r"\bassistant\s*:\s*", "AML.T0051.000", "forged assistant turn"),
    (r"report\s+all\s+(?:controls?|checks?|findings?)\s+as\s+(?:compliant|pass)", "AML.T0051.001", "verdict manipulation"),
    (r"mark\s+(?:this|the)\s+(?:device|config\w*)\s+as\s+compliant", "AML.T0051.001", "verdict manipulation"),
    (r"<\s*/?\s*(?:system|instruction|prompt)\s*>", "AML.T0051.001", "delimiter injection"),
    (r"\{\{\s*.*?\s*\}\}", "AML.T0051.001", "template injection"),
    (r"new\s+instructions?\s*:", "AML.T0051.002", "triggered injection"),
    (r"do\s+not\s+(?:report|flag|mention)\b", "AML.T0051.001", "suppression attempt"),
]


def injection_label(text: Column) -> Column:
    """T4: technique and label of the first signature a line matches, NULL when none."""
    out = None
    for p, tech, label in INJECTION:
        v = F.struct(F.lit(tech).alias("technique"), F.lit(label).alias("label"))
        out = F.when(text.rlike("(?i)" + p), v) if out is None else out.when(text.rlike("(?i)" + p), v)
    return out


def prescan(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """T4: (hits, clean lines). A flagged line is quarantined, not warned about."""
    x = lines.withColumn("inj", injection_label(F.col("text")))
    return x.where("inj is not null").select(*lines.columns, "inj.*"), x.where("inj is null").drop("inj")
