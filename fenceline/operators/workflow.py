"""Ownership, recertification, deletion candidates and consensus."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.compare import as_text


def certify(register: DataFrame, new: DataFrame) -> DataFrame:
    """The register after new certifications; one record per device and rule, the newest kept. An owner is required."""
    checked = new.withColumn("owner", F.when(F.trim(F.coalesce("owner", F.lit(""))) != "", F.trim("owner")).otherwise(
        F.raise_error(F.lit("a certification must name an owner")).cast("string")))
    both = register.withColumn("__o", F.lit(0)).unionByName(checked.select(*register.columns).withColumn("__o", F.lit(1)))
    cols = [c for c in register.columns if c not in ("device_id", "rule_id")]
    return (both.groupBy("device_id", "rule_id").agg(F.max_by(F.struct(*cols), F.struct("__o", "certified_at")).alias("r")).select("device_id", "rule_id", "r.*"))


def review(rules: DataFrame, register: DataFrame, unused: DataFrame, today: Column, within: int = 30) -> DataFrame:
    """R2: rules that need a human decision. unused(device_id, rule_id)."""
    u = unused.select("device_id", F.col("rule_id").alias("id"), F.lit(True).alias("stale")).distinct()
    c = register.select("device_id", F.col("rule_id").alias("id"), "owner", "certified_at", "period_days")
    j = rules.where("enabled").join(c, ["device_id", "id"], "left").join(u, ["device_id", "id"], "left")
    days = F.datediff(F.date_add("certified_at", F.coalesce("period_days", F.lit(365))), today)
    kind = (F.when(F.col("owner").isNull(), F.when(F.col("stale"), "stale_and_unowned").otherwise("unowned")).when(days < 0, "expired").when(days <= within, "expiring"))
    sev = F.when(F.col("kind").isin("stale_and_unowned", "expired"), "high").when(F.col("kind") == "unowned", "medium").otherwise("low")
    return (j.withColumn("days_remaining", F.when(F.col("owner").isNotNull(), days)).withColumn("kind", kind).where("kind is not null").withColumn("severity", sev)
            .select("device_id", F.col("id").alias("rule_id"), "kind", "severity", "owner", "days_remaining", "hit_count"))


def deletion_candidates(rules: DataFrame, hygiene: DataFrame, register: DataFrame) -> DataFrame:
    """Rules for which at least two independent signals agree, strongest first when ordered by confidence."""
    flags = hygiene.where(F.col("kind").isin("unused_rule", "redundant_rule", "shadowed_rule")).groupBy("device_id", F.col("rule_id").alias("id")).agg(
        *[F.bool_or(F.col("kind") == k).alias(k) for k in ("unused_rule", "redundant_rule", "shadowed_rule")])
    owned = register.select("device_id", F.col("rule_id").alias("id"), F.lit(True).alias("owned")).distinct()
    j = rules.join(flags, ["device_id", "id"], "left").join(owned, ["device_id", "id"], "left")
    sig = F.filter(F.array(F.when(F.col("unused_rule"), "unused"), F.when(F.col("redundant_rule"), "redundant"), F.when(F.col("shadowed_rule"), "shadowed"),
                           F.when(F.col("owned").isNull(), "unowned")), lambda x: x.isNotNull())
    return (j.withColumn("signals", sig).withColumn("confidence", F.size("signals")).where("confidence >= 2")
            .select("device_id", F.col("id").alias("rule_id"), "signals", "confidence", "hit_count"))


def _truthy(v: Column) -> Column:
    return F.coalesce(F.when(v["kind"] == "bool", v["b"]).when(v["kind"] == "num", v["n"] != 0).when(v["kind"] == "list", F.size(v["l"]) > 0)
                      .when(v["kind"].isin("str", "badregex"), v["s"] != ""), F.lit(False))


def _agrees(field: Column, detector: Column, v: Column, state: Column) -> Column:
    """Whether an observed value confirms a detection of insecurity; the field decides first, then the detector."""
    is_true, is_false = F.coalesce((v["kind"] == "bool") & v["b"], F.lit(False)), F.coalesce((v["kind"] == "bool") & ~v["b"], F.lit(False))
    text = F.lower(F.coalesce(as_text(v), F.lit("none")))
    # Fields whose mere presence confirms, SNMP versions and actions that count as insecure.
    by_field = field.isin("snmp.communities", "crypto.ipsec_proposals", "crypto.weak_ciphers")
    return (F.when(by_field, _truthy(v)).when(detector == "cleartext_credential", is_false).when(detector.isin("telnet_enabled", "cleartext_http_mgmt"), is_true)
            .when(detector == "weak_crypto", F.when(v["kind"] == "list", F.size(v["l"]) > 0).otherwise(is_true))
            .when(detector == "snmp_v1_v2c", text.isin("1", "v1", "2c", "v2c", "2")).when(detector.isin("default_snmp_community", "ftp_enabled"), _truthy(v))
            .when(detector == "any_any_permit", text.isin("permit", "allow", "accept")).otherwise(state == "FAIL"))


def consensus(detections: DataFrame, findings: DataFrame) -> DataFrame:
    """Each detection against the mapped finding on the same field (the first by control order)."""
    first = findings.groupBy("device_id", "field").agg(F.min_by(F.struct("state", "observed"), "control_id").alias("p"))
    d = detections.withColumn("field", F.col("field_hint")).join(first, ["device_id", "field"], "left")
    state, v = F.col("p.state"), F.col("p.observed")
    undecided = F.col("p").isNull() | state.isin("UNKNOWN", "NOT_APPLICABLE", "MANUAL_REVIEW")
    agree = F.coalesce(_agrees(F.col("field"), F.col("detector"), v, state), F.lit(False))
    return (d.withColumn("verdict", F.when(undecided, "UNCORROBORATED").when(agree, "CONFIRMED").otherwise("DISPUTED"))
            .withColumn("coverage_gap", F.col("p").isNull())
            .withColumn("confidence", F.when(F.col("verdict") == "CONFIRMED", 1.0).when(F.col("verdict") == "DISPUTED", 0.5).otherwise(F.col("confidence")))
            .withColumn("pack_state", F.coalesce(state, F.lit(""))).drop("p"))


def consensus_summary(items: DataFrame, findings: DataFrame) -> DataFrame:
    """Verdict counts, dispute rate, coverage gaps, and failures only the mapped side can see."""
    v = F.col("verdict")
    s = items.groupBy("device_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(v == "CONFIRMED").alias("confirmed"), F.count_if(v == "DISPUTED").alias("disputed"),
                                       F.count_if(v == "UNCORROBORATED").alias("uncorroborated"), F.count_if("coverage_gap").alias("coverage_gaps"))
    seen = items.select("device_id", "field").distinct()
    only = findings.where("state = 'FAIL'").join(seen, ["device_id", "field"], "left_anti").groupBy("device_id").agg(F.count(F.lit(1)).alias("pack_only"))
    return s.join(only, "device_id", "full").na.fill(0).withColumn("dispute_rate_pct", F.when(F.col("total") > 0, F.round(100.0 * F.col("disputed") / F.col("total"), 1)).otherwise(F.lit(0.0)))
