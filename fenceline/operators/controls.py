"""Control evaluation, scores, risk, remediation and what-if.

One shuffle by device carries the work: a device's settings that some control reads are folded
into a map (its size bounded by the control set), controls are a size-checked scalar array, and
every ladder step is then an expression over the two. Scoped settings, which are not bounded,
are reduced per (device, control) with partial aggregation first.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions.compare import PREPARED, as_items, compare, is_member, judge, prepare, same_value
from ..session import cut_lineage
from ..types import (ALLOW_WORDS, DECIDED, RESULT_STATES, SEVERITY_WEIGHT, TVAL, TVAL_DDL, WORST_RANK, bounded, small_side, lookup,
                     dealt, shuffled, tval_py)

MAX_CONTROLS = 5000
# Observations that one task sorts and folds.
OBSERVATIONS_A_TASK = 200000

REQUIRE = T.StructType([
    T.StructField("field", T.StringType()), T.StructField("equals", TVAL),
    T.StructField("not_in", TVAL), T.StructField("because", T.StringType())])
STEP = T.StructType([
    T.StructField("commands", T.ArrayType(T.StringType())), T.StructField("phase", T.IntegerType()),
    T.StructField("verify", T.StringType()), T.StructField("management_impact", T.StringType())])
CONTROL = T.StructType([
    T.StructField("control_id", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("field", T.StringType()), T.StructField("operator", T.StringType()),
    T.StructField("expected", TVAL), T.StructField("severity", T.StringType()),
    T.StructField("tier", T.StringType()), T.StructField("applies_to", T.ArrayType(T.StringType())),
    T.StructField("requires", T.ArrayType(REQUIRE)),
    T.StructField("frameworks", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("remediation", T.MapType(T.StringType(), STEP)),
    T.StructField("ordinal", T.IntegerType())])


def controls_df(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Authored control definitions (plain dicts) as the typed control table."""
    out = []
    for i, r in enumerate(rows):
        exp = tval_py(r.get("expected"))
        if r.get("operator") == "matches" and exp is not None:
            try:
                re.compile(str(r["expected"]))
            except re.error:
                exp["kind"] = "badregex"
        reqs = [{"field": q.get("field"), "equals": tval_py(q["equals"]) if "equals" in q else None,
                 "not_in": tval_py(list(q["not_in"])) if "not_in" in q else None, "because": q.get("because")}
                for q in r.get("requires") or []]
        rem = {k: {"commands": list(s.get("commands") or []), "phase": s.get("phase"), "verify": s.get("verify"),
                   "management_impact": s.get("management_impact")}
               for k, s in (r.get("remediation") or {}).items()}
        out.append({"control_id": r["id"], "title": r.get("title", r["id"]), "field": r["field"],
                    "operator": r["operator"], "expected": exp, "severity": r["severity"],
                    "tier": r.get("tier", "core"), "applies_to": list(r.get("applies_to") or []), "requires": reqs,
                    "frameworks": {k: list(v) for k, v in (r.get("frameworks") or {}).items()},
                    "remediation": rem, "ordinal": i})
    return spark.createDataFrame(out, CONTROL)


def with_controls(df: DataFrame, controls: DataFrame, *cols: str) -> DataFrame:
    """Each row of df beside every control: the control set enters as one size-checked scalar array."""
    names = list(cols) or controls.columns
    n = F.count(F.lit(1))
    packed = controls.agg(
        F.when(n <= MAX_CONTROLS, F.collect_list(F.struct(*names)))
        .otherwise(F.raise_error(F.lit("control set larger than its bound"))).alias("a"))
    return df.withColumn("__c", F.explode(packed.scalar())).select(*df.columns, "__c.*")


def judged_controls(controls: DataFrame) -> DataFrame:
    """Controls with their expected value laid out and their state for an absent setting, worked out once per control."""
    c = prepare(controls, "expected", "e", expected=True).withColumn("__none", F.lit(None).cast(TVAL_DDL))
    return prepare(c, "__none", "n").withColumn("absent", compare("operator", "n", "e")).drop("__none", *[f"n_{x}" for x in PREPARED])


def _read_fields(controls: DataFrame) -> DataFrame:
    reqs = controls.select(F.explode("requires").alias("r")).select(F.col("r.field").alias("field"))
    return controls.select("field").unionByName(reqs).where("field is not null").distinct()


def read_observations(observations: DataFrame, controls: DataFrame) -> DataFrame:
    """The observations of fields that some control reads; no other can change a finding."""
    return observations.join(small_side(_read_fields(controls), 4 * MAX_CONTROLS), "field", "left_semi")


def latest(observations: DataFrame) -> DataFrame:
    """The last write per (device, field, scope) wins; the place of the first write is kept for ties."""
    cols = [c for c in observations.columns if c not in ("device_id", "field", "scope", "ordinal")]
    return (observations.groupBy("device_id", "field", "scope")
            .agg(F.max_by(F.struct(*cols), "ordinal").alias("o"), F.min("ordinal").alias("ordinal"))
            .select("device_id", "field", "scope", "ordinal", "o.*"))


def scoped_worst(observations: DataFrame, controls: DataFrame) -> DataFrame:
    """Worst state over the scoped instances of a control's field, first in order on a tie."""
    ctl = small_side(controls.select("control_id", "field", "operator", "expected"), MAX_CONTROLS)
    s = observations.where("scope is not null").join(ctl, "field")
    s = judge(s, "operator", "value", "expected", "judged")
    judged = F.col("judged")
    st = (F.when(F.col("state") == "UNPARSED", F.lit("UNKNOWN"))
          .when((judged == "FAIL") & (F.col("state") == "DEFAULT_ASSUMED"), F.lit("UNKNOWN")).otherwise(judged))
    s = s.withColumn("st", st).withColumn("rk", lookup(F.col("st"), WORST_RANK, 9))
    worst = s.groupBy("device_id", "control_id").agg(
        F.min_by(F.struct("st", "value", "confidence", "evidence", "rk"), F.struct("rk", "ordinal")).alias("w"),
        F.count(F.lit(1)).alias("n"))
    first3 = (s.withColumn("k", F.row_number().over(W.partitionBy("device_id", "control_id", "rk").orderBy("ordinal")))
              .where("k <= 3").groupBy("device_id", "control_id", "rk")
              .agg(F.array_sort(F.collect_list(F.struct("k", "scope"))).alias("l"))
              .select("device_id", "control_id", F.col("rk").alias("lrk"), F.col("l.scope").alias("scopes")))
    j = worst.join(first3, ["device_id", "control_id"]).where("w.rk = lrk")
    return j.select("device_id", "control_id", F.col("w.st").alias("state"), F.col("w.value").alias("observed"),
                    F.col("w.confidence").alias("confidence"), F.col("w.evidence").alias("evidence"),
                    F.concat(F.lit("worst of "), F.col("n").cast("string"), F.lit(" scoped instance(s); "),
                             F.col("w.st"), F.lit(" at "), F.array_join("scopes", ", ")).alias("reason"))


def evaluate(devices: DataFrame, controls: DataFrame, observations: DataFrame,
             na_fields: DataFrame | None = None, na_domains: DataFrame | None = None) -> DataFrame:
    """One finding per device and control, by the precedence ladder.

    devices(device_id, platform), observations(device_id, field, scope, ordinal, state, value, confidence,
    evidence), na_fields(platform, field, reason), na_domains(platform, domain, reason).
    """
    obs = latest(dealt(read_observations(observations, controls), OBSERVATIONS_A_TASK, "device_id", "field", "scope"))
    plain = (obs.where("scope is null").groupBy("device_id")
             .agg(F.map_from_entries(F.collect_list(F.struct(
                 "field", F.struct("state", "value", "confidence", "evidence")))).alias("m")))
    scoped = (scoped_worst(obs, controls).groupBy("device_id")
              .agg(F.map_from_entries(F.collect_list(F.struct(
                  "control_id", F.struct("state", "observed", "confidence", "evidence", "reason")))).alias("sm")))
    d = devices.join(shuffled(plain), "device_id", "left").join(shuffled(scoped), "device_id", "left")
    d = _with_na(d, na_fields, na_domains)
    g = with_controls(d, judged_controls(controls), "control_id", "title", "field", "operator", "expected", "severity", "tier",
                      "applies_to", "requires", "frameworks", "absent", *[f"e_{x}" for x in PREPARED])
    m = F.col("m")
    domain = F.regexp_extract("field", r"^([^.\[]*)", 1)
    failing = F.filter("requires", lambda r: _requirement_fails(m, r))
    g = g.withColumns({"o": F.when(m.isNotNull(), F.element_at("m", F.col("field"))),
                       "so": F.when(F.col("sm").isNotNull(), F.element_at("sm", F.col("control_id"))),
                       "req": F.when(F.size("requires") > 0, F.get(failing, F.lit(0))),
                       "naf": F.element_at("na_f", F.col("field")), "nad": F.element_at("na_d", domain)})
    g = prepare(g.withColumn("ov", F.col("o.value")), "ov", "o").withColumn("direct", compare("operator", "o", "e"))
    direct, absent = F.col("direct"), F.col("absent")
    rv = F.element_at("m", F.col("req.field"))
    steps = [
        ((F.size("applies_to") > 0) & ~F.coalesce(F.array_contains("applies_to", F.col("platform")), F.lit(False)),
         F.lit("NOT_APPLICABLE"), F.concat(F.lit("control does not apply to platform "), F.coalesce("platform", F.lit("None"))), "none"),
        (F.col("naf").isNotNull(), F.lit("NOT_APPLICABLE"),
         F.concat("field", F.lit(" does not exist on platform "), F.coalesce("platform", F.lit("None")), F.lit(": "), "naf"), "none"),
        (F.col("nad").isNotNull(), F.lit("NOT_APPLICABLE"),
         F.concat(F.lit("platform has no "), domain, F.lit(" capability: "), "nad"), "none"),
        (F.col("req").isNotNull(), F.lit("NOT_APPLICABLE"),
         F.coalesce(F.col("req.because"), F.concat(F.lit("precondition not met: "), F.col("req.field"))), "req"),
        (F.col("o").isNull() & F.col("so").isNotNull(), F.col("so.state"), F.col("so.reason"), "so"),
        (F.col("o").isNull(), F.lit("UNKNOWN"), F.concat("field", F.lit(" was never evaluated by any mapping rule")), "none"),
        (F.col("o.state") == "UNPARSED", F.lit("UNKNOWN"),
         F.concat("field", F.lit(" appeared in the config but could not be interpreted")), "o"),
        (F.col("o.state") == "NOT_OBSERVED", absent,
         F.concat("field", F.lit(" not present in configuration"),
                  F.when(absent == "PASS", F.lit(" (absence satisfies this control)")).otherwise(F.lit(""))), "o"),
        ((direct == "FAIL") & (F.col("o.state") == "DEFAULT_ASSUMED"), F.lit("UNKNOWN"),
         F.concat("field", F.lit(" was assumed from platform defaults, not observed")), "o"),
    ]

    def ladder(i: int, last: Column) -> Column:
        c = None
        for s in steps:
            c = F.when(s[0], s[i]) if c is None else c.when(s[0], s[i])
        return c.otherwise(last)

    src = _ladder_src(steps)
    g = (g.withColumn("state", ladder(1, direct)).withColumn("src", src)
         .withColumn("reason", ladder(2, F.when(direct == "PARTIAL", F.lit("partially satisfied"))
                                      .when(direct == "ERROR", F.lit("operator failed")).otherwise(F.lit("")))))

    def pick(name, so_name=None):
        return (F.when(F.col("src") == "o", F.col(f"o.{name}")).when(F.col("src") == "so", F.col(f"so.{so_name or name}"))
                .when(F.col("src") == "req", rv[name]))

    return g.select("device_id", "platform", "control_id", "title", "field", "operator", "severity", "tier", "state",
                    "expected", pick("value", "observed").alias("observed"), "reason",
                    F.coalesce(pick("confidence"), F.lit(1.0)).alias("confidence"),
                    pick("evidence").alias("evidence"), "frameworks")


def _ladder_src(steps) -> Column:
    c = None
    for s in steps:
        c = F.when(s[0], F.lit(s[3])) if c is None else c.when(s[0], F.lit(s[3]))
    return c.otherwise(F.lit("o"))


def _requirement_fails(m: Column, r: Column) -> Column:
    """Only an OBSERVED value may suppress a control."""
    v = F.when(m.isNotNull() & r["field"].isNotNull(), F.element_at(m, r["field"]))
    val = v["value"]
    truthy = (F.when(val["kind"] == "bool", val["b"]).when(val["kind"] == "num", val["n"] != 0)
              .when(val["kind"] == "list", F.size(val["l"]) > 0).when(val["kind"] == "str", val["s"] != "")
              .otherwise(F.lit(False)))
    ok = (F.when(r["equals"].isNotNull(), same_value(val, r["equals"]))
          .when(r["not_in"].isNotNull(), ~is_member(val, r["not_in"])).otherwise(F.coalesce(truthy, F.lit(False))))
    return F.coalesce(v["state"] == "OBSERVED", F.lit(False)) & ~ok


def _with_na(d: DataFrame, na_fields, na_domains) -> DataFrame:
    """Per-platform exclusions, stated by a pack, as maps on the device row."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    for df, key, out in ((na_fields, "field", "na_f"), (na_domains, "domain", "na_d")):
        if df is None:
            d = d.withColumn(out, empty)
            continue
        per = bounded(df, 100000, "not-applicable table").groupBy("platform").agg(
            F.map_from_entries(F.collect_list(F.struct(key, F.coalesce("reason", F.lit("verified absent"))))).alias(out))
        d = d.join(F.broadcast(per), "platform", "left").withColumn(out, F.coalesce(out, empty))
    return d


# ------------------------------------------------------------------ scores

def score(findings: DataFrame, by: str = "device_id") -> DataFrame:
    """E5: severity-weighted score; PARTIAL counts half on both sides; NULL when nothing was decided."""
    w = lookup(F.col("severity"), SEVERITY_WEIGHT)
    half = F.when(F.col("state") == "PARTIAL", w * 0.5).otherwise(F.lit(0.0))
    p = F.sum(F.when(F.col("state") == "PASS", w).otherwise(half))
    x = F.sum(F.when(F.col("state") == "FAIL", w).otherwise(half))
    return findings.groupBy(by).agg(p.alias("w_pass"), x.alias("w_fail")).withColumn(
        "weighted_score_pct", F.when(F.col("w_pass") + F.col("w_fail") > 0,
                                     F.round(100.0 * F.col("w_pass") / (F.col("w_pass") + F.col("w_fail")), 1)))


def state_counts(findings: DataFrame, by: str = "device_id") -> DataFrame:
    """One column per state, zero where a state does not occur."""
    return findings.groupBy(by).pivot("state", RESULT_STATES).count().na.fill(0)


def coverage(findings: DataFrame, by: str = "device_id") -> DataFrame:
    """How much was decided, and the unweighted pass rate over what was."""
    st = F.col("state")
    c = findings.groupBy(by).agg(
        F.count(F.lit(1)).alias("controls_total"), F.count_if(st == "NOT_APPLICABLE").alias("not_applicable"),
        F.count_if(st.isin(DECIDED)).alias("controls_decided"),
        F.count_if(st.isin("UNKNOWN", "ERROR")).alias("controls_undecided"), F.count_if(st == "PASS").alias("passed"))
    app = F.col("controls_total") - F.col("not_applicable")
    return c.withColumn("controls_applicable", app).withColumn(
        "assessed_pct", F.when(app > 0, F.round(100.0 * F.col("controls_decided") / app, 1)).otherwise(F.lit(0.0))
    ).withColumn("score_pct", F.when(F.col("controls_decided") > 0,
                                     F.round(100.0 * F.col("passed") / F.col("controls_decided"), 1)))


# ------------------------------------------------------------------ control sets

def select_controls(controls: DataFrame, tiers: list[str] | None = None,
                    frameworks: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Controls of the chosen tiers citing a chosen framework, and the frameworks that cite nothing."""
    c = controls.where(F.col("tier").isin(tiers)) if tiers else controls
    spark = controls.sparkSession
    if not frameworks:
        return c, spark.createDataFrame([], "framework string")
    labels = c.select("control_id", F.explode("frameworks").alias("framework", "ids")).where(F.size("ids") > 0)
    chosen = spark.createDataFrame([(f,) for f in frameworks], "framework string")
    kept = c.join(labels.join(F.broadcast(chosen), "framework", "left_semi"), "control_id", "left_semi")
    return kept, chosen.join(labels, "framework", "left_anti")


def validate_controls(controls: DataFrame, catalog: DataFrame, fields: DataFrame) -> DataFrame:
    """Duplicate ids, unknown fields, missing labels and framework ids absent from a loaded catalogue."""
    from ..functions.text import canonical_nist_id, unscope
    labels = controls.select("control_id", F.explode("frameworks").alias("framework", "ids"))
    ids = labels.select("control_id", "framework", F.explode("ids").alias("id")).withColumn(
        "canon", F.when(F.col("framework") == "nist_800_53", canonical_nist_id(F.col("id"))).otherwise(F.col("id")))
    loaded = catalog.select("framework").distinct()
    bad = (ids.where(F.col("framework").isin("nist_800_53", "stig")).join(loaded, "framework", "left_semi")
           .join(catalog.select("framework", F.col("id").alias("canon")), ["framework", "canon"], "left_anti"))
    dup = controls.groupBy("control_id").count().where("count > 1")
    no_field = controls.withColumn("base", unscope(F.col("field"))).join(
        fields.select(F.col("field").alias("base")), "base", "left_anti")
    bare = controls.where(~F.exists(F.map_values("frameworks"), lambda a: F.size(a) > 0))
    return (dup.select("control_id", F.lit("duplicate").alias("problem"), F.lit("").alias("item"))
            .unionByName(no_field.select("control_id", F.lit("unknown_field").alias("problem"), F.col("field").alias("item")))
            .unionByName(bare.select("control_id", F.lit("no_labels").alias("problem"), F.lit("").alias("item")))
            .unionByName(bad.select("control_id", F.concat(F.lit("unknown_id:"), "framework").alias("problem"),
                                    F.col("id").alias("item"))))


def na_unjustified(findings: DataFrame) -> DataFrame:
    """NOT_APPLICABLE findings that state no reason (there must be none)."""
    return findings.where((F.col("state") == "NOT_APPLICABLE") & (F.trim(F.coalesce("reason", F.lit(""))) == ""))


# ------------------------------------------------------------------ risk and remediation

def exposure_facts(rules: DataFrame, policies: DataFrame) -> DataFrame:
    """What a device's policy proves about its untrusted side."""
    r = (rules.where("enabled").select("device_id", F.lower("action").alias("action"),
                                       F.explode("source_zones").alias("zone"))
         .select("device_id", "action", F.lower("zone").alias("zone")))
    u = policies.select("device_id", F.explode("untrusted_zones").alias("zone")).select(
        "device_id", F.lower("zone").alias("zone")).distinct()
    hit = r.join(u, ["device_id", "zone"], "left_semi").groupBy("device_id").agg(
        F.lit(True).alias("any_rule"), F.bool_or(F.col("action").isin(ALLOW_WORDS)).alias("any_allow"))
    return (policies.select("device_id", (F.size("untrusted_zones") > 0).alias("has_untrusted"))
            .join(hit, "device_id", "left").na.fill(False, ["any_rule", "any_allow"]))


def finding_risk(findings: DataFrame, rules: DataFrame, policies: DataFrame,
                 states: tuple[str, ...] = ("FAIL",)) -> DataFrame:
    """Severity base x proven exposure x confidence. A device without a policy is not discounted."""
    f = findings.where(F.col("state").isin(*states)).join(exposure_facts(rules, policies), "device_id", "left")
    base = lookup(F.col("severity"), SEVERITY_WEIGHT, 3.0) * F.when(F.col("state") == "PARTIAL", 0.5).otherwise(1.0)
    fld = F.coalesce(F.when(F.col("field") != "", F.col("field")), F.col("control_id"))
    policy_like = fld.contains("exposure") | fld.contains("firewall")
    mgmt_like = fld.contains("management") | fld.contains("snmp") | fld.contains("banner")
    expo = (F.when(~F.coalesce("has_untrusted", F.lit(False)), 1.0)
            .when(policy_like, F.when(F.col("any_allow"), 1.5).otherwise(0.6))
            .when(mgmt_like & F.col("any_rule"), 1.5).otherwise(1.0))
    conf0 = F.when(F.coalesce(F.col("confidence"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("confidence"))
    conf = F.when(F.coalesce(F.size("evidence"), F.lit(0)) <= 0, F.least(conf0, F.lit(0.7))).otherwise(F.least(conf0, F.lit(1.0)))
    f = f.withColumn("base", base).withColumn("exposure", expo).withColumn("conf", conf)
    f = f.withColumn("risk", F.col("base") * F.col("exposure") * F.col("conf"))
    return f.withColumn("band", F.when(F.col("risk") >= 12, "CRITICAL").when(F.col("risk") >= 7, "HIGH")
                        .when(F.col("risk") >= 3, "MEDIUM").otherwise("LOW"))


def device_risk(risks: DataFrame) -> DataFrame:
    """Total, counts by band and worst band per device."""
    return risks.groupBy("device_id").agg(
        F.round(F.sum("risk"), 1).alias("total_risk"), F.max_by("band", "risk").alias("worst"),
        *[F.count_if(F.col("band") == b).alias(b.lower()) for b in ("CRITICAL", "HIGH", "MEDIUM", "LOW")])


# What a remediation step cuts off, and the setting showing that transport is live.
IMPACT_FIELD = {"disables_http": "management.http.enabled", "disables_telnet": "management.telnet.enabled",
                "disables_ssh": "management.ssh.enabled"}
# A vendor's own timed revert, by platform prefix (first match in this order).
ROLLBACK = [("juniper", "commit confirmed 5"), ("cisco_asa", "reload in 5"), ("cisco", "reload in 5")]


def remediation_plan(risks: DataFrame, controls: DataFrame, observations: DataFrame) -> DataFrame:
    """Ordered steps per device; a step cutting the only live transport is deferred."""
    live = (latest(observations.where("scope is null").where(F.col("field").isin(*IMPACT_FIELD.values())))
            .where((F.col("value.kind") == "bool") & F.col("value.b"))
            .groupBy("device_id").agg(F.collect_set("field").alias("live")))
    spec = F.coalesce(F.element_at("remediation", F.coalesce("platform", F.lit(""))), F.element_at("remediation", F.lit("default")))
    ctl = small_side(controls.select("control_id", "remediation"), MAX_CONTROLS)
    r = risks.join(ctl, "control_id", "left").withColumn("spec", spec).join(live, "device_id", "left")
    impact = F.coalesce(F.col("spec.management_impact"), F.lit("none"))
    cuts = lookup(impact, IMPACT_FIELD)
    lives = F.coalesce(F.array_contains("live", cuts), F.lit(False))
    others = F.size(F.array_remove(F.col("live"), cuts))
    rollback = None
    for p, cmd in ROLLBACK:
        c = F.col("platform").startswith(p)
        rollback = F.when(c, cmd) if rollback is None else rollback.when(c, cmd)
    r = (r.withColumn("available", F.col("spec").isNotNull())
         .withColumn("phase", F.when(F.col("spec").isNotNull(), F.coalesce(
             F.when(F.col("spec.phase") != 0, F.col("spec.phase")), F.when(cuts.isNotNull(), 40).otherwise(30))))
         .withColumn("management_impact", impact).withColumn("deferred", lives & (others == 0))
         .withColumn("lockout_warning", F.when(lives & (others == 0), "only live management transport")
                     .when(lives, "confirm you are connected another way").otherwise("")))
    pos = F.row_number().over(W.partitionBy("device_id", "available", "deferred")
                              .orderBy("phase", F.col("risk").desc(), "control_id"))
    return r.withColumn("step", pos).select(
        "device_id", "platform", "control_id", "available", "deferred", "step", "phase", "risk", "band",
        "management_impact", "lockout_warning", F.col("spec.commands").alias("commands"),
        F.col("spec.verify").alias("verify"), rollback.alias("rollback"))


def version_notes(devices: DataFrame, packs: DataFrame) -> DataFrame:
    """Device release against the releases its pack was verified on."""
    from ..functions.version import release_key, version_covers
    p = packs.select("platform", "verified_versions")
    d = devices.join(small_side(p, 100000), "platform").where(F.size("verified_versions") > 0)
    res = F.transform("verified_versions", lambda v: version_covers(v, F.col("version")))
    unstated = F.coalesce(F.col("version"), F.lit("")) == ""
    note = (F.when(unstated, "not_stated").when(F.exists(res, lambda x: F.coalesce(x, F.lit(False))), F.lit(None))
            .when(F.forall(res, lambda x: x.isNull()), "not_comparable").otherwise("outside_verified"))
    return d.withColumn("note", note).where("note is not null").select("device_id", "platform", "version", "note")


# ------------------------------------------------------------------ what-if

# Fields computed from the policy; overwriting them would hide the rule behind a finding.
POLICY_DERIVED = ("exposure.", "firewall.rules", "firewall.default_action")


def compliant_value(op: Column, expected: Column, current: Column) -> Column:
    """A value that satisfies the operator, NULL when there is no single one."""
    from ..types import tv_list, tv_str
    items = F.when(expected["kind"] == "list", expected["l"])
    cur = F.when(current["kind"] == "list", current["l"]).otherwise(F.array().cast("array<string>"))
    want = F.floor(F.coalesce(expected["n"], expected["s"].try_cast("double"))).cast("int")
    first = F.when(F.size(items) > 0, F.get(items, F.lit(0)))
    add = F.greatest(want - F.size(cur), F.lit(0))
    filler = F.when(add > 0, F.transform(F.sequence(F.lit(1), F.greatest(add, F.lit(1))),
                                         lambda i: F.concat(F.lit("<added entry "), i.cast("string"), F.lit(">")))
                    ).otherwise(F.array().cast("array<string>"))
    low = F.transform(items, F.lower)
    return (F.when(op.isin("equals", "gte", "lte"), expected)
            .when(op == "in", F.when(first.isNotNull(), tv_str(first)).otherwise(expected))
            .when(op == "contains_all", tv_list(as_items(expected)))
            .when(op == "contains_none", tv_list(F.filter(cur, lambda x: ~F.coalesce(F.array_contains(low, F.lower(x)), F.lit(False)))))
            .when(op == "max_count", tv_list(F.slice(cur, 1, F.greatest(want, F.lit(0)))))
            .when(op == "min_count", tv_list(F.concat(cur, filler)))
            .when(op == "is_set", tv_str(F.lit("<configured>"))))


def disable_rules(rules: DataFrame, disabled: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rules after, applied, rejected) for disabled(device_id, rule): a rule is asked for by its name or id, in any case; of several the first is meant.

    applied(device_id, rule, id, scope, action_was), rejected(device_id, rule, why). scope is the name under which the rule's own settings stand.
    """
    want = disabled.select("device_id", "rule").distinct().withColumn("k", F.lower("rule"))
    named = rules.select("device_id", "id", "ord", "enabled", "action", F.coalesce(F.nullif("name", F.lit("")), "id").alias("scope"), F.explode(F.array_distinct(F.transform(F.array_compact(F.array("name", "id")), F.lower))).alias("k")).where("k <> ''")
    first = named.join(want.select("device_id", "k").distinct(), ["device_id", "k"], "left_semi").groupBy("device_id", "k").agg(F.min_by(F.struct("id", "enabled", "action", "scope"), F.struct("ord", "id")).alias("r"))
    q = want.join(shuffled(first), ["device_id", "k"], "left").join(rules.select("device_id", F.lit(True).alias("has")).distinct(), "device_id", "left")
    why = F.when(F.col("has").isNull(), "no policy object graph").when(F.col("r").isNull(), "no rule with this name or id").when(~F.col("r.enabled"), "already disabled")
    q = cut_lineage(q.withColumn("why", why))
    applied = q.where("why is null").select("device_id", "rule", "r.id", "r.scope", F.col("r.action").alias("action_was"))
    off = applied.select("device_id", "id", F.lit(True).alias("off")).distinct()
    after = rules.join(off, ["device_id", "id"], "left").withColumn("enabled", F.col("enabled") & F.col("off").isNull()).select(*rules.columns)
    return after, applied, q.where("why is not null").select("device_id", "rule", "why")


def what_if(devices: DataFrame, controls: DataFrame, observations: DataFrame, findings: DataFrame,
            fixes: DataFrame, rules: DataFrame | None = None, disabled: DataFrame | None = None, policies: DataFrame | None = None, **na):
    """Apply fixes(device_id, control_id) and disabled(device_id, rule) to a copy and judge it again.

    Returns (findings after, changes, rejected). rules are resolved, with their policies. A disabled rule leaves its device's policy: the
    exposure facts of that device are derived anew from the rules that stay, and the rule's own settings go. Only devices that something was applied to
    are judged again; of the others the findings stand. rejected(device_id, control_id, rule, why, suggest): a finding computed from the policy
    cannot be fixed by overwriting it; suggest names the rules behind it.
    """
    from .policy import EXPOSURE_FIELDS, exposure_observations
    ctl = small_side(controls.select("control_id", F.col("field").alias("cfield"), F.col("operator").alias("cop"),
                                              F.col("expected").alias("cexp")), MAX_CONTROLS)
    given = findings
    # both sides of the comparison read the findings; they are written once instead of being worked out again
    findings = cut_lineage(findings.select("device_id", "control_id", "state"))
    q = (fixes.select("device_id", "control_id").distinct().join(ctl, "control_id", "left")
         .join(findings.select("device_id", "control_id", F.col("state").alias("before")), ["device_id", "control_id"], "left"))
    derived = F.lit(False)
    for p in POLICY_DERIVED:
        derived = derived | F.col("cfield").startswith(p)
    q = q.withColumn("why", F.when(F.col("cfield").isNull() | F.col("before").isNull(), "no such control")
                     .when(~F.col("before").isin("FAIL", "PARTIAL"), "not a failure").when(derived, "computed from policy")
                     .when(F.col("cop").isin("not_equals", "not_in", "matches"), "no single compliant value"))
    q = cut_lineage(q)
    ok = q.where("why is null").select("device_id", F.col("cfield").alias("field"), "cop", "cexp", "control_id")
    rejected = q.where("why is not null").select("device_id", "control_id", F.lit(None).cast("string").alias("rule"), "why")
    touched = ok.select("device_id")
    off = None
    if disabled is not None and rules is not None:
        left, off, refused = disable_rules(rules, disabled)
        touched = touched.unionByName(off.select("device_id"))
        rejected = rejected.unionByName(refused.select("device_id", F.lit(None).cast("string").alias("control_id"), "rule", "why"))
    elif disabled is not None:
        rejected = rejected.unionByName(disabled.select("device_id", F.lit(None).cast("string").alias("control_id"), "rule", F.lit("no policy object graph").alias("why")).distinct())
    touched = cut_lineage(touched.distinct())
    now = latest(read_observations(observations, controls).join(touched, "device_id", "left_semi"))
    if off is not None and policies is not None:
        now = cut_lineage(now)  # three branches read it
        changed = off.select("device_id").distinct()
        gone = now.where(F.col("field").startswith("firewall.rules")).join(off.select("device_id", "scope").distinct(), ["device_id", "scope"], "left_semi").select("device_id", "field", "scope")
        stale = now.where(F.col("field").isin(list(EXPOSURE_FIELDS.values()))).join(changed, "device_id", "left_semi").select("device_id", "field", "scope")
        drop = gone.unionByName(stale).distinct().withColumn("drop", F.lit(True))
        kept = now.alias("n").join(shuffled(drop).alias("d"), (F.col("n.device_id") == F.col("d.device_id")) & (F.col("n.field") == F.col("d.field")) & F.col("n.scope").eqNullSafe(F.col("d.scope")), "left_anti")
        anew = exposure_observations(left.join(changed, "device_id", "left_semi"), policies.join(changed, "device_id", "left_semi"))
        now = cut_lineage(kept.unionByName(anew.select(*kept.columns)))
    # Controls on one field are applied in order, each seeing the last; the final one stands.
    last = ok.groupBy("device_id", "field").agg(F.max_by(F.struct("cop", "cexp"), "control_id").alias("f"))
    has_scope = now.groupBy("device_id", "field").agg(F.count_if(F.col("scope").isNotNull()).alias("ns"))
    fixed = now.join(last, ["device_id", "field"], "left").join(has_scope, ["device_id", "field"], "left")
    hit = F.col("f").isNotNull() & ((F.col("ns") == 0) | F.col("scope").isNotNull())
    sim = F.array(F.struct(F.lit("simulation").alias("file"), F.lit(None).cast("int").alias("line"),
                           F.concat(F.lit("[SIMULATED] "), F.col("field")).alias("raw"), F.lit("what-if").alias("record_id")))
    fixed = fixed.select("device_id", "field", "scope", "ordinal",
                         F.when(hit, F.lit("OBSERVED")).otherwise(F.col("state")).alias("state"),
                         F.when(hit, compliant_value(F.col("f.cop"), F.col("f.cexp"), F.col("value"))).otherwise(F.col("value")).alias("value"),
                         F.when(hit, F.lit(1.0)).otherwise(F.col("confidence")).alias("confidence"),
                         F.when(hit, sim).otherwise(F.col("evidence")).alias("evidence"))
    fresh = last.join(has_scope, ["device_id", "field"], "left_anti").select(
        "device_id", "field", F.lit(None).cast("string").alias("scope"), F.lit(0).cast("long").alias("ordinal"),
        F.lit("OBSERVED").alias("state"),
        compliant_value(F.col("f.cop"), F.col("f.cexp"), F.lit(None).cast(TVAL_DDL)).alias("value"),
        F.lit(1.0).alias("confidence"), sim.alias("evidence"))
    fixed = cut_lineage(fixed)
    judged = cut_lineage(evaluate(devices.join(touched, "device_id", "left_semi"), controls, fixed.withColumn("ordinal", F.col("ordinal").cast("long")).unionByName(fresh), **na))
    after = judged.unionByName(given.join(touched, "device_id", "left_anti"), allowMissingColumns=True)
    b = findings.select("device_id", "control_id", F.col("state").alias("before"))
    changes = (judged.select("device_id", "control_id", F.col("state").alias("after")).join(b, ["device_id", "control_id"])
               .where(F.col("before") != F.col("after"))
               .join(ok.select("device_id", "control_id", F.lit(True).alias("targeted")).distinct(), ["device_id", "control_id"], "left")
               .na.fill(False, ["targeted"]))
    suggest = F.lit(None).cast("array<string>")
    if rules is not None and "evidence" in given.columns and "evidence" in rules.columns:
        named = rejected.where("why = 'computed from policy'").select("device_id", "control_id").distinct()
        behind = rules_behind(given.join(named, ["device_id", "control_id"], "left_semi"), rules).groupBy("device_id", "control_id").agg(F.array_sort(F.collect_set("rule")).alias("suggest"))
        return after, changes, rejected.join(behind, ["device_id", "control_id"], "left")
    return after, changes, rejected.withColumn("suggest", suggest)


def score_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(device_id, score_delta, assessed_delta): by how many points a simulation moves the pass rate and the share decided; NULL where either side has none."""
    pair = lambda f, x: coverage(f).select("device_id", F.col("score_pct").alias(f"s{x}"), F.col("assessed_pct").alias(f"a{x}"))
    return pair(before, 0).join(pair(after, 1), "device_id").select("device_id", F.round(F.col("s1") - F.col("s0"), 1).alias("score_delta"), F.round(F.col("a1") - F.col("a0"), 1).alias("assessed_delta"))


def twins(rules: DataFrame, disabled: DataFrame) -> DataFrame:
    """Rules that permit exactly what a disabled rule did, and are still enabled.

    Rules equal on action, zones and (sorted) sides form a class; a class holding both a disabled rule and
    an enabled one is reported member by member, so the result stays linear in the rules however many copies exist.
    """
    sides = ["action", "source_zones", "destination_zones", F.array_sort("source"), F.array_sort("destination"), F.array_sort("services")]
    key = [F.xxhash64(F.lit(k), *sides).alias(f"h{k}") for k in (1, 2)]  # a class is told by 128 bits, so only narrow rows are moved
    off = disabled.select("device_id", F.col("rule").alias("id"), F.lit(True).alias("off")).distinct()
    m = rules.select("device_id", "id", "enabled", *key).join(off, ["device_id", "id"], "left").withColumn(
        "role", F.when(F.col("off"), "disabled").when(F.col("enabled"), "still_open")).where("role is not null")
    m = cut_lineage(m.select("device_id", "id", "role", "h1", "h2"))
    both = m.groupBy("device_id", "h1", "h2").agg(F.count_if(F.col("role") == "disabled").alias("n_disabled"),
                                                  F.count_if(F.col("role") == "still_open").alias("n_open"))
    return (m.join(both.where("n_disabled > 0 and n_open > 0"), ["device_id", "h1", "h2"])
            .select("device_id", F.concat(F.lpad(F.hex("h1"), 16, "0"), F.lpad(F.hex("h2"), 16, "0")).alias("twin_class"), F.col("id").alias("rule"), "role", "n_disabled", "n_open"))


def rules_behind(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules citing the same evidence as a finding."""
    keys = ["record_id", "line", "raw"]

    def cited(df, *cols):
        e = df.select("device_id", *cols, F.explode("evidence").alias("e"))
        return e.select("device_id", *cols, *[F.col(f"e.{k}").alias(k) for k in keys]).withColumn(
            "k", F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)).drop(*keys).distinct()

    return (cited(findings, "control_id").join(cited(rules, "id"), ["device_id", "k"])
            .select("device_id", "control_id", F.col("id").alias("rule")).distinct())
