"""Framework crosswalks, requirement states and per-framework scores."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.compare import judge
from ..functions.text import base_control
from ..types import DECIDED, small_side

# Framework keys, and platform names as the profile table spells them.
FRAMEWORKS = ["cis", "nist_800_53", "stig", "iso_27001"]
PLATFORM_KEY = {"paloalto_panos": "panos", "fortinet_fortios": "fortios", "juniper_srx_xml": "juniper_srx"}


def crosswalk(ids: DataFrame, xwalk: DataFrame) -> DataFrame:
    """Targets of each id; an enhancement without a row of its own inherits its base control's.

    ids(key, id), xwalk(from_id, to_id) -> key, targets[] distinct and in order (plain clauses before annex ones).
    """
    i = ids.withColumn("cid", F.upper("id")).withColumn("base", base_control(F.col("id")))
    x = xwalk.select(F.col("from_id"), F.col("to_id")).distinct()
    have = x.select(F.col("from_id").alias("cid"), F.lit(True).alias("direct")).distinct()
    j = i.join(have, "cid", "left").withColumn("via", F.when(F.col("direct"), F.col("cid")).otherwise(F.col("base")))
    t = j.join(x, F.col("via") == F.col("from_id"), "left").select("key", "to_id").distinct()
    pairs = F.array_sort(F.collect_list(F.when(F.col("to_id").isNotNull(), F.struct(F.col("to_id").startswith("A.").alias("a"), "to_id"))))
    return t.groupBy("key").agg(F.transform(pairs, lambda p: p["to_id"]).alias("targets"))


def crosswalk_coverage(ids: DataFrame, xwalk: DataFrame) -> DataFrame:
    """Direct, inherited or missing, per id."""
    have = xwalk.select(F.col("from_id").alias("k"), F.lit(True).alias("hit")).distinct()
    i = ids.withColumn("cid", F.upper("id")).withColumn("base", base_control(F.col("id")))
    d = have.select(F.col("k").alias("cid"), F.col("hit").alias("d"))
    b = have.select(F.col("k").alias("base"), F.col("hit").alias("b"))
    return i.join(d, "cid", "left").join(b, "base", "left").select(
        "key", "cid", F.when(F.col("d"), "direct").when(F.col("b"), "inherited").otherwise("missing").alias("coverage"))


def provenance_chain(hits: DataFrame, doc_ccis: DataFrame, cci_nist: DataFrame, nist_iso: DataFrame, limit: int = 3) -> DataFrame:
    """Rule hit -> its CCIs -> NIST control -> ISO clause, the score inherited and never raised.

    hits(probe, doc_id, rank, score), doc_ccis(doc_id, pos, cci), cci_nist(cci, pos, nist), nist_iso(nist, pos, clause).
    """
    n = (hits.join(doc_ccis.withColumnRenamed("pos", "p1"), "doc_id").join(cci_nist.withColumnRenamed("pos", "p2"), "cci")
         .groupBy("probe", "nist").agg(F.min_by(F.struct("rank", "p1", "p2", "doc_id", "cci", "score"), F.struct("rank", "p1", "p2")).alias("f")))
    n = n.withColumn("nrank", F.row_number().over(W.partitionBy("probe").orderBy("f.rank", "f.p1", "f.p2", "nist"))).where(F.col("nrank") <= limit)
    iso = nist_iso.where(F.col("clause").startswith("A."))
    own = iso.select("nist", F.lit(True).alias("own")).distinct()
    top = (n.where("nrank = 1").join(own, "nist", "left")
           .withColumn("via", F.when(F.col("own"), F.col("nist")).otherwise(F.split_part("nist", F.lit("."), F.lit(1)))))
    c = top.join(iso.select(F.col("nist").alias("via"), "pos", "clause"), "via")
    c = c.withColumn("crank", F.row_number().over(W.partitionBy("probe").orderBy("pos", "clause"))).where(F.col("crank") <= limit)
    return (n.select("probe", F.lit("nist_800_53").alias("framework"), F.col("nist").alias("target"), F.col("nrank").alias("rank"),
                     F.col("f.score").alias("score"), F.col("f.doc_id").alias("from_id"), F.col("f.cci").alias("via"))
            .unionByName(c.select("probe", F.lit("iso_27001").alias("framework"), F.col("clause").alias("target"), F.col("crank").alias("rank"),
                                  (F.col("f.score") / F.col("crank")).alias("score"), F.col("nist").alias("from_id"), F.lit("crosswalk").alias("via"))))


def framework_state(labelled: DataFrame, profiles: DataFrame) -> DataFrame:
    """A decided finding judged again by a framework's own threshold, where a profile gives one.

    labelled has framework, control_id, platform, state, operator, observed; profiles(framework, control_id, platform, expected).
    """
    key = F.col("platform")
    for k, v in PLATFORM_KEY.items():
        key = F.when(F.col("platform") == k, v).otherwise(key)
    p = small_side(profiles.select("framework", "control_id", F.col("platform").alias("pkey"), F.col("expected").alias("own")), 100000)
    j = labelled.withColumn("pkey", key).join(p, ["framework", "control_id", "pkey"], "left")
    j = judge(j, "operator", "observed", "own", "judged")
    judged = F.when(F.col("state").isin(DECIDED) & F.col("own").isNotNull(), F.col("judged")).otherwise(F.col("state"))
    return j.withColumn("fstate", judged).withColumn("profiled", F.col("fstate") != F.col("state")).drop("pkey", "own", "judged")


def requirement_state(state: Column) -> Column:
    """W5 (aggregate): any failure is NOT_MET, all passes is MET, anything else is UNDECIDED."""
    return (F.when(F.count_if(state.isin("FAIL", "PARTIAL")) > 0, "NOT_MET")
            .when(F.count_if(state == "PASS") == F.count(F.lit(1)), "MET").otherwise("UNDECIDED"))


def label_rows(findings: DataFrame) -> DataFrame:
    """One row per finding and framework that cites it."""
    return (findings.select("device_id", "platform", "control_id", "state", "operator", "observed", F.explode("frameworks").alias("framework", "ids"))
            .where((F.size("ids") > 0) & F.col("framework").isin(FRAMEWORKS)))


def requirements(judged: DataFrame) -> DataFrame:
    """State and share of passed checks per device, framework and requirement."""
    r = judged.where("fstate != 'NOT_APPLICABLE'").withColumn("requirement", F.explode("ids"))
    dec, ok = F.count_if(F.col("fstate").isin(DECIDED)), F.count_if(F.col("fstate") == "PASS")
    return r.groupBy("device_id", "framework", "requirement").agg(requirement_state(F.col("fstate")).alias("rstate"), F.when(dec > 0, ok / dec).alias("share"))


def framework_coverage(findings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each framework scored over its own requirements, beside the check-level numbers."""
    j = framework_state(label_rows(findings), profiles)
    checks = j.groupBy("device_id", "framework").agg(
        F.count(F.lit(1)).alias("controls"), F.count_if(F.col("fstate").isin(DECIDED)).alias("decided"),
        F.count_if(F.col("fstate") == "PASS").alias("passed"), F.count_if("profiled").alias("profiled_controls"))
    r = requirements(j).groupBy("device_id", "framework").agg(
        F.count(F.lit(1)).alias("requirements"), F.count("share").alias("requirements_decided"),
        F.count_if(F.col("rstate") == "MET").alias("requirements_met"), F.count_if(F.col("rstate") == "NOT_MET").alias("requirements_not_met"),
        F.array_sort(F.collect_list(F.when(F.col("rstate") == "NOT_MET", F.col("requirement")))).alias("not_met_ids"),
        F.avg("share").alias("mean_share"))
    out = checks.join(r, ["device_id", "framework"], "left").na.fill(0, ["requirements", "requirements_decided", "requirements_met", "requirements_not_met"])
    return (out.withColumn("score_pct", F.when(F.col("decided") > 0, F.round(100.0 * F.col("passed") / F.col("decided"), 1)))
            .withColumn("framework_score_pct", F.round(100.0 * F.col("mean_share"), 1)))


def framework_summary(coverage: DataFrame) -> DataFrame:
    """Fleet totals per framework and over all of them."""
    return (coverage.groupingSets([["framework"], []], "framework").agg(
        F.count_distinct("device_id").alias("devices"), F.sum("controls").alias("controls"), F.sum("passed").alias("passed"),
        F.sum("requirements_met").alias("requirements_met"), F.sum("requirements_not_met").alias("requirements_not_met"))
        .withColumn("framework", F.coalesce("framework", F.lit("ALL"))))


def catalog_counts(catalog: DataFrame) -> DataFrame:
    """Entries per framework and automatability with subtotals."""
    return (catalog.rollup("framework", "automatability").agg(F.count(F.lit(1)).alias("entries"), F.grouping_id().alias("gid"))
            .select(F.when(F.col("gid") >= 3, "TOTAL").otherwise(F.col("framework")).alias("framework"),
                    F.when(F.col("gid") >= 1, "ALL").otherwise(F.col("automatability")).alias("automatability"), "entries"))


def attack_coverage(control_ids: DataFrame, mapping: DataFrame, techniques: DataFrame) -> DataFrame:
    """Techniques the control set stands in front of, by tactic. Unknown or withdrawn techniques are dropped."""
    live = techniques.where("not coalesce(revoked, false)").select("technique", F.explode("tactics").alias("tactic"))
    hit = control_ids.select("control_id").distinct().join(mapping.select("control_id", "technique"), "control_id").join(live, "technique")
    return hit.groupBy("tactic").agg(F.array_sort(F.collect_set("technique")).alias("techniques"), F.count_distinct("control_id").alias("controls"))


def unpopulated_frameworks(known: DataFrame, catalog: DataFrame) -> DataFrame:
    """Frameworks that loaded nothing, and why. known(framework, reason)."""
    return known.join(catalog.select("framework").distinct(), "framework", "left_anti").where("reason is not null")
