"""Snapshots, diffs, drift alerts and due jobs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.compare import as_text

# How good a state is, for telling an improvement from a regression.
RANK = {"FAIL": 0, "PARTIAL": 1, "UNKNOWN": 2, "ERROR": 2, "MANUAL_REVIEW": 2, "NOT_APPLICABLE": 3, "PASS": 4}
UNDECIDED = ["UNKNOWN", "ERROR", "MANUAL_REVIEW"]


def rule_signature() -> Column:
    """Everything about a rule that changes what it permits. The hit counter is left out on purpose."""
    def joined(c):
        return F.array_join(F.array_sort(c), ",")
    return F.concat_ws("|", "action", F.when(F.col("enabled"), "True").otherwise("False"), F.col("ord").cast("string"), joined("source"),
                       joined("destination"), joined("services"), joined("source_zones"), joined("destination_zones"))


def device_keys(d: DataFrame) -> DataFrame:
    """Every identifier a device shows, strongest first."""
    keys = F.array(F.when(F.coalesce("serial", F.lit("")) != "", F.concat(F.lit("serial:"), "serial")),
                   F.when(F.coalesce("hostname", F.lit("")) != "", F.concat(F.lit("host:"), "hostname")), F.concat(F.lit("file:"), "source_file"))
    return d.withColumn("device_keys", F.filter(keys, lambda k: k.isNotNull())).withColumn("device_key", F.get("device_keys", F.lit(0)))


def analysis_version(analysis: DataFrame) -> DataFrame:
    """A hash of the mapping and control definitions in force, taken in name order. analysis(name, content)."""
    from ..types import bounded
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "content"))), lambda x: F.concat(x["name"], x["content"])), "")
    return bounded(analysis, 100000, "analysis files").agg(F.substring(F.sha2(joined, 256), 1, 16).alias("v"))


def snapshot(findings: DataFrame, devices: DataFrame, framework_scores: DataFrame, taken_at: Column, version: Column) -> DataFrame:
    """One row per device, its maps bounded by the control set. Rules go to snapshot_rules, one row each."""
    # list observations are kept sorted so that a reordering is not a change
    val = F.when(F.col("observed.kind") == "list", F.to_json(F.array_sort("observed.l"))).otherwise(as_text(F.col("observed")))
    st = findings.groupBy("device_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("control_id", "state")))).alias("states"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(val.isNotNull(), F.struct("control_id", val.alias("v")))))).alias("observed"),
        F.count_if(F.col("state") == "PASS").alias("p"), F.count_if(F.col("state").isin("PASS", "FAIL", "PARTIAL")).alias("d"))
    fw = framework_scores.groupBy("device_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("framework", "framework_score_pct")))).alias("frameworks"))
    out = device_keys(devices).join(st, "device_id", "left").join(fw, "device_id", "left")
    return out.select("device_id", "device_key", "device_keys", taken_at.alias("taken_at"), F.col("sha256").alias("config_sha256"), version.alias("analysis_version"),
                      F.when(F.col("d") > 0, F.round(100.0 * F.col("p") / F.col("d"), 1)).alias("score_pct"), "states", "observed", "frameworks")


def snapshot_rules(rules: DataFrame, devices: DataFrame, snapshot_id: Column) -> DataFrame:
    """The signature of every rule at the time of a snapshot."""
    return rules.join(device_keys(devices).select("device_id", "device_key"), "device_id").select(
        "device_key", snapshot_id.alias("snapshot_id"), F.col("id").alias("rule_id"), rule_signature().alias("signature"))


def same_device(a_keys: Column, b_keys: Column, a_key: Column, b_key: Column) -> Column:
    """Any shared strong identifier; a file name is never one."""
    def strong(k):
        return F.filter(k, lambda x: ~x.startswith("file:"))
    return F.coalesce(F.arrays_overlap(strong(a_keys), strong(b_keys)), F.lit(False)) | (a_key == b_key)


def attribution(device_changed: Column, analysis_changed: Column) -> Column:
    return (F.when(device_changed & ~analysis_changed, "device").when(analysis_changed & ~device_changed, "analysis")
            .when(device_changed, "ambiguous").otherwise("neither"))


def direction(before: Column, after: Column) -> Column:
    from ..types import lookup
    return (F.when(before.isin(UNDECIDED) | after.isin(UNDECIDED), "coverage_change")
            .when(lookup(after, RANK, 2) > lookup(before, RANK, 2), "improved").otherwise("regressed"))


def latest_vs_previous(snapshots: DataFrame) -> DataFrame:
    """Each snapshot beside the one before it of the same device."""
    w = W.partitionBy("device_key").orderBy("taken_at", "snapshot_id")
    prev = F.lag(F.struct(*[c for c in snapshots.columns if c != "device_key"])).over(w)
    return snapshots.withColumn("prev", prev).where("prev is not null")


def _exploded(pairs: DataFrame, column: str, key: str) -> DataFrame:
    """Union of both maps' keys with the value on either side, without a join."""
    cur, old = F.col(column), F.col(f"prev.{column}")
    ks = F.array_distinct(F.concat(F.coalesce(F.map_keys(cur), F.array().cast("array<string>")), F.coalesce(F.map_keys(old), F.array().cast("array<string>"))))
    return pairs.withColumn(key, F.explode(ks)).withColumn("before", F.when(old.isNotNull(), F.element_at(old, F.col(key)))).withColumn(
        "after", F.when(cur.isNotNull(), F.element_at(cur, F.col(key))))


def diff_controls(pairs: DataFrame) -> DataFrame:
    """Controls present on both sides whose state changed, with direction and what it can be attributed to."""
    x = _exploded(pairs, "states", "control_id").where("before is not null and after is not null and before != after")
    attr = attribution(F.col("config_sha256") != F.col("prev.config_sha256"), F.col("analysis_version") != F.col("prev.analysis_version"))
    return x.select("device_key", "snapshot_id", "taken_at", "control_id", "before", "after", direction(F.col("before"), F.col("after")).alias("direction"), attr.alias("attributable_to"))


def diff_rules(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """C4: rules added, removed or modified by signature. rules(device_key, snapshot_id, rule_id, signature)."""
    now = pairs.select("device_key", "snapshot_id").join(rules, ["device_key", "snapshot_id"]).withColumnRenamed("signature", "after")
    old = pairs.select("device_key", F.col("snapshot_id").alias("cur"), F.col("prev.snapshot_id").alias("snapshot_id")).join(
        rules, ["device_key", "snapshot_id"]).select("device_key", F.col("cur").alias("snapshot_id"), "rule_id", F.col("signature").alias("before"))
    k = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "modified")
    return now.join(old, ["device_key", "snapshot_id", "rule_id"], "full").withColumn("change", k).where("change is not null").select(
        "device_key", "snapshot_id", "rule_id", "change")


def diff_rule_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """C4 over two plain rule tables."""
    def sig(df, name):
        return df.select("device_id", "id", rule_signature().alias(name))
    j = sig(before, "b").join(sig(after, "a"), ["device_id", "id"], "full")
    return j.select("device_id", F.col("id").alias("rule_id"), F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed")
                    .when(F.col("a") != F.col("b"), "modified").alias("change")).where("change is not null")


def diff_framework_scores(pairs: DataFrame) -> DataFrame:
    """Only frameworks recorded on both sides."""
    ks = F.array_intersect(F.map_keys("frameworks"), F.map_keys("prev.frameworks"))
    return pairs.withColumn("framework", F.explode(ks)).select("device_key", "snapshot_id", "taken_at", "framework",
                                                              F.element_at("prev.frameworks", F.col("framework")).alias("before"), F.element_at("frameworks", F.col("framework")).alias("after"))


def score_history(snapshots: DataFrame) -> DataFrame:
    """The score over time with its change."""
    w = W.partitionBy("device_key").orderBy("taken_at", "snapshot_id")
    return snapshots.select("device_key", "snapshot_id", "taken_at", "score_pct", F.row_number().over(w).alias("seq"),
                            (F.col("score_pct") - F.lag("score_pct").over(w)).alias("delta"))


def drift_alerts(pairs: DataFrame) -> DataFrame:
    """Score drops, framework drops and regressed controls against the previous snapshot."""
    keys = ["device_key", "snapshot_id", "taken_at"]
    s = pairs.where("score_pct < prev.score_pct").select(*keys, F.lit("score_drop").alias("kind"), F.lit("score").alias("item"),
                                                         F.col("prev.score_pct").cast("string").alias("before"), F.col("score_pct").cast("string").alias("after"))
    f = diff_framework_scores(pairs).where("after < before").select(*keys, F.lit("framework_drop").alias("kind"), F.col("framework").alias("item"),
                                                                    F.col("before").cast("string").alias("before"), F.col("after").cast("string").alias("after"))
    c = diff_controls(pairs).where("direction = 'regressed'").select(*keys, F.lit("control_regressed").alias("kind"), F.col("control_id").alias("item"), "before", "after")
    return s.unionByName(f).unionByName(c)


def due_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Never run, or last run plus interval has passed."""
    nxt = F.col("last_run") + F.make_dt_interval(mins=F.col("interval_minutes").cast("int"))
    return jobs.where(F.col("last_run").isNull() | (nxt <= now))
