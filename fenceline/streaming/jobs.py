"""The log, detection and drift questions as Structured Streaming transformations.

Each takes and gives a streaming DataFrame and reuses the batch Column expressions; the caller starts the query.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.change import drift_alerts, latest_vs_previous
from ..operators.detect import SPECIFICITY, hits_on_line, significant
from ..operators.logs import with_event


def stream_parse_logs(lines: DataFrame, year: int, text: str = "value") -> DataFrame:
    """Events of a stream of log lines; lines that are no event are dropped (count them with the batch twin)."""
    return with_event(lines, year, text).where("e is not null").select(*[c for c in lines.columns if c != text], "e.*")


def stream_rule_activity(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events and last match per rule and window; late events are counted until the watermark passes."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (events.where("rule_id != ''").withWatermark("ts", late).groupBy(w, "rule_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_seen"))
            .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "rule_id", "n", "last_seen"))


def stream_quiet_rules(events: DataFrame, gap: str = "90 days", late: str = "10 minutes") -> DataFrame:
    """Z3: sessions of a rule's activity; a closed session is a rule gone quiet for the gap. A session window takes in an event that comes
    exactly its gap later; such a rule has been quiet for the gap, so the window's is a microsecond shorter."""
    return (events.where("rule_id != ''").withWatermark("ts", late).groupBy(F.session_window("ts", f"{gap} -1 microseconds"), "rule_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_seen"))
            .select("rule_id", F.col("session_window.start").alias("active_from"), "last_seen", (F.col("session_window.end") + F.expr("interval 1 microsecond")).alias("quiet_since"), "n"))


def stream_detect(lines: DataFrame) -> DataFrame:
    """Detections on a stream of configuration lines (device_id, line, text, ...), stateless."""
    return significant(lines).withColumn("h", F.explode(hits_on_line(F.col("text")))).select(*[c for c in lines.columns], "h.detector", "h.severity", "h.field_hint", "h.matched")


def stream_dedup_events(lines: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """One finding per line. The most specific detection is chosen on the line itself, and a line sent again
    within the watermark is dropped."""
    order = F.transform(hits_on_line(F.col("text")), lambda h: F.struct(
        F.when(h["detector"] == "default_snmp_community", SPECIFICITY["default_snmp_community"]).when(h["detector"] == "weak_crypto", SPECIFICITY["weak_crypto"])
        .when(h["detector"] == "cleartext_credential", SPECIFICITY["cleartext_credential"]).otherwise(9).alias("r"), h["emit"].alias("emit"), h.alias("h")))
    one = significant(lines).withColumn("b", F.array_min(order)).where("b is not null")
    return one.select(*lines.columns, "b.h.detector", "b.h.severity", "b.h.field_hint").withWatermark(ts, late).dropDuplicatesWithinWatermark(["device_id", "line"])


def stream_static_corroborate(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Events joined to the rule table as they arrive: a match on a rule whose counter reads zero means the counter was reset."""
    r = rules.where("enabled").select(F.col("id").alias("rule_id"), F.col("name").alias("rule_name"), "hit_count")
    return events.where("rule_id != ''").join(r, "rule_id").withColumn("verdict", F.when(F.col("hit_count") == 0, "counter_was_reset").otherwise("active"))


SNAPSHOT = ["device_key", "snapshot_id", "taken_at", "score_pct", "states", "frameworks", "config_sha256", "analysis_version"]


def drift_batch(path: str):
    """Z4, the work on one micro-batch: (batch, epoch) -> None, for foreachBatch.

    Under `path`, alerts/epoch=N holds the alerts of a batch and last/epoch=N the last snapshot of every device after it. A batch meets only the stored
    snapshots of its own devices; each new snapshot is compared with the one before it by the batch operators. A snapshot older than the stored one
    is ignored. A batch that is run again after a failure overwrites what it wrote.
    """
    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        b = batch.select(*[F.col(c) if c in batch.columns else F.lit("").alias(c) for c in SNAPSHOT]).withColumn("new", F.lit(True))
        stored = (spark.read.schema(b.drop("new").schema).parquet(f"{path}/last/epoch={epoch - 1}") if epoch else b.drop("new").limit(0)).withColumn("new", F.lit(False))
        here = b.select("device_key").distinct()
        seen = stored.join(here, "device_key", "left_semi")
        late = b.join(seen.select("device_key", F.col("taken_at").alias("__at")), "device_key", "left").where("__at is null or taken_at >= __at").drop("__at")
        both = seen.unionByName(late)
        drift_alerts(latest_vs_previous(both).where("new")).write.mode("overwrite").parquet(f"{path}/alerts/epoch={epoch}")
        newest = both.groupBy("device_key").agg(F.max_by(F.struct(*SNAPSHOT[1:]), F.struct("taken_at", "snapshot_id")).alias("s")).select("device_key", "s.*")
        stored.drop("new").join(here, "device_key", "left_anti").unionByName(newest).write.mode("overwrite").parquet(f"{path}/last/epoch={epoch}")

    return run


def stream_drift_alerts(snapshots: DataFrame, path: str):
    """A writer that keeps alerts and last snapshots under `path`; the caller sets checkpoint and trigger and starts it."""
    return snapshots.writeStream.foreachBatch(drift_batch(path))


def stored_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The alerts written so far."""
    return spark.read.parquet(f"{path}/alerts/*")
