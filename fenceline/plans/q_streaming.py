"""Streaming jobs driven over the event tables to completion; each result is the state of its memory sink."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..session import checkpoint_dir
from ..streaming import jobs as J
from . import views as V
from .registry import query


def _stream(spark, sf, name: str) -> DataFrame:
    """A table read as a stream."""
    path = f"{sf}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _drive(df: DataFrame, mode: str = "append", flush=None) -> DataFrame:
    """Run to completion into a parquet folder under the checkpoint folder and read that back."""
    spark = df.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch, epoch):
        batch.withColumn("__epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out/*")


def _staged(spark, sf, table: str, stage, build, start, n: int = 3) -> str:
    """Rows of a table arrive in n stages; after each, the query runs on what is there and ends, and the next run goes on from its checkpoint.

    start(df, base) gives the writer of the built stream; the result is the folder it writes under.
    """
    base = f"{checkpoint_dir(spark)}/staged-{uuid.uuid4().hex}"
    rows = V.table(spark, sf, table)
    for k in range(n):
        rows.where(stage == k).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        start(build(stream), base).option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start().awaitTermination()
    return base


def _appended(df: DataFrame, base: str):
    """A writer in append mode, one folder for each batch."""
    return df.writeStream.outputMode("append").foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}"))


def _third(spark, sf):
    """Which third of the time span an event lies in; one of 97 of the first third comes with the last, long after its window has closed."""
    lo, hi = V.table(spark, sf, "events").agg(F.unix_micros(F.min(F.col("ts").cast("timestamp"))), F.unix_micros(F.max(F.col("ts").cast("timestamp")))).first()
    third = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - lo) * 3 / F.lit(hi - lo + 1)).cast("int")
    return F.when((third == 0) & (F.col("event_id") % 97 == 0), 2).otherwise(third)


#: The same for SQL: events that count, with ts in whole seconds, and how far event time has got at the end.
THIRDS = """b AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events), t AS (SELECT e.*, CAST(floor((epoch_us(ts) - lo) * 3 / CAST(hi - lo + 1 AS double)) AS int) AS third FROM events e, b),
 e AS (SELECT event_id, CAST(user_id AS string) AS rule_id, date_trunc('second', ts) AS ts FROM t WHERE event_id % 10 < 8 AND NOT (third = 0 AND event_id % 97 = 0)), m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM e)"""


def _lines(spark, sf, e=None):
    e = e if e is not None else _stream(spark, sf, "events")
    tail = (F.when(F.col("event_id") % 10 == 9, F.concat(F.lit("heartbeat "), F.col("event_id").cast("string")))
            .when(F.col("event_id") % 10 == 8, F.concat(F.lit("fw01 drop src=10.0.0."), (F.col("user_id") % 250).cast("string"), F.lit(" dport="), (F.col("event_id") % 1000).cast("string")))
            .otherwise(F.concat(F.lit("rule="), F.col("user_id").cast("string"), F.lit(" action="), "event_type", F.lit(" proto=tcp"))))
    return e.select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" "), tail).alias("value"))


@query("stream_parse_logs", "WITH " + V.duck_cte("px_log_lines") + " SELECT event_id, CASE WHEN event_id % 10 < 8 THEN CAST(user_id AS string) ELSE '' END AS rule_id, CASE WHEN event_id % 10 = 8 THEN 'deny' ELSE event_type END AS action FROM px_log_lines WHERE event_id % 10 <> 9")
def stream_parse_logs(spark, sf):
    return _drive(J.stream_parse_logs(_lines(spark, sf), 2024)).select("event_id", "rule_id", "action")


@query("stream_rule_activity", f"WITH {THIRDS} SELECT rule_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS start, count(*) AS n FROM e, m GROUP BY rule_id, 2, date_trunc('hour', ts), mark HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark")
def stream_rule_activity(spark, sf):
    """Closed windows only, over three runs; what comes after its window has closed is dropped."""
    base = _staged(spark, sf, "events", _third(spark, sf), lambda e: J.stream_rule_activity(J.stream_parse_logs(_lines(spark, sf, e), 2024)), _appended)
    return spark.read.parquet(f"{base}/out/*").select("rule_id", F.date_format("start", "yyyy-MM-dd HH").alias("start"), "n")


@query("stream_rule_activity_sliding", f"""WITH {THIRDS}, w AS (SELECT rule_id, date_trunc('hour', ts) + INTERVAL 1 HOUR * k AS start, mark FROM e, m, (SELECT unnest([-1, 0]) AS k))
 SELECT rule_id, strftime(start, '%Y-%m-%d %H') AS start, count(*) AS n FROM w GROUP BY rule_id, w.start, mark HAVING w.start + INTERVAL 2 HOUR <= mark""")
def stream_rule_activity_sliding(spark, sf):
    """Windows of two hours that begin every hour."""
    base = _staged(spark, sf, "events", _third(spark, sf), lambda e: J.stream_rule_activity(J.stream_parse_logs(_lines(spark, sf, e), 2024), "2 hours", "1 hour"), _appended)
    return spark.read.parquet(f"{base}/out/*").select("rule_id", F.date_format("start", "yyyy-MM-dd HH").alias("start"), "n")


@query("stream_quiet_rules", f"""WITH {THIRDS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY rule_id ORDER BY ts) >= INTERVAL 1 DAY THEN 1 ELSE 0 END AS b FROM e),
 s AS (SELECT *, sum(b) OVER (PARTITION BY rule_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT rule_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS active_from, count(*) AS n FROM s, m GROUP BY rule_id, s, mark HAVING max(ts) + INTERVAL 1 DAY <= mark""")
def stream_quiet_rules(spark, sf):
    """Sessions that have closed: rules that have been quiet for a day."""
    base = _staged(spark, sf, "events", _third(spark, sf), lambda e: J.stream_quiet_rules(J.stream_parse_logs(_lines(spark, sf, e), 2024), "1 day"), _appended)
    return spark.read.parquet(f"{base}/out/*").select("rule_id", F.date_format("active_from", "yyyy-MM-dd HH:mm:ss").alias("active_from"), "n")


@query("stream_drift_alerts", "WITH " + V.duck_cte("px_snapshots") + """, p AS (SELECT *, lag(sc) OVER w AS psc, lag(st) OVER w AS pst FROM px_snapshots WINDOW w AS (PARTITION BY device_key ORDER BY taken_at, snapshot_id))
 SELECT device_key, snapshot_id, 'score_drop' AS kind, 'score' AS item FROM p WHERE sc < psc UNION ALL SELECT device_key, snapshot_id, 'framework_drop', 'cis' FROM p WHERE sc % 100 < psc % 100 UNION ALL SELECT device_key, snapshot_id, 'control_regressed', 'K1' FROM p WHERE pst = 'O' AND st = 'F'""")
def stream_drift_alerts(spark, sf):
    st = F.when(F.col("o_orderstatus") == "O", "PASS").when(F.col("o_orderstatus") == "F", "FAIL").otherwise("UNKNOWN")
    lo, hi = V.table(spark, sf, "orders").agg(F.unix_micros(F.min(F.col("o_orderdate").cast("timestamp"))), F.unix_micros(F.max(F.col("o_orderdate").cast("timestamp")))).first()
    stage = F.floor((F.unix_micros(F.col("o_orderdate").cast("timestamp")) - lo) * 3 / F.lit(hi - lo + 1)).cast("int")
    shots = lambda o: o.select(F.col("o_custkey").cast("string").alias("device_key"), F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").cast("timestamp").alias("taken_at"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("score_pct"),
                 F.create_map(F.lit("K1"), st).alias("states"), F.create_map(F.lit("cis"), (F.floor(F.col("o_totalprice") / 1000) % 100).cast("double")).alias("frameworks"))
    base = _staged(spark, sf, "orders", stage, shots, J.stream_drift_alerts)
    return J.stored_alerts(spark, base).select("device_key", "snapshot_id", "kind", "item")


@query("stream_detect", "SELECT p_partkey AS line, CASE WHEN p_partkey % 3 = 0 THEN 'telnet_enabled' ELSE 'any_any_permit' END AS detector FROM part WHERE p_partkey % 3 <> 2")
def stream_detect(spark, sf):
    k = F.col("p_partkey")
    l = _stream(spark, sf, "part").select(F.lit("d").alias("device_id"), k.alias("line"), F.when(k % 3 == 0, "transport input telnet").when(k % 3 == 1, "access-list permit any any").otherwise("no ip http server").alias("text"))
    return _drive(J.stream_detect(l)).select("line", "detector")


@query("stream_dedup_events", f"WITH {THIRDS} SELECT event_id AS line, 'default_snmp_community' AS detector FROM t WHERE event_id % 2 = 0 AND NOT (third = 0 AND event_id % 97 = 0)")
def stream_dedup_events(spark, sf):
    """Every line is sent twice, a minute apart; ten minutes of state are kept, and what comes after them is dropped."""
    def sent(e):
        text = F.when(F.col("event_id") % 2 == 0, "snmp-server community public RO").otherwise("hostname x")
        twice = e.withColumn("again", F.explode(F.array(F.lit(0), F.lit(60))))
        return twice.select(F.lit("d").alias("device_id"), F.col("event_id").alias("line"), F.timestamp_seconds(F.unix_timestamp(F.col("ts").cast("timestamp")) + F.col("again")).alias("ts"), text.alias("text"))
    base = _staged(spark, sf, "events", _third(spark, sf), lambda e: J.stream_dedup_events(sent(e)), _appended)
    return spark.read.parquet(f"{base}/out/*").select("line", "detector")


@query("stream_static_corroborate", "SELECT CAST(user_id AS string) AS rule_id, CASE WHEN user_id % 4 = 1 THEN 'counter_was_reset' ELSE 'active' END AS verdict, count(*) AS n FROM events WHERE event_id % 10 < 8 AND user_id % 6 <> 0 AND user_id IN (SELECT c_custkey FROM customer) GROUP BY 1, 2")
def stream_static_corroborate(spark, sf):
    c = V.table(spark, sf, "customer")
    k = F.col("c_custkey")
    rules = c.select(k.cast("string").alias("id"), F.lit("").alias("name"), (k % 6 != 0).alias("enabled"), F.when(k % 4 == 1, F.lit(0)).otherwise(k).alias("hit_count"))
    return _drive(J.stream_static_corroborate(J.stream_parse_logs(_lines(spark, sf), 2024), rules)).groupBy("rule_id", "verdict").agg(F.count(F.lit(1)).alias("n"))
