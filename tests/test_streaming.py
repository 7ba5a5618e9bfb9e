"""Event-time state over several runs from one checkpoint: closed windows only, late rows dropped and counted, last snapshots kept between runs."""
from pyspark.sql import functions as F

from fenceline.streaming import jobs as J


def feed(spark, base, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")


def run(spark, base, build, schema):
    df = build(spark.readStream.schema(schema).parquet(f"{base}/in").withColumn("ts", F.col("ts").cast("timestamp")))
    q = df.writeStream.outputMode("append").option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).foreachBatch(lambda b, e: b.write.mode("overwrite").parquet(f"{base}/out/epoch={e}")).start()
    q.awaitTermination()
    return sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])


EVENT = "ts string, rule_id string"


def test_windows_close_once_and_late_rows_are_counted(spark, tmp_path):
    base = f"file://{tmp_path}"
    slide = lambda e: J.stream_rule_activity(e, "2 hours", "1 hour")
    got = lambda: {(str(r.start)[11:16], r.rule_id): r.n for r in spark.read.parquet(f"{base}/out/*").collect()}
    feed(spark, base, [("2024-01-01 10:10:00", "a"), ("2024-01-01 10:50:00", "a"), ("2024-01-01 11:05:00", "b"), ("2024-01-01 11:05:00", "")], EVENT)
    assert run(spark, base, slide, EVENT) == 0 and got() == {}
    feed(spark, base, [("2024-01-01 13:30:00", "a"), ("2024-01-01 10:55:00", "a")], EVENT)  # out of order, in time
    assert run(spark, base, slide, EVENT) == 0
    assert got() == {("09:00", "a"): 3, ("10:00", "a"): 3, ("10:00", "b"): 1, ("11:00", "b"): 1}
    feed(spark, base, [("2024-01-01 10:20:00", "a"), ("2024-01-01 20:00:00", "a")], EVENT)  # too late for both of its windows
    assert run(spark, base, slide, EVENT) == 2
    assert got() == {("09:00", "a"): 3, ("10:00", "a"): 3, ("10:00", "b"): 1, ("11:00", "b"): 1, ("12:00", "a"): 1, ("13:00", "a"): 1}


def test_a_rule_that_comes_back_exactly_after_the_gap_was_quiet_for_it(spark, tmp_path):
    base = f"file://{tmp_path}"
    feed(spark, base, [("2024-01-01 10:00:00", "a"), ("2024-01-02 10:00:00", "a"), ("2024-01-01 10:00:00", "b"), ("2024-01-02 09:59:59", "b"), ("2024-01-09 00:00:00", "c")], EVENT)
    run(spark, base, lambda e: J.stream_quiet_rules(e, "1 day"), EVENT)
    got = sorted((r.rule_id, str(r.active_from), str(r.last_seen), str(r.quiet_since), r.n) for r in spark.read.parquet(f"{base}/out/*").collect())
    day = lambda n, t="10:00:00": f"2024-01-0{n} {t}"
    assert got == [("a", day(1), day(1), day(2), 1), ("a", day(2), day(2), day(3), 1), ("b", day(1), day(2, "09:59:59"), day(3, "09:59:59"), 2)]


def test_a_line_sent_again_within_the_watermark_is_dropped_and_state_ends(spark, tmp_path):
    base = f"file://{tmp_path}"
    schema = "ts string, device_id string, line int, text string"
    row = lambda t, n: (f"2024-01-01 {t}:00", "d", n, "snmp-server community public RO")
    feed(spark, base, [row("10:00", 1), row("10:05", 1), row("10:01", 2)], schema)
    run(spark, base, J.stream_dedup_events, schema)
    feed(spark, base, [row("10:09", 1), row("12:00", 3)], schema)
    run(spark, base, J.stream_dedup_events, schema)
    feed(spark, base, [row("12:05", 1), row("10:02", 2)], schema)  # long after: a new sighting; and one too late
    assert run(spark, base, J.stream_dedup_events, schema) == 1
    assert sorted(r.line for r in spark.read.parquet(f"{base}/out/*").collect()) == [1, 1, 2, 3]


def test_drift_compares_with_the_last_snapshot_of_earlier_runs(spark, tmp_path):
    base = f"file://{tmp_path}"
    schema = "device_key string, snapshot_id long, taken_at timestamp, score_pct double, states map<string,string>, frameworks map<string,double>"
    shot = lambda d, i, hour, score, state, fw: f"('{d}', {i}L, timestamp'2024-01-01 {hour}:00:00', {score}, map('K', '{state}'), map('cis', {fw}))"
    runs = [[shot("a", 1, "10", "90D", "PASS", "50D"), shot("b", 2, "10", "CAST(NULL AS DOUBLE)", "UNKNOWN", "1D"), shot("a", 3, "11", "80D", "PASS", "50D")],
            [shot("a", 4, "12", "80D", "FAIL", "40D"), shot("a", 5, "09", "1D", "FAIL", "1D")], [shot("b", 6, "12", "5D", "FAIL", "1D"), shot("c", 7, "12", "5D", "PASS", "1D")], [shot("a", 8, "13", "85D", "PASS", "40D"), shot("c", 9, "13", "4D", "UNKNOWN", "2D")]]
    cols = [c.split(" ")[0] for c in schema.split(", ")]
    for rows in runs:
        spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({', '.join(cols)})").coalesce(1).write.mode("append").parquet(f"{base}/in")
        J.stream_drift_alerts(spark.readStream.schema(schema).parquet(f"{base}/in"), base).option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start().awaitTermination()
    got = {(r.device_key, r.snapshot_id, r.kind, r.item, r.before, r.after) for r in J.stored_alerts(spark, base).collect()}
    assert got == {("a", 3, "score_drop", "score", "90.0", "80.0"), ("a", 4, "control_regressed", "K", "PASS", "FAIL"), ("a", 4, "framework_drop", "cis", "50.0", "40.0"), ("c", 9, "score_drop", "score", "5.0", "4.0")}
