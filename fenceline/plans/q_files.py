"""Sinks and readers in pairs: what is composed from the tables is written under the checkpoint folder and read back."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import logs as LG
from ..session import checkpoint_dir
from ..sources import files as S
from ..types import spread
from . import views as V
from .registry import query


def _folder(spark, what: str) -> str:
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}/{what}"


@query("read_config_files", """SELECT s_suppkey AS k, sha256(concat('hostname s', s_suppkey, chr(10), '! nation ', s_nationkey, chr(10), ' line ', s_name, chr(10))) AS sha256, 2 AS lines, NULL AS error FROM supplier""")
def read_config_files(spark, sf):
    """One file per supplier, read as whole files and cut into significant lines."""
    base = _folder(spark, "configs")
    s = V.table(spark, sf, "supplier")
    k = F.col("s_suppkey").cast("string")
    text = s.select("s_suppkey", F.concat(F.lit("hostname s"), k, F.lit("\n! nation "), F.col("s_nationkey").cast("string"), F.lit("\n line "), F.col("s_name")).alias("value"))
    # one folder holds all files: a folder for each would be made, moved and listed for each; many tasks write, and each moves its own files
    spread(text, "s_suppkey").select("value").write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(base)
    files = S.read_config_files(spark, base)
    own = F.max(F.regexp_extract("text", r"^hostname s(\d+)$", 1)).cast("bigint")
    n = S.explode_lines(files).groupBy("device_id", "path", "sha256", "error").agg(own.alias("k"), F.count(F.lit(1)).alias("lines"))
    return n.select("k", "sha256", "lines", "error")


@query("read_logs", "WITH " + V.duck_cte("px_log_lines") + " SELECT CASE WHEN event_id % 10 = 8 THEN 'deny' ELSE event_type END AS action, count(*) AS n FROM px_log_lines WHERE event_id % 10 <> 9 GROUP BY 1")
def read_logs(spark, sf):
    """Log lines written as text files, read and parsed."""
    base = _folder(spark, "logs")
    e = V.table(spark, sf, "events")
    tail = (F.when(F.col("event_id") % 10 == 9, F.concat(F.lit("heartbeat "), F.col("event_id").cast("string"))).when(F.col("event_id") % 10 == 8, F.concat(F.lit("fw01 drop src=10.0.0."), (F.col("user_id") % 250).cast("string"), F.lit(" dport=1")))
            .otherwise(F.concat(F.lit("rule="), F.col("user_id").cast("string"), F.lit(" action="), "event_type", F.lit(" proto=tcp"))))
    e.select(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" "), tail).alias("value")).write.text(base)
    return LG.with_event(S.read_logs(spark, base), 2024, "value").where("e is not null").groupBy(F.col("e.action").alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("jsonl_records", "SELECT p_partkey, p_name, CASE WHEN p_size % 2 = 0 THEN p_size END AS size FROM part")
def jsonl_records(spark, sf):
    """Records appended as JSON lines in two writes."""
    base = _folder(spark, "queue")
    p = V.table(spark, sf, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("size"))
    for rest in (0, 1):
        S.write_jsonl(p.where(F.col("p_partkey") % 2 == rest), base)
    return spark.read.schema(p.schema).json(base)


@query("snapshot_history", "SELECT CAST(o_custkey AS string) AS device_key, o_orderkey AS snapshot_id, o_totalprice AS score_pct, count(*) OVER (PARTITION BY o_custkey) AS kept FROM orders WHERE o_custkey % 7 = 0")
def snapshot_history(spark, sf):
    """Snapshots appended in two runs, laid out by day, and the history of the devices asked for."""
    base = _folder(spark, "history")
    o = V.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("device_key"), F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").cast("timestamp").alias("taken_at"), F.col("o_totalprice").alias("score_pct"))
    month = F.trunc("taken_at", "year").cast("timestamp")
    for rest in (0, 1):
        S.save_snapshot(o.where(F.col("snapshot_id") % 2 == rest).withColumn("taken_at", month), base)
    h = S.history(spark, base).where("cast(device_key as bigint) % 7 = 0")
    n = h.groupBy("device_key").agg(F.count(F.lit(1)).alias("kept"))
    return h.join(n, "device_key").select("device_key", "snapshot_id", "score_pct", "kept")
