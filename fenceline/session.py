"""Session helpers: builder defaults and lineage cutting that survives executor loss."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, types as T

BROADCAST_ROWS = 50000  # a table between steps that has more rows is broadcast by no join, however small its files are

def get_spark(app: str = "fenceline", master: str | None = None, shuffle_partitions: int | None = None,
              **conf: str) -> SparkSession:
    """A session with AQE on and UTC pinned. Cluster settings are left alone unless given."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC"))
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the cluster's setting, or a temporary one on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
    made = tempfile.mkdtemp(prefix="fenceline-ckpt-")
    sc.setCheckpointDir(made)
    return made


def _parquet_holds(t: T.DataType) -> bool:
    """Can a Parquet column have this type? Untyped nulls, intervals and empty structs cannot."""
    if isinstance(t, T.StructType):
        names = {f.name.lower() for f in t.fields}
        return len(names) == len(t.fields) > 0 and all(_parquet_holds(f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return _parquet_holds(t.elementType)
    if isinstance(t, T.MapType):
        return _parquet_holds(t.keyType) and _parquet_holds(t.valueType)
    return not isinstance(t, (T.NullType, T.CalendarIntervalType, T.DayTimeIntervalType, T.YearMonthIntervalType))


def cut_lineage(df: DataFrame) -> DataFrame:
    """df worked out once and kept in the checkpoint folder: an iterative plan stays flat and a lost executor loses no state.

    As a compressed Parquet table where its types allow that, which takes a small part of the disk of a checkpoint's rows and lets readers leave columns out.
    """
    if _parquet_holds(df.schema):
        return stored(df)
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the checkpoint folder: computed once, and what reads it may leave columns out.

    Spark takes the compressed files for the size of the rows, so joins would send large tables whole through the driver; a table of many rows is marked for shuffled joins.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    return out.hint("merge") if out.count() > BROADCAST_ROWS else out
