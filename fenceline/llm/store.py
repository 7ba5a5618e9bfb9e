"""Tables that a plan reads more than once, written to the shared folder of the cluster, and column names that clash with no other."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from fenceline.session import checkpoint_dir


def written(df: DataFrame, what: str, **options: str) -> DataFrame:
    """df as Parquet files under spark.checkpoint.dir: computed once, and still there after executors are lost. options go to the writer."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}/{what}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plain(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named __c0, __c1, ... in order, and those names by the old ones."""
    names = {c: f"__c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names
