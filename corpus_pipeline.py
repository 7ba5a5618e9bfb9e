"""From raw documents to packed training sequences; every stage is one operator of fenceline.llm."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fenceline.llm import mixing, near, packing, quality, secrets
from fenceline.llm.store import written

#: The flattest mixture that reads no source more often than this; every document is read once at least.
MAX_EPOCHS = 1.25


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the compression bands keep."""
    return quality.keep_good(docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates on five-word shingles at 0.8; the one of the smallest doc_id."""
    return near.drop_copies(docs)


def scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with `<secret>` in place of every secret found in their texts."""
    return secrets.redact(docs, secrets.train(secrets.samples(docs)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources reads them; a document read twice is two rows."""
    return mixing.mix(docs, mixing.Target(max_epochs=MAX_EPOCHS)).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with their ids."""
    return packing.pack(docs)


STAGES = [("quality_rules", rules), ("near_dedup", copies), ("secret_scans", scan), ("mixing", mixture), ("packing", sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each reads the written table of the one before it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
