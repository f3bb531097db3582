"""From raw documents to shards: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage is one of the operators of ``slowtruth.llm``, works on all rows its predecessor kept and is written
to the shared folder before the next one reads it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slowtruth.llm import decontam, mix, neardup, quality, shard
from slowtruth.session import materialize


def only_documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the compression bands accept."""
    return only_documents(quality.compression_bands(docs).where("kept"), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return only_documents(decontam.benchmark_hits(docs, benchmark).where("not contaminated"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return only_documents(neardup.near_duplicates(docs, percent=80).where("kept"), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that the tokens of sources, languages and topics meet their targets."""
    mixed = mix.mix_to_targets(docs.withColumn("topic", mix.form(docs["text"])), mix.TARGETS)
    return only_documents(mixed.where("kept"), docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal row counts, each in a uniform random order."""
    return shard.shard_rows(docs, 8)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
#: Compression ratios, sampling and a random permutation are not SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
