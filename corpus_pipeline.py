"""Corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; ``run`` applies them to
``documents``, writing each result as Parquet in the shared folder and reading it again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandex.llm import decontam, mixing, neardup, quality, sharding
from strandex.llm.common import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with the benchmark."""
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as they are taken (not in order of finish, as the next stage sorts by shard and id)."""
    return mixing.mixed_rows(docs, ordered=False)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus: every document of the mix with its shard and slot, sorted by them."""
    return sharding.sharded(docs)


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_dedup), ("decontamination", decontaminate), ("mixing", mix_sources), ("sharding", shard)]

#: Outlier estimates and the forest are no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
    return docs
