"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, source mix, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsatlas.llm import decontaminate, jaccard_join, mixing, quality, sharding
from newsatlas.llm.frames import table
from newsatlas.session import cut, prepare


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    prepare(spark)
    return quality.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    prepare(spark)
    return jaccard_join.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    prepare(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: none, once or twice."""
    prepare(spark)
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their size, checksum, shard, and slot in it."""
    prepare(spark)
    return sharding.shard(docs)


STAGES = [
    ("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mix), ("sharding", shards),
]

#: Shingle sets, edit distances and hash draws have no counterpart in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
