"""The corpus pipeline: documents without toxic ones, near duplicates and benchmark leaks, mixed and sharded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared
folder and reads it again as the next stage's docs; what a stage no longer needs is deleted. Null texts pass the filters and have no
tokens to mix. Shards are cut in the order of the mixing's permutation of the documents, not of their ids, so that every shard holds
all sources in their weights, as the blocks do; the copies of a document share a shard.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from sievelake.llm import common, decontam, mixing, neardup, sharding, toxicity


def _stage(f):
    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.importable(spark)
        return f(spark, docs, sf_dir)

    return run_stage


@_stage
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.without_near_duplicates(docs)


@_stage
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


@_stage
def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded(docs, order=mixing.order("doc_id"))


STAGES = [("toxicity", toxic), ("near duplicates", near_duplicates), ("benchmark decontamination", benchmark_leaks), ("mixing", mix), ("sharding", shards)]

#: Random walks, consistent sampling and alignment have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = common.save(stage(spark, docs, sf_dir))
        if before is not None:
            common.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
