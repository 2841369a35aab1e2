"""The corpus pipeline: five operators in order, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents; the last adds the virtual slot and the shard.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnfold.llm import decontaminate, language_id, mixing, ngram_join, sharding
from tarnfold.llm.workspace import Workspace

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or of several with none prevailing, go."""
    return language_id.keep_identified(docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest id."""
    return ngram_join.keep_first(docs, "pipeline_ngram")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic tokens are mixed out; other domains keep theirs."""
    return mixing.mix_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), name="pipeline_mix")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their virtual slot and shard, near-equal in bytes."""
    ws = Workspace(spark, "pipeline_shards")
    return sharding.assign_shards(docs, 8, f"{ws.path}/slot_map", ws)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", join_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
    ("sharding", shard),
]
# Trained models and iterative stages have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a stage's folder goes when the next is written."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name)
        if before:
            ws.drop(before)
        before = name
    return docs
