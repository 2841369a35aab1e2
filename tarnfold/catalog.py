"""Registry of the engine's queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _modules() -> list:
    from tarnfold.plans import admin_queries, chunk_queries, cleanup_queries, config_queries, corpus_queries, decision_queries, layout_queries, ledger_queries, retrieval_queries, storage_queries, text_queries

    return [cleanup_queries, admin_queries, corpus_queries, layout_queries, decision_queries, chunk_queries, text_queries, retrieval_queries, ledger_queries, storage_queries, config_queries]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnfold.plans import cleanup_queries

    return cleanup_queries.QUERIES["cleanup_markdown"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: query for module in _modules() for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.ORACLES.items()}
