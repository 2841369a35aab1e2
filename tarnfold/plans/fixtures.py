"""The engine's ledgers and chunk points as views of the given tables.

A view is a table and its columns as expressions that Spark and the reference SQL read
alike, so a query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnfold.session import table

SCOPE = {"tenant_id": "concat('t', CAST(o_custkey % 4 AS STRING))", "project_id": "concat('p', CAST(o_custkey % 3 AS STRING))"}
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "runs": ("orders", {
        "id": "o_orderkey", **SCOPE, "doc_id": "concat('d', CAST(o_custkey AS STRING))", "doc_version": "concat('v', CAST(o_orderkey % 5 AS STRING))",
        "status": "CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_orderkey % 3 = 0 THEN 'hitl' ELSE 'running' END",
        "current_node": "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderkey % 2 = 0 THEN 'judge' ELSE 'refine' END",
        "error_code": "CASE WHEN o_orderstatus = 'P' THEN concat('E', CAST(o_orderkey % 7 AS STRING)) ELSE '' END", "updated_at": "o_orderdate",
    }),
    "nodes": ("lineitem", {
        "run_id": "l_orderkey", "part": "l_partkey", "supp": "l_suppkey", "line": "l_linenumber",
        "node_name": "CASE l_linenumber % 5 WHEN 0 THEN 'ingest' WHEN 1 THEN 'cleanup' WHEN 2 THEN 'judge' WHEN 3 THEN 'refine' ELSE 'metadata' END",
        "status": "CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'completed' END", "error_code": "CASE WHEN l_linestatus = 'O' AND l_returnflag <> 'N' THEN concat('N', CAST(l_partkey % 5 AS STRING)) ELSE '' END",
        "error_message": "CASE WHEN l_partkey % 50 = 0 THEN 'timeout' ELSE '' END", "duration_ms": "l_quantity",
    }),
    "tasks": ("orders", {
        "id": "o_orderkey", **SCOPE, "run_id": "o_orderkey", "judge_score": "CAST(o_orderkey % 6 AS DOUBLE)", "is_sensitive": "o_custkey % 7 = 0",
        "status": "CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' ELSE 'skipped' END",
        "assigned_to": "CASE WHEN o_custkey % 3 = 0 THEN '' ELSE concat('u', CAST(o_custkey % 9 AS STRING)) END", "open": "o_custkey % 5 = 0",
    }),
    "feedback": ("conversations", {
        "id": "conv_id * 100 + turn", "tenant_id": "concat('t', CAST(conv_id % 4 AS STRING))", "project_id": "concat('p', CAST(conv_id % 3 AS STRING))", "corpus_id": "concat('c', CAST(conv_id % 2 AS STRING))",
        "doc_id": "concat('d', CAST(conv_id AS STRING))", "category": "role", "created": "turn",
    }),
    "points": ("documents", {
        "id": "doc_id", "tenant_id": "concat('t', CAST(doc_id % 4 AS STRING))", "project_id": "concat('p', CAST(doc_id % 3 AS STRING))", "corpus_id": "source", "doc_id": "concat('d', CAST(doc_id % 300 AS STRING))",
        "doc_version": "concat('v', CAST(doc_id % 5 AS STRING))", "chunk_index": "doc_id % 9", "is_finalized": "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE doc_id % 3 <> 0 END", "is_active_version": "doc_id % 2 = 0",
        "fidelity_flag": "CASE doc_id % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'partial' WHEN 2 THEN 'low_confidence' ELSE 'needs_review' END", "text": "text",
    }),
    "pages_done": ("conversations", {
        "session_id": "conv_id", "page_num": "turn", "status": "CASE WHEN (conv_id + turn) % 5 = 0 THEN 'error' WHEN (conv_id + turn) % 7 = 0 THEN 'skipped' WHEN (conv_id + turn) % 3 = 0 THEN 'pending' ELSE 'done' END",
        "enabled": "(conv_id * 3 + turn) % 11 <> 0", "markdown": "text",
    }),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, columns = VIEWS[name]
    return table(spark, sf_dir, base).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def with_views(*names: str) -> str:
    """The views as the head of a SQL query."""
    return "WITH " + ", ".join(f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in VIEWS[n][1].items())} FROM {VIEWS[n][0]})" for n in names) + " "
