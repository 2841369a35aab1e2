"""The chunk store: Parquet folders by tenant that never change, and records of those that a version consists of.

A change writes the tenants that it touches and then names them, so a reader sees the store before or
after it and never between, and other tenants' folders stay. Ids are a function of the chunk, so committing twice
changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.functions import decisions
from tarnfold.operators import ledger
from tarnfold.operators.commits import Commits
from tarnfold.operators.chunking import chunk_rows, with_chunks
from tarnfold.operators.retrieval import deterministic_embedding

SCOPE = ["tenant_id", "project_id", "corpus_id", "doc_id", "doc_version"]


class ChunkStore:
    """A folder of versions. Writers take turns; readers need no lock."""

    def __init__(self, spark: SparkSession, path: str, dim: int) -> None:
        self.log, self.dim = Commits(spark, path), dim

    def read(self) -> DataFrame:
        """The newest version; tenants' folders are pruned by a filter."""
        return self.log.read("points")

    def _right(self, points: DataFrame) -> DataFrame:
        """Vectors of another length are an error, at the row that has one."""
        return points.withColumn("vector", F.when(F.size("vector") == self.dim, F.col("vector")).otherwise(F.raise_error(F.lit(f"vectors have {self.dim} numbers"))))

    def write(self, points: DataFrame) -> None:
        """A new version of these points alone."""
        self.log.commit(self.log.snapshot(), replace={"points": self._right(points)}, by={"points": "tenant_id"})

    def scroll(self, where: Column, cursor: str | None = None, limit: int = 500) -> DataFrame:
        """The next payloads that pass the filter, by id; vectors aren't read."""
        return ledger.after_cursor(self.read().filter(where).drop("vector"), "id", cursor, limit)

    def set_payload(self, where: Column, **values: object) -> None:
        hit = F.coalesce(where, F.lit(False))
        self.log.change("points", where, lambda rows: rows.withColumns({k: F.when(hit, F.lit(v)).otherwise(F.col(k)).cast(rows.schema[k].dataType) for k, v in values.items()}))

    def delete(self, where: Column) -> None:
        self.log.change("points", where, lambda rows: ledger.without(rows, where))

    def activate(self, version: str, **document: object) -> None:
        own = F.lit(True)
        for k, v in document.items():
            own = own & (F.col(k) == v)
        self.log.change("points", own, lambda rows: ledger.activated(rows, version, **document))

    def commit(self, points: DataFrame) -> None:
        """The points in place of all of their documents' versions that are there, so that a version that shrank leaves nothing behind. Tenants that get none stay as they are."""
        base = self.log.snapshot()
        if "points" not in base.tables:
            self.write(points)
            return
        tenants = [r[0] for r in points.select("tenant_id").distinct().collect()]
        scopes = points.select(*SCOPE).distinct()
        added = self._right(points)
        known = {f.rpartition("/")[2] for f in base.tables["points"]["folders"]}
        if any(self.log._partition_name("tenant_id", t) in known for t in tenants):
            self.log.change("points", F.col("tenant_id").isin(tenants), lambda rows: rows.join(scopes, SCOPE, "left_anti").unionByName(added), base)
        else:
            self.log.commit(base, append={"points": added})


def points_of(docs: DataFrame, strategy: str, dim: int, **sizes: int) -> DataFrame:
    """Chunks of docs (the scope's columns, text, is_finalized, judge_score, retries) as points with ids, hashes, flags and vectors: one narrow job without a shuffle."""
    chunked = with_chunks(docs, strategy, **sizes)
    rows = chunk_rows(chunked.withColumn("fidelity_flag", decisions.fidelity_flag(F.col("judge_score"), F.col("retries"), 3)), *SCOPE, "is_finalized", "fidelity_flag", "strategy")
    digest = F.sha2("text", 256)
    rows = rows.withColumnRenamed("index", "chunk_index").withColumn("content_hash", digest)
    key = decisions.chunk_id([F.col(c) for c in [*SCOPE, "chunk_index", "content_hash"]])
    return rows.withColumns({"id": key, "vector": deterministic_embedding(F.col("text"), dim).cast("array<float>"), "is_active_version": F.lit(True), "chunking_strategy": F.col("strategy")}).drop("strategy", "sibling_ids")
