"""Vector search, retrieval evaluation, chunks and ledgers as DataFrame operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.functions.markdown import bound
from tarnfold.session import saver

# What the modes of fidelity let through.
FIDELITY = {"verified": ["verified"], "verified+partial": ["verified", "partial"], "verified_partial": ["verified", "partial"], "all": None}
QUERY_BLOCK, QUERY_BYTES = 256, 64 << 20


def search_predicate(tenant_id: str, project_id: str, corpus_id: str | None = None, fidelity: str = "verified") -> Column:
    """Finalised points of active versions in a scope and of a fidelity; a conjunction that reaches the scan. An unknown mode is an error."""
    if fidelity not in FIDELITY:
        raise ValueError(f"fidelity is one of {sorted(FIDELITY)}, not {fidelity!r}")
    out = (F.col("tenant_id") == tenant_id) & (F.col("project_id") == project_id) & F.col("is_finalized") & F.col("is_active_version")
    if corpus_id is not None:
        out = out & (F.col("corpus_id") == corpus_id)
    return out if FIDELITY[fidelity] is None else out & F.col("fidelity_flag").isin(FIDELITY[fidelity])


def _nearest(shared, k: int):
    """The k best points of each batch for every query: one matrix product a block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, q = shared.value
        for batch in batches:
            ids = batch.column("id").to_numpy()
            if not len(ids):
                continue
            v = np.stack(batch.column("vector").to_numpy(zero_copy_only=False)).astype(float)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            for a in range(0, len(asked), QUERY_BLOCK):
                who = asked[a : a + QUERY_BLOCK]
                score = np.round(v @ q[a : a + QUERY_BLOCK].T, 6)
                score[ids[:, None] == who[None, :]] = -np.inf
                best = np.lexsort((np.broadcast_to(ids[:, None], score.shape), -score), axis=0)[:k]
                at = np.broadcast_to(np.arange(len(who)), best.shape)
                fine = np.isfinite(score[best, at])
                yield pa.RecordBatch.from_arrays([pa.array(who[at[fine]]), pa.array(ids[best[fine]]), pa.array(score[best, at][fine])], names=["query_id", "id", "score"])

    return run


def search(points: DataFrame, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """query_id, rank, id, score: the k nearest points that pass the filter, by cosine, ties to the smaller id.

    points has id (long) and vector; queries has query_id (long) and vector. Queries of any
    number are taken in passes of about QUERY_BYTES, which is what the driver and a task hold at
    once; a batch of points gives k rows a query at most, so pairs are never built. Vectors
    that are null, or hold a null or no finite number, take no part.
    """
    spark = points.sparkSession
    usable = "vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    vector = F.col("vector").cast("array<double>").alias("vector")
    kept = (points if where is None else points.filter(where)).select(F.col("id").cast("long").alias("id"), vector).filter(usable)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), vector).filter(usable)
    size = asked.agg(F.sum(8 * (F.size("vector") + 1)).alias("n")).first()["n"] or 0
    passes = max(1, -(-size // QUERY_BYTES))
    save, found = saver(spark, "search"), None
    for p in range(passes):
        rows = asked.filter(F.pmod(F.xxhash64("query_id", "vector"), F.lit(passes)) == p).collect()  # about QUERY_BYTES
        q = np.array([r["vector"] for r in rows], float).reshape(len(rows), -1 if rows else 1)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((np.array([r["query_id"] for r in rows], np.int64), q))
        part = kept.mapInArrow(_nearest(shared, k), "query_id long, id long, score double")
        if passes > 1:  # its rows are written before the next pass's queries come
            part = save(part, f"pass{p}")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def evaluate(hits: DataFrame, expected: DataFrame, k: int, cases: DataFrame | None = None) -> DataFrame:
    """case_id, best_rank (0 without one), hit, mrr of every case: the first of its expected ids among its hits.

    expected has case_id and id; cases, where given, names the cases that expected may lack.
    """
    wanted = expected.select("case_id", F.col("id").alias("id")).distinct()
    first = hits.filter(F.col("rank") <= k).join(wanted, ["case_id", "id"]).groupBy("case_id").agg(F.min("rank").alias("best_rank"))
    every = (expected if cases is None else cases).select("case_id").distinct().join(first, "case_id", "left")
    return every.select("case_id", F.coalesce("best_rank", F.lit(0)).alias("best_rank"), F.col("best_rank").isNotNull().alias("hit"), F.coalesce(1.0 / F.col("best_rank"), F.lit(0.0)).alias("mrr"))


def evaluation_summary(cases: DataFrame) -> DataFrame:
    """cases, hit_rate and mrr over the rows of `evaluate`."""
    return cases.agg(F.count("*").alias("cases"), F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("hit_rate"), F.coalesce(F.avg("mrr"), F.lit(0.0)).alias("mrr"))


def word_chunks(text: Column, size: int, step: int) -> Column:
    """array<struct<chunk_index, chunk>>: overlapping runs of words; the last run ends the text."""

    def runs(words: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(words) - size) / step)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("chunk_index"), F.array_join(F.slice(words, i * step + 1, F.lit(size)), " ").alias("chunk")))

    return bound(F.filter(F.split(text, r"\s+"), lambda w: w != ""), runs)


def deterministic_embedding(text: Column, dim: int) -> Column:
    """Numbers in [0, 1) from sha256 of the text and a big-endian counter, eight a digest."""
    digests = -(-dim // 8)
    blocks = F.array(*[F.sha2(F.concat(text.cast("binary"), F.unhex(F.lit(f"{i:08x}"))), 256) for i in range(digests)])
    at = lambda i: F.conv(F.substr(F.element_at(blocks, F.floor(i / 8).cast("int") + 1), (i % 8) * 8 + 1, F.lit(8)), 16, 10).cast("double") / 4294967296.0
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), at)


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the greatest version of each key: ingesting twice leaves one. Aggregated before the shuffle, nothing is sorted."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct("*"), version).alias("_row")).select("_row.*")


def review_queue(tasks: DataFrame, n: int) -> DataFrame:
    """The n tasks of the highest priority, ties to the smaller id."""
    return tasks.orderBy(F.desc("priority"), "task_id").limit(n)
