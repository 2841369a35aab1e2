"""Queries over chunks, vectors and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfold.operators import retrieval
from tarnfold.session import table
from tarnfold.streaming import runs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Queries are the rows whose id is divisible by 50, against all points with an even label."""
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    asked = points.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    return retrieval.search(points, asked, k, F.col("label") % 2 == 0)


_HITS = """
WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 AND b.label % 2 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM s)
"""
_CASES = _HITS + """, w AS (SELECT a.vec_id AS query_id, b.vec_id AS id FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND b.label = a.label AND a.vec_id <> b.vec_id),
f AS (SELECT query_id, min(rank) AS best_rank FROM r JOIN w USING (query_id, id) WHERE rank <= 10 GROUP BY query_id),
e AS (SELECT DISTINCT query_id AS case_id, coalesce(best_rank, 0) AS best_rank, best_rank IS NOT NULL AS hit, coalesce(1.0::DOUBLE / best_rank, 0.0) AS mrr FROM w LEFT JOIN f USING (query_id))
"""


@_register("filtered_search", _HITS + "SELECT query_id, id, score, rank FROM r WHERE rank <= 10")
def filtered_search(spark, sf_dir):
    return _hits(spark, sf_dir, 10)


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's expected points are those of its own label; only hits are looked up, so no pairs of a label are built."""
    points = table(spark, sf_dir, "embeddings")
    label = points.select(F.col("vec_id").alias("id"), "label")
    cases = label.filter("id % 50 = 0").select(F.col("id").alias("case_id"), F.col("label").alias("wanted"))
    hits = _hits(spark, sf_dir, 10).withColumnRenamed("query_id", "case_id")
    expected = hits.join(label, "id").join(cases, "case_id").filter("label = wanted").select("case_id", "id")
    return retrieval.evaluate(hits, expected, 10, cases)


@_register("retrieval_eval", _CASES + "SELECT * FROM e")
def retrieval_eval(spark, sf_dir):
    return _cases(spark, sf_dir)


@_register("retrieval_summary", _CASES + "SELECT count(*) AS cases, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 9) AS hit_rate, round(avg(mrr), 9) AS mrr FROM e")
def retrieval_summary(spark, sf_dir):
    return retrieval.evaluation_summary(_cases(spark, sf_dir)).select("cases", F.round("hit_rate", 9).alias("hit_rate"), F.round("mrr", 9).alias("mrr"))


@_register("vector_inventory", "SELECT label, count(*) AS points, count(DISTINCT vec_id) AS documents, count(*) FILTER (vec_id % 2 = 0) AS finalized FROM embeddings GROUP BY label")
def vector_inventory(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings")
    return points.groupBy("label").agg(F.count("*").alias("points"), F.count_distinct("vec_id").alias("documents"), F.count_if(F.col("vec_id") % 2 == 0).alias("finalized"))


@_register("orphans", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphans(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@_register("word_chunks", """WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(text, '\\s+') IF x <> ''] AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(CAST(1 + greatest(0, ceil((len(ws) - 64) / 48)) AS INT))) AS k FROM w)
SELECT doc_id, CAST(k AS INT) AS chunk_index, sha256(array_to_string(ws[k * 48 + 1 : k * 48 + 64], ' ')) AS digest FROM i""")
def word_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(retrieval.word_chunks(F.col("text"), 64, 48)).alias("c"))
    return docs.select("doc_id", "c.chunk_index", F.sha2("c.chunk", 256).alias("digest"))


@_register("chunk_quality", """WITH w AS (SELECT doc_id, text, [x FOR x IN regexp_split_to_array(text, '\\s+') IF x <> ''] AS ws FROM documents),
i AS (SELECT doc_id, text, ws, unnest(range(CAST(1 + greatest(0, ceil((len(ws) - 64) / 48)) AS INT))) AS k FROM w), c AS (SELECT doc_id, text, array_to_string(ws[k * 48 + 1 : k * 48 + 64], ' ') AS c FROM i)
SELECT doc_id, count(*) AS chunks, max(length(c) // 4) AS most_tokens, min(length(c) // 4) AS least_tokens, round(1 - count(DISTINCT c) / count(*), 6) AS duplicated,
round(sum(length(c)) / greatest(1, length(any_value(text))), 6) AS coverage FROM c GROUP BY doc_id""")
def chunk_quality(spark, sf_dir):
    each = F.transform(retrieval.word_chunks(F.col("text"), 64, 48), lambda c: c["chunk"])
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"), each.alias("c"))
    tokens = F.transform("c", lambda c: F.floor(F.length(c) / 4))
    total = F.aggregate("c", F.lit(0), lambda a, c: a + F.length(c))
    return docs.select("doc_id", F.size("c").cast("long").alias("chunks"), F.array_max(tokens).alias("most_tokens"), F.array_min(tokens).alias("least_tokens"), F.round(1 - F.size(F.array_distinct("c")) / F.size("c"), 6).alias("duplicated"), F.round(total / F.greatest(F.lit(1), F.col("n")), 6).alias("coverage"))


@_register("latest_versions", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def latest_versions(spark, sf_dir):
    return retrieval.latest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn")


@_register("review_queue", "SELECT o_orderkey AS task_id, (10 - o_orderkey % 10) * CASE WHEN o_orderstatus = 'O' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS priority FROM orders ORDER BY priority DESC, task_id LIMIT 100")
def review_queue(spark, sf_dir):
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), ((10 - F.col("o_orderkey") % 10) * F.when(F.col("o_orderstatus") == "O", 2.0).otherwise(1.0)).alias("priority"))
    return retrieval.review_queue(tasks, 100)


@_register("score_history", """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey % 5 + 1 AS score, lag(l_partkey % 5 + 1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS before FROM lineitem)
SELECT l_orderkey AS run, count(*) FILTER (score < before) AS worse, count(*) FILTER (score = before) AS plateaus FROM s GROUP BY l_orderkey""")
def score_history(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    scores = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 5 + 1).alias("score")).withColumn("before", F.lag("score").over(order))
    return scores.groupBy(F.col("l_orderkey").alias("run")).agg(F.count_if(F.col("score") < F.col("before")).alias("worse"), F.count_if(F.col("score") == F.col("before")).alias("plateaus"))


@_register("deterministic_embedding", """WITH h AS (SELECT doc_id, sha256(encode(text) || '\\x00\\x00\\x00\\x00'::BLOB) AS h FROM documents)
SELECT doc_id, round(CAST(CAST(concat('0x', substr(h, 1, 8)) AS UBIGINT) AS DOUBLE) / 4294967296, 9) AS first, round(CAST(CAST(concat('0x', substr(h, 57, 8)) AS UBIGINT) AS DOUBLE) / 4294967296, 9) AS eighth FROM h""")
def deterministic_embedding(spark, sf_dir):
    v = table(spark, sf_dir, "documents").select("doc_id", retrieval.deterministic_embedding(F.col("text"), 16).alias("v"))
    return v.select("doc_id", F.round(F.col("v")[0], 9).alias("first"), F.round(F.col("v")[7], 9).alias("eighth"))


@_register("streamed_runs", """SELECT date_trunc('hour', ts) AS started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def streamed_runs(spark, sf_dir):
    return runs.replay(spark, f"{sf_dir}/events.parquet")


@_register("feedback_counts", "SELECT role AS category, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM conversations WHERE role IS NOT NULL GROUP BY role")
def feedback_counts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").filter("role is not null")
    return turns.groupBy(F.col("role").alias("category")).agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("conversations"))
