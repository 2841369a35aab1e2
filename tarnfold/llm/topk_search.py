"""Exact maximum-inner-product top-k by norm-bucketed retrieval.

Vectors are ordered by length and cut into buckets. A query's bound is its k-th best
score within the bucket of the longest vectors; the bound, the query's length and the
bucket's greatest length give a local cosine threshold. A bucket whose threshold
exceeds 1 is skipped in the join itself. In others, a threshold of at least
`COORDINATE_FROM` prunes by ranges of the query's heaviest coordinates and a lower one
by length; what is left is verified by exact integer products.

Vectors travel packed, a bucket or a block of queries a row, so no step emits a row for
each pair of vectors. Buckets of near lengths form at most GROUPS groups, and where
lengths tie groups are split by a salt; a block of queries is sent to those groups alone
whose longest vector can reach its bound.

Defined cases: a vector that is null or holds a null or non-finite component takes no
part; vectors shorter than the longest count as padded by zeros; every row is a candidate
but the query's own, so rows that share an id meet each other, and one without an id is
found, as null and after its equals; with fewer than k candidates all are returned;
products beyond the range of a long are clamped to it. Rows are numbered in the order of
their ids, and go by that number until the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfold.llm.workspace import Workspace

BUCKET_ROWS, QUERY_ROWS, GROUPS, COORDINATE_FROM, COORDINATES = 4096, 1024, 2048, 0.75, 4
SCALE = 1024.0
LONG = 2**63


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def scaled(vector: Column) -> Column:
    """floor(1024 * x) as doubles; whole numbers, exact below 2^53."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * SCALE).cast("double"))


def length(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))


def _pack(rows: int, width: int, sort: bool):
    """Rows to packed blocks of at most `rows` vectors; sorted input gives buckets of near-equal lengths."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def block(df: pd.DataFrame) -> pd.DataFrame:
            mat = np.zeros((len(df), width))
            for i, v in enumerate(df["v"]):
                mat[i, : len(v)] = v
            norm = np.sqrt((mat * mat).sum(axis=1))
            order = np.argsort(-norm, kind="stable") if sort else np.arange(len(df))
            ids = df["row"].to_numpy(np.int64)[order]
            return pd.DataFrame({"block": [int(ids[0]) if len(ids) else 0], "n": [len(df)], "most": [float(norm.max(initial=0.0))], "ids": [ids.tobytes()], "mat": [mat[order].tobytes()]})

        for pdf in batches:
            held.append(pdf)
            while sum(map(len, held)) >= rows:
                whole = pd.concat(held, ignore_index=True)
                yield block(whole.iloc[:rows])
                held = [whole.iloc[rows:]]
        if sum(map(len, held)):
            yield block(pd.concat(held, ignore_index=True))

    return run


PACKED = "block long, n long, most double, ids binary, mat binary"


def _opened(ids: bytes, mat: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(mat, np.float64).reshape(len(i), -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, clamped to the range of a long."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 2**53:
        x, y = ([[int(v) for v in row] for row in m] for m in (a, b))
        return np.array([[max(-LONG, min(LONG - 1, sum(map(int.__mul__, r, s)))) for s in y] for r in x], dtype=object).reshape(len(a), len(b))
    return a @ b.T


def _bounds(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, mat: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query in the bucket of the longest vectors; -inf if it has fewer."""
    score = _products(q, mat).astype(np.float64)
    score[q_ids[:, None] == ids[None, :]] = -np.inf
    if score.shape[1] < k:
        return np.full(len(q), -np.inf)
    return -np.sort(-score, axis=1)[:, k - 1]


def _survivors(q: np.ndarray, bound: float, unit: np.ndarray, norm: np.ndarray, mat: np.ndarray) -> np.ndarray:
    """Positions in a bucket that may reach the bound, by coordinate or length pruning."""
    q_norm = float(np.sqrt(q @ q))
    if not np.isfinite(bound) or bound <= 0 or q_norm == 0:
        return np.arange(len(norm))
    # Length pruning: a score of at least the bound needs |p| >= bound / |q|; rows are sorted by length.
    last = int(np.searchsorted(-norm, -(bound / q_norm) * (1 - 1e-9), side="right"))
    if not last:
        return np.arange(0)
    cosine = min(1.0, bound / (q_norm * norm[0])) * (1 - 1e-9)
    if cosine < COORDINATE_FROM:
        return np.arange(last)
    # Coordinate pruning: with cosine t at least, p_f lies within q_f t -+ sqrt((1 - q_f^2)(1 - t^2)) or above.
    keep = np.ones(last, bool)
    w = q / q_norm
    for f in np.argsort(-np.abs(w))[:COORDINATES]:
        c = abs(w[f])
        low = c * cosine - np.sqrt(max(0.0, (1 - c * c) * (1 - cosine * cosine))) - 1e-9
        keep &= np.sign(w[f]) * unit[:last, f] >= low
    return np.nonzero(keep)[0]


def top_k(vectors: DataFrame, queries: Column, k: int = 10, name: str = "topk") -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each row for which `queries` holds."""
    spark = vectors.sparkSession
    ws = Workspace(spark, name)
    rows = vectors.filter(usable(F.col("embedding"))).select("vec_id", scaled(F.col("embedding")).alias("v"))
    last = F.asc_nulls_last("vec_id")
    rows = rows.withColumn("_any", F.rand(5)).repartitionByRange(last, "_any").sortWithinPartitions(last, "_any").drop("_any")
    rows = ws.save(rows.withColumns({"norm": length(F.col("v")), "row": F.monotonically_increasing_id()}), "rows")
    width = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 1)
    buckets = ws.save(rows.select("row", "v", "norm").repartitionByRange(F.desc("norm"), "row").sortWithinPartitions(F.desc("norm"), "row").mapInPandas(_pack(BUCKET_ROWS, width, True), PACKED), "buckets")
    n_buckets = buckets.count()
    head = buckets.orderBy(F.desc("most"), "block").limit(1).collect()  # one bucket of BUCKET_ROWS vectors
    head_ids, head_mat = (head[0]["ids"], head[0]["mat"]) if head else (b"", b"")

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                ids, mat = _opened(r.ids, r.mat)
                b = _bounds(ids, mat, *_opened(head_ids, head_mat), k)
                norms = np.sqrt((mat * mat).sum(axis=1))
                need = np.where((b > 0) & (norms > 0), b / np.maximum(norms, 1e-300), 0.0)
                yield pd.DataFrame({"q_ids": [r.ids], "q_mat": [r.mat], "bounds": [b.tobytes()], "need": [float(need.min()) * (1 - 1e-9)]})

    asked = rows.filter(queries).select("row", "v").mapInPandas(_pack(QUERY_ROWS, width, False), PACKED).mapInPandas(bound, "q_ids binary, q_mat binary, bounds binary, need double")
    # Buckets of near lengths are a group; a block of queries goes to the groups that can hold a candidate, and only there.
    groups = max(1, min(n_buckets, GROUPS))
    tops = sorted(set(buckets.approxQuantile("most", [(i + 1) / groups for i in range(groups)], 0.0)))  # at most GROUPS numbers
    upper = F.lit(tops).cast("array<double>")
    group = F.array_position(F.transform(upper, lambda t: F.col("most") <= t), True)
    salts = -(-groups // max(1, len(tops)))
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("g", F.explode(F.filter(F.sequence(F.lit(1).cast("long"), F.lit(len(tops)).cast("long")), lambda g: F.element_at(upper, g.cast("int")) >= F.col("need"))))
    cells = asked.join(buckets.withColumns({"g": group, "salt": F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")}), ["g", "salt"]).filter(F.col("most") >= F.col("need"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                q_ids, q = _opened(r.q_ids, r.q_mat)
                ids, mat = _opened(r.ids, r.mat)
                bounds = np.frombuffer(r.bounds, np.float64)
                norm = np.sqrt((mat * mat).sum(axis=1))
                unit = mat / np.maximum(norm, 1e-300)[:, None]
                out: list[tuple[int, np.ndarray, np.ndarray]] = []
                for i, qid in enumerate(q_ids):
                    at = _survivors(q[i], bounds[i], unit, norm, mat)
                    at = at[ids[at] != qid]
                    score = _products(q[i : i + 1], mat[at])[0] if len(at) else np.zeros(0)
                    keep = np.nonzero(score.astype(np.float64) >= bounds[i])[0] if np.isfinite(bounds[i]) else np.arange(len(at))
                    best = keep[np.lexsort((ids[at[keep]], -score[keep].astype(np.float64)))[:k]] if score.dtype != object else np.array(sorted(keep, key=lambda j: (-score[j], ids[at[j]]))[:k], dtype=int)
                    out.append((int(qid), ids[at[best]], score[best]))
                yield pd.DataFrame({"query": np.repeat([o[0] for o in out], [len(o[1]) for o in out]).astype(np.int64), "row": np.concatenate([o[1] for o in out]).astype(np.int64), "score": np.concatenate([o[2] for o in out]).astype(np.int64)})

    found = cells.select("q_ids", "q_mat", "bounds", "ids", "mat").mapInPandas(verify, "query long, row long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "row")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = rows.select("row", "vec_id")
    best = best.join(names, "row").join(names.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")), "query")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return top_k(vectors, F.col("vec_id") % 100 == 0, 10, "op3")


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS i, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.i AS query, a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_dot_product([CAST(x AS DOUBLE) FOR x IN a.q], [CAST(x AS DOUBLE) FOR x IN b.q]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.i <> b.i
  WHERE a.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST) AS k FROM s
)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""
