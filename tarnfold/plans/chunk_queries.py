"""Queries over the chunkers, with structure injected alike in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.functions import chunking
from tarnfold.operators import chunking as C
from tarnfold.plans.text_queries import NL
from tarnfold.session import table

# Every line a paragraph, headings around them, and at the end a table, a list and a fence of one paragraph each.
PARTS = f"concat('Preface ', CAST(doc_id AS STRING), {NL}, {NL}, '# One ', CAST(doc_id % 3 AS STRING), {NL}, {NL}, replace(text, {NL}, concat({NL}, {NL})), {NL}, {NL}, '## Two', {NL}, {NL}, left(replace(text, {NL}, ' '), 700), {NL}, {NL}, '### Deep', {NL}, {NL}, 'short', {NL}, {NL}, '## Three', {NL}, {NL}, '| a | b |', {NL}, '|---|---|', {NL}, '| 1 | 2 |', {NL}, {NL}, '1. x', {NL}, '  more', {NL}, '- y', {NL}, {NL}, 'end')"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(PARTS).alias("text"))


def _rows(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "index", F.sha2("text", 256).alias("digest"), F.array_join("section_path", "/").alias("path"))


_BASE = f"WITH i AS (SELECT doc_id, {PARTS} AS t FROM documents), p AS (SELECT doc_id, unnest(string_split(t, concat({NL}, {NL}))) AS p, unnest(range(len(string_split(t, concat({NL}, {NL}))))) AS k FROM i)"
# The stack of headings: a title holds until one of its level or above.
_PATHS = r""", h AS (SELECT *, length(regexp_extract(p, '^(#{1,6})\s', 1)) AS level, regexp_extract(p, '^#{1,6}\s+(.*)$', 1) AS title FROM p),
s AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER w AS section, max(CASE WHEN level = 1 THEN k END) OVER w AS k1, max(CASE WHEN level = 2 THEN k END) OVER w AS k2, max(CASE WHEN level = 3 THEN k END) OVER w AS k3 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
q AS (SELECT s.*, array_to_string([x FOR x IN [a.title, CASE WHEN s.k2 > coalesce(s.k1, -1) THEN b.title END, CASE WHEN s.k3 > greatest(coalesce(s.k1, -1), coalesce(s.k2, -1)) THEN c.title END] IF x IS NOT NULL], '/') AS path
  FROM s LEFT JOIN h a ON a.doc_id = s.doc_id AND a.k = s.k1 LEFT JOIN h b ON b.doc_id = s.doc_id AND b.k = s.k2 LEFT JOIN h c ON c.doc_id = s.doc_id AND c.k = s.k3)"""


def _greedy(source: str, size: str, more: str) -> str:
    """Run numbers of the parts of each group (doc_id, section), in order of k, by a fold that carries the run's size."""
    return f"""g AS (SELECT doc_id, section, list(p ORDER BY k) AS ps, list({size} ORDER BY k) AS ns, any_value(path) AS path FROM {source} GROUP BY doc_id, section),
f AS (SELECT *, list_reduce([{{'run': 0, 'total': 0, 'n': CAST(n AS BIGINT), 'runs': CAST([] AS BIGINT[])}} FOR n IN ns], lambda a, b: CASE WHEN len(a.runs) > 0 AND NOT ({more}) THEN {{'run': a.run + 1, 'total': b.n, 'n': b.n, 'runs': list_append(a.runs, a.run + 1)}}
  ELSE {{'run': a.run, 'total': a.total + b.n, 'n': b.n, 'runs': list_append(a.runs, a.run)}} END, {{'run': 0, 'total': 0, 'n': 0::BIGINT, 'runs': CAST([] AS BIGINT[])}}).runs AS runs FROM g),
u AS (SELECT doc_id, section, path, unnest(ps) AS p, unnest(runs) AS run, unnest(range(len(ps))) AS k FROM f),
j AS (SELECT doc_id, section, run, any_value(path) AS path, trim(string_agg(p, concat({NL}, {NL}) ORDER BY k), concat(' ', chr(9), {NL})) AS text FROM u GROUP BY doc_id, section, run)"""


@lambda f: QUERIES.__setitem__("semantic_chunks", f)
def semantic_chunks(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("chunks", chunking.semantic_chunks(F.col("text"), 120, 160))
    return _rows(C.chunk_rows(docs, "doc_id"))


_SEMANTIC = f"{_BASE}{_PATHS}, {_greedy('q', 'greatest(1, length(p) // 4)', 'a.total + b.n <= 160 OR a.total < 120')}"
ORACLES["semantic_chunks"] = f"{_SEMANTIC} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section, run) - 1 AS INT) AS index, sha256(text) AS digest, path FROM j"

# Long paragraphs are cut; the pieces are parts of a size above the limit, so each is a run of its own.
_CUT = f"""c AS (SELECT doc_id, section, path, k, unnest(CASE WHEN length(p) > 600 THEN [trim(p[a * 600 + 1 : a * 600 + 600], concat(' ', chr(9), {NL})) FOR a IN range((length(p) + 599) // 600)] ELSE [p] END) AS p, length(p) > 600 AS long, unnest(range(CASE WHEN length(p) > 600 THEN (length(p) + 599) // 600 ELSE 1 END)) AS a FROM q),
d AS (SELECT doc_id, section, path, k * 1000 + a AS k, p, CASE WHEN long THEN 100000 ELSE length(p) END AS n FROM c WHERE p <> '')"""


@lambda f: QUERIES.__setitem__("paragraph_chunks", f)
def paragraph_chunks(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("chunks", chunking.paragraph_chunks(F.col("text"), 600))
    return _rows(C.chunk_rows(docs, "doc_id")).drop("path")


_MORE = "a.total + b.n <= 602 AND a.total < 100000"
ORACLES["paragraph_chunks"] = f"{_BASE}, q AS (SELECT doc_id, 0 AS section, '' AS path, k, p FROM p), {_CUT}, {_greedy('d', 'n + 2', _MORE)} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section, run) - 1 AS INT) AS index, sha256(text) AS digest FROM j"


@lambda f: QUERIES.__setitem__("hierarchical_chunks", f)
def hierarchical_chunks(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("chunks", chunking.hierarchical_chunks(F.col("text"), 600))
    rows = C.chunk_rows(docs, "doc_id")
    return rows.select("doc_id", "index", F.sha2("text", 256).alias("digest"), F.array_join("section_path", "/").alias("path"), F.coalesce("parent_header_id", F.lit("")).alias("parent"), F.array_join("sibling_ids", ",").alias("siblings"))


_HIERARCHY = f"{_BASE}{_PATHS}, {_CUT}, {_greedy('d', 'n + 2', _MORE)}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section, run) - 1 AS index, CASE WHEN contains(path, '/') THEN string_split(path, '/')[-2] ELSE '' END AS parent FROM j)"
ORACLES["hierarchical_chunks"] = f"""{_HIERARCHY} SELECT r.doc_id, CAST(r.index AS INT) AS index, sha256(text) AS digest, path, r.parent, coalesce(array_to_string([x FOR x IN f.every IF x <> r.index], ','), '') AS siblings
FROM r LEFT JOIN (SELECT doc_id, parent, list(index ORDER BY index) AS every FROM r WHERE parent <> '' GROUP BY doc_id, parent) f ON f.doc_id = r.doc_id AND f.parent = r.parent"""


@lambda f: QUERIES.__setitem__("chunks_with_fallback", f)
def chunks_with_fallback(spark, sf_dir):
    """Semantic chunks of small bounds: documents of a long paragraph break them and are chunked by paragraphs."""
    out = C.with_chunks(documents(spark, sf_dir), "semantic", target_tokens=120, max_tokens=160, max_chars=600)
    return out.select("doc_id", "strategy", "qa.chunk_count", "qa.max_tokens", "qa.min_tokens", F.round("qa.avg_tokens", 6).alias("avg_tokens"), F.round("qa.coverage_ratio", 6).alias("coverage"), F.round("qa.max_token_ratio", 6).alias("ratio"), F.round("qa.duplication_ratio", 6).alias("duplication"), "qa.passed")


def _qa(source: str, most: int) -> str:
    return f"""SELECT doc_id, CAST(count(*) AS INT) AS chunk_count, CAST(max(greatest(1, length(text) // 4)) AS INT) AS max_tokens, CAST(min(greatest(1, length(text) // 4)) AS INT) AS min_tokens, avg(greatest(1, length(text) // 4)) AS avg_tokens,
    sum(length(text)) AS chars, max(greatest(1, length(text) // 4)) / {most}.0::DOUBLE AS ratio, 1 - count(DISTINCT text) / count(*)::DOUBLE AS duplication FROM {source} GROUP BY doc_id"""


_PLAIN = f"{_BASE}, q AS (SELECT doc_id, 0 AS section, '' AS path, k, p FROM p), {_CUT}, {_greedy('d', 'n + 2', _MORE)} SELECT doc_id, text FROM j"
_PASSED = "ratio <= 1.25 AND duplication <= 0.10 AND chars / greatest(1, length(trim(t, concat(' ', chr(9), chr(10))))) >= 0.80"
ORACLES["chunks_with_fallback"] = f"""WITH x AS ({_SEMANTIC} SELECT doc_id, text FROM j), y AS ({_PLAIN}), t AS (SELECT doc_id, {PARTS} AS t FROM documents), a AS ({_qa('x', 160)}), b AS ({_qa('y', 150)}),
e AS (SELECT 'semantic' AS strategy, a.*, t, {_PASSED} AS passed FROM a JOIN t USING (doc_id)), v AS (SELECT * FROM e WHERE passed UNION ALL SELECT 'paragraph', b.*, t, {_PASSED} FROM b JOIN t USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM e WHERE NOT passed))
SELECT doc_id, strategy, chunk_count, max_tokens, min_tokens, round(avg_tokens, 6) AS avg_tokens, round(chars / greatest(1, length(trim(t, concat(' ', chr(9), chr(10))))), 6) AS coverage, round(ratio, 6) AS ratio, round(duplication, 6) AS duplication, passed FROM v"""


@lambda f: QUERIES.__setitem__("chunk_features", f)
def chunk_features(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(f"concat(CASE WHEN doc_id % 2 = 0 THEN 'x | y |' ELSE 'x' END, {NL}, CASE WHEN doc_id % 3 = 0 THEN '|:---|  --- |' ELSE '| -- |' END, {NL}, CASE WHEN doc_id % 5 = 0 THEN ' 12. z' ELSE '12.z' END, {NL}, text, CASE WHEN doc_id % 7 = 0 THEN '```' ELSE '' END)").alias("t"))
    return docs.select("doc_id", chunking.chunk_features(F.col("t")).alias("f")).select("doc_id", "f.*")


ORACLES["chunk_features"] = "SELECT doc_id, doc_id % 3 = 0 AS has_table, doc_id % 5 = 0 AS is_procedure, doc_id % 7 = 0 AS has_code FROM documents"


@lambda f: QUERIES.__setitem__("line_kinds", f)
def line_kinds(spark, sf_dir):
    """How many lines of each kind the documents hold."""
    x = F.col("x")
    lines = documents(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("x"))
    return lines.groupBy("doc_id").agg(
        F.count_if(chunking.heading_of(x).isNotNull()).alias("headings"), F.count_if(chunking.is_table_line(x)).alias("table_lines"), F.count_if(chunking.is_table_rule(x)).alias("rules"), F.count_if(chunking.is_list_item(x)).alias("items"),
        F.count_if(chunking.is_continuation(x)).alias("continuations"), F.max(F.when(chunking.heading_of(x)["level"] == 1, chunking.heading_of(x)["title"])).alias("title"),
    )


ORACLES["line_kinds"] = rf"""WITH i AS (SELECT doc_id, {PARTS} AS t FROM documents), l AS (SELECT doc_id, unnest(string_split(t, {NL})) AS x FROM i)
SELECT doc_id, count(*) FILTER (regexp_matches(x, '^#{{1,6}}\s+.')) AS headings, count(*) FILTER (contains(x, '|') AND (trim(x)[1] = '|' OR trim(x)[-1] = '|')) AS table_lines, count(*) FILTER (regexp_matches(x, '^[| :-]*---[| :-]*$') AND contains(x, '|')) AS rules,
count(*) FILTER (regexp_matches(x, '^\s*([-*+]|[0-9]+\.)\s+')) AS items, count(*) FILTER (regexp_matches(x, '^\s{{2,}}\S')) AS continuations, max(regexp_extract(x, '^#\s+(.*)$', 1)) FILTER (regexp_matches(x, '^#\s')) AS title FROM l GROUP BY doc_id"""
