"""Queries over artifacts, scopes, sessions and converters' pages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfold.functions import guardrails
from tarnfold.operators import artifacts as A
from tarnfold.plans.fixtures import view, with_views
from tarnfold.plans.text_queries import HEADED, NL
from tarnfold.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return put


# Order lines stand for references of runs.
_REF = {
    "id": "l_partkey * 10000 + l_suppkey * 10 + l_linenumber", "run_id": "l_orderkey", "kind": "CASE l_linenumber % 3 WHEN 0 THEN 'source' WHEN 1 THEN 'markdown' ELSE 'manifest' END",
    "path": "concat('runs/', CAST(l_orderkey AS STRING), CASE l_linenumber % 4 WHEN 0 THEN '/source/a.pdf' WHEN 1 THEN '/doc.md' WHEN 2 THEN '/x.json' ELSE '/edit.md' END, CAST(l_partkey % 3 AS STRING))",
}
_REFS = f"WITH r AS (SELECT DISTINCT {', '.join(f'{e} AS {c}' for c, e in _REF.items())} FROM lineitem), q AS (SELECT id, run_id, max(kind) AS kind, max(regexp_replace(path, '[012]$', '')) AS path FROM r GROUP BY id, run_id) "


def _refs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in _REF.items()]).distinct()
    return rows.groupBy("id", "run_id").agg(F.max("kind").alias("kind"), F.max(F.regexp_replace("path", "[012]$", "")).alias("path"))


@query("newest_markdown", _REFS + "SELECT run_id, path FROM q WHERE path LIKE '%.md' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY id DESC) = 1")
def newest_markdown(spark, sf_dir):
    return A.newest_markdown(_refs(spark, sf_dir))


@query("run_sources", _REFS + "SELECT run_id, path FROM q WHERE kind = 'source' OR contains(path, '/source/') QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY id) = 1")
def run_sources(spark, sf_dir):
    return A.source_of(_refs(spark, sf_dir))


@query("editor_saves", "SELECT doc_id AS run_id, 'editor_save' AS kind, concat('runs/', doc_id, '/edit.md') AS path, sha256(text) AS sha256, CAST(length(text) AS INT) AS chars FROM documents")
def editor_saves(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("run_id"), F.lit("edit.md").alias("name"), F.col("text").alias("content"))
    return A.artifact_refs(docs, "editor_save")


@query("runs_appended", with_views("runs") + ", m AS (SELECT max(id) AS m FROM runs WHERE id % 2 = 0) SELECT id, doc_id, status FROM runs WHERE id % 2 = 0 UNION ALL SELECT (SELECT m FROM m) + row_number() OVER (ORDER BY id), doc_id, 'new' FROM runs WHERE id % 2 = 1")
def runs_appended(spark, sf_dir):
    """New rows get ids after the largest, in order."""
    runs = view(spark, sf_dir, "runs")
    new = runs.filter("id % 2 = 1").select(F.col("id").alias("at"), "doc_id", F.lit("new").alias("status"))
    return A.appended(runs.filter("id % 2 = 0").select("id", "doc_id", "status"), new, [F.col("at")])


@query("page_cache_grown", """WITH c AS (SELECT sha256(text) AS key, text AS t FROM conversations) SELECT key, CAST(max(length(t)) AS INT) AS chars FROM c GROUP BY key""")
def page_cache_grown(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").select("conv_id", F.sha2("text", 256).alias("key"), F.length("text").alias("chars"))
    old = pages.filter("conv_id % 2 = 0").select("key", "chars").dropDuplicates(["key"])
    return A.added_if_absent(old, pages.select("key", "chars"), ["key"])


@query("scopes_created", with_views("points") + """, n AS (SELECT DISTINCT concat('t', doc_id % 6) AS tenant_id, concat('p', doc_id % 4) AS project_id FROM documents)
SELECT tenant_id, project_id, CASE WHEN tenant_id NOT IN (SELECT tenant_id FROM points) THEN 'missing_parent' WHEN EXISTS (SELECT 1 FROM points p WHERE p.tenant_id = n.tenant_id AND p.project_id = n.project_id) THEN 'exists' ELSE 'created' END AS outcome FROM n""")
def scopes_created(spark, sf_dir):
    points = view(spark, sf_dir, "points")
    new = table(spark, sf_dir, "documents").selectExpr("concat('t', doc_id % 6) AS tenant_id", "concat('p', doc_id % 4) AS project_id").distinct()
    return A.created(points, new, ["tenant_id", "project_id"], points, ["tenant_id"])


@query("scopes_listed", with_views("points") + "SELECT tenant_id, count(DISTINCT project_id) AS projects, bool_or(is_active_version) AS active FROM points GROUP BY tenant_id HAVING bool_or(is_active_version) ORDER BY tenant_id")
def scopes_listed(spark, sf_dir):
    points = view(spark, sf_dir, "points")
    return points.groupBy("tenant_id").agg(F.count_distinct("project_id").alias("projects"), F.bool_or("is_active_version").alias("active")).filter("active").orderBy("tenant_id")


@query("sessions_loaded", with_views("pages_done") + ", s AS (SELECT DISTINCT session_id FROM pages_done) SELECT session_id, coalesce(string_agg(concat(page_num, ':', status), ',' ORDER BY page_num) FILTER (page_num % 2 = 1), '') AS pages FROM pages_done GROUP BY session_id")
def sessions_loaded(spark, sf_dir):
    pages = view(spark, sf_dir, "pages_done")
    out = A.with_pages(pages.select("session_id").distinct(), pages.filter("page_num % 2 = 1"))
    return out.select("session_id", F.array_join(F.transform("pages", lambda p: F.concat(p["page_num"].cast("string"), F.lit(":"), p["status"])), ",").alias("pages"))


_JSON = """concat('{"body": {"children": [{"$ref": "#/texts/0"}, {"$ref": "#/tables/0"}, {"$ref": "#/texts/1"}, {"$ref": "#/texts/2"}, {"$ref": "#/none"}]}, "texts": [{"self_ref": "#/texts/0", "label": "section_header", "text": "Head', CAST(doc_id AS STRING), '", "prov": [{"page_no": 1}]}, {"self_ref": "#/texts/1", "label": "text", "text": "body", "prov": [{"page_no": ', CAST(doc_id % 2 + 1 AS STRING), '}]}, {"self_ref": "#/texts/2", "label": "title", "text": "End", "prov": [{"page_no": 2}]}], "tables": [{"self_ref": "#/tables/0", "prov": [{"page_no": 1}], "data": {"grid": [[{"text": "a"}, {"text": "b"}], [{"text": "1"}, {"text": "2"}]]}}]}')"""


@query("converted_pages", f"""WITH p AS (SELECT doc_id, unnest([1, 2]) AS page_no FROM documents), t AS (SELECT doc_id, page_no, CASE WHEN page_no = 1 THEN concat('## Head', doc_id, {NL}, {NL}, '| a | b |', {NL}, '|---|---|', {NL}, '| 1 | 2 |', CASE WHEN doc_id % 2 = 0 THEN concat({NL}, {NL}, 'body') ELSE '' END)
ELSE concat(CASE WHEN doc_id % 2 = 1 THEN concat('body', {NL}, {NL}) ELSE '' END, '# End') END AS markdown FROM p) SELECT doc_id, page_no, markdown FROM t""")
def converted_pages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_JSON).alias("content"))
    pages = A.page_texts(docs)
    return A.page_markdown(pages, 0).withColumn("page_no", F.lit(1)).unionByName(A.page_markdown(pages, 1).withColumn("page_no", F.lit(2)))


@query("refined_by_section", rf"""WITH i AS (SELECT doc_id, {HEADED} AS t FROM documents), s AS (SELECT doc_id, t, unnest(string_split(regexp_replace(t, '(?m)^(#{{1,2}}\s)', chr(1) || '\1', 'g'), chr(1))) AS p, unnest(range(len(string_split(regexp_replace(t, '(?m)^(#{{1,2}}\s)', chr(1) || '\1', 'g'), chr(1))))) AS k FROM i),
n AS (SELECT doc_id, any_value(t) AS t, string_agg(concat('[REFINED]', {NL}, regexp_replace(p, '^\s+|\s+$', '', 'g')), concat({NL}, {NL}) ORDER BY k) AS n FROM s WHERE regexp_replace(p, '^\s+|\s+$', '', 'g') <> '' GROUP BY doc_id) SELECT doc_id, sha256(n) AS digest, NULL::VARCHAR AS refused FROM n""")
def refined_by_section(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(HEADED).alias("text"))
    return A.refined_by_section(docs, most_tokens=100_000).select("doc_id", F.sha2("refined", 256).alias("digest"), "refused")


_SAID = f"""CASE doc_id % 4 WHEN 0 THEN concat('```json', {NL}, '{{"rule_yaml": "- name: r', CAST(doc_id AS STRING), '", "rationale": "because"}}', {NL}, '```') WHEN 1 THEN '{{"rule_yaml": "x"}}' WHEN 2 THEN 'no json' ELSE '{{"other": 1}}' END"""


@query("suggestions_parsed", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('- name: r', doc_id) WHEN 1 THEN 'x' END AS rule_yaml, CASE doc_id % 4 WHEN 0 THEN 'because' WHEN 1 THEN '' END AS rationale FROM documents")
def suggestions_parsed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", guardrails.suggestion_of(F.expr(_SAID)).alias("s")).select("doc_id", "s.rule_yaml", "s.rationale")


@query("collection_info", with_views("points") + "SELECT count(*) AS points, count(DISTINCT corpus_id) AS corpora, CAST(max(length(text)) AS INT) AS longest FROM points")
def collection_info(spark, sf_dir):
    return view(spark, sf_dir, "points").agg(F.count("*").alias("points"), F.count_distinct("corpus_id").alias("corpora"), F.max(F.length("text")).alias("longest"))
