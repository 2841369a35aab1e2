"""Queries of what is stored: commits over several tables, observed metrics, nested exports and folders of files, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tarnfold.functions.markdown import collapse_newlines
from tarnfold.operators import commits, packages, stitching
from tarnfold.operators.diagnostics import Diagnostics
from tarnfold.plans.fixtures import view, with_views
from tarnfold.plans.text_queries import NL
from tarnfold.session import shared_dir, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return put


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/tarnfold-{name}-{uuid.uuid4().hex}"


# Runs that the ledger has as running wait from now on, at their first asking; some ask twice.
@query("runs_paused", with_views("runs") + """SELECT id, CASE WHEN status = 'running' THEN 'hitl' ELSE status END AS status, CASE WHEN status = 'running' THEN 'hitl' ELSE current_node END AS current_node, CAST(CASE WHEN status = 'running' THEN (10 - id % 6) * CASE WHEN id % 7 = 0 THEN 2 ELSE 1 END END AS DOUBLE) AS priority, CASE WHEN status = 'running' THEN 1 ELSE 0 END AS waiting FROM runs""")
def runs_paused(spark, sf_dir):
    log = commits.Commits(spark, _folder(spark, "pauses"))
    runs = view(spark, sf_dir, "runs").select("id", "status", "current_node")
    log.commit(log.snapshot(), replace={"runs": runs})
    asked = runs.filter("status = 'running'").select(F.col("id").alias("run_id"), (F.col("id") % 6).alias("judge_score"), (F.col("id") % 7 == 0).alias("is_sensitive"), F.lit("text").alias("before_md"), F.lit("{}").alias("meta"))
    commits.paused(log, asked.filter("run_id % 2 = 0"))
    now = commits.paused(log, asked)
    nodes = log.read("nodes", now).groupBy(F.col("run_id").alias("id")).agg(F.count("*").cast("int").alias("waiting"))
    tasks = log.read("tasks", now).select(F.col("run_id").alias("id"), "priority")
    return log.read("runs", now).join(tasks, "id", "left").join(nodes, "id", "left").withColumn("waiting", F.coalesce("waiting", F.lit(0)))


@query("sessions_committed", f"""WITH s AS (SELECT conv_id, max(turn) AS most, CASE WHEN conv_id % 3 = 0 THEN conv_id + 1000 END AS run, concat('<!-- page ', min(turn), ' -->') AS head, string_agg(concat('<!-- page ', turn, ' -->', {NL}, {NL}, 'Text ', conv_id, '.', turn), concat({NL}, {NL}) ORDER BY turn) AS md FROM (SELECT DISTINCT conv_id, turn FROM conversations) GROUP BY conv_id),
n AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS nth FROM s WHERE run IS NULL AND conv_id % 5 <> 0), m AS (SELECT max(run) AS m FROM s)
SELECT conv_id AS session_id, CASE WHEN conv_id % 5 = 0 THEN 'complete' ELSE 'committed' END AS status, CASE WHEN conv_id % 5 = 0 THEN run ELSE coalesce(run, coalesce(m, 0) + nth) END AS run_id, CASE WHEN conv_id % 5 <> 0 THEN sha256(concat(md, {NL})) END AS sha256, conv_id % 5 <> 0 AND run IS NULL AS resumes FROM s LEFT JOIN n USING (conv_id), m""")
def sessions_committed(spark, sf_dir):
    """Each conversation is a session whose turns are its pages; a fifth isn't stitched yet, a third belongs to a run."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("page_num")).distinct()
    own = F.when(F.col("session_id") % 3 == 0, F.col("session_id") + 1000)
    sessions = turns.select("session_id").distinct().select("session_id", own.alias("run_id"), F.lit("complete").alias("status"), F.concat(F.col("session_id").cast("string"), F.lit(".pdf")).alias("filename"))
    runs = sessions.filter("run_id IS NOT NULL").select(F.col("run_id").alias("id"), F.lit("running").alias("status"), F.lit("judge").alias("current_node"), F.lit("d").alias("doc_id"), F.lit(False).alias("is_hitl_resume"))
    log = commits.Commits(spark, _folder(spark, "sessions"))
    log.commit(log.snapshot(), replace={"sessions": sessions, "runs": runs})
    pages = turns.filter("session_id % 5 <> 0").withColumn("markdown", F.format_string("Text %d.%d", "session_id", "page_num"))
    stitched = stitching.stitched(pages, "session_id").select("session_id", "markdown", "pages_processed")
    now = commits.session_committed(log, stitched)
    refs = log.read("artifacts", now).select("session_id", "sha256")
    resumes = log.read("runs", now).select(F.col("id").alias("run_id"), F.col("is_hitl_resume").alias("resumes"))
    out = log.read("sessions", now).join(refs, "session_id", "left").join(resumes, "run_id", "left")
    return out.select("session_id", "status", "run_id", "sha256", F.coalesce("resumes", F.lit(False)).alias("resumes"))


@query("sessions_rehydrated", with_views("pages_done") + """, s AS (SELECT session_id, count(*) FILTER (WHERE status = 'done') AS done FROM pages_done GROUP BY session_id)
SELECT session_id, CASE WHEN session_id % 4 = 0 THEN 'complete' WHEN session_id % 4 = 1 THEN 'failed' ELSE 'configuring' END AS status, CAST(CASE WHEN session_id % 4 = 0 THEN done END AS BIGINT) AS pages_processed, done FROM s""")
def sessions_rehydrated(spark, sf_dir):
    pages = view(spark, sf_dir, "pages_done").withColumn("status", F.when(F.col("status") == "pending", "processing").otherwise(F.col("status")))
    sessions = pages.select("session_id").distinct().withColumns({"status": F.expr("CASE session_id % 4 WHEN 1 THEN 'failed' WHEN 2 THEN 'stitching' WHEN 3 THEN 'odd' ELSE 'processing' END"), "stitched_markdown": F.expr("CASE WHEN session_id % 4 = 0 THEN 'text' ELSE '' END")})
    sessions, pages = commits.rehydrated(sessions, pages)
    done = pages.groupBy("session_id").agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "processing").alias("stuck"))
    return sessions.join(done.filter("stuck = 0"), "session_id").select("session_id", "status", "pages_processed", "done")


@query("cleanup_observed", rf"""WITH c AS (SELECT doc_id, concat(text, repeat({NL}, doc_id % 5), 'end') AS before, regexp_replace(concat(text, repeat({NL}, doc_id % 5), 'end'), '\n{{3,}}', concat({NL}, {NL}), 'g') AS after FROM documents), t AS (SELECT count(*) AS n, count(*) FILTER (WHERE before <> after) AS changed, sum(len(before) - len(after)) AS signs FROM c)
SELECT doc_id, sha256(after) AS digest, CAST(n AS BIGINT) AS seen, CAST(changed AS BIGINT) AS changed, CAST(signs AS BIGINT) AS signs FROM c, t""")
def cleanup_observed(spark, sf_dir):
    """Cleaned documents, and beside them what the job that cleaned them counted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.expr("repeat('\\n', CAST(doc_id % 5 AS INT))"), F.lit("end")).alias("before"))
    cleaned = docs.withColumn("after", collapse_newlines(F.col("before")))
    kept = Diagnostics(spark, _folder(spark, "diagnostics"))
    counts = {"seen": F.count("*"), "changed": F.count_if(F.col("before") != F.col("after")), "signs": F.sum(F.length("before") - F.length("after"))}
    out = kept.written("collapse_newlines", cleaned, _folder(spark, "cleaned"), counts)
    last = kept.latest(1).filter("success").select(*[F.col("metrics")[c].cast("long").alias(c) for c in counts])
    return out.select("doc_id", F.sha2("after", 256).alias("digest")).join(F.broadcast(last))  # one row


_DOCS = with_views("points") + f""", d AS (SELECT tenant_id, project_id, corpus_id, doc_id, doc_version, count(*) AS chunks, string_agg(text, concat({NL}, {NL}) ORDER BY chunk_index, text) AS markdown FROM points WHERE is_finalized AND is_active_version GROUP BY ALL),
f AS (SELECT *, concat(doc_id, '_', doc_version, '.md') AS file, concat('---', {NL}, 'doc_id: "', doc_id, '"', {NL}, 'chunks: ', chunks, {NL}, '---', {NL}, {NL}, markdown) AS content FROM d)"""


@query("scopes_exported", _DOCS + " SELECT tenant_id, project_id, corpus_id, file, chunks, sha256(content) AS digest FROM f")
def scopes_exported(spark, sf_dir):
    """All corpora of all tenants exported and read again."""
    path = _folder(spark, "export")
    packages.export_scopes(packages.scoped_documents(view(spark, sf_dir, "points")), path, ["doc_id", "chunks"])
    return packages.read_exported(spark, path).select(*packages.SCOPE, "file", "chunks", F.sha2("content", 256).alias("digest"))


@query("export_manifests", _DOCS + """ SELECT tenant_id, project_id, corpus_id, count(*) AS documents, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(len(content)) AS BIGINT) AS chars FROM (FROM f QUALIFY row_number() OVER (PARTITION BY tenant_id, project_id, corpus_id ORDER BY doc_id, doc_version) <= 3) GROUP BY ALL""")
def export_manifests(spark, sf_dir):
    """The manifests of an export of three documents a corpus, whose files say the same."""
    path = _folder(spark, "export")
    packages.export_scopes(packages.scoped_documents(view(spark, sf_dir, "points"), most=3), path, ["doc_id", "chunks"])
    wrong = packages.verified_export(spark, path).select(*packages.SCOPE)
    return spark.read.json(f"{path}/manifests").join(wrong, packages.SCOPE, "left_anti").select(*packages.SCOPE, "documents", "chunks", "chars")
