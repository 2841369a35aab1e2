"""Queries over the ledgers and chunk points, each with its SQL over the same views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfold.operators import ledger as L
from tarnfold.plans.fixtures import view, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str, sql: str | None):
    """Register f(views...) as a query, and its SQL, which starts from the same views."""
    names = views.split()

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in names])
        if sql:
            ORACLES[name] = with_views(*names) + sql
        return f

    return put


@query("runs_in_flight", "runs", "SELECT id, tenant_id, status, current_node FROM runs WHERE status NOT IN ('completed', 'failed') AND tenant_id = 't1' ORDER BY updated_at DESC, id DESC LIMIT 50")
def runs_in_flight(runs):
    return L.in_flight(runs, 50, tenant_id="t1").select("id", "tenant_id", "status", "current_node")


@query("runs_failed", "runs nodes", """, f AS (SELECT id, error_code AS run_error FROM runs WHERE status = 'failed' ORDER BY updated_at DESC, id DESC LIMIT 50),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line DESC, part DESC, supp DESC) AS nth FROM nodes WHERE status = 'failed' OR error_code <> '' OR error_message <> '')
SELECT id, run_error, CAST(nth AS INT) AS nth, node_name, error_code, error_message FROM f LEFT JOIN n ON id = run_id AND nth <= 25""")
def runs_failed(runs, nodes):
    return L.failed_runs(runs, nodes, [F.desc("line"), F.desc("part"), F.desc("supp")])


@query("runs_listed", "runs", "SELECT id, doc_id, doc_version, status FROM runs WHERE tenant_id = 't2' AND project_id = 'p1' ORDER BY id DESC LIMIT 100")
def runs_listed(runs):
    return L.newest(L.scoped(runs, tenant_id="t2", project_id="p1"), [F.desc("id")], 100).select("id", "doc_id", "doc_version", "status")


@query("run_by_id", "runs", "SELECT id, doc_id, status FROM runs WHERE id = 77")
def run_by_id(runs):
    return L.scoped(runs, id=77).select("id", "doc_id", "status")


@query("tasks_listed", "tasks", "SELECT id, status, (10 - judge_score) * CASE WHEN is_sensitive THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS priority FROM tasks WHERE open AND status = 'pending' AND tenant_id = 't0' ORDER BY priority DESC, id LIMIT 40")
def tasks_listed(tasks):
    from tarnfold.functions.decisions import hitl_priority

    ranked = L.scoped(tasks.filter("open"), status="pending", tenant_id="t0").withColumn("priority", hitl_priority(F.col("judge_score"), F.col("is_sensitive")))
    return L.newest(ranked, [F.desc("priority"), F.col("id")], 40).select("id", "status", "priority")


@query("task_claimed", "tasks", """, p AS (SELECT *, (10 - judge_score) * CASE WHEN is_sensitive THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS priority FROM tasks WHERE open),
h AS (SELECT id FROM p WHERE status = 'pending' ORDER BY priority DESC, id LIMIT 1)
SELECT id, CASE WHEN id IN (SELECT id FROM h) THEN 'in_progress' ELSE status END AS status, CASE WHEN id IN (SELECT id FROM h) THEN 'me' ELSE assigned_to END AS assigned_to FROM p""")
def task_claimed(tasks):
    from tarnfold.functions.decisions import hitl_priority

    ranked = tasks.filter("open").withColumn("priority", hitl_priority(F.col("judge_score"), F.col("is_sensitive")))
    return L.claimed(ranked, "me").select("id", "status", "assigned_to")


_MOVE = "CASE (l_linenumber + l_partkey) % 4 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'completed' WHEN 2 THEN 'skipped' ELSE 'rejected' END"


def task_lifecycle(spark, sf_dir):
    """Order lines stand for the events of a task, an order: its state after all of them."""
    from tarnfold.session import table

    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS id", "l_linenumber * 1000000 + l_partkey AS at", f"{_MOVE} AS to")
    return L.task_states(lines)


QUERIES["task_lifecycle"] = task_lifecycle
# A task leaves pending once at most, and in_progress once at most: its first skip, reject or claim, then the first end after a claim.
ORACLES["task_lifecycle"] = f"""WITH e AS (SELECT l_orderkey AS id, l_linenumber * 1000000 + l_partkey AS at, {_MOVE} AS to_, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 1000000 + l_partkey, {_MOVE}) AS n FROM lineitem),
a AS (SELECT id, min(n) FILTER (to_ <> 'completed') AS n1, count(*) AS steps FROM e GROUP BY id), b AS (SELECT a.*, e.to_ AS s1 FROM a LEFT JOIN e ON e.id = a.id AND e.n = a.n1),
c AS (SELECT b.*, (SELECT min(n) FROM e WHERE e.id = b.id AND b.s1 = 'in_progress' AND e.n > b.n1 AND e.to_ <> 'in_progress') AS n2 FROM b), d AS (SELECT c.*, e.to_ AS s2 FROM c LEFT JOIN e ON e.id = c.id AND e.n = c.n2)
SELECT id, coalesce(s2, s1, 'pending') AS status, CAST(steps - CASE WHEN n1 IS NULL THEN 0 ELSE 1 END - CASE WHEN n2 IS NULL THEN 0 ELSE 1 END AS INT) AS refused FROM d"""


@query("feedback_listed", "feedback", "SELECT id, category, doc_id FROM feedback WHERE tenant_id = 't1' AND category = 'user' ORDER BY created DESC, id DESC LIMIT 30")
def feedback_listed(feedback):
    return L.newest(L.scoped(feedback, tenant_id="t1", project_id=None, category="user"), [F.desc("created"), F.desc("id")], 30).select("id", "category", "doc_id")


@query("feedback_removed", "feedback", "SELECT id, category FROM feedback WHERE id <> 201")
def feedback_removed(feedback):
    return L.without(feedback, F.col("id") == 201).select("id", "category")


@query("nodes_of_run", "nodes", "SELECT run_id, line, part, node_name, status FROM nodes WHERE run_id BETWEEN 10 AND 40 ORDER BY run_id, line, part, supp LIMIT 200")
def nodes_of_run(nodes):
    return L.newest(nodes.filter(F.col("run_id").between(10, 40)), [F.col(c) for c in ("run_id", "line", "part", "supp")], 200).select("run_id", "line", "part", "node_name", "status")


_SUMMARY = """, c AS (SELECT 'runs' AS section, 'total' AS name, CAST(count(*) AS DOUBLE) AS value FROM runs UNION ALL SELECT 'runs', 'docs_unique', count(DISTINCT doc_id) FROM runs
UNION ALL SELECT 'runs', 'last_day', count(*) FILTER (updated_at >= TIMESTAMP '2001-01-01') FROM runs UNION ALL SELECT 'runs.by_status', status, count(*) FROM runs WHERE status IS NOT NULL GROUP BY status
UNION ALL SELECT 'runs.by_node', current_node, count(*) FROM runs WHERE current_node IS NOT NULL GROUP BY current_node UNION ALL SELECT 'runs.failed_by_code', error_code, count(*) FROM runs WHERE error_code <> '' GROUP BY error_code
UNION ALL SELECT 'nodes', 'total', count(*) FROM nodes UNION ALL SELECT 'nodes.by_status', status, count(*) FROM nodes GROUP BY status UNION ALL SELECT 'nodes.by_name', node_name, count(*) FROM nodes GROUP BY node_name
UNION ALL SELECT 'nodes.failed_by_code', error_code, count(*) FROM nodes WHERE error_code <> '' GROUP BY error_code UNION ALL SELECT 'tasks', 'total', count(*) FROM tasks
UNION ALL SELECT 'tasks', 'pending_unassigned', count(*) FILTER (status = 'pending' AND assigned_to = '') FROM tasks UNION ALL SELECT 'tasks.by_status', status, count(*) FROM tasks GROUP BY status) SELECT * FROM c"""


@query("ledger_summary", "runs nodes tasks", _SUMMARY)
def ledger_summary(runs, nodes, tasks):
    return L.ledger_summary(runs, nodes, tasks, "2001-01-01 00:00:00")


_METRICS = """, r AS (SELECT * FROM runs WHERE tenant_id = 't1'), k AS (SELECT * FROM tasks WHERE tenant_id = 't1' AND open), b AS (SELECT * FROM feedback WHERE tenant_id = 't1' AND corpus_id = 'c1'),
o AS (SELECT n.* FROM nodes n JOIN r ON n.run_id = r.id), g AS (SELECT count(*) AS t, count(*) FILTER (status = 'completed') AS c, count(*) FILTER (status = 'failed') AS f, (SELECT count(*) FROM k) AS e FROM r),
a AS (SELECT *, CASE WHEN c > 0 THEN greatest(0, c - e) ELSE 0 END AS x FROM g)
SELECT 'runs' AS section, u.name, u.value FROM a, LATERAL (VALUES ('total', CAST(t AS DOUBLE)), ('completion_rate', round_even(c / t, 4)), ('failure_rate', round_even(f / t, 4)), ('escalated', CAST(e AS DOUBLE)), ('escalation_rate', round_even(e / t, 4)), ('auto_accepted', CAST(x AS DOUBLE)), ('auto_accepted_rate', round_even(x / t, 4))) u(name, value)
UNION ALL SELECT 'runs.by_status', status, count(*) FROM r GROUP BY status UNION ALL SELECT 'nodes', 'total', count(*) FROM o UNION ALL SELECT 'nodes', 'failed', count(*) FILTER (status = 'failed' OR error_code <> '') FROM o
UNION ALL SELECT 'nodes', 'failure_rate', round_even(count(*) FILTER (status = 'failed' OR error_code <> '') / count(*), 4) FROM o UNION ALL SELECT 'nodes.failures_by_name', node_name, count(*) FROM o WHERE status = 'failed' OR error_code <> '' GROUP BY node_name
UNION ALL SELECT 'tasks.by_status', status, count(*) FROM k GROUP BY status UNION ALL SELECT 'feedback', 'total', count(*) FROM b UNION ALL SELECT 'feedback.by_category', category, count(*) FROM b WHERE category IS NOT NULL GROUP BY category"""


@query("pipeline_metrics", "runs nodes tasks feedback", _METRICS)
def pipeline_metrics(runs, nodes, tasks, feedback):
    return L.pipeline_metrics(runs, nodes, tasks.filter("open"), feedback, tenant_id="t1", corpus_id="c1")


@query("stage_metrics", "runs nodes", """SELECT node_name, count(*) AS runs, count(*) FILTER (n.status = 'failed' OR n.error_code <> '') AS failed, round(avg(duration_ms), 6) AS mean_ms, max(duration_ms) AS most_ms FROM nodes n JOIN runs r ON n.run_id = r.id WHERE r.project_id = 'p2' GROUP BY node_name""")
def stage_metrics(runs, nodes):
    own = nodes.join(L.scoped(runs, project_id="p2").select(F.col("id").alias("run_id")), "run_id")
    return own.groupBy("node_name").agg(F.count("*").alias("runs"), F.count_if(L.node_failed()).alias("failed"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"), F.max("duration_ms").alias("most_ms"))


@query("point_inventory", "points", """, c AS (SELECT 'by_tenant' AS section, tenant_id AS name, CAST(count(*) AS DOUBLE) AS value FROM points GROUP BY tenant_id UNION ALL SELECT 'by_project', project_id, count(*) FROM points GROUP BY project_id
UNION ALL SELECT 'by_tenant_project', concat(tenant_id, '/', project_id), count(*) FROM points GROUP BY ALL UNION ALL SELECT 'points', 'total', count(*) FROM points UNION ALL SELECT 'points', 'docs', count(DISTINCT doc_id) FROM points
UNION ALL SELECT 'points', 'tenants', count(DISTINCT tenant_id) FROM points UNION ALL SELECT 'points', 'projects', count(DISTINCT project_id) FROM points UNION ALL SELECT 'points', 'finalized', count(*) FILTER (is_finalized) FROM points
UNION ALL SELECT 'points', 'open', count(*) FILTER (NOT is_finalized) FROM points) SELECT * FROM c""")
def point_inventory(points):
    return L.point_inventory(points)


_K = "tenant_id, project_id, doc_id, doc_version"


@query("orphan_groups", "points runs", f"SELECT {_K}, count(*) AS points FROM points p WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.tenant_id = p.tenant_id AND r.project_id = p.project_id AND r.doc_id = p.doc_id AND r.doc_version = p.doc_version) GROUP BY {_K}")
def orphan_groups(points, runs):
    return L.orphan_groups(points, runs)


@query("orphan_sample", "points runs", f"SELECT {_K}, count(*) AS points FROM points p WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.tenant_id = p.tenant_id AND r.project_id = p.project_id AND r.doc_id = p.doc_id AND r.doc_version = p.doc_version) GROUP BY {_K} ORDER BY points DESC, {_K} LIMIT 20")
def orphan_sample(points, runs):
    return L.newest(L.orphan_groups(points, runs), [F.desc("points"), *map(F.col, L.KEYS)], 20)


@query("dangling_runs", "points runs", """, r AS (SELECT * FROM runs ORDER BY id DESC LIMIT 200) SELECT id, tenant_id, project_id, doc_id, doc_version FROM r WHERE NOT EXISTS (SELECT 1 FROM points p
WHERE r.tenant_id = p.tenant_id AND r.project_id = p.project_id AND r.doc_id = p.doc_id AND r.doc_version = p.doc_version) ORDER BY id DESC LIMIT 50""")
def dangling_runs(points, runs):
    return L.dangling_runs(points, runs).select("id", *L.KEYS)


@query("dangling_run_removed", "points runs", """SELECT id, status FROM runs r WHERE NOT (id % 10 = 3 AND NOT EXISTS (SELECT 1 FROM points p WHERE r.tenant_id = p.tenant_id AND r.project_id = p.project_id AND r.doc_id = p.doc_id AND r.doc_version = p.doc_version))""")
def dangling_run_removed(points, runs):
    """Runs whose id ends in 3 are asked to go; those with points stay."""
    gone = runs.filter("id % 10 = 3").join(points.select(*L.KEYS), L.KEYS, "left_anti").select("id")
    return runs.join(gone, "id", "left_anti").select("id", "status")


@query("orphans_due", "points runs", """, k AS (SELECT DISTINCT doc_id AS key FROM points WHERE doc_id NOT IN (SELECT doc_id FROM runs WHERE id % 3 = 0)), s AS (SELECT doc_id AS key, min(updated_at) AS first_seen FROM runs WHERE id % 2 = 0 GROUP BY doc_id)
SELECT key, coalesce(first_seen, TIMESTAMP '2000-01-01') AS first_seen, coalesce(first_seen, TIMESTAMP '2000-01-01') <= TIMESTAMP '1999-12-30' AS due FROM k LEFT JOIN s USING (key)""")
def orphans_due(points, runs):
    """Keys that are orphans now, with earlier sightings (even runs stand for them): due after two days."""
    now = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    current = points.select(F.col("doc_id").alias("key")).join(runs.filter("id % 3 = 0").select(F.col("doc_id").alias("key")), "key", "left_anti")
    seen = runs.filter("id % 2 = 0").select(F.col("doc_id").alias("key"), F.col("updated_at").cast("timestamp_ntz").alias("first_seen"))
    return L.mature_orphans(current, seen, now)


@query("first_points", "points", "SELECT doc_id, id, tenant_id, project_id, corpus_id, doc_version FROM points WHERE tenant_id = 't1' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY id) = 1 ORDER BY id LIMIT 100")
def first_points(points):
    return L.first_seen_points(points, 100, tenant_id="t1")


@query("document_detail", "points", "SELECT id, chunk_index, doc_version FROM points WHERE doc_id = 'd17' AND id > 20 ORDER BY id LIMIT 5")
def document_detail(points):
    return L.after_cursor(L.scoped(points, doc_id="d17"), "id", 20, 5).select("id", "chunk_index", "doc_version")


@query("chunk_preview", "points", "SELECT id, doc_id, chunk_index, sha256(text) AS digest FROM points WHERE doc_id = 'd25' AND chunk_index = 7 ORDER BY id LIMIT 1")
def chunk_preview(points):
    return L.newest(L.scoped(points, doc_id="d25", chunk_index=7), [F.col("id")], 1).select("id", "doc_id", "chunk_index", F.sha2("text", 256).alias("digest"))


@query("latest_doc_versions", "runs", "SELECT tenant_id, project_id, doc_id, doc_version FROM runs QUALIFY row_number() OVER (PARTITION BY tenant_id, project_id, doc_id ORDER BY id DESC) = 1")
def latest_doc_versions(runs):
    return L.latest_version(runs)


_ACTIVE = "a AS (SELECT tenant_id, project_id, CASE WHEN id % 3 = 0 THEN doc_id ELSE concat('c', id % 2, '::', doc_id) END AS doc_id, max(doc_version) AS active_doc_version FROM runs GROUP BY ALL)"


@query("active_doc_versions", "runs", f""", {_ACTIVE}, q AS (SELECT DISTINCT tenant_id, project_id, doc_id, concat('c', CAST(id % 2 AS STRING)) AS corpus_id FROM runs)
SELECT q.tenant_id, q.project_id, q.doc_id, q.corpus_id, coalesce(x.active_doc_version, y.active_doc_version) AS active_doc_version FROM q LEFT JOIN a x ON x.tenant_id = q.tenant_id AND x.project_id = q.project_id AND x.doc_id = concat(q.corpus_id, '::', q.doc_id)
LEFT JOIN a y ON y.tenant_id = q.tenant_id AND y.project_id = q.project_id AND y.doc_id = q.doc_id""")
def active_doc_versions(runs):
    corpus = F.concat(F.lit("c"), (F.col("id") % 2).cast("string"))
    active = runs.withColumn("doc_id", F.when(F.col("id") % 3 == 0, F.col("doc_id")).otherwise(F.concat(corpus, F.lit("::"), "doc_id"))).groupBy("tenant_id", "project_id", "doc_id").agg(F.max("doc_version").alias("active_doc_version"))
    return L.active_version(runs.select("tenant_id", "project_id", "doc_id", corpus.alias("corpus_id")).distinct(), active)


@query("version_activated", "points", "SELECT id, doc_version, CASE WHEN tenant_id = 't1' AND doc_id = 'd25' THEN doc_version = 'v0' ELSE is_active_version END AS is_active_version FROM points")
def version_activated(points):
    return L.activated(points, "v0", tenant_id="t1", doc_id="d25").select("id", "doc_version", "is_active_version")


@query("active_version_stored", "runs", """, a AS (SELECT doc_id, max(doc_version) AS v FROM runs WHERE id % 2 = 0 GROUP BY doc_id), n AS (SELECT doc_id, max_by(doc_version, id) AS v FROM runs WHERE id % 5 = 0 GROUP BY doc_id)
SELECT doc_id, v FROM n UNION ALL SELECT doc_id, v FROM a WHERE doc_id NOT IN (SELECT doc_id FROM n)""")
def active_version_stored(runs):
    stored = runs.filter("id % 2 = 0").groupBy("doc_id").agg(F.max("doc_version").alias("v"))
    return L.upserted(stored, runs.filter("id % 5 = 0").groupBy("doc_id").agg(F.max_by("doc_version", "id").alias("v")), ["doc_id"])


@query("scope_moved", "points", "SELECT id, CASE WHEN is_finalized AND doc_id = 'd10' THEN 't9' ELSE tenant_id END AS tenant_id, CASE WHEN is_finalized AND doc_id = 'd10' THEN 'p9' ELSE project_id END AS project_id FROM points")
def scope_moved(points):
    return L.rescoped(points, F.col("is_finalized") & (F.col("doc_id") == "d10"), tenant_id="t9", project_id="p9").select("id", "tenant_id", "project_id")


@query("orphans_adopted", "points runs", f""", o AS (SELECT DISTINCT {_K} FROM points p WHERE doc_id < 'd12' AND NOT EXISTS (SELECT 1 FROM runs r WHERE r.tenant_id = p.tenant_id AND r.project_id = p.project_id AND r.doc_id = p.doc_id AND r.doc_version = p.doc_version))
SELECT {_K}, 'completed' AS status FROM o UNION ALL SELECT {_K}, status FROM runs""")
def orphans_adopted(points, runs):
    """Each orphan group gets a run of its own."""
    made = L.orphan_groups(points.filter("doc_id < 'd12'"), runs).select(*L.KEYS, F.lit("completed").alias("status"))
    return runs.select(*L.KEYS, "status").unionByName(made)


@query("document_removed", "points", "SELECT id, doc_id FROM points WHERE NOT (coalesce(tenant_id = 't1' AND project_id = 'p1' AND doc_id = 'd13', false)) AND NOT coalesce(is_finalized AND doc_id = 'd14', false)")
def document_removed(points):
    gone = L.without(points, (F.col("tenant_id") == "t1") & (F.col("project_id") == "p1") & (F.col("doc_id") == "d13"))
    return L.without(gone, F.col("is_finalized") & (F.col("doc_id") == "d14")).select("id", "doc_id")


@query("tenants_to_remove", "runs points", "SELECT DISTINCT tenant_id, project_id FROM runs r WHERE NOT EXISTS (SELECT 1 FROM points p WHERE p.tenant_id = r.tenant_id AND p.project_id = r.project_id AND p.is_finalized AND p.chunk_index > 7)")
def tenants_to_remove(runs, points):
    return L.childless(runs.select("tenant_id", "project_id").distinct(), points.filter("is_finalized and chunk_index > 7"), ["tenant_id", "project_id"])


@query("projects_of_tenants", "points", "SELECT tenant_id, project_id, array_to_string(list_sort(list(DISTINCT corpus_id)), ',') AS corpora FROM points GROUP BY tenant_id, project_id ORDER BY tenant_id, project_id")
def projects_of_tenants(points):
    return points.groupBy("tenant_id", "project_id").agg(F.array_join(F.sort_array(F.collect_set("corpus_id")), ",").alias("corpora")).orderBy("tenant_id", "project_id")


@query("corpus_documents", "points", "SELECT doc_id, doc_version, count(*) AS chunks FROM points WHERE is_active_version AND is_finalized AND tenant_id = 't2' GROUP BY doc_id, doc_version ORDER BY doc_id, doc_version LIMIT 500")
def corpus_documents(points):
    own = L.scoped(points.filter("is_active_version and is_finalized"), tenant_id="t2")
    return L.newest(own.groupBy("doc_id", "doc_version").agg(F.count("*").alias("chunks")), [F.col("doc_id"), F.col("doc_version")], 500)


@query("search_scope", "points", "SELECT id, fidelity_flag FROM points WHERE tenant_id = 't0' AND project_id = 'p1' AND is_finalized AND is_active_version AND fidelity_flag IN ('verified', 'partial')")
def search_scope(points):
    from tarnfold.operators.retrieval import search_predicate

    return points.filter(search_predicate("t0", "p1", fidelity="verified+partial")).select("id", "fidelity_flag")


@query("session_progress", "pages_done", """SELECT session_id, count(*) AS total, count(*) FILTER (enabled) AS enabled, count(*) FILTER (enabled AND status = 'done') AS done, count(*) FILTER (enabled AND status = 'skipped') AS skipped,
count(*) FILTER (enabled AND status = 'error') AS errors, count(*) FILTER (enabled AND status = 'pending') AS pending, min(page_num) FILTER (enabled AND status = 'pending') AS next_page FROM pages_done GROUP BY session_id""")
def session_progress(pages):
    return L.session_progress(pages)


@query("sessions_to_resume", "pages_done", "SELECT session_id, count(*) FILTER (status IN ('done', 'skipped') AND page_num > 0) AS pages_done FROM pages_done GROUP BY session_id ORDER BY session_id DESC LIMIT 60")
def sessions_to_resume(pages):
    return L.resume_list(pages.select("session_id").distinct(), pages.filter("page_num > 0"), 60)


@query("page_results_stored", "pages_done", """, n AS (SELECT session_id, page_num, 'corrected' AS status FROM pages_done WHERE (session_id + page_num) % 4 = 0) SELECT session_id, page_num, status FROM n
UNION ALL SELECT session_id, page_num, status FROM pages_done WHERE (session_id + page_num) % 4 <> 0""")
def page_results_stored(pages):
    rows = pages.select("session_id", "page_num", "status")
    return L.upserted(rows, rows.filter("(session_id + page_num) % 4 = 0").withColumn("status", F.lit("corrected")), ["session_id", "page_num"])


@query("page_cache", "pages_done", "SELECT count(*) AS entries, count(DISTINCT session_id) AS documents FROM pages_done")
def page_cache(pages):
    return pages.agg(F.count("*").alias("entries"), F.count_distinct("session_id").alias("documents"))


@query("page_cache_hits", "pages_done", """, c AS (SELECT sha256(markdown) AS key, min(page_num) AS first_page FROM pages_done WHERE session_id % 3 = 0 GROUP BY 1) SELECT session_id, page_num, first_page IS NOT NULL AS hit FROM pages_done LEFT JOIN c ON sha256(markdown) = key""")
def page_cache_hits(pages):
    """Pages found among those already read, by content."""
    known = pages.filter("session_id % 3 = 0").groupBy(F.sha2("markdown", 256).alias("key")).agg(F.min("page_num").alias("first_page"))
    return pages.withColumn("key", F.sha2("markdown", 256)).join(known, "key", "left").select("session_id", "page_num", F.col("first_page").isNotNull().alias("hit"))


@query("thumbnail_page", "pages_done", "SELECT session_id, page_num, page_num < 5 AS has_more FROM pages_done WHERE page_num >= 2 AND page_num < 6")
def thumbnail_page(pages):
    """Pages 2 to 5 of each session, asked for by offset and limit: page numbers have no gaps, so they are ranges."""
    offset, limit, most = 2, 4, 6
    return pages.filter((F.col("page_num") >= offset) & (F.col("page_num") < offset + limit)).select("session_id", "page_num", (F.col("page_num") < most - 1).alias("has_more"))
