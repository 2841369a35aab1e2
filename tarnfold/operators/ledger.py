"""Ledgers of runs, nodes, review tasks, feedback and chunk points as DataFrame operators.

Lists are filters with an order and a limit, which Spark plans as a top-n without a full
sort; reports that were many small statements are one pass over each table, and a row per
figure: section, name, value. Changes give the whole new table, to be written as the next
version of a folder, so no reader sees half of one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The states of runs, tasks and pages.
CLOSED = ["completed", "failed"]
TASK_MOVES = {"in_progress": ["pending"], "completed": ["in_progress"], "skipped": ["pending", "in_progress"], "rejected": ["pending", "in_progress"]}
PAGE_DONE = ["done", "skipped"]


def scoped(df: DataFrame, **equal: object) -> DataFrame:
    """Rows that equal all values given; a value of None asks for nothing."""
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def newest(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    return df.orderBy(*order).limit(limit)


def in_flight(runs: DataFrame, limit: int = 50, **scope: object) -> DataFrame:
    return newest(scoped(runs, **scope).filter(~F.col("status").isin(CLOSED)), [F.desc("updated_at"), F.desc("id")], limit)


def node_failed_or_told() -> Column:
    """The failures report's test of a node."""
    return (F.col("status") == "failed") | (F.col("error_code") != "") | (F.col("error_message") != "")


def node_failed() -> Column:
    """The metrics' test of a node."""
    return (F.col("status") == "failed") | (F.col("error_code") != "")


def failed_runs(runs: DataFrame, nodes: DataFrame, order: Sequence[Column], limit: int = 50, per_run: int = 25, **scope: object) -> DataFrame:
    """The newest failed runs and each one's newest failing nodes, as one join; `nth` is null for a run without any."""
    failed = newest(scoped(runs, **scope).filter("status = 'failed'"), [F.desc("updated_at"), F.desc("id")], limit).select("id", F.col("error_code").alias("run_error"))
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy(*order))
    wrong = nodes.filter(node_failed_or_told()).join(F.broadcast(failed.select(F.col("id").alias("run_id"))), "run_id", "left_semi").withColumn("nth", nth).filter(F.col("nth") <= per_run)
    return failed.join(wrong, F.col("id") == F.col("run_id"), "left").select("id", "run_error", "nth", "node_name", "error_code", "error_message")


def claimed(tasks: DataFrame, who: str) -> DataFrame:
    """The tasks after the head of the queue (pending, highest priority, smallest id) is given to `who`."""
    head = tasks.filter("status = 'pending'").agg(F.max_by("id", F.struct("priority", -F.col("id"))).alias("_head"))
    out = tasks.join(F.broadcast(head), how="left", on=F.lit(True))
    taken = F.coalesce(F.col("id") == F.col("_head"), F.lit(False))
    return out.withColumns({"assigned_to": F.when(taken, F.lit(who)).otherwise(F.col("assigned_to")), "status": F.when(taken, "in_progress").otherwise(F.col("status"))}).drop("_head")


def task_states(events: DataFrame) -> DataFrame:
    """id, status, refused: each task's state after its events in order of `at`; a move that its state doesn't allow is refused and changes nothing."""
    moves = F.create_map(*[x for to, of in TASK_MOVES.items() for x in (F.lit(to), F.array(*map(F.lit, of)))])
    start = F.struct(F.lit("pending").alias("status"), F.lit(0).alias("refused"))
    steps = events.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "to"))).alias("steps"))

    def step(s: Column, e: Column) -> Column:
        fine = F.coalesce(F.array_contains(F.try_element_at(moves, e["to"]), s["status"]), F.lit(False))
        return F.struct(F.when(fine, e["to"]).otherwise(s["status"]).alias("status"), (s["refused"] + F.when(fine, 0).otherwise(1)).alias("refused"))

    return steps.select("id", F.aggregate("steps", start, step).alias("s")).select("id", "s.status", "s.refused")


def counts(df: DataFrame, section: str, column: str, where: Column | None = None) -> DataFrame:
    """section, name, value: rows by label, null labels left out."""
    kept = df.filter(F.col(column).isNotNull())
    return (kept if where is None else kept.filter(where)).groupBy(F.col(column).alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit(section).alias("section"), "name", "value")


def figures(df: DataFrame, section: str, **values: Column) -> DataFrame:
    """section, name, value from one aggregate over df."""
    one = df.agg(*[v.cast("double").alias(n) for n, v in values.items()])
    return one.unpivot([], list(values), "name", "value").select(F.lit(section).alias("section"), "name", "value")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ledger_summary(runs: DataFrame, nodes: DataFrame, tasks: DataFrame, since: str) -> DataFrame:
    """Totals and counts by label of all ledgers; `since` is where the last day begins."""
    return _union([
        figures(runs, "runs", total=F.count("*"), docs_unique=F.count_distinct("doc_id"), last_day=F.count_if(F.col("updated_at") >= F.lit(since).cast("timestamp"))),
        counts(runs, "runs.by_status", "status"), counts(runs, "runs.by_node", "current_node"), counts(runs, "runs.failed_by_code", "error_code", F.col("error_code") != ""),
        figures(nodes, "nodes", total=F.count("*")), counts(nodes, "nodes.by_status", "status"), counts(nodes, "nodes.by_name", "node_name"), counts(nodes, "nodes.failed_by_code", "error_code", F.col("error_code") != ""),
        figures(tasks, "tasks", total=F.count("*"), pending_unassigned=F.count_if((F.col("status") == "pending") & (F.col("assigned_to") == ""))), counts(tasks, "tasks.by_status", "status"),
    ])


def share(part: Column, whole: Column) -> Column:
    """Four digits, half to even; 0 of nothing."""
    return F.bround(F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0)), 4)


def pipeline_metrics(runs: DataFrame, nodes: DataFrame, tasks: DataFrame, feedback: DataFrame, tenant_id: str | None = None, project_id: str | None = None, corpus_id: str | None = None) -> DataFrame:
    """Completion, failure, node failure and escalation rates of a scope; corpus_id narrows feedback alone."""
    scope = {"tenant_id": tenant_id, "project_id": project_id}
    runs, tasks, feedback = scoped(runs, **scope), scoped(tasks, **scope), scoped(feedback, **scope, corpus_id=corpus_id)
    own = nodes.join(runs.select(F.col("id").alias("run_id")), "run_id")
    total, done = F.count("*"), F.count_if(F.col("status") == "completed")
    run_figures = runs.agg(total.alias("total"), done.alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))
    both = run_figures.crossJoin(tasks.agg(F.count("*").alias("escalated")))  # one row each
    t, c, e = F.col("total"), F.col("completed"), F.col("escalated")
    accepted = F.when(c > 0, F.greatest(F.lit(0), c - e)).otherwise(0)
    rates = both.select(t.cast("double").alias("total"), share(c, t).alias("completion_rate"), share(F.col("failed"), t).alias("failure_rate"), e.cast("double").alias("escalated"), share(e, t).alias("escalation_rate"), accepted.cast("double").alias("auto_accepted"), share(accepted, t).alias("auto_accepted_rate"))
    return _union([
        rates.unpivot([], rates.columns, "name", "value").select(F.lit("runs").alias("section"), "name", "value"), counts(runs, "runs.by_status", "status"),
        figures(own, "nodes", total=F.count("*"), failed=F.count_if(node_failed()), failure_rate=share(F.count_if(node_failed()), F.count("*"))), counts(own, "nodes.failures_by_name", "node_name", node_failed()),
        counts(tasks, "tasks.by_status", "status"), figures(feedback, "feedback", total=F.count("*")), counts(feedback, "feedback.by_category", "category"),
    ])


def point_inventory(points: DataFrame) -> DataFrame:
    """Points by tenant, project and both (one grouping pass), and distinct counts, over all points."""
    name = F.concat_ws("/", "tenant_id", "project_id")
    grouped = points.groupingSets([["tenant_id"], ["project_id"], ["tenant_id", "project_id"]], "tenant_id", "project_id").agg(F.grouping_id().alias("g"), F.count("*").cast("double").alias("value"))
    section = F.when(F.col("g") == 1, "by_tenant").when(F.col("g") == 2, "by_project").otherwise("by_tenant_project")
    known = (F.col("g").bitwiseAND(2) != 0) | F.col("tenant_id").isNotNull(), (F.col("g").bitwiseAND(1) != 0) | F.col("project_id").isNotNull()
    by = grouped.filter(known[0] & known[1]).select(section.alias("section"), name.alias("name"), "value")
    return by.unionByName(figures(points, "points", total=F.count("*"), docs=F.count_distinct("doc_id"), tenants=F.count_distinct("tenant_id"), projects=F.count_distinct("project_id"), finalized=F.count_if(F.col("is_finalized")), open=F.count_if(~F.col("is_finalized"))))


KEYS = ["tenant_id", "project_id", "doc_id", "doc_version"]


def _whole_keys() -> Column:
    out = F.lit(True)
    for k in KEYS:
        out = out & F.col(k).isNotNull() & (F.col(k) != "")
    return out


def orphan_groups(points: DataFrame, runs: DataFrame) -> DataFrame:
    """Scope, document and version of points that no run knows, with their number; points with an empty key are left out."""
    return points.filter(_whole_keys()).join(runs.select(*KEYS), KEYS, "left_anti").groupBy(*KEYS).agg(F.count("*").alias("points"))


def dangling_runs(points: DataFrame, runs: DataFrame, latest: int = 200, limit: int = 50) -> DataFrame:
    """Of the latest runs, those without any point."""
    recent = newest(runs, [F.desc("id")], latest)
    return newest(recent.join(points.select(*KEYS), KEYS, "left_anti"), [F.desc("id")], limit)


def mature_orphans(current: DataFrame, seen: DataFrame, now: Column, grace_hours: int = 48) -> DataFrame:
    """The new table of first sightings (key, first_seen) and `due`: orphaned for the whole grace time. Keys that are orphans no more are forgotten."""
    kept = current.select("key").distinct().join(seen.groupBy("key").agg(F.min("first_seen").alias("first_seen")), "key", "left").withColumn("first_seen", F.coalesce("first_seen", now))
    return kept.withColumn("due", F.col("first_seen") <= now - F.expr(f"INTERVAL {grace_hours} HOURS"))


def first_seen_points(points: DataFrame, limit: int, **scope: object) -> DataFrame:
    """The first point of each document, by id."""
    first = scoped(points, **scope).groupBy("doc_id").agg(F.min_by(F.struct("id", "tenant_id", "project_id", "corpus_id", "doc_version"), "id").alias("p"))
    return newest(first.select("doc_id", "p.*"), [F.col("id")], limit)


def after_cursor(df: DataFrame, key: str, cursor: object | None, limit: int) -> DataFrame:
    """The next rows by key after the cursor: a page that never reads what was read."""
    return newest(df if cursor is None else df.filter(F.col(key) > cursor), [F.col(key)], limit)


def latest_version(runs: DataFrame) -> DataFrame:
    """The newest run's version of each document in its scope."""
    return runs.groupBy("tenant_id", "project_id", "doc_id").agg(F.max_by("doc_version", "id").alias("doc_version"))


def active_version(asked: DataFrame, active: DataFrame) -> DataFrame:
    """asked with active_doc_version: by the key `corpus::doc`, else by the document alone (rows written before corpora)."""
    key = F.when(F.coalesce(F.col("corpus_id"), F.lit("")) == "", F.col("doc_id")).otherwise(F.concat_ws("::", "corpus_id", "doc_id"))
    known = active.select("tenant_id", "project_id", F.col("doc_id").alias("_key"), "active_doc_version")
    scope = ["tenant_id", "project_id", "_key"]
    first = asked.withColumn("_key", key).join(known.withColumnRenamed("active_doc_version", "_own"), scope, "left")
    both = first.withColumn("_key", F.col("doc_id")).join(known.withColumnRenamed("active_doc_version", "_old"), scope, "left")
    return both.withColumn("active_doc_version", F.coalesce("_own", "_old")).drop("_key", "_own", "_old")


def activated(points: DataFrame, version: str, **document: object) -> DataFrame:
    """All points, with exactly the given version of the document active: one expression, so no reader sees none."""
    own = F.lit(True)
    for k, v in document.items():
        own = own & (F.col(k) == v)
    return points.withColumn("is_active_version", F.when(own, F.col("doc_version") == version).otherwise(F.col("is_active_version")))


def upserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with the rows in place of those of equal keys, and added where there are none."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def rescoped(df: DataFrame, where: Column, **scope: str) -> DataFrame:
    """Rows that the condition names, moved to another scope; others stay. A null condition is false."""
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({k: F.when(hit, F.lit(v)).otherwise(F.col(k)) for k, v in scope.items()})


def without(df: DataFrame, where: Column) -> DataFrame:
    """Rows that the condition does not name; a null condition names none."""
    return df.filter(~F.coalesce(where, F.lit(False)))


def childless(parents: DataFrame, children: DataFrame, keys: list[str]) -> DataFrame:
    """Parents that may be deleted."""
    return parents.join(children.select(*keys), keys, "left_anti")


def session_progress(pages: DataFrame) -> DataFrame:
    """Page counts of each session; pages that aren't enabled count in the total alone."""
    on = lambda s: F.count_if(F.col("enabled") & (F.col("status") == s))
    first = F.min(F.when(F.col("enabled") & (F.col("status") == "pending"), F.col("page_num")))
    return pages.groupBy("session_id").agg(F.count("*").alias("total"), F.count_if("enabled").alias("enabled"), on("done").alias("done"), on("skipped").alias("skipped"), on("error").alias("errors"), on("pending").alias("pending"), first.alias("next_page"))


def resume_list(sessions: DataFrame, pages: DataFrame, limit: int) -> DataFrame:
    """The newest sessions with the number of their finished pages."""
    done = pages.groupBy("session_id").agg(F.count_if(F.col("status").isin(PAGE_DONE)).alias("pages_done"))
    return newest(sessions.join(done, "session_id", "left").withColumn("pages_done", F.coalesce("pages_done", F.lit(0))), [F.desc("session_id")], limit)
