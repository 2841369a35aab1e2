"""Documents through judging and refining, as passes over a table of states.

A pass moves every document that still runs by one node, and reads those alone; documents
at rest stay where the pass that ended them wrote them. The number of passes is bounded by
the retries, and a pass writes its table to the
shared folder, so lineage doesn't grow and a lost executor costs one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.functions import decisions, guardrails

ENDS = ("metadata", "hitl", "failed")


def started(docs: DataFrame, text: str = "text", max_retries: int = 2) -> DataFrame:
    """docs with the state of a run before its first judge."""
    none = lambda kind: F.lit(None).cast(kind)
    return docs.withColumns({
        "markdown": F.col(text), "before": none("string"), "current_node": F.lit("judge"), "score": none("int"), "history": F.array().cast("array<int>"), "retries": F.lit(0), "attempts": F.lit(0), "max_retries": F.lit(max_retries),
        "cleanup_passes": F.lit(0), "needs_hitl": F.lit(False), "resumed": F.lit(False), "sub_scores": none("struct<faithfulness:int,formatting:int,cohesion:int,hallucination_risk:int>"), "rule_tags": F.array().cast("array<string>"), "ocr_confidence": none("double"), "health_score": none("int"),
    })


@dataclass(frozen=True)
class Provider:
    """What judges and refines, as functions of a text column."""

    judge: callable = decisions.judged_offline
    refine: callable = decisions.refined_offline


def judged(state: DataFrame, provider: Provider, routing: decisions.Routing) -> DataFrame:
    """Documents at the judge get a score, which their history keeps, and go where the routing table sends them; a score that fell takes the text before back."""
    at = F.col("current_node") == "judge"
    score = provider.judge(F.col("markdown"))
    state = state.withColumn("_score", F.when(at, score)).withColumns({"score": F.coalesce("_score", "score"), "history": F.when(at, F.array_append("history", F.col("_score"))).otherwise(F.col("history"))})
    state = state.withColumn("_to", decisions.route(routing))
    valid = decisions.may_move(F.col("current_node"), F.col("_to.target"))
    return state.withColumns({"markdown": F.when(at & F.col("_to.rollback"), F.coalesce("before", "markdown")).otherwise(F.col("markdown")), "current_node": F.when(at, F.when(valid, F.col("_to.target")).otherwise("failed")).otherwise(F.col("current_node"))}).drop("_score", "_to")


def refined(state: DataFrame, provider: Provider) -> DataFrame:
    """Documents at the refiner get its text if the guards let it stand, and go back to the judge. A refused one spends no retry until twice the retries were tried."""
    at = F.col("current_node") == "refine"
    state = state.withColumn("_new", F.when(at, provider.refine(F.col("markdown")))).withColumn("_why", guardrails.refine_verdict(F.col("markdown"), F.col("_new")))
    good, tries = F.col("_why").isNull(), F.col("attempts") + 1
    spent = good | (tries >= F.col("max_retries") * 2)
    return state.withColumns({
        "before": F.when(at, F.col("markdown")).otherwise(F.col("before")), "markdown": F.when(at & good, F.col("_new")).otherwise(F.col("markdown")), "attempts": F.when(at, tries).otherwise(F.col("attempts")),
        "retries": F.when(at & spent, F.col("retries") + 1).otherwise(F.col("retries")), "current_node": F.when(at, "judge").otherwise(F.col("current_node")),
    }).drop("_new", "_why")


def run(docs: DataFrame, save: callable, routing: decisions.Routing | None = None, provider: Provider | None = None, max_retries: int = 2, text: str = "text") -> DataFrame:
    """docs with their final state: at metadata (accepted), hitl (for a human) or failed. save(df, name) writes a pass and reads it again."""
    routing, provider = routing or decisions.Routing(), provider or Provider()
    state, rest = started(docs, text, max_retries), None
    for i in range(3 * max_retries + 1):
        done = save(judged(state, provider, routing), f"judged{i}")
        running = done.filter("current_node = 'refine'")
        if running.isEmpty():
            return done if rest is None else rest.unionByName(done)
        ended = done.filter("current_node <> 'refine'")
        rest = ended if rest is None else rest.unionByName(ended)
        state = refined(running, provider)
    return rest.unionByName(state)


def outcome(judge_score: Column, retries: Column, max_retries: int) -> Column:
    """The fidelity of a run's result."""
    return decisions.fidelity_flag(judge_score, retries, max_retries)


def node_rows(runs: DataFrame) -> DataFrame:
    """run_id, node_name, detail: a row for each node whose result a run has (columns cleanup, judge, refine, metadata; null if it has none)."""
    each = F.array(*[F.struct(F.lit(n).alias("node_name"), F.col(n).cast("string").alias("detail")) for n in ("cleanup", "judge", "refine", "metadata")])
    return runs.select("run_id", F.inline(F.filter(each, lambda x: x["detail"].isNotNull())))


def may_resume(tasks: DataFrame, runs: DataFrame, most: int = 2) -> DataFrame:
    """Completed review tasks with an edited text, of runs that aren't completed and were resumed less than `most` times."""
    fine = tasks.filter((F.col("status") == "completed") & (F.coalesce("after_md", F.lit("")) != "") & (F.coalesce("resumes", F.lit(0)) < most))
    return fine.join(runs.filter("status <> 'completed'").select(F.col("id").alias("run_id")), "run_id", "left_semi")
