"""What a row's work doesn't repeat: expressions that are worked out once, and no shuffle where rows suffice."""

from pyspark.sql import functions as F

from tarnfold.functions import guardrails
from tarnfold.operators import artifacts, retrieval, stitching


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def texts(spark):
    return spark.range(3).select(F.col("id").alias("doc_id"), F.concat(F.lit("# a\n\nb "), F.col("id").cast("string")).alias("text"))


def test_words_are_split_once(spark):
    """Not once more for each chunk."""
    assert plan(texts(spark).select(retrieval.word_chunks(F.col("text"), 64, 48).alias("c"))).count("split(") == 1


def test_artifacts_are_found_in_one_pass(spark):
    """One split to lines and one at headings."""
    assert plan(texts(spark).select(guardrails.strip_artifacts(F.col("text")).alias("t"))).count("split(") == 2


def test_sections_are_refined_where_they_lie(spark):
    df = artifacts.refined_by_section(texts(spark).unionByName(spark.createDataFrame([(7, " "), (8, None)], "doc_id long, text string")))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: (r["refined"], r["refused"]) for r in df.collect()} == {**{i: (f"[REFINED]\n# a\n\nb {i}", None) for i in range(3)}, 7: (None, None), 8: (None, None)}


def test_documents_of_a_batch_leave_together(spark, monkeypatch):
    """Not a table for each document."""
    pages = spark.range(40).selectExpr("id DIV 2 AS doc_id", "CAST(id % 2 AS INT) AS page_num", "concat('p', id) AS markdown")
    made = []
    with monkeypatch.context() as m:
        m.setattr(type(pages), "mapInPandas", lambda self, run, schema: made.extend(run(iter([self.toPandas()]))) or self)
        stitching.stitched(pages.coalesce(1))
    assert sum(map(len, made)) == 20
    assert len(made) <= 2
