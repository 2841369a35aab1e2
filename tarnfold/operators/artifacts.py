"""Artifacts of runs, ledger rows with ids of their own, scopes, and pages of a converter's JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.functions import decisions, guardrails
from tarnfold.functions.markdown import bound, sections
from tarnfold.session import saver

# What converters call headings and titles, and the marks that they get.
MARKS = {"section_header": "## ", "title": "# "}
CONVERTED = "body struct<children:array<struct<`$ref`:string>>>, texts array<struct<self_ref:string,label:string,text:string,prov:array<struct<page_no:int>>>>, tables array<struct<self_ref:string,prov:array<struct<page_no:int>>,data:struct<grid:array<array<struct<text:string>>>>>>"


def artifact_refs(files: DataFrame, kind: str) -> DataFrame:
    """run_id, kind, path, sha256, chars of files (run_id, name, content): what a ledger keeps of a written artifact."""
    return files.select("run_id", F.lit(kind).alias("kind"), F.concat(F.lit("runs/"), F.col("run_id").cast("string"), F.lit("/"), "name").alias("path"), F.sha2("content", 256).alias("sha256"), F.length("content").alias("chars"))


def newest_markdown(refs: DataFrame) -> DataFrame:
    """run_id, path: the latest reference of each run whose path ends in .md."""
    return refs.filter(F.col("path").endswith(".md")).groupBy("run_id").agg(F.max_by("path", "id").alias("path"))


def source_of(refs: DataFrame) -> DataFrame:
    """run_id, path: the first reference of each run that is a source, or lies below one."""
    return refs.filter((F.col("kind") == "source") | F.contains("path", F.lit("/source/"))).groupBy("run_id").agg(F.min_by("path", "id").alias("path"))


def appended(ledger: DataFrame, rows: DataFrame, order: list[Column]) -> DataFrame:
    """ledger and the rows after it, numbered on from its largest id. Rows are numbered within ranges of their order, so no task numbers all of them.

    The ranges are written once and read twice: a range sort that is worked out again draws
    other bounds, and counts of ranges must be of the rows that are numbered.
    """
    save = saver(rows.sparkSession, "appended")
    spread = save(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    numbered = spread.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy("_at")))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = spread.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))  # a row a partition
    last = ledger.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    out = numbered.join(F.broadcast(parts.select("_part", "_before")), "_part").join(F.broadcast(last), how="left", on=F.lit(True))
    return ledger.unionByName(out.withColumn("id", (F.col("_last") + F.col("_before") + F.col("_nth")).cast("long")).select(*ledger.columns))


def added_if_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table and those rows whose keys it lacks; of several new ones of a key, one."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def created(scopes: DataFrame, new: DataFrame, keys: list[str], parents: DataFrame | None = None, parent_keys: list[str] | None = None) -> DataFrame:
    """new with `outcome`: created, exists, or missing_parent."""
    known = scopes.select(*keys, F.lit(True).alias("_known")).distinct()
    out = new.join(known, keys, "left")
    if parents is None:
        return out.withColumn("outcome", F.when(F.col("_known"), "exists").otherwise("created")).drop("_known")
    out = out.join(parents.select(*parent_keys, F.lit(True).alias("_parent")).distinct(), parent_keys, "left")
    return out.withColumn("outcome", F.when(F.col("_parent").isNull(), "missing_parent").when(F.col("_known"), "exists").otherwise("created")).drop("_known", "_parent")


def with_pages(sessions: DataFrame, pages: DataFrame) -> DataFrame:
    """sessions with `pages`, an array of their pages in order; one without pages has none."""
    own = pages.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("page_num", "status"))).alias("pages"))
    return sessions.join(own, "session_id", "left").withColumn("pages", F.coalesce("pages", F.array().cast(own.schema["pages"].dataType)))


def page_texts(docs: DataFrame, content: str = "content") -> DataFrame:
    """doc_id, page_no, texts: what lies on each page of a converter's JSON, in the order of its body; headings marked, tables as rows."""
    j = docs.select("doc_id", F.from_json(content, CONVERTED).alias("j"))
    order = j.select("doc_id", F.posexplode("j.body.children").alias("at", "c")).select("doc_id", "at", F.col("c.$ref").alias("ref"))
    mark = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv]), F.col("label")), F.lit(""))
    texts = j.select("doc_id", F.inline("j.texts")).select("doc_id", F.col("self_ref").alias("ref"), F.col("prov")[0]["page_no"].alias("page_no"), F.concat(mark, "text").alias("text"))
    row = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: c["text"]), " | "), F.lit(" |"))
    rule = lambda cells: F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(cells)))
    grid = F.col("data.grid")
    lines = F.flatten(F.transform(grid, lambda r, i: F.when(i == 0, F.array(row(r), rule(r))).otherwise(F.array(row(r)))))
    tables = j.select("doc_id", F.inline("j.tables")).select("doc_id", F.col("self_ref").alias("ref"), F.col("prov")[0]["page_no"].alias("page_no"), F.array_join(lines, "\n").alias("text"))
    placed = order.join(texts.unionByName(tables), ["doc_id", "ref"]).filter("page_no IS NOT NULL AND text <> ''")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])
    return placed.groupBy("doc_id", "page_no").agg(parts.alias("texts"))


def page_markdown(pages: DataFrame, number: int) -> DataFrame:
    """doc_id, markdown of the page with a number that counts from 0."""
    return pages.filter(F.col("page_no") == number + 1).select("doc_id", F.array_join("texts", "\n\n").alias("markdown"))


def refined_by_section(docs: DataFrame, refine=decisions.refined_offline, most_tokens: int = 6000, text: str = "text") -> DataFrame:
    """docs with `refined`, their sections refined one by one and put together again, and `refused`, why it doesn't stand (the text is then kept). A row is refined where it lies; refine is of built-in functions."""
    whole = bound(F.transform(sections(F.col(text), most_tokens), refine), lambda parts: F.when(F.size(parts) > 0, F.array_join(parts, "\n\n")))
    out = docs.withColumn("_new", whole).withColumn("refused", guardrails.refine_verdict(F.col(text), F.coalesce("_new", F.lit(""))))
    return out.withColumn("refined", F.when(F.col("refused").isNull(), F.col("_new")).otherwise(F.col(text))).drop("_new")
