"""Documents from files, and a versioned chunk store of Parquet folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfold.functions.ordered import html_unescape
from tarnfold.operators.retrieval import latest
from tarnfold.session import saver

# The kinds of files by extension.
KINDS = {"md": "markdown", "markdown": "markdown", "txt": "text", "html": "html", "htm": "html", "csv": "csv", "json": "json", "jsonl": "json"}


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, filename, kind, source_hash and text of every whole text file below path (a folder or pattern)."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("filename"), F.regexp_replace("value", "^﻿", "").alias("text"))
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    extension = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))
    return rows.select("path", "filename", F.coalesce(F.try_element_at(kinds, extension), F.lit("text")).alias("kind"), F.sha2("text", 256).alias("source_hash"), "text")


def html_to_text(html):
    """The text of an HTML page: scripts, styles and comments go, block ends become line feeds, entities are decoded."""
    out = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(?:p|div|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav)\s*>", "\n")
    out = html_unescape(F.regexp_replace(out, r"<[^>]+>", ""))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t\x{a0}]+", " "), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


def html_to_markdown(html):
    """Headings, list items and paragraphs of an HTML page as markdown."""
    out = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    for level in range(1, 7):
        out = F.regexp_replace(out, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}\s*>", "\n\n" + "#" * level + " $1\n\n")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<li\b[^>]*>", "\n- "), r"(?i)<br\s*/?>|</(?:p|div|ul|ol|tr|table|article|section|header|footer|nav)\s*>", "\n\n")
    out = html_unescape(F.regexp_replace(out, r"<[^>]+>", ""))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r" ?\n ?(?:\n ?)+", "\n\n"), r"^\s+|\s+$", "")


def html_without_tags(html):
    """The plain way: tags become blanks, runs of blanks one, a line feed at the end. Scripts' texts stay."""
    out = F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"(?U)\s+", " ")
    return F.concat(F.trim(out), F.lit("\n"))


def append_chunks(chunks: DataFrame, path: str) -> None:
    """Add chunks; a chunk comes again when its document is ingested again, and read_chunks keeps the newest."""
    chunks.write.mode("append").partitionBy("tenant_id").parquet(path)


def read_chunks(spark: SparkSession, path: str, tenant: str) -> DataFrame:
    """The newest version of each chunk of one tenant; other tenants' folders aren't read."""
    rows = spark.read.parquet(path).filter(F.col("tenant_id") == tenant)
    return latest(rows, ["chunk_id"], "doc_version")


def read_expectations(spark: SparkSession, path: str) -> DataFrame:
    """document, wanted: the lines of `<document>.expected.txt` files; blanks and lines that begin with # are left out."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.expected.txt").text(path)
    wanted = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    rows = lines.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.expected\.txt$", "").alias("document"), wanted.alias("wanted"))
    return rows.filter((F.col("wanted") != "") & ~F.col("wanted").startswith("#"))


def write_golden_sets(cases: DataFrame, path: str, order: list[Column]) -> None:
    """Golden sets of cases (source, id, query, expected_doc_ids): a folder a source, below it an object a line, of one case and its place in the source's order. So no row or task holds a set.

    Cases are ranged by source and order, and the ranges written once, so that places are
    counted over the rows that get them. A row for each source and range is broadcast.
    """
    rows = cases.repartitionByRange("source", *order).sortWithinPartitions("source", *order)
    rows = saver(cases.sparkSession, "golden")(rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranges")
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(F.col("source").alias("_source"), F.col("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    parts = parts.select("_source", F.col("_part").alias("_of"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    placed = rows.join(F.broadcast(parts), (F.col("_part") == F.col("_of")) & F.col("source").eqNullSafe(F.col("_source")))
    line = F.struct((F.col("_at") + F.col("_shift")).alias("first"), F.array(F.struct("id", "query", "expected_doc_ids")).alias("cases"))
    placed.select("source", F.to_json(line).alias("value")).write.partitionBy("source").text(path)


def read_golden_set(spark: SparkSession, path: str, lines: bool = False, blank: bool = False) -> DataFrame:
    """case_id, query, id: a row for each document that a case of a golden set expects. A case without expectations is an error, and so is one without a query, unless those may be blank.

    A file is an object, or with lines each of its lines is one; `first` is the place of an object's first case.
    """
    raw = spark.read.schema("first long, cases array<struct<id:string,query:string,expected_doc_ids:array<string>>>").option("maxStringLen", str(2**31 - 1)).option("multiLine", not lines).json(path)
    cases = raw.select("first", F.posexplode("cases").alias("n", "c"))
    fine = (F.lit(blank) | (F.coalesce(F.trim("c.query"), F.lit("")) != "")) & (F.size(F.coalesce("c.expected_doc_ids", F.array().cast("array<string>"))) > 0)
    wanted = F.when(fine, F.col("c.expected_doc_ids")).otherwise(F.raise_error(F.lit("a case needs a query and expected_doc_ids")))
    place = F.coalesce("first", F.lit(0)) + F.col("n")
    return cases.select(F.coalesce("c.id", place.cast("string")).alias("case_id"), F.col("c.query").alias("query"), F.explode(wanted).alias("id"))
