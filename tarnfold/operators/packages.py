"""Packages of documents: frontmatter, markdown, manifests, inventories and zipped exports, and their import.

Everything that goes into a package is a row first; a zip is made where its document's
rows lie, one Arrow batch at a time, and read again the same way.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfold.functions.markdown import safe_filename, strip_frontmatter

# What a package's files are called, and a zip entry's date, so that equal documents give equal bytes.
MANIFEST, INDEX, TEXT, INVENTORY = "manifest.json", "index.json", "document.md", "INDEX.md"
DATE = (1980, 1, 1, 0, 0, 0)
SCOPE = ["tenant_id", "project_id", "corpus_id"]


def json_string(c: Column) -> Column:
    """A value as JSON writes it alone."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def frontmatter(fields: dict[str, Column]) -> Column:
    """A block of `key: value` lines between rules; null fields are left out."""
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), json_string(c))) for k, c in fields.items()]
    return F.concat(F.array_join(F.array_compact(F.array(F.lit("---"), *lines, F.lit("---"))), "\n"), F.lit("\n\n"))


def document_markdown(chunks: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """doc_id, doc_version, markdown, chunks: the stored text without its frontmatter, else the chunks' texts in order, those without an index last."""
    keys = ["doc_id", "doc_version"]
    parts = F.sort_array(F.collect_list(F.struct(F.col("chunk_index").isNull().alias("last"), "chunk_index", "text")))
    out = chunks.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda c: c["text"]), "\n\n").alias("markdown"), F.count("*").alias("chunks"))
    if artifacts is None:
        return out
    stored = artifacts.select(*keys, strip_frontmatter(F.col("text")).alias("_stored"))
    return out.join(stored, keys, "left").withColumn("markdown", F.coalesce("_stored", "markdown")).drop("_stored")


def lean(docs: DataFrame, meta: list[str]) -> DataFrame:
    """file, content: each document's frontmatter and text. A document without a text has an empty one."""
    content = F.concat(frontmatter({m: F.col(m) for m in meta}), F.coalesce("markdown", F.lit("")))
    return docs.select(F.concat(safe_filename(F.col("doc_id")), F.lit(".md")).alias("file"), content.alias("content"))


def manifest(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_index, line: a JSON line a chunk."""
    line = F.to_json(F.struct("id", F.col("section_path").alias("heading_path"), "text", F.struct("doc_version", "chunk_index").alias("metadata")))
    return chunks.select("doc_id", "chunk_index", line.alias("line"))


def inventory(docs: DataFrame, title: str, columns: list[str]) -> DataFrame:
    """markdown: one table of the exported documents, numbered in the order of doc_id and doc_version. It is a report of one row a document, and one text."""
    rows = F.sort_array(F.collect_list(F.struct("doc_id", "doc_version", F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("cells"))))
    body = F.transform(rows, lambda r, i: F.concat(F.lit("| "), (i + 1).cast("string"), F.lit(" | "), F.array_join(r["cells"], " | "), F.lit(" |")))
    head = [f"# {title}", ""], ["", "| # | " + " | ".join(columns) + " |", "|---|" + "---|" * len(columns)]
    lit = lambda xs: F.array(*map(F.lit, xs))
    lines = F.concat(lit(head[0]), F.array(F.concat(F.lit("Total documents: "), F.count("*").cast("string"))), lit(head[1]), body, lit([""]))
    return docs.agg(F.array_join(lines, "\n").alias("markdown"))


def inventory_lines(docs: DataFrame, title: str, columns: list[str], save: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """nth, line: the same table as a row a line, for inventories of any size. Rows are numbered within ranges of their order, and the ranges by their counts; `save` writes the ranges once, so that they stay what they were counted as."""
    cells = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    rows = docs.select("doc_id", "doc_version", cells.alias("cells")).repartitionByRange("doc_id", "doc_version").sortWithinPartitions("doc_id", "doc_version")
    rows = save(rows.select("cells", F.monotonically_increasing_id().alias("at")), "ranges").withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    parts = save(parts.select("part", (before - F.col("first") + 1).alias("shift"), "n"), "parts")
    numbered = rows.join(parts.select("part", "shift"), "part").select((F.col("at") + F.col("shift")).alias("number"), "cells")
    head = [f"# {title}", "", "Total documents: ", "", "| # | " + " | ".join(columns) + " |", "|---|" + "---|" * len(columns)]
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("string").alias("t"))
    top = total.select(F.posexplode(F.array(*[F.concat(F.lit(x), F.col("t")) if x.endswith(": ") else F.lit(x) for x in head])).alias("at", "line")).select((F.col("at") + 1).cast("long").alias("nth"), "line")
    line = F.concat(F.lit("| "), F.col("number").cast("string"), F.lit(" | "), F.array_join("cells", " | "), F.lit(" |"))
    return top.unionByName(numbered.select((F.col("number") + len(head)).alias("nth"), line.alias("line")))


def _zip(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(zipfile.ZipInfo(name, DATE), content)
    return out.getvalue()


def packed(docs: DataFrame) -> DataFrame:
    """file, package: a zip for each row of doc_id, doc_version, markdown, meta (JSON) and index (JSON of its chunks)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [_zip({MANIFEST: m, INDEX: i, TEXT: t or ""}) for m, i, t in zip(pdf["meta"], pdf["index"], pdf["markdown"], strict=True)]
            yield pd.DataFrame({"file": pdf["file"], "package": made})

    name = F.concat(safe_filename(F.col("doc_id")), F.lit("_"), safe_filename(F.col("doc_version")), F.lit(".zip"))
    return docs.select(name.alias("file"), "markdown", "meta", "index").mapInPandas(run, "file string, package binary")


def unpacked(packages: DataFrame) -> DataFrame:
    """file, doc_id, doc_version, text, error of each package: its manifest and its text without frontmatter; what can't be read has an error and nothing else."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, blob in zip(pdf["file"], pdf["package"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(blob)) as z:
                        about, text = json.loads(z.read(MANIFEST)), z.read(TEXT).decode()
                    rows.append((name, str(about["doc_id"]), about.get("doc_version"), text, None))
                except (zipfile.BadZipFile, KeyError, ValueError, TypeError) as e:
                    rows.append((name, None, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["file", "doc_id", "doc_version", "text", "error"])

    out = packages.select("file", "package").mapInPandas(run, "file string, doc_id string, doc_version string, text string, error string")
    return out.withColumn("text", strip_frontmatter(F.col("text")))


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """file, package of the zips in a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("content").alias("package"))


def scoped_documents(points: DataFrame, most: int | None = None) -> DataFrame:
    """The finalised documents of active versions with their scope: (tenant, project, corpus, doc_id, doc_version), markdown and chunks; of each corpus the first `most`, if given, by id and version."""
    kept = points.filter("is_finalized AND is_active_version")
    parts = F.sort_array(F.collect_list(F.struct(F.col("chunk_index").isNull().alias("last"), "chunk_index", "text")))
    docs = kept.groupBy(*SCOPE, "doc_id", "doc_version").agg(F.array_join(F.transform(parts, lambda c: c["text"]), "\n\n").alias("markdown"), F.count("*").alias("chunks"))
    if most is None:
        return docs
    nth = F.row_number().over(Window.partitionBy(*SCOPE).orderBy("doc_id", "doc_version"))
    return docs.withColumn("_nth", nth).filter(F.col("_nth") <= most).drop("_nth")


def export_scopes(docs: DataFrame, path: str, meta: list[str]) -> None:
    """Folders by tenant, project and corpus, written by the executors: `documents` has a line for each document's file (its content, frontmatter and all), `manifests` one for each corpus, of aggregates over them.

    Rows are dealt by corpus, large corpora over several files, and nothing is held whole:
    a manifest is counts and sums, and the sum of the files' hashes, not a list.
    """
    files = docs.select(*SCOPE, "doc_id", "doc_version", "chunks", *lean_columns(meta))
    files.hint("rebalance", *SCOPE).write.mode("errorifexists").partitionBy(*SCOPE).json(f"{path}/documents")
    exported_manifests(docs.sparkSession, path).write.mode("errorifexists").partitionBy(*SCOPE[:2]).json(f"{path}/manifests")


def lean_columns(meta: list[str]) -> list[Column]:
    """file and content of a document."""
    content = F.concat(frontmatter({m: F.col(m) for m in meta}), F.coalesce("markdown", F.lit("")))
    return [F.concat(safe_filename(F.col("doc_id")), F.lit("_"), safe_filename(F.col("doc_version")), F.lit(".md")).alias("file"), content.alias("content")]


def read_exported(spark: SparkSession, path: str) -> DataFrame:
    """The documents' lines of an export again, with their scope; other tenants' folders aren't read under a filter."""
    return spark.read.schema(", ".join(f"{c} string" for c in ("doc_id", "doc_version")) + ", chunks long, file string, content string, " + ", ".join(f"{c} string" for c in SCOPE)).json(f"{path}/documents")


def exported_manifests(spark: SparkSession, path: str) -> DataFrame:
    """A row a corpus of what an export's files hold: documents, chunks, characters, and a checksum that doesn't depend on their order."""
    digest = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", "file", "content"), 256), 1, 8), 16, 10).cast("long")
    return read_exported(spark, path).groupBy(*SCOPE).agg(F.count("*").alias("documents"), F.sum("chunks").alias("chunks"), F.sum(F.length("content")).alias("chars"), F.sum(digest).alias("checksum"))


def verified_export(spark: SparkSession, path: str) -> DataFrame:
    """Each corpus whose files and manifest don't say the same, with what differs: none, if the export is whole."""
    kept = spark.read.schema(", ".join(f"{c} string" for c in SCOPE) + ", documents long, chunks long, chars long, checksum long").json(f"{path}/manifests").alias("m")
    now = exported_manifests(spark, path).alias("f")
    same = F.lit(True)
    for c in ("documents", "chunks", "chars", "checksum"):
        same = same & F.col(f"m.{c}").eqNullSafe(F.col(f"f.{c}"))
    return kept.join(now, [F.col(f"m.{c}").eqNullSafe(F.col(f"f.{c}")) for c in SCOPE], "full").filter(~same).select(*[F.coalesce(f"m.{c}", f"f.{c}").alias(c) for c in SCOPE], F.col("m.documents").alias("listed"), F.col("f.documents").alias("found"))
