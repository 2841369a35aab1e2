"""Tables that change together: data folders that never change, and records that name them.

A commit writes new folders first and then one record, which names, for every table, the
folders that it consists of. Only the record makes a change visible: whoever stops before
it leaves folders that nothing names, and a reader sees all tables before the commit or all
of them after. A record's file is created only where there is none, so of two writers that
started from one snapshot the second is told, and may start again from the newer one. A
record that was cut short is passed over, and numbers go on beyond it.

Folders lie by partition column, so a change rewrites only the partitions that it touches
and filters by that column read only theirs.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnfold.operators.artifacts import appended
from tarnfold.session import saver

VERSION = "_version"  # the column that a data folder's name stands for


class Conflict(RuntimeError):
    """Another commit came first."""


@dataclass(frozen=True)
class Snapshot:
    """One record: of each table its schema (JSON), its partition column and its folders."""

    number: int
    tables: dict[str, dict]


class Commits:
    """A folder of tables and of the records of their versions."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _numbers(self) -> list[int]:
        folder = self._at("records")
        names = [f.getPath().getName() for f in self.files.listStatus(folder)] if self.files.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _record(self, number: int) -> dict | None:
        """What a record names; None if it was cut short."""
        text = "\n".join(r["value"] for r in self.spark.read.option("wholetext", True).text(f"{self.path}/records/{number}.json").collect())
        try:
            return json.loads(text)
        except ValueError:
            return None

    def snapshot(self, number: int | None = None) -> Snapshot:
        """The newest whole record up to a number; the empty one before all."""
        for n in reversed([n for n in self._numbers() if number is None or n <= number]):
            if (tables := self._record(n)) is not None:
                return Snapshot(n, tables)
        return Snapshot(0, {})

    def read(self, table: str, at: Snapshot | None = None) -> DataFrame:
        """A table as the snapshot (the newest) has it."""
        about = (at or self.snapshot()).tables.get(table)
        if about is None:
            raise ValueError(f"no table {table} at {self.path}")
        schema = StructType.fromJson(json.loads(about["schema"]))
        if not about["folders"]:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(StructType([*schema]).add(VERSION, "string")).option("basePath", f"{self.path}/{table}").parquet(*[f"{self.path}/{table}/{f}" for f in about["folders"]])
        return rows.select(*schema.fieldNames())

    def _write(self, table: str, rows: DataFrame, by: str | None) -> dict:
        """A new data folder, and what a record says of it: a table of rows alone."""
        name = f"{VERSION}={uuid.uuid4().hex}"
        writer = rows.write.mode("errorifexists")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/{table}/{name}")
        inner = [f.getPath().getName() for f in self.files.listStatus(self._at(f"{table}/{name}"))] if by else []
        return {"schema": rows.schema.json(), "by": by, "folders": [f"{name}/{x}" for x in inner if x.startswith(f"{by}=")] if by else [name]}

    def commit(self, base: Snapshot, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None, by: dict[str, str] | None = None) -> Snapshot:
        """The tables of base with rows added and tables replaced, as one new record. A table's partition column is given with its first rows. Raises Conflict if base isn't the newest record any more."""
        tables, by = dict(base.tables), by or {}
        for name, rows in (replace or {}).items():
            tables[name] = self._write(name, rows, tables.get(name, {}).get("by") or by.get(name))
        for name, rows in (append or {}).items():
            old = tables.get(name)
            order = StructType.fromJson(json.loads(old["schema"])).fieldNames() if old else rows.columns
            new = self._write(name, rows.select(*order), old["by"] if old else by.get(name))
            tables[name] = {**(old or new), "folders": (old["folders"] if old else []) + new["folders"]}
        return self._put(base, tables)

    def change(self, table: str, touched: Column, how, base: Snapshot | None = None) -> Snapshot:
        """A table with how(rows) in place of the rows of all partitions in which the condition names any; other partitions' folders stay as they are."""
        base = base or self.snapshot()
        about = base.tables[table]
        if not about["by"]:
            return self.commit(base, replace={table: how(self.read(table, base))})
        by, rows = F.col(about["by"]), self.read(table, base)
        hit = [r[0] for r in rows.filter(F.coalesce(touched, F.lit(False))).select(by).distinct().collect()]  # names of partitions, which a record lists anyway
        mine = by.isin([h for h in hit if h is not None]) | (by.isNull() if None in hit else F.lit(False))
        new = self._write(table, how(rows.filter(F.coalesce(mine, F.lit(False)))), about["by"])
        gone = {self._partition_name(about["by"], h) for h in hit}
        stay = [f for f in about["folders"] if f.rpartition("/")[2] not in gone]
        return self._put(base, {**base.tables, table: {**about, "folders": stay + new["folders"]}})

    def _partition_name(self, by: str, value: str | None) -> str:
        return self.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(by, value)

    def _put(self, base: Snapshot, tables: dict[str, dict]) -> Snapshot:
        number = max(self._numbers(), default=0) + 1
        if self.snapshot().number != base.number:
            raise Conflict(f"{self.path} is at {self.snapshot().number}, not at {base.number}")
        try:
            out = self.files.create(self._at(f"records/{number}.json"), False)
        except Py4JJavaError as e:
            raise Conflict(f"record {number} of {self.path} is there") from e
        try:
            out.write(bytearray(json.dumps(tables).encode()))
        finally:
            out.close()
        return Snapshot(number, tables)


    def vacuum(self, keep: int = 1, idle_ms: int = 86_400_000) -> int:
        """Delete the data folders that none of the newest `keep` whole records names and that nobody has written to for idle_ms, which is longer than any writer takes; how many. Records stay, but snapshots before those kept can't be read any more."""
        whole = [t for n in reversed(self._numbers()) if (t := self._record(n)) is not None][:keep]
        named = {(table, f.partition("/")[0]) for tables in whole for table, about in tables.items() for f in about["folders"]}
        before, gone = self.jvm.java.lang.System.currentTimeMillis() - idle_ms, 0
        for table in {t for tables in whole for t in tables}:
            for f in self.files.listStatus(self._at(table)):
                name = f.getPath().getName()
                if name.startswith(f"{VERSION}=") and (table, name) not in named and f.getModificationTime() <= before:
                    self.files.delete(f.getPath(), True)
                    gone += 1
        return gone


def paused(log: Commits, runs: DataFrame, base: Snapshot | None = None) -> Snapshot:
    """Runs that wait for a human: in one commit each gets status and node hitl, a pending task with the judge's words, and a waiting node.

    runs: run_id, judge_score, is_sensitive, before_md and meta (JSON). The log's tables are
    runs (id, status, current_node, ...), tasks and nodes. Runs that the log doesn't have get a task all the
    same, as a reviewer's work must not be lost; a run that waits already gets none.
    """
    base = base or log.snapshot()
    known = log.read("runs", base)
    waiting = log.read("tasks", base).filter("status = 'pending'").select("run_id") if "tasks" in base.tables else None
    new = runs if waiting is None else runs.join(waiting, "run_id", "left_anti")
    new = new.dropDuplicates(["run_id"])
    hit = known.join(new.select(F.col("run_id").alias("id"), F.lit(True).alias("_hit")), "id", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    held = hit.withColumns({c: F.when(F.col("_hit"), "hitl").otherwise(F.col(c)) for c in ("status", "current_node")}).select(*known.columns)
    score = F.coalesce(F.col("judge_score").cast("double"), F.lit(0.0))
    priority = (10 - score) * F.when(F.col("is_sensitive"), 2.0).otherwise(1.0)
    tasks = new.select("run_id", F.lit("pending").alias("status"), F.lit("doc").alias("chunk_id"), "is_sensitive", score.alias("judge_score"), priority.alias("priority"), "before_md", "meta")
    nodes = new.select("run_id", F.lit("hitl").alias("node_name"), F.lit("waiting").alias("status"), F.to_json(F.struct(score.alias("judge_score"))).alias("input_ref"))
    return log.commit(base, append={"tasks": tasks, "nodes": nodes}, replace={"runs": held})


def session_committed(log: Commits, stitched: DataFrame, base: Snapshot | None = None) -> Snapshot:
    """Finished sessions: in one commit each gets its markdown as an artifact of its run, a run where it has none, and the status committed.

    stitched: session_id, markdown, pages_processed. The log's tables are sessions (session_id,
    run_id, status, filename), runs (id, status, current_node, doc_id, is_hitl_resume) and artifacts. A session
    without a stitched text, or that is committed already, stays as it is. New runs are numbered after the largest, by session.
    """
    base = base or log.snapshot()
    sessions, runs = log.read("sessions", base), log.read("runs", base)
    stitched = saver(log.spark, "stitched")(stitched, "texts")  # read three times below, stitched once
    ready = sessions.join(stitched.filter("markdown <> ''"), "session_id").filter("status <> 'committed'")
    started = ready.filter("run_id IS NULL").select(F.col("session_id").alias("_session"), F.lit("complete").alias("status"), F.lit("vlm_ingest").alias("current_node"), F.col("filename").alias("doc_id"), F.lit(True).alias("is_hitl_resume"))
    runs_after = appended(runs.withColumn("_session", F.lit(None).cast(sessions.schema["session_id"].dataType)), started, [F.col("_session")])
    own = runs_after.filter("_session IS NOT NULL").select(F.col("_session").alias("session_id"), F.col("id").alias("_new_run"))
    named = sessions.join(own, "session_id", "left").withColumn("run_id", F.coalesce("run_id", "_new_run")).drop("_new_run")
    refs = named.join(ready.select("session_id", "markdown", "pages_processed"), "session_id")
    path = F.concat(F.lit("runs/"), F.col("run_id").cast("string"), F.lit("/vlm_ingest/markdown.md"))
    refs = refs.select("run_id", "session_id", F.lit("vlm_ingest").alias("kind"), path.alias("path"), F.sha2("markdown", 256).alias("sha256"), F.length("markdown").alias("chars"), "pages_processed", "markdown")
    done = named.join(ready.select("session_id", F.lit(True).alias("_done")), "session_id", "left").withColumn("status", F.when(F.col("_done"), "committed").otherwise(F.col("status"))).select(*sessions.columns)
    return log.commit(base, append={"artifacts": refs}, replace={"runs": runs_after.drop("_session"), "sessions": done})


def rehydrated(sessions: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and pages as they go on after a restart: what was under way is pending or being configured again, a session with a stitched text is complete and counts its finished pages; an unknown status is the first one."""
    known = lambda c, kinds, first: F.when(F.col(c).isin(kinds), F.col(c)).otherwise(first)
    pages = pages.withColumn("status", known("status", ["done", "error", "skipped"], "pending"))
    done = pages.groupBy("session_id").agg(F.count_if(F.col("status") == "done").alias("pages_processed"))
    text = F.coalesce("stitched_markdown", F.lit("")) != ""
    status = F.when(text, "complete").otherwise(known("status", ["complete", "committed", "failed"], "configuring"))
    return sessions.join(done, "session_id", "left").withColumns({"status": status, "pages_processed": F.when(text, F.coalesce("pages_processed", F.lit(0)))}), pages
