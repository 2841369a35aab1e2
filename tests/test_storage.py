"""Commits over several tables, recovery, metrics of jobs, nested exports and folders of files."""

import json

import pytest
from pyspark.sql import functions as F

from tarnfold.operators import artifacts, packages, retrieval
from tarnfold.operators.commits import Commits, Conflict, paused
from tarnfold.operators.diagnostics import Diagnostics
from tarnfold.operators.store import ChunkStore
from tarnfold.plans import chunk_queries
from tarnfold.sources import parsers

RUN = "id long, status string, current_node string"
ASKED = "run_id long, judge_score double, is_sensitive boolean, before_md string, meta string"


@pytest.fixture
def log(spark, tmp_path):
    out = Commits(spark, f"file://{tmp_path}/log")
    out.commit(out.snapshot(), replace={"runs": spark.createDataFrame([(1, "running", "judge"), (2, "running", "refine"), (3, "completed", "completed")], RUN)})
    return out


def state(log, at=None):
    at = at or log.snapshot()
    return {name: sorted(map(repr, map(tuple, log.read(name, at).collect()))) for name in sorted(at.tables)}


def test_a_commit_that_fails_between_its_tables_changes_none(spark, log, monkeypatch):
    before, asked = state(log), spark.createDataFrame([(1, 2.0, True, "text", "{}")], ASKED)
    whole = Commits._write
    for fails_at in ("tasks", "nodes", "runs"):
        def write(self, table, rows, by, fails_at=fails_at):
            out = whole(self, table, rows, by)  # the folder is there, and nothing names it
            if table == fails_at:
                raise OSError("lost")
            return out

        monkeypatch.setattr(Commits, "_write", write)
        with pytest.raises(OSError, match="lost"):
            paused(log, asked)
        monkeypatch.setattr(Commits, "_write", whole)
        assert state(log) == before
    paused(log, asked)
    after = state(log)
    assert "(1, 'hitl', 'hitl')" in after["runs"] and len(after["tasks"]) == len(after["nodes"]) == 1 and "16.0" in after["tasks"][0]
    assert state(log, log.snapshot(1)) == before  # older snapshots stay readable
    paused(log, asked)
    assert state(log) == after  # a run that waits isn't asked for again


def test_records_that_were_cut_short_are_passed_over(spark, log, tmp_path):
    before = state(log)
    (tmp_path / "log" / "records" / "2.json").write_text('{"runs": {"schema"')
    assert state(log) == before and log.snapshot().number == 1
    after = log.commit(log.snapshot(), append={"runs": spark.createDataFrame([(9, "running", None)], RUN)})
    assert after.number == 3 and log.snapshot().number == 3 and len(state(log)["runs"]) == 4


def test_vacuum_keeps_what_is_named_and_what_is_new(spark, log):
    row = spark.createDataFrame([(9, "running", None)], RUN)
    log.commit(log.snapshot(), append={"runs": row})
    log.commit(log.snapshot(), replace={"runs": row})
    log._write("runs", row, None)  # a writer that stopped
    before = state(log)
    assert log.vacuum(keep=1) == 0 and log.vacuum(keep=2, idle_ms=-1) == 1
    assert state(log) == before and len(state(log, log.snapshot(2))["runs"]) == 4
    assert log.vacuum(keep=1, idle_ms=-1) == 2 and state(log) == before


def test_of_two_writers_from_one_snapshot_the_second_is_told(spark, log):
    base, row = log.snapshot(), spark.createDataFrame([(9, "running", None)], RUN)
    log.commit(base, append={"runs": row})
    with pytest.raises(Conflict):
        log.commit(base, append={"runs": row})
    log.commit(log.snapshot(), append={"runs": row})
    assert len(state(log)["runs"]) == 5


def test_a_change_rewrites_only_the_partitions_that_it_touches(spark, tmp_path):
    schema = "tenant_id string, project_id string, corpus_id string, doc_id string, doc_version string, id string, note string, is_active_version boolean, vector array<float>"
    row = lambda t, n: (t, "p", "c", f"d{n}", "v1", f"{t}{n}", None, True, [1.0, 0.0])
    store = ChunkStore(spark, f"file://{tmp_path}/store", 2)
    store.commit(spark.createDataFrame([row(t, n) for t in ("a b", "007", "x=y", None) for n in range(3)], schema))
    folders = lambda: {f.rpartition("/")[2]: f for f in store.log.snapshot().tables["points"]["folders"]}
    first = folders()
    assert len(first) == 4 and sorted(str(r["tenant_id"]) for r in store.read().collect()) == sorted(["a b", "007", "x=y", "None"] * 3)
    store.set_payload((F.col("tenant_id") == "a b") & (F.col("doc_id") == "d1"), note="seen")
    second = folders()
    assert {k for k in first if first[k] == second[k]} == {k for k in first if "a" not in k.split("=", 1)[1][:1]} and store.read().filter("note = 'seen'").count() == 1
    store.delete(F.col("tenant_id").isNull())
    assert store.read().count() == 9 and len(folders()) == 3
    store.commit(spark.createDataFrame([("007", "p", "c", "d1", "v1", "new", None, True, [0.0, 1.0]), row("z", 1)], schema))
    assert sorted(r["id"] for r in store.read().filter("tenant_id IN ('007', 'z')").collect()) == ["0070", "0072", "new", "z1"] and folders()["tenant_id=a b"] == second["tenant_id=a b"]
    assert "PartitionFilters: [isnotnull(tenant_id" in store.read().filter("tenant_id = 'z'")._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="vectors have 2 numbers"):
        store.commit(spark.createDataFrame([("z", "p", "c", "d2", "v1", "bad", None, True, [1.0])], schema))
    assert store.read().filter("tenant_id = 'z'").count() == 1


def test_metrics_come_from_the_job_itself(spark, tmp_path):
    kept = Diagnostics(spark, f"file://{tmp_path}/metrics")
    df = spark.range(100).withColumn("odd", F.col("id") % 2 == 1)
    out = kept.written("split", df, f"file://{tmp_path}/out", {"rows": F.count("*"), "odd": F.count_if("odd"), "none": F.max(F.lit(None).cast("int"))}, source="range")
    assert out.count() == 100
    with pytest.raises(ZeroDivisionError), kept.operation("fails") as held:
        held["done"] = 3
        held["done"] /= 0
    for i in range(3):
        with kept.operation("again") as held:
            held["i"] = i
    got = {r["operation"]: r for r in kept.latest(1).collect()}
    assert got["split"]["metrics"] == {"rows": 100.0, "odd": 50.0} and got["split"]["notes"] == {"source": "range"} and got["split"]["success"]
    assert (got["fails"]["success"], got["fails"]["error"], got["fails"]["metrics"]) == (False, "ZeroDivisionError", {"done": 3.0})
    assert [r["metrics"]["i"] for r in kept.latest(2).filter("operation = 'again'").orderBy("nth").collect()] == [2.0, 1.0]
    assert {r["operation"]: (r["runs"], r["failed"]) for r in kept.summary().collect()} == {"split": (1, 0), "fails": (1, 1), "again": (3, 0)}


def test_a_folder_of_mixed_files_is_a_table(spark, tmp_path):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    files = {"a.md": "﻿# T\n".encode(), "b.HTML": b"<p>x <b>y</b></p>\n<i>z</i>", "c.txt": b"\xff\xfe bad", "d.pdf": b"%PDF", "e": b"?", "f.txt": b"", "_skipped.txt": b"x", "g.csv": b"1,2"}
    for name, content in files.items():
        (folder / name).write_bytes(content)
    parsers.register(spark)
    got = {r["filename"]: r for r in spark.read.format("tarnfold_folder").option("bytesPerPartition", 10).load(f"file://{tmp_path}/in").collect()}
    assert set(got) == set(files) - {"_skipped.txt"}
    assert (got["a.md"]["markdown"], got["b.HTML"]["markdown"], got["f.txt"]["markdown"]) == ("# T\n", "x y z\n", "")
    assert got["c.txt"]["error_code"] == "PARSE_FAILED" and "UnicodeDecodeError" in got["c.txt"]["error"] and got["c.txt"]["markdown"] is None
    assert [got[n]["error_code"] for n in ("d.pdf", "e", "g.csv")] == ["CONVERTER_MISSING", "INVALID_MIME_TYPE", "INVALID_MIME_TYPE"]
    assert spark.read.format("tarnfold_folder").option("mostBytes", 5).load(str(folder)).filter("error_code = 'FILE_TOO_LARGE'").count() == 3
    assert spark.read.format("tarnfold_folder").option("chain", "html").load(str(folder)).filter("parser IS NOT NULL").count() == 1
    reader = parsers.FolderSource({"path": str(folder), "bytesPerPartition": "10"}).reader(None)
    assert sum(len(p.paths) for p in reader.partitions()) == 7 and len(reader.partitions()) > 3
    with pytest.raises(Exception, match="no parser"):
        spark.read.format("tarnfold_folder").option("chain", "odd").load(str(folder)).collect()


def test_the_source_gives_what_columns_give(spark, tmp_path):
    """The rows of sources_by_type, from files instead of a table."""
    from tarnfold.plans import corpus_queries

    sf = "/root/testdata/sf0.001"
    ext = {0: "txt", 1: "md", 2: "html", 3: "pdf", 4: "doc", 5: "png"}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        (tmp_path / f"{r['doc_id']}.{ext[r['doc_id'] % 6]}").write_text(r["text"], newline="")
    parsers.register(spark)
    rows = spark.read.format("tarnfold_folder").load(str(tmp_path)).withColumn("doc_id", F.substring_index("filename", ".", 1).cast("long"))
    want = corpus_queries.QUERIES["sources_by_type"](spark, sf).withColumns({"error_code": F.when(F.col("profile") == "converted", "CONVERTER_MISSING").otherwise(F.col("error_code")), "digest": F.when(F.col("profile") != "converted", F.col("digest"))})
    got = rows.select("doc_id", "profile", "error_code", F.sha2("markdown", 256).alias("digest"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_exports_tell_when_files_are_missing(spark, tmp_path):
    rows = [(t, "p", c, f"d/{n}", "v1", f"text {n}\n---", 1) for t in ("a", "007") for c in ("x", None) for n in range(4)]
    docs = spark.createDataFrame(rows, "tenant_id string, project_id string, corpus_id string, doc_id string, doc_version string, markdown string, chunks long")
    path = f"file://{tmp_path}/export"
    packages.export_scopes(docs, path, ["doc_id"])
    got = packages.read_exported(spark, path)
    assert got.count() == 16 and {r["file"] for r in got.collect()} == {f"d_{n}_v1.md" for n in range(4)} and got.filter("tenant_id = '007' AND corpus_id IS NULL").count() == 4
    assert got.filter("doc_id = 'd/2'").first()["content"] == '---\ndoc_id: "d/2"\n---\n\ntext 2\n---'
    assert packages.verified_export(spark, path).count() == 0
    gone = next(p for p in (tmp_path / "export" / "documents").rglob("*.json") if "tenant_id=a" in str(p) and "corpus_id=x" in str(p))
    gone.rename(tmp_path / "gone.json")
    lost = json.loads("[" + ",".join((tmp_path / "gone.json").read_text().split("\n")[:-1]) + "]")
    assert [(r["tenant_id"], r["listed"], r["found"] or 0) for r in packages.verified_export(spark, path).collect()] == [("a", 4, 4 - len(lost))]


def test_chunkers_run_once(spark):
    for name in ("semantic_chunks", "paragraph_chunks", "hierarchical_chunks"):
        plan = chunk_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython [") == 1, name


def test_search_in_several_passes_and_unusable_vectors(spark, monkeypatch):
    rows = [(i, [float(i % 7) - 3, float(i % 5), 1.0]) for i in range(60)] + [(60, None), (61, [1.0, None, 0.0]), (62, [float("nan"), 0.0, 1.0])]
    points = spark.createDataFrame(rows, "id long, vector array<float>")
    asked = points.filter("id % 10 = 0 OR id > 59").withColumnRenamed("id", "query_id")
    one = sorted(map(tuple, retrieval.search(points, asked, 3).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 64)
    assert sorted(map(tuple, retrieval.search(points, asked, 3).collect())) == one and len(one) == 18


def test_rows_are_numbered_on_when_ranges_are_sampled(spark):
    conf = {"spark.sql.execution.rangeExchange.sampleSizePerPartition": "5", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    held = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        new = spark.range(20000).select((F.col("id") * 7919 % 20011).alias("at"), F.concat(F.lit("new "), "id").alias("status"))
        got = artifacts.appended(spark.range(10).select("id", F.lit("old").alias("status"), F.lit(-1).cast("long").alias("at")), new, [F.col("at")]).filter("status LIKE 'new %'").orderBy("id").collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert [r["id"] for r in got] == list(range(10, 20010)) and [r["at"] for r in got] == sorted(i * 7919 % 20011 for i in range(20000))
