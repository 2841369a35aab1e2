from pyspark.sql import functions as F

from tarnfold.sources import files


def test_files_by_kind(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# T\n\nx")
    (tmp_path / "sub" / "b.html").write_text("<html><head><title>t</title></head><body><p>one &amp; <b>two</b></p><p>three</p></body></html>")
    got = {r["filename"]: r for r in files.read_text_files(spark, f"file://{tmp_path}").collect()}
    assert got["a.md"]["kind"] == "markdown" and got["a.md"]["text"] == "# T\n\nx"
    assert got["b.html"]["kind"] == "html"
    text = spark.createDataFrame([(got["b.html"]["text"],)], "h string").select(files.html_to_text(F.col("h"))).first()[0]
    assert text == "one & two\nthree"


def test_ingesting_twice_leaves_one(spark, tmp_path):
    rows = spark.createDataFrame([("t1", "c1", 1, "old"), ("t2", "c1", 1, "other")], "tenant_id string, chunk_id string, doc_version int, text string")
    newer = spark.createDataFrame([("t1", "c1", 2, "new")], rows.schema)
    for part in (rows, newer, newer):
        files.append_chunks(part, f"file://{tmp_path}/chunks")
    got = files.read_chunks(spark, f"file://{tmp_path}/chunks", "t1").select("chunk_id", "text").collect()
    assert [tuple(r) for r in got] == [("c1", "new")]
