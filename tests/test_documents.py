"""Stitching, layouts, configuration, sources and the chunk store on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from tarnfold import config
from tarnfold.functions import guardrails, rules
from tarnfold.operators import evaluation, layout, ledger, retrieval, stitching, workflow
from tarnfold.sources import files


def test_edges_of_pages():
    assert stitching.edge(["", "a", " b ", ""], 1) == ["a"] and stitching.edge(["", "a", " b ", ""], -1) == ["b"] and stitching.edge([], 3) == []
    assert stitching.joined_at("x\nfoot", "foot\nfoot\ny")[1:] == ("foot\ny", {"lines": 1, "tables": 0, "headings": 0})  # a line is matched once
    assert stitching.joined_at("x\nfoot", "\nfoot\ny")[1].strip() == "foot\ny"  # a blank line ends the search
    before, page, done = stitching.joined_at("| a |\n\n", "| b |\n\n| c |\nrest\n| d |")
    assert before == "| a |\n| b |\n\n| c |" and page == "rest\n| d |" and done["tables"] == 1
    assert stitching.joined_at("t\n# Same", "## Same\nmore")[1:] == ("more", {"lines": 0, "tables": 0, "headings": 1})


def test_stitching_documents(spark):
    rows = [(1, 2, "b\nend"), (1, 1, "a\nfoot"), (1, 3, "  "), (2, 5, "only"), (3, 1, None), (1, 4, "end\nc")]
    got = {r["doc_id"]: r for r in stitching.stitched(spark.createDataFrame(rows, "doc_id int, page_num int, markdown string").repartition(3)).collect()}
    assert got[1]["markdown"] == "<!-- page 1 -->\n\na\nfoot\n\n<!-- page 2 -->\n\nb\nend\n\n<!-- page 4 -->\n\nc\n"
    assert (got[1]["page_count"], got[1]["pages_processed"], got[1]["duplicate_lines_removed"]) == (4, 3, 1)
    assert got[2]["markdown"] == "<!-- page 5 -->\n\nonly\n" and got[3]["pages_processed"] == 0


def _boxes(spark, seed):
    rng = random.Random(seed)
    rows = []
    for page in range(12):
        for box in range(rng.randrange(1, 15)):
            x, y = rng.randrange(40), rng.randrange(40)
            rows.append((0, page, box, float(x), float(x + rng.randrange(1, 30)), float(y), float(y + rng.randrange(1, 30)), f"t{box}", float(rng.randrange(100)) + box / 100, rng.choice(["text", "text", "table"]), rng.randrange(2), rng.choice(["a", "a", None]), 20.0))
    return rows, spark.createDataFrame(rows, "doc_id int, page int, box int, x0 double, x1 double, top double, bottom double, text string, score double, kind string, column int, layoutno string, mean_height double").repartition(3)


def test_suppression(spark):
    rows, df = _boxes(spark, 1)
    want = set()
    for page in range(12):
        kept = []
        for r in sorted((r for r in rows if r[1] == page), key=lambda r: -r[8]):
            def union_share(a, b):
                w, h = max(0, min(a[4], b[4]) - max(a[3], b[3]) + 1), max(0, min(a[6], b[6]) - max(a[5], b[5]) + 1)
                return w * h / ((a[4] - a[3]) * (a[6] - a[5]) + (b[4] - b[3]) * (b[6] - b[5]) - w * h)

            if all(union_share(k, r) <= 0.5 for k in kept):
                kept.append(r)
        want |= {(page, r[2]) for r in kept}
    assert {(r["page"], r["box"]) for r in layout.suppressed(df).collect()} == want


def test_lines_merge(spark):
    rows, df = _boxes(spark, 2)
    want = []
    for page in range(12):
        out = []
        for r in sorted((list(r) for r in rows if r[1] == page), key=lambda r: (r[10], r[5], r[3], r[2])):
            a = out[-1] if out else None
            if a and a[10] == r[10] and a[11] and a[11] == r[11] and a[9] != "table" and abs(r[5] + r[6] - a[5] - a[6]) / 2 < 20 / 3:
                a[4], a[5], a[6], a[7] = r[4], (a[5] + r[5]) / 2, (a[6] + r[6]) / 2, a[7] + r[7]
            else:
                out.append(r)
        want += [(page, r[2], r[7], r[5]) for r in out]
    assert sorted((r["page"], r["box"], r["text"], r["top"]) for r in layout.merged_lines(df).collect()) == sorted(want)


def test_configuration():
    base = {"a": {"b": 1, "c": [1]}, "roles": {"embed": "e", "judge": "j"}, "profiles": {"fast": {"a": {"b": 2}, "roles": {"embed": "x", "judge": "k"}}}}
    got = config.with_profile(base, "fast")
    assert got["a"] == {"b": 2, "c": [1]} and got["roles"] == {"embed": "e", "judge": "k"} and base["a"]["b"] == 1
    with pytest.raises(ValueError):
        config.with_profile(base, "slow")
    assert config.stable_hash({"x": 1, "y": 2}) == config.stable_hash({"y": 2, "x": 1}) != config.stable_hash({"x": 2, "y": 1})
    assert config.profile_name({"default_profile": "d"}) == "d" and config.profile_name({}, "o", "e") == "o"
    assert config.merged_rules([{"name": "a", "n": 1}, {"name": "b"}], [{"name": "a", "n": 2}]) == [{"name": "b"}, {"name": "a", "n": 2}]
    with pytest.raises(ValueError):
        config.without_rule([{"name": "a"}], "b")


def test_what_is_wrong_with_rules():
    assert config.rule_errors(None) == [] and config.rule_errors([{"name": "a", "steps": ["fix_bullets", {"kind": "rewrite_pattern", "pattern": "x"}]}]) == []
    said = config.rule_errors([3, {"name": "b b", "match": {"who": 1}, "steps": [{"kind": "nope"}, {"kind": "strip_lines_matching", "pattern": "("}, 7], "tags": "t"}, {"steps": []}])
    for part in ("cleanup_rules[0]: must be a mapping", "'name' must be alphanumeric", "unknown keys ['who']", "unknown kind 'nope'", "invalid regex '('", "steps[2]: must be a string or mapping", "'tags' must be a list", "cleanup_rules[2]: 'name' is required", "cleanup_rules[2]: 'steps' is required"):
        assert any(part in s for s in said), part
    assert config.toggle_errors({"html_unescape": 1, "table_span_min_chars": "x", "repeated_heading_scope": "all", "unknown": 5}) and config.toggle_errors({"html_unescape": False}) == []


def test_configuration_versions(spark):
    v = spark.createDataFrame([], config.VERSIONS)
    assert config.effective(v, {"d": 1}) == {"d": 1}
    v = config.versioned(config.versioned(v, "one", {"a": 1}, {"b": 2}), "two", {"a": 1}, {"b": 3}).cache()
    assert config.effective(v, {}) == {"a": 1, "b": 3} and v.filter("is_active").count() == 1
    assert config.effective(config.activated(v, 1), {}) == {"a": 1, "b": 2}


@pytest.mark.parametrize(("glob", "name", "fits"), [("*.md", "a.md", True), ("*.md", "a.mdx", False), ("r?port_[0-9].txt", "report_7.txt", True), ("[!a]*", "abc", False), ("a[]b", "a[]b", True), ("a.b", "axb", False), ("x[^y]", "x^", True)])
def test_globs(spark, glob, name, fits):
    assert spark.range(1).select(F.lit(name).rlike(rules.glob_pattern(glob))).first()[0] is fits


def test_artifacts_of_models(spark):
    cases = {
        "```md\n# T\n```": "# T", "Here is the document:\n\n# T\ntext": "# T\ntext", "# T\n\nFeel free to ask\n\n": "# T", "# T\n## Changes log\n- x\n## Real\ny": "# T\n## Real\ny", "plain": "plain", " ": " ",
        "Certainly! ok\nkeep\nSure, not at the start": "keep\nSure, not at the start",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", guardrails.strip_artifacts(F.col("t")).alias("s"))
    assert {r["t"]: r["s"] for r in df.collect()} == cases


def test_files_of_expectations(spark, tmp_path):
    (tmp_path / "a.pdf.expected.txt").write_text("# note\n\n one \ntwo\n")
    (tmp_path / "g.json").write_text('{"cases": [{"id": "q1", "query": "x", "expected_doc_ids": ["d1", "d2"]}, {"query": "y", "expected_doc_ids": ["d3"]}]}')
    assert sorted(map(tuple, files.read_expectations(spark, f"file://{tmp_path}").collect())) == [("a.pdf", "one"), ("a.pdf", "two")]
    assert sorted(map(tuple, files.read_golden_set(spark, f"file://{tmp_path}/g.json").collect())) == [("1", "y", "d3"), ("q1", "x", "d1"), ("q1", "x", "d2")]
    (tmp_path / "bad.json").write_text('{"cases": [{"query": " ", "expected_doc_ids": []}]}')
    with pytest.raises(Exception, match="a case needs"):
        files.read_golden_set(spark, f"file://{tmp_path}/bad.json").collect()


def test_html_keeps_structure(spark):
    page = "<html><head><title>t</title></head><body><h1>A &amp; B</h1><p>one<br>two</p><ul><li>x</li><li>y</li></ul><script>z</script></body></html>"
    assert spark.range(1).select(files.html_to_markdown(F.lit(page))).first()[0] == "# A & B\n\none\n\ntwo\n\n- x\n- y"


def test_searches_in_passes_give_the_same_hits(spark, monkeypatch):
    rng = random.Random(4)
    points = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)], "id long, vector array<double>").repartition(3).cache()
    asked = points.filter("id % 3 = 0").withColumnRenamed("id", "query_id")
    whole = sorted(map(tuple, retrieval.search(points, asked, 5).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 500)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    assert len(whole) == 200 and sorted(map(tuple, retrieval.search(points, asked, 5).collect())) == whole
    assert retrieval.search(points, asked.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        retrieval.search_predicate("t", "p", fidelity="some")


def test_workflow_spends_retries(spark, tmp_path):
    calls = []

    def save(df, name):
        calls.append(name)
        df.write.parquet(f"file://{tmp_path}/{name}")
        return spark.read.schema(df.schema).parquet(f"file://{tmp_path}/{name}")

    # A refiner that always cuts too much: its attempts are refused, and only twice the retries end them.
    provider = workflow.Provider(judge=lambda t: F.when(F.length(t) > 0, 3).otherwise(3), refine=lambda t: F.left(t, F.lit(2)))
    got = workflow.run(spark.createDataFrame([(1, "some long text")], "doc_id int, text string"), save, provider=provider).first()
    assert (got["current_node"], got["attempts"], got["retries"], got["markdown"]) == ("hitl", 4, 1, "some long text") and len(calls) == 5


def test_task_moves(spark):
    events = [(1, 1, "completed"), (1, 2, "in_progress"), (1, 3, "in_progress"), (1, 4, "completed"), (2, 1, "skipped"), (2, 2, "in_progress"), (3, 5, "unknown")]
    got = {tuple(r) for r in ledger.task_states(spark.createDataFrame(events, "id int, at int, to string")).collect()}
    assert got == {(1, "completed", 2), (2, "skipped", 1), (3, "pending", 1)}


def test_expected_strings_are_met_sign_by_sign(spark):
    docs = spark.createDataFrame([(1, "Die ErßPf\n\tΑΣ\u00a0İx.")], "document int, markdown string")
    wanted = spark.createDataFrame([(1, w) for w in ("die erßpf ας", "erßpf ΑΣ", "pf ασ\u00a0ix. ", "erssp", "ασ ix")], "document int, w string")
    got = evaluation.check_expectations(docs, wanted.select("document", evaluation.raised(F.col("w")).alias("wanted"))).first()
    assert (got["expected_total"], got["expected_found"], got["missing"]) == (5, 3, ["ERSSP", "ΑΣ IX"])
