"""Configurations of many scopes: what is missing, unknown or malformed."""

import pytest
from pyspark.sql import functions as F

from tarnfold.operators import configuration as C


def test_merging_hashing_and_profiles_of_rows(spark):
    rows = spark.createDataFrame([(1, '{"a":{"x":1}}', '{"a":{"y":2}}'), (2, None, '{"b":1}'), (3, '{"b": 1}', None), (4, None, None)], "id int, base string, patch string")
    got = {r["id"]: r for r in rows.select("id", C.merged(F.col("base"), F.col("patch")).alias("m"), C.hashed(C.merged(F.col("base"), F.col("patch"))).alias("h")).collect()}
    assert got[1]["m"] == '{"a": {"x": 1, "y": 2}}' and got[4]["m"] is None and got[4]["h"] is None and got[2]["h"] == got[3]["h"] != got[1]["h"]
    text = F.lit('{"k":1,"profiles":{"p":{"k":2}}}')
    out = spark.range(1).select(*[C.with_profile(text, F.lit(o).cast("string"), F.lit(e).cast("string")).alias(f"c{n}") for n, (o, e) in enumerate([(None, None), ("p", None), (None, "p"), ("no", "p")])]).first()
    assert [None if c is None else c[: c.index(",")] for c in out] == ['{"k":1', '{"k": 2', '{"k": 2', None]


def test_versions_of_a_scope_without_any(spark):
    versions = spark.createDataFrame([("a", 4, "v", True, '{"n":1}'), ("a", 7, "v", False, '{"n":2}')], "scope string, id long, name string, is_active boolean, payload string")
    new = spark.createDataFrame([("a", "n", '{"m":1}', True), ("b", "n", '{"m":2}', False)], "scope string, name string, patch string, activate boolean")
    got = {(r["scope"], r["id"]): (r["is_active"], r["payload"]) for r in C.versions_created(versions, new, ["scope"]).collect()}
    assert got == {("a", 4): (False, '{"n":1}'), ("a", 7): (False, '{"n":2}'), ("a", 8): (True, '{"n": 1, "m": 1}'), ("b", 1): (False, '{"m": 2}')}


def test_rules_of_configurations_without_rules(spark):
    configs = spark.createDataFrame([(1, '{"cleanup_rules":[{"name":"x"},{"name":"y"}]}'), (2, "{}"), (3, None)], "scope int, config string")
    rules = C.rules_of(configs, ["scope"])
    assert sorted(map(tuple, rules.select("scope", "nth", "name").collect())) == [(1, 1, "x"), (1, 2, "y")]
    left, outcome = C.rules_removed(rules, spark.createDataFrame([(1, "x"), (2, "x")], "scope int, name string"), ["scope"])
    assert [(r["nth"], r["name"]) for r in left.collect()] == [(1, "y")] and sorted(map(tuple, outcome.collect())) == [(1, "x", "removed"), (2, "x", "unknown")]


def test_yaml_that_is_written_is_read(spark):
    yaml = pytest.importorskip("yaml")
    rules = spark.createDataFrame([(1, 2, "b", '{"name":"b"}'), (1, 1, "a", '{"name":"a","steps":["x: y"]}')], "scope int, nth int, name string, rule string")
    text = C.rules_as_yaml(rules, ["scope"]).first()["yaml"]
    assert yaml.safe_load(text) == {"cleanup_rules": [{"name": "a", "rule": {"name": "a", "steps": ["x: y"]}}, {"name": "b", "rule": {"name": "b"}}]}
    assert C.read_yaml(text) == yaml.safe_load(text) and C.read_yaml('{"a": 1}') == {"a": 1}
    with pytest.raises(ValueError, match="mapping"):
        C.read_yaml("- 1")
