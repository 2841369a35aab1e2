"""Queries over configurations of many scopes, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tarnfold.operators import configuration as C
from tarnfold.plans.text_queries import NL
from tarnfold.session import shared_dir, table
from tarnfold.sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return put


_BASE = """concat('{"b":"', source, '","a":{"y":[1,2],"x":', CAST(doc_id % 3 AS STRING), '}}')"""
_PATCH = """CASE doc_id % 4 WHEN 0 THEN '{"a":{"y":[3]}}' WHEN 1 THEN '{"a":5}' WHEN 2 THEN concat('{"c":{"n":', CAST(doc_id AS STRING), '},"a":{"x":null}}') END"""


@query("config_merged", """SELECT doc_id, sha256(CASE doc_id % 4 WHEN 0 THEN concat('{"a":{"x":', doc_id % 3, ',"y":[3]},"b":"', source, '"}') WHEN 1 THEN concat('{"a":5,"b":"', source, '"}') WHEN 2 THEN concat('{"a":{"x":null,"y":[1,2]},"b":"', source, '","c":{"n":', doc_id, '}}')
ELSE concat('{"a":{"x":', doc_id % 3, ',"y":[1,2]},"b":"', source, '"}') END) AS config_hash FROM documents""")
def config_merged(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_BASE).alias("base"), F.expr(_PATCH).alias("patch"))
    return docs.select("doc_id", C.hashed(C.merged(F.col("base"), F.col("patch"))).alias("config_hash"))


@query("config_profiles", """WITH p AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'fast' WHEN doc_id % 5 = 1 THEN 'none' WHEN doc_id % 3 = 0 THEN 'local' WHEN doc_id % 2 = 0 THEN 'fast' END AS profile FROM documents)
SELECT doc_id, CASE profile WHEN 'none' THEN NULL WHEN 'fast' THEN 'm-fast' WHEN 'local' THEN 'm-1' ELSE 'm-1' END AS judge, CASE WHEN profile = 'none' THEN NULL ELSE 'e-1' END AS embed, CASE WHEN profile = 'local' THEN 'http://here' END AS endpoint FROM p""")
def config_profiles(spark, sf_dir):
    """Profiles asked for, of the environment and by default; the embedding role stays whatever they say."""
    profiles = '"profiles":{"fast":{"roles":{"judge":"m-fast","embed":"e-9"}},"local":{"endpoint":"http://here","roles":{"embed":"e-0"}}}'
    default = F.when(F.col("doc_id") % 2 == 0, F.lit(',"default_profile":"fast"')).otherwise(F.lit(""))
    text = F.concat(F.lit('{"roles":{"judge":"m-1","embed":"e-1"},'), F.lit(profiles), default, F.lit("}"))
    asked, env = F.expr("CASE doc_id % 5 WHEN 0 THEN 'fast' WHEN 1 THEN 'none' END"), F.expr("CASE WHEN doc_id % 3 = 0 THEN 'local' END")
    out = table(spark, sf_dir, "documents").select("doc_id", C.with_profile(text, asked, env).alias("config"))
    return out.select("doc_id", *[F.get_json_object("config", f"$.{p}").alias(n) for n, p in (("judge", "roles.judge"), ("embed", "roles.embed"), ("endpoint", "endpoint"))])


# Orders are versions of their customer's configuration; the largest id of some customers is active.
_VERSIONS = """v AS (SELECT o_custkey AS scope, o_orderkey AS id, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AND o_custkey % 3 <> 0 AS is_active, o_orderstatus AS status FROM orders)"""


def _versions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    last = rows.groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"))
    return rows.join(last, "o_custkey").select(
        F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("id"), F.lit("v").alias("name"), ((F.col("o_orderkey") == F.col("last")) & (F.col("o_custkey") % 3 != 0)).alias("is_active"), F.concat(F.lit('{"status":"'), "o_orderstatus", F.lit('","n":1}')).alias("payload")
    )


@query("config_versions", f"""WITH {_VERSIONS}, n AS (SELECT c_custkey AS scope, coalesce(max(id), 0) + 1 AS id, 'new' AS name, c_custkey % 2 = 0 AS is_active, max(CASE WHEN is_active THEN status END) AS status, 2 AS n FROM customer LEFT JOIN v ON v.scope = c_custkey GROUP BY c_custkey),
a AS (SELECT scope, id, 'v' AS name, is_active AND scope % 2 = 1 AS is_active, status, 1 AS n FROM v UNION ALL FROM n) SELECT scope, id, name, is_active, status, n, CAST(row_number() OVER (PARTITION BY scope ORDER BY id DESC) AS INT) AS place FROM a""")
def config_versions(spark, sf_dir):
    """A new version for every customer, active for every second one."""
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scope"), F.lit("new").alias("name"), F.lit('{"n":2}').alias("patch"), (F.col("c_custkey") % 2 == 0).alias("activate"))
    out = C.listed(C.versions_created(_versions(spark, sf_dir), new, ["scope"]), ["scope"])
    return out.select("scope", "id", "name", "is_active", F.get_json_object("payload", "$.status").alias("status"), F.get_json_object("payload", "$.n").cast("int").alias("n"), "place")


@query("config_effective", f"""WITH {_VERSIONS}, f AS (SELECT scope, min(id) AS first FROM v WHERE scope % 4 = 0 GROUP BY scope), w AS (SELECT v.*, CASE WHEN first IS NULL THEN is_active ELSE id = first END AS now FROM v LEFT JOIN f USING (scope)) SELECT c_custkey AS scope, coalesce(max(status) FILTER (WHERE now), 'default') AS status FROM customer LEFT JOIN w ON w.scope = c_custkey GROUP BY c_custkey""")
def config_effective(spark, sf_dir):
    """Every fourth customer goes back to the first version, some choose one that there isn't; what holds then."""
    versions = _versions(spark, sf_dir)
    chosen = versions.filter("scope % 4 = 0").groupBy("scope").agg(F.min("id").alias("id"))
    wrong = versions.filter("scope % 4 = 1").select("scope", F.lit(-1).cast("long").alias("id")).distinct()
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scope"))
    out = C.effective(customers, C.activated(versions, chosen.unionByName(wrong), ["scope"]), ["scope"], F.lit('{"status":"default"}'))
    return out.select("scope", F.get_json_object("config", "$.status").alias("status"))


# Suppliers' parts are rules of the part's scope, by name.
_RULES = "r AS (SELECT p_partkey % 40 AS scope, p_partkey AS part, concat('r', p_partkey // 40 % 5) AS name FROM part), o AS (SELECT scope, name, CAST(row_number() OVER (PARTITION BY scope ORDER BY part) AS INT) AS nth FROM r)"


def _rules(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("scope"), F.col("p_partkey").alias("at"), F.expr("concat('r', CAST(p_partkey DIV 40 % 5 AS STRING))").alias("name"))
    items = F.transform(F.sort_array(F.collect_list(F.struct("at", "name"))), lambda r: F.concat(F.lit('{"name":"'), r["name"], F.lit('","steps":["fix_bullets"]}')))
    return C.rules_of(parts.groupBy("scope").agg(F.concat(F.lit('{"cleanup_rules":['), F.array_join(items, ","), F.lit("]}")).alias("config")), ["scope"])


@query("config_rules_merged", f"WITH {_RULES}, n AS (SELECT DISTINCT scope, concat('r', scope % 7) AS name FROM r), k AS (SELECT scope, name, 0 AS new, nth FROM o WHERE (scope, name) NOT IN (FROM n) UNION ALL SELECT scope, name, 1, 1 FROM n) SELECT scope, name, CAST(row_number() OVER (PARTITION BY scope ORDER BY new, nth) AS INT) AS nth, new = 1 AS changed FROM k")
def config_rules_merged(spark, sf_dir):
    rules = _rules(spark, sf_dir)
    new = rules.select("scope").distinct().select("scope", F.lit(1).alias("nth"), F.expr("concat('r', CAST(scope % 7 AS STRING))").alias("name"), F.lit('{"changed":true}').alias("rule"))
    return C.rules_merged(rules, new, ["scope"]).select("scope", "name", "nth", F.coalesce(F.get_json_object("rule", "$.changed") == "true", F.lit(False)).alias("changed"))


@query("config_rules_removed", f"WITH {_RULES}, g AS (SELECT DISTINCT scope, concat('r', scope % 7) AS name FROM r), k AS (SELECT scope, count(*) AS n FROM o WHERE (scope, name) NOT IN (FROM g) GROUP BY scope) SELECT g.scope, g.name, CASE WHEN (g.scope, g.name) IN (SELECT scope, name FROM o) THEN 'removed' ELSE 'unknown' END AS outcome, coalesce(n, 0) AS left_over FROM g LEFT JOIN k USING (scope)")
def config_rules_removed(spark, sf_dir):
    rules = _rules(spark, sf_dir)
    names = rules.select("scope", F.expr("concat('r', CAST(scope % 7 AS STRING))").alias("name")).distinct()
    kept, outcome = C.rules_removed(rules, names, ["scope"])
    return outcome.join(kept.groupBy("scope").agg(F.max("nth").cast("long").alias("left_over")), "scope", "left").withColumn("left_over", F.coalesce("left_over", F.lit(0)))


@query("config_rules_yaml", f"""WITH {_RULES} SELECT scope, sha256(concat('cleanup_rules:', {NL}, string_agg(concat('- name: ', name, {NL}, '  rule: {{"name":"', name, '","steps":["fix_bullets"]}}', {NL}), '' ORDER BY nth))) AS digest FROM o GROUP BY scope""")
def config_rules_yaml(spark, sf_dir):
    return C.rules_as_yaml(_rules(spark, sf_dir), ["scope"]).select("scope", F.sha2("yaml", 256).alias("digest"))


_RULE = """CASE doc_id % 8 WHEN 0 THEN '[]' WHEN 1 THEN '{}' WHEN 2 THEN '[1]' WHEN 3 THEN '[{"steps":["fix_bullets"]}]' WHEN 4 THEN '[{"name":"a b","steps":["fix_bullets"]}]' WHEN 5 THEN '[{"name":"a","steps":[]}]' WHEN 6 THEN '[{"name":"a","steps":["fix_bullets"],"match":{"odd":1}}]' ELSE '[{"name":"a","steps":[{"kind":"rewrite_pattern","pattern":"a"}]}]' END"""
_TOGGLE = """CASE doc_id % 3 WHEN 0 THEN '{"fix_ligatures":"yes"}' WHEN 1 THEN '{"repetitive_line_threshold":3,"odd":1}' ELSE '{"repeated_heading_scope":"all"}' END"""


@query("config_checked", """SELECT doc_id, CASE doc_id % 8 WHEN 1 THEN 'cleanup_rules must be a list' WHEN 2 THEN 'cleanup_rules[0]: must be a mapping' WHEN 3 THEN 'cleanup_rules[0]: ''name'' is required and must be a non-empty string' WHEN 4 THEN 'cleanup_rules[0]: ''name'' must be alphanumeric/underscore/hyphen (got ''a b'')'
WHEN 5 THEN 'cleanup_rules[0]: ''steps'' is required and must be a non-empty list' WHEN 6 THEN 'cleanup_rules[0].match: unknown keys [''odd'']' ELSE '' END AS rules, CASE doc_id % 3 WHEN 0 THEN 'builtin_cleanup.fix_ligatures must be a boolean (got str)' WHEN 1 THEN '' ELSE 'builtin_cleanup.repeated_heading_scope must be one of [''any'', ''title''] (got ''all'')' END AS toggles FROM documents""")
def config_checked(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_RULE).alias("rules"), F.expr(_TOGGLE).alias("section"))
    return docs.select("doc_id", F.array_join(C.rule_errors(F.col("rules")), "; ").alias("rules"), F.array_join(C.toggle_errors(F.col("section")), "; ").alias("toggles"))


@query("golden_cases", "WITH n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents) SELECT CASE WHEN doc_id % 2 = 0 THEN concat('c', doc_id) ELSE CAST(n AS VARCHAR) END AS case_id, sha256(text) AS query_hash, concat('d', doc_id + k) AS id FROM n, (SELECT unnest([0, 1]) AS k)")
def golden_cases(spark, sf_dir):
    """Golden sets of a case a document, a folder a source, written and read again; cases without an id go by their place. A document without text is a case all the same."""
    path = f"{shared_dir(spark)}/tarnfold-golden-{uuid.uuid4().hex}"
    ids = F.array(F.concat_ws("", F.lit("d"), F.col("doc_id").cast("string")), F.concat_ws("", F.lit("d"), (F.col("doc_id") + 1).cast("string")))
    case = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("c"), "doc_id"))
    cases = table(spark, sf_dir, "documents").select("source", "doc_id", case.alias("id"), F.col("text").alias("query"), ids.alias("expected_doc_ids"))
    files.write_golden_sets(cases, path, [F.col("doc_id").asc_nulls_last()])
    return files.read_golden_set(spark, path, lines=True, blank=True).select("case_id", F.sha2("query", 256).alias("query_hash"), "id")
