"""Configurations of many scopes as rows: merged, overlaid by profiles, hashed, checked, versioned, and their clean-up rules by name.

A configuration is a JSON text. What a single one means is `tarnfold.config`; here it is
applied a batch of rows at a time, and what compares rows is a join or a window.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tarnfold import config

RULE = ["nth", "name", "rule"]


def _by_row(change: Callable, returns=StringType()):
    """A UDF of JSON texts; a row with a null among them gives null."""

    @F.pandas_udf(returns)
    def run(*texts: pd.Series) -> pd.Series:
        return pd.Series([None if any(t is None for t in row) else change(*row) for row in zip(*texts, strict=True)], dtype=object)

    return run


def merged(base: Column, patch: Column) -> Column:
    """patch over base; of either null, the other."""
    both = _by_row(lambda a, b: json.dumps(config.deep_merge(json.loads(a), json.loads(b))))(base, patch)
    return F.coalesce(both, base, patch)


def hashed(text: Column) -> Column:
    """The same for equal configurations, however their keys are ordered."""
    return _by_row(lambda t: config.stable_hash(json.loads(t)))(text)


def with_profile(text: Column, override: Column, environment: Column) -> Column:
    """The configuration under the profile asked for, else the environment's, else its own default; without one as it is. An unknown profile is null."""
    default = F.get_json_object(text, "$.default_profile")
    name = F.coalesce(override, environment, default)

    def change(t: str, profile: str) -> str | None:
        try:
            return json.dumps(config.with_profile(json.loads(t), profile))
        except ValueError:
            return None

    return F.when(name.isNull(), text).otherwise(_by_row(change)(text, name))


def rule_errors(rules: Column) -> Column:
    """What is wrong with a list of rules, in words."""
    return _by_row(lambda t: config.rule_errors(json.loads(t)), ArrayType(StringType()))(rules)


def toggle_errors(section: Column) -> Column:
    """What is wrong with a built-in clean-up's section, in words."""
    return _by_row(lambda t: config.toggle_errors(json.loads(t)), ArrayType(StringType()))(section)


def rules_of(configs: DataFrame, scope: list[str], text: str = "config") -> DataFrame:
    """Each scope's rules in order: nth (from 1), name, rule (JSON)."""
    items = F.from_json(F.get_json_object(text, "$.cleanup_rules"), "array<string>")
    return configs.select(*scope, F.posexplode(items).alias("at", "rule")).select(*scope, (F.col("at") + 1).alias("nth"), F.get_json_object("rule", "$.name").alias("name"), "rule")


def _numbered(rules: DataFrame, scope: list[str], *order: str) -> DataFrame:
    return rules.withColumn("nth", F.row_number().over(Window.partitionBy(*scope).orderBy(*order))).select(*scope, *RULE)


def rules_merged(existing: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """Rules whose name a new one has go, the new ones follow in order; numbered anew."""
    kept = existing.join(new.select(*scope, "name").distinct(), [*scope, "name"], "left_anti").withColumn("_new", F.lit(0))
    return _numbered(kept.unionByName(new.withColumn("_new", F.lit(1))), scope, "_new", "nth")


def rules_removed(existing: DataFrame, names: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rules without those named, numbered anew, and the names with `outcome`: removed, or unknown where no rule has them."""
    known = existing.select(*scope, "name", F.lit(True).alias("_known")).distinct()
    outcome = names.join(known, [*scope, "name"], "left").withColumn("outcome", F.when(F.col("_known"), "removed").otherwise("unknown")).drop("_known")
    return _numbered(existing.join(names.select(*scope, "name"), [*scope, "name"], "left_anti"), scope, "nth"), outcome


def rules_as_yaml(rules: DataFrame, scope: list[str]) -> DataFrame:
    """yaml of each scope: its rules in order below `cleanup_rules`. A rule's parts are flow mappings, which JSON is."""
    entry = F.concat(F.lit("- name: "), F.col("name"), F.lit("\n  rule: "), F.col("rule"), F.lit("\n"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("nth", entry.alias("entry")))), lambda r: r["entry"])
    return rules.groupBy(*scope).agg(F.concat(F.lit("cleanup_rules:\n"), F.array_join(lines, "")).alias("yaml"))


def versions_created(versions: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """versions (scope, id, name, is_active, payload) and one more a row of new (scope, name, patch, activate): its scope's newest active payload with the patch, numbered after the scope's largest id. An activated one is the only active one."""
    last = versions.groupBy(*scope).agg(F.max("id").alias("_last"), F.max_by("payload", F.when(F.col("is_active"), F.col("id"))).alias("_base"))
    base = F.coalesce(F.when(F.col("_base").isNotNull(), F.col("_base")), F.lit("{}"))
    made = new.join(last, scope, "left").select(*scope, (F.coalesce("_last", F.lit(0)) + 1).alias("id"), "name", F.col("activate").alias("is_active"), merged(base, F.col("patch")).alias("payload"))
    off = new.filter("activate").select(*scope, F.lit(True).alias("_off")).distinct()
    old = versions.join(off, scope, "left").withColumn("is_active", F.col("is_active") & F.col("_off").isNull()).drop("_off")
    return old.unionByName(made)


def activated(versions: DataFrame, chosen: DataFrame, scope: list[str]) -> DataFrame:
    """versions with the chosen (scope, id) as the only active one of its scope. A choice that names no version changes nothing."""
    real = chosen.join(versions.select(*scope, "id"), [*scope, "id"], "left_semi").select(*scope, F.col("id").alias("_chosen"))
    out = versions.join(real, scope, "left")
    return out.withColumn("is_active", F.when(F.col("_chosen").isNull(), F.col("is_active")).otherwise(F.col("id") == F.col("_chosen"))).drop("_chosen")


def listed(versions: DataFrame, scope: list[str]) -> DataFrame:
    """versions with `place`: 1 is the newest of its scope."""
    return versions.withColumn("place", F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc("id"))))


def effective(scopes: DataFrame, versions: DataFrame, scope: list[str], defaults: Column) -> DataFrame:
    """scopes with `config`: the payload of the newest active version, else the defaults."""
    active = versions.filter("is_active").groupBy(*scope).agg(F.max_by("payload", "id").alias("config"))
    return scopes.join(active, scope, "left").withColumn("config", F.coalesce("config", defaults))


def read_yaml(text: str) -> dict:
    """A configuration from YAML, where a reader for it is installed; JSON, which YAML includes, is read without one."""
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("a YAML reader is needed for configurations that aren't JSON") from e
        out = yaml.safe_load(text)
    if not isinstance(out, dict):
        raise ValueError("a configuration is a mapping")
    return out
