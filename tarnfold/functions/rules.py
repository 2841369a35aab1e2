"""Configurable clean-up rules, compiled to column expressions.

A rule is a list of (kind, parameters). Every step takes a text column and gives the
new text with the number of its fixes; `apply_rule` chains them and reports which
steps changed the text. Steps over lines are array functions; those in which a line
depends on earlier ones are the Arrow-batched ones of `ordered`.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.functions import ordered

Step = Callable[[Column, dict], tuple[Column, Column]]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _text(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def _java(replacement: str) -> str:
    """Group references as Java writes them; its own signs are kept literal."""
    return re.sub(r"\\(\d)", r"$\1", replacement.replace("$", r"\$"))


def _misses(pattern: str) -> Callable[[Column], Column]:
    return lambda x: ~x.rlike(pattern)


def drop_lines(text: Column, params: dict) -> tuple[Column, Column]:
    kept = F.filter(_lines(text), _misses(params["pattern"]))
    return _text(kept), F.size(_lines(text)) - F.size(kept)


def rewrite(text: Column, params: dict) -> tuple[Column, Column]:
    return F.regexp_replace(text, params["pattern"], _java(params.get("replacement", ""))), F.regexp_count(text, F.lit(params["pattern"]))


def drop_headers_and_footers(text: Column, params: dict) -> tuple[Column, Column]:
    lines = _lines(text)
    first, last = int(params.get("first_n", 0)), int(params.get("last_n", 0))
    kept = F.slice(lines, first + 1, F.greatest(F.size(lines) - first - last, F.lit(0)))
    for pattern in params.get("patterns", []):
        kept = F.filter(kept, _misses(pattern))
    return _text(kept), F.size(lines) - F.size(kept)


def _both(done: Column) -> tuple[Column, Column]:
    return done["text"], done["fixes"]


def underlined_headings(text: Column, params: dict) -> tuple[Column, Column]:
    """`===` and `---` under a line become `#` and `##` before it."""
    return _both(ordered.headings_from_underlines(text))


def join_wrapped_lines(text: Column, params: dict) -> tuple[Column, Column]:
    """Neighbouring plain lines become one; empty lines, headings, list items and fences stay and part them."""
    return _both(ordered.joined_lines(text))


def unescape(text: Column, params: dict) -> tuple[Column, Column]:
    return _both(ordered.html_unescape_counted(text))


def number_headings(text: Column, params: dict) -> tuple[Column, Column]:
    """A numbered heading's level is the number of its segments, at most max_level."""
    pattern = r"^(#{1,6})\s+(\d+(?:\.\d+)*)\s+(.*)$"

    def level(x: Column) -> Column:
        return F.least(F.size(F.split(F.regexp_extract(x, pattern, 2), r"\.")), F.lit(int(params.get("max_level", 6))))

    def wrong(x: Column) -> Column:
        return x.rlike(pattern) & (F.length(F.regexp_extract(x, pattern, 1)) != level(x))

    changed = F.transform(_lines(text), lambda x: F.when(wrong(x), F.concat(F.repeat(F.lit("#"), level(x)), F.lit(" "), F.regexp_extract(x, pattern, 2), F.lit(" "), F.regexp_extract(x, pattern, 3))).otherwise(x))
    return _text(changed), F.size(F.filter(_lines(text), wrong))


def one_bullet(text: Column, params: dict) -> tuple[Column, Column]:
    """One marker for all list items outside code fences."""
    return _both(ordered.one_bullet(text, params.get("marker", "-")))


# The names of the steps in rule files.
STEPS: dict[str, Step] = {
    "strip_lines_matching": drop_lines,
    "rewrite_pattern": rewrite,
    "strip_headers_footers": drop_headers_and_footers,
    "normalize_headings": underlined_headings,
    "fix_numbered_headings": number_headings,
    "merge_hardwrapped_paragraphs": join_wrapped_lines,
    "fix_bullets": one_bullet,
    "html_unescape": unescape,
}
MATCHED = ("tenant_id", "project_id", "corpus_id", "mime_type")
MATCH_KEYS = {*MATCHED, "filename_pattern"}
TAGS = {"auto_fix_only", "suspicious_content", "hard_failure"}


@dataclass(frozen=True)
class Rule:
    """A named list of steps for the documents that its match block describes."""

    name: str
    steps: list[tuple[str, dict]]
    match: dict[str, str] = field(default_factory=dict)
    tags: list[str] = field(default_factory=list)

    def fits(self) -> Column:
        """Every field of the match block equals the document's, whatever the case; the file name fits the pattern. An empty block fits all."""
        out = F.lit(True)
        for key in MATCHED:
            if self.match.get(key) is not None:
                out = out & (F.lower(F.coalesce(F.col(key), F.lit(""))) == self.match[key].lower())
        pattern = self.match.get("filename_pattern")
        if pattern is not None:
            out = out & F.lower(F.coalesce(F.col("filename"), F.lit(""))).rlike(glob_pattern(pattern.lower()))
        return out


def glob_pattern(glob: str) -> str:
    """A file name pattern (`*`, `?`, `[seq]`, `[!seq]`) as a regular expression over the whole name."""
    out, i = [], 0
    while i < len(glob):
        c, end = glob[i], glob.find("]", i + 2 if glob[i + 1 : i + 2] != "!" else i + 3)
        if c == "[" and end > 0:
            inside = glob[i + 1 : end].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            out.append("[" + ("^" + inside[1:] if inside.startswith("!") else inside) + "]")
            i = end
        else:
            out.append({"*": ".*", "?": "."}.get(c, re.escape(c)))
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


def parsed(raw: list) -> list[Rule]:
    """Rules from mappings, in order; what isn't a mapping, or a step that is neither a name nor a mapping, is left out."""
    out = []
    for i, entry in enumerate(raw):
        if not isinstance(entry, dict) or not isinstance(entry.get("steps", []), list):
            continue
        steps = [(s, {}) if isinstance(s, str) else (s.get("kind", ""), {k: v for k, v in s.items() if k != "kind"}) for s in entry.get("steps", []) if isinstance(s, str | dict)]
        out.append(Rule(str(entry.get("name", f"rule_{i}")), steps, dict(entry.get("match") or {}), list(entry.get("tags", []))))
    return out


def first_fitting(rules: list[Rule]) -> Column:
    """The number of the first rule that fits a document, null without one."""
    return F.coalesce(*[F.when(r.fits(), F.lit(i)) for i, r in enumerate(rules)]) if rules else F.lit(None).cast("int")


def apply_rules(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """docs under the first rule that fits each: the new text, `rule` (null without one), `steps_applied`, `fix_counts` and `tags`. Rules don't mix: each works on its own documents."""
    numbered = docs.withColumn("_rule", first_fitting(rules))
    out = None
    for i, rule in enumerate([*rules, None]):
        own = numbered.filter(F.col("_rule").isNull() if rule is None else F.col("_rule") == i)
        done = apply_rule(own, rule.steps if rule else [], text)
        tags = F.array(*[F.lit(t) for t in (rule.tags if rule else [])]).cast("array<string>")
        done = done.withColumns({"rule": F.lit(rule.name if rule else None).cast("string"), "tags": tags}).drop("_rule")
        out = done if out is None else out.unionByName(done)
    return out


def apply_rule(docs: DataFrame, rule: list[tuple[str, dict]], text: str = "text") -> DataFrame:
    """docs with the changed text, `steps_applied` and `fix_counts`; unknown kinds are skipped. A step that changes nothing counts 0."""
    counts: list[Column] = []
    out = docs
    known = [(k, p) for k, p in rule if k in STEPS]
    for i, (kind, params) in enumerate(known):
        changed, fixes = STEPS[kind](F.col(text), params)
        out = out.withColumns({f"_new{i}": changed, f"_fixes{i}": fixes.cast("int")}).withColumn(f"_fixes{i}", F.when(F.col(f"_new{i}") != F.col(text), F.col(f"_fixes{i}"))).withColumn(text, F.col(f"_new{i}")).drop(f"_new{i}")
        counts.append(F.struct(F.lit(kind).alias("kind"), F.coalesce(F.col(f"_fixes{i}"), F.lit(0)).alias("fixes")))
    applied = F.filter(F.array(*[F.when(F.col(f"_fixes{i}").isNotNull(), F.lit(kind)) for i, (kind, _) in enumerate(known)]), lambda k: k.isNotNull())
    total = F.array(*counts) if counts else F.expr("CAST(array() AS array<struct<kind:string,fixes:int>>)")
    return out.withColumns({"steps_applied": applied if known else F.expr("CAST(array() AS array<string>)"), "fix_counts": total}).drop(*[f"_fixes{i}" for i in range(len(known))])
