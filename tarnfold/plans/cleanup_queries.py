"""Queries over the clean-up steps, rules and warnings, with markup injected alike in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.functions import markdown, ordered, rules
from tarnfold.plans.text_queries import BULLETED, GLYPHS, HEADED, NL, PAGED, POWERS, SPACED
from tarnfold.session import table

ENTITIES = "concat('&lt;b&gt; &#8212; ', text, ' &copy;&#x41; R&amp;amp;D')"
WORD = f"left(replace(replace(text, {NL}, ' '), '|', ' '), 24)"
TABLED = f"concat(text, {NL}, '| Out | Out | ', CAST(doc_id % 3 AS STRING), ' |', {NL}, '|---|:--:|---|', {NL}, '| off | off | x |', {NL}, ' |', {WORD}, '|', {WORD}, '|', {WORD}, '|', {NL}, concat('| a ', chr(92), '| a | a |'), {NL}, '|  ||  |')"
AGAIN = f"concat('# Head ', CAST(doc_id % 5 AS STRING), {NL}, text, {NL}, '## Head ', CAST(doc_id % 3 AS STRING), {NL}, '## Notes', {NL}, '# Head ', CAST(doc_id % 5 AS STRING), {NL}, '## Notes', {NL}, '### Notes')"
ODD = "CASE doc_id % 4 WHEN 0 THEN concat(text, ' <b>x</b> <br/> <B> <i> <!-- c --> <a href=1> </p>') WHEN 1 THEN concat(text, '    wide') WHEN 2 THEN left(text, 30) ELSE text END"
RULED = f"concat('Title', {NL}, '=====', {NL}, 'Part one', {NL}, '---', {NL}, {NL}, '## 1.1.8 A', {NL}, '# 2.11 B', {NL}, 'Page 3', {NL}, '* item', {NL}, '  + item', {NL}, '```', {NL}, '* code', {NL}, '```', {NL}, text, {NL}, 'was 12% and 7%', {NL}, 'Foot')"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _docs(spark: SparkSession, sf_dir: str, injected: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(injected).alias("t"))


def _text(name: str, injected: str, change, sql: str) -> None:
    """A query that gives the sha256 of the changed text of every document; sql is a table expression over i (doc_id, t) that ends in doc_id, t."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _docs(spark, sf_dir, injected).select("doc_id", F.sha2(change(F.col("t")), 256).alias("digest"))

    QUERIES[name] = run
    ORACLES[name] = f"WITH i AS (SELECT doc_id, {injected} AS t FROM documents), {sql} SELECT doc_id, sha256(t) AS digest FROM o"


_L = f"l AS (SELECT doc_id, unnest(string_split(t, {NL})) AS x, unnest(range(len(string_split(t, {NL})))) AS i FROM i)"
_JOINED = f"o AS (SELECT doc_id, string_agg(x, {NL} ORDER BY i) AS t FROM z GROUP BY doc_id)"
_UNESCAPED = "replace(replace(replace(replace(replace(replace({0}, '&amp;', chr(1)), '&lt;', '<'), '&gt;', '>'), '&#8212;', '—'), '&copy;', '©'), '&#x41;', 'A')"
_text("html_unescape", ENTITIES, ordered.html_unescape, f"o AS (SELECT doc_id, replace({_UNESCAPED.format('t')}, chr(1), '&') AS t FROM i)")

_ROW, _RULE = r"^[ \t]*\|.*\|[ \t]*$", r"^[ \t]*\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+[ \t]*(?::?-{3,}:?[ \t]*)?\|?[ \t]*$"


def _spans(source: str) -> str:
    """Lines of source (doc_id, i, x) with repeated cells blanked, as z."""
    return rf"""r AS (SELECT *, regexp_matches(x, '{_ROW}') AND NOT regexp_matches(x, '{_RULE}') AND NOT contains(x, chr(92) || '|') AS is_row, coalesce(regexp_matches(lead(x) OVER (PARTITION BY doc_id ORDER BY i), '{_RULE}'), false) AS is_head FROM {source}),
c AS (SELECT doc_id, i, x, is_head, unnest(string_split(trim(x, concat(' ', chr(9)))[2:-2], '|')) AS c, unnest(range(len(string_split(trim(x, concat(' ', chr(9)))[2:-2], '|')))) AS k FROM r WHERE is_row),
p AS (SELECT *, lag(trim(c)) OVER (PARTITION BY doc_id, i ORDER BY k) AS b FROM c),
q AS (SELECT doc_id, i, concat(regexp_extract(any_value(x), '^[ \t]*'), '|', string_agg(CASE WHEN trim(c) <> '' AND trim(c) = b AND length(trim(c)) >= CASE WHEN is_head THEN 1 ELSE 20 END THEN repeat(' ', length(c)) ELSE c END, '|' ORDER BY k), '|') AS y,
  bool_or(trim(c) <> '' AND trim(c) = b AND length(trim(c)) >= CASE WHEN is_head THEN 1 ELSE 20 END) AS changed FROM p GROUP BY doc_id, i),
z AS (SELECT r.doc_id, r.i, CASE WHEN changed THEN y ELSE x END AS x FROM r LEFT JOIN q ON q.doc_id = r.doc_id AND q.i = r.i)"""


_text("table_spans", TABLED, ordered.blank_repeated_cells, f"{_L}, {_spans('l')}, {_JOINED}")


def _once(source: str, scope: str) -> str:
    """Lines of source (doc_id, i, x) with later copies of headings emptied, as z."""
    least = 2 if scope == "title" else 3
    mine = "h = first_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)" if scope == "title" else "true"
    return rf"""h AS (SELECT *, nullif(trim(regexp_extract(x, '^(#{{1,6}})[ \t]+(.*\S)[ \t]*$', 2)), '') AS h FROM {source}),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS times, row_number() OVER (PARTITION BY doc_id, h ORDER BY i) AS nth, {mine} AS mine FROM h),
z AS (SELECT doc_id, i, CASE WHEN h IS NOT NULL AND mine AND times >= {least} AND nth > 1 THEN '' ELSE x END AS x FROM n)"""


_text("repeated_title", AGAIN, ordered.blank_repeated_headings, f"{_L}, {_once('l', 'title')}, {_JOINED}")
_text("repeated_headings", AGAIN, lambda t: ordered.blank_repeated_headings(t, "any"), f"{_L}, {_once('l', 'any')}, {_JOINED}")


def cleanup_warnings(spark, sf_dir):
    return _docs(spark, sf_dir, ODD).select("doc_id", F.array_join(markdown.warnings(F.col("t")), "; ").alias("warnings"))


QUERIES["cleanup_warnings"] = cleanup_warnings
ORACLES["cleanup_warnings"] = rf"""WITH i AS (SELECT doc_id, {ODD} AS t FROM documents), w AS (SELECT doc_id, t, list_sort(list_distinct(regexp_extract_all(t, '</?[a-zA-Z][^>]*>')))[1:5] AS tags, length(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS n FROM i)
SELECT doc_id, array_to_string([x FOR x IN [CASE WHEN len(tags) > 0 THEN concat('leftover_html_tags: ', array_to_string(tags, ' ')) END, CASE WHEN regexp_matches(t, '[^\S\n]{{4,}}[A-Za-z]') THEN 'possible_ocr_whitespace_artefacts' END,
CASE WHEN n > 0 AND n < 50 THEN concat('very_short_output (', n, ' chars)') END] IF x IS NOT NULL], '; ') AS warnings FROM w"""


def structure_counts(spark, sf_dir):
    return _docs(spark, sf_dir, TABLED).select("doc_id", markdown.structure_counts(F.concat(F.lit("# One\n ## Two\n"), "t")).alias("s")).select("doc_id", "s.*")


QUERIES["structure_counts"] = structure_counts
ORACLES["structure_counts"] = rf"""WITH i AS (SELECT doc_id, concat('# One', {NL}, ' ## Two', {NL}, {TABLED}) AS t FROM documents)
SELECT doc_id, CAST(length(t) AS INT) AS chars, CAST(len(regexp_extract_all(t, '[\p{{L}}\p{{N}}_](?:[\p{{L}}\p{{N}}_''-]*[\p{{L}}\p{{N}}_])?')) AS INT) AS words,
CAST(len(regexp_extract_all(t, '(?m)^\s{{0,3}}#{{1,6}}\s+\S')) AS INT) AS headings, CAST(len(regexp_extract_all(t, '(?m)^\s*\|[\s:|-]+\|\s*$')) AS INT) AS tables FROM i"""


def _rule(name: str, kind: str, params: dict, sql: str) -> None:
    """A query of one rule step: digest, fixes and whether it changed the text; sql is over i and ends in o (doc_id, t, fixes)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = rules.apply_rule(_docs(spark, sf_dir, RULED), [(kind, params), ("no such step", {})], "t")
        return out.select("doc_id", F.sha2("t", 256).alias("digest"), F.col("fix_counts")[0]["fixes"].alias("fixes"), F.array_join("steps_applied", ",").alias("steps"))

    QUERIES[name] = run
    ORACLES[name] = f"WITH i AS (SELECT doc_id, {RULED} AS t FROM documents), {sql} SELECT o.doc_id, sha256(o.t) AS digest, CAST(CASE WHEN o.t = i.t THEN 0 ELSE fixes END AS INT) AS fixes, CASE WHEN o.t = i.t THEN '' ELSE '{kind}' END AS steps FROM o JOIN i USING (doc_id)"


_AGG = f"o AS (SELECT doc_id, string_agg(x, {NL} ORDER BY i) AS t, sum(fixed) AS fixes FROM z GROUP BY doc_id)"
_rule("rule_strip_lines", "strip_lines_matching", {"pattern": "^Page [0-9]+$|^Foot$"}, f"k AS (SELECT doc_id, string_split(t, {NL}) AS a, [x FOR x IN string_split(t, {NL}) IF NOT regexp_matches(x, '^Page [0-9]+$|^Foot$')] AS b FROM i), o AS (SELECT doc_id, array_to_string(b, {NL}) AS t, len(a) - len(b) AS fixes FROM k)")
_rule("rule_rewrite", "rewrite_pattern", {"pattern": "([0-9]+)%", "replacement": r"\1 percent $"}, r"o AS (SELECT doc_id, regexp_replace(t, '([0-9]+)%', '\1 percent $', 'g') AS t, len(regexp_extract_all(t, '[0-9]+%')) AS fixes FROM i)")
_rule("rule_headers_footers", "strip_headers_footers", {"first_n": 2, "last_n": 1, "patterns": ["^was "]}, f"k AS (SELECT doc_id, string_split(t, {NL}) AS a, [x FOR x IN string_split(t, {NL})[3:-2] IF NOT regexp_matches(x, '^was ')] AS b FROM i), o AS (SELECT doc_id, array_to_string(b, {NL}) AS t, len(a) - len(b) AS fixes FROM k)")
_rule("rule_underlines", "normalize_headings", {}, f"""{_L}, m AS (SELECT *, trim(lag(x, 1, '') OVER w) <> '' AND regexp_matches(trim(x), '^(={{3,}}|-{{3,}})$') AS under FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT *, coalesce(lead(under) OVER (PARTITION BY doc_id ORDER BY i), false) AS titled, lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM m),
z AS (SELECT doc_id, i, CASE WHEN titled THEN concat(CASE WHEN trim(next)[1] = '=' THEN '# ' ELSE '## ' END, trim(x)) ELSE x END AS x, CASE WHEN titled THEN 1 ELSE 0 END AS fixed FROM n WHERE NOT under), {_AGG}""")
_NUMBERED = r"^(#{1,6})\s+([0-9]+(?:\.[0-9]+)*)\s+(.*)$"
_rule("rule_numbered_headings", "fix_numbered_headings", {"max_level": 3}, f"""{_L}, m AS (SELECT *, regexp_matches(x, '{_NUMBERED}') AS hit, least(3, len(string_split(regexp_extract(x, '{_NUMBERED}', 2), '.'))) AS level FROM l),
z AS (SELECT doc_id, i, CASE WHEN hit AND length(regexp_extract(x, '{_NUMBERED}', 1)) <> level THEN concat(repeat('#', CAST(level AS INT)), ' ', regexp_extract(x, '{_NUMBERED}', 2), ' ', regexp_extract(x, '{_NUMBERED}', 3)) ELSE x END AS x,
CASE WHEN hit AND length(regexp_extract(x, '{_NUMBERED}', 1)) <> level THEN 1 ELSE 0 END AS fixed FROM m), {_AGG}""")
_rule("rule_wrapped_lines", "merge_hardwrapped_paragraphs", {}, rf"""{_L}, m AS (SELECT doc_id, i, x, regexp_replace(x, '^\s+|\s+$', '', 'g') AS s FROM l), k AS (SELECT *, s = '' OR s[1] = '#' OR starts_with(s, '```') OR regexp_matches(s, '^[-*+] ') AS apart FROM m),
g AS (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM k),
z AS (SELECT doc_id, min(i) AS i, any_value(x) AS x, 0 AS fixed FROM g WHERE apart GROUP BY doc_id, g.i UNION ALL SELECT doc_id, min(i), string_agg(s, ' ' ORDER BY i), count(*) - 1 FROM g WHERE NOT apart GROUP BY doc_id, part), {_AGG}""")
_rule("rule_bullets", "fix_bullets", {"marker": "-"}, rf"""{_L}, f AS (SELECT *, sum(CASE WHEN starts_with(trim(x), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS fenced FROM l),
z AS (SELECT doc_id, i, CASE WHEN fenced THEN x ELSE regexp_replace(x, '^(\s*)[*+] ', '\1- ') END AS x, CASE WHEN NOT fenced AND regexp_matches(x, '^\s*[*+] ') THEN 1 ELSE 0 END AS fixed FROM f), {_AGG}""")

RULES = rules.parsed([
    {"name": "reports", "match": {"tenant_id": "T1", "filename_pattern": "*_[0-4]?.md"}, "steps": ["fix_bullets", {"kind": "strip_lines_matching", "pattern": "^Foot$"}], "tags": ["auto_fix_only"]},
    "not a rule",
    {"name": "french", "match": {"project_id": "FR"}, "steps": [{"kind": "rewrite_pattern", "pattern": "%", "replacement": " pour cent"}, 7], "tags": ["suspicious_content"]},
    {"name": "rest", "match": {"mime_type": "Text/Markdown", "filename_pattern": "*[!3-9].md"}, "steps": [{"kind": "fix_numbered_headings"}]},
])


def rules_applied(spark, sf_dir):
    """The first rule that fits each document, and its outcome."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("t"), F.col("doc_id") % 3).alias("tenant_id"), F.col("lang").alias("project_id"), F.col("source").alias("corpus_id"), F.lit("text/markdown").alias("mime_type"), F.concat("source", F.lit("_"), F.col("doc_id"), F.lit(".md")).alias("filename"), F.expr(RULED).alias("t"))
    out = rules.apply_rules(docs, RULES, "t")
    return out.select("doc_id", "rule", F.sha2("t", 256).alias("digest"), F.array_join("steps_applied", ",").alias("steps"), F.array_join("tags", ",").alias("tags"))


QUERIES["rules_applied"] = rules_applied
ORACLES["rules_applied"] = rf"""WITH i AS (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 1 AND regexp_matches(concat(source, '_', doc_id, '.md'), '^(?s).*_[0-4].\.md$') THEN 'reports' WHEN lang = 'fr' THEN 'french' WHEN regexp_matches(concat(source, '_', doc_id, '.md'), '^(?s).*[^3-9]\.md$') THEN 'rest' END AS rule, {RULED} AS t FROM documents), {_L},
f AS (SELECT *, sum(CASE WHEN starts_with(trim(x), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS fenced FROM l),
a AS (SELECT doc_id, string_agg(CASE WHEN fenced THEN x ELSE regexp_replace(x, '^(\s*)[*+] ', '\1- ') END, {NL} ORDER BY i) FILTER (x <> 'Foot') AS t FROM f GROUP BY doc_id),
b AS (SELECT doc_id, string_agg(CASE WHEN regexp_matches(x, '{_NUMBERED}') THEN concat(repeat('#', CAST(least(6, len(string_split(regexp_extract(x, '{_NUMBERED}', 2), '.'))) AS INT)), ' ', regexp_extract(x, '{_NUMBERED}', 2), ' ', regexp_extract(x, '{_NUMBERED}', 3)) ELSE x END, {NL} ORDER BY i) AS t FROM l GROUP BY doc_id)
SELECT doc_id, rule, sha256(CASE rule WHEN 'reports' THEN a.t WHEN 'french' THEN replace(i.t, '%', ' pour cent') WHEN 'rest' THEN b.t ELSE i.t END) AS digest,
CASE rule WHEN 'reports' THEN 'fix_bullets,strip_lines_matching' WHEN 'french' THEN 'rewrite_pattern' WHEN 'rest' THEN 'fix_numbered_headings' ELSE '' END AS steps, CASE rule WHEN 'reports' THEN 'auto_fix_only' WHEN 'french' THEN 'suspicious_content' ELSE '' END AS tags
FROM i JOIN a USING (doc_id) JOIN b USING (doc_id)"""

# The whole clean-up's input holds what each step looks for.
SOILED = f"concat({HEADED.replace('text', SPACED)}, {NL}, ' [a]() [c](x) [d](#)', {NL}, 'R&amp;D &#8212; ﬁn ﬆ', 'a​b', {NL}, 'Page 7 of 9', {NL}, '- • item', {NL}, '*  x', {NL}, '1×10 -7 and 2 nd   ', {NL}, '| Out | Out |', {NL}, '|---|---|', {NL}, '| a | a |', {NL}, '# ', left(replace({SPACED}, {NL}, ' '), 20))"


def cleanup_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole clean-up over every document; the flagship."""
    out = markdown.cleaned(_docs(spark, sf_dir, SOILED), "t")
    return out.select("doc_id", F.sha2("t", 256).alias("digest"), F.col("chars_before").cast("long").alias("chars_before"), F.col("chars_after").cast("long").alias("chars_after"), F.size(F.filter("transforms_applied", lambda x: ~x.startswith("builtin"))).alias("core_steps"))


QUERIES["cleanup_markdown"] = cleanup_markdown
_MARK = r"^([ \t]*(?:[-*+]|[0-9]+[.)]))"
_BY_LINE = f"replace(replace(replace(replace(replace(replace(replace(x, '&amp;', '&'), '&#8212;', '—'), 'ﬁ', 'fi'), 'ﬆ', 'st'), '​', ''), '­', ''), '﻿', '')"
ORACLES["cleanup_markdown"] = rf"""WITH s AS (SELECT doc_id, {SOILED} AS t FROM documents), s1 AS (SELECT doc_id, t, regexp_replace(t, '\n{{3,}}', concat({NL}, {NL}), 'g') AS u FROM s),
s2 AS (SELECT doc_id, t AS t0, u, regexp_replace(regexp_replace(u, '\[([^\]]*)\]\(\s*\)', '\1', 'g'), '\[([^\]]*)\]\(\s*#\s*\)', '\1', 'g') AS t FROM s1), i AS (SELECT doc_id, t FROM s2), {_L},
v AS (SELECT *, nullif(length(regexp_extract(x, '^(#{{1,6}})\s+(.*)$', 1)), 0) AS level FROM l), k AS (SELECT *, count(level) OVER w AS k FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT doc_id, i, x AS x0, CASE WHEN level IS NULL THEN x ELSE concat(repeat('#', CAST(k + min(level - k) OVER (PARTITION BY doc_id ORDER BY i) AS INT)), ' ', regexp_extract(x, '^(#{{1,6}})\s+(.*)$', 2)) END AS x FROM k),
y AS (SELECT doc_id, i, x0, x AS x1, regexp_replace(x, '\s+$', '') AS x FROM e),
y2 AS (SELECT doc_id, i, CASE WHEN regexp_matches(trim(x), '(?i)^(?:page\s+)?[0-9]+(?:\s*/\s*[0-9]+|\s+of\s+[0-9]+)?\s*$') THEN '' ELSE
  regexp_replace(regexp_replace(regexp_replace(regexp_replace({_BY_LINE}, '{_MARK}[ \t]+[{markdown.BULLETS}][ \t]*(\S)', '\1 \2'), '{_MARK}[ \t]{{2,}}(\S)', '\1 \2'), '([×x]10)\s+([-−]?[0-9]{{1,3}})\b', '\1^\2', 'g'), '\b([0-9]+)[ \t]+(st|nd|rd|th)\b', '\1\2', 'g') END AS x FROM y),
{_spans('y2').replace('z AS (', 'y3 AS (')}, {_once('y3', 'title').replace('n AS (', 'nn AS (').replace('FROM n)', 'FROM nn)').replace('h AS (', 'hh AS (').replace('FROM h)', 'FROM hh)')}, {_JOINED},
w AS (SELECT doc_id, bool_or(x0 <> x1) AS c3, bool_or(x1 <> x) AS c4 FROM y GROUP BY doc_id)
SELECT o.doc_id, sha256(o.t) AS digest, CAST(length(s2.t0) AS BIGINT) AS chars_before, CAST(length(o.t) AS BIGINT) AS chars_after, CAST((s2.t0 <> s2.u)::INT + (s2.u <> s2.t)::INT + c3::INT + c4::INT AS INT) AS core_steps FROM o JOIN s2 USING (doc_id) JOIN w USING (doc_id)"""
