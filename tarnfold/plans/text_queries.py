"""Queries over the text operators, each over all documents, with markup injected alike in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.functions import decisions, markdown, ordered
from tarnfold.session import table

NL = "chr(10)"
SPACED = f"replace(text, {NL}, repeat({NL}, CAST(1 + doc_id % 4 AS INT)))"
LINKED = "concat(text, ' [a]() [b]( # ) [c](x) [d](#)')"
TRAILED = f"concat(replace(text, {NL}, concat('  ', chr(9), {NL})), '   ')"
GLYPHS = f"concat(text, ' ﬁn ', '{''.join(markdown.LIGATURES)}', ' a', '{markdown.INVISIBLE}', 'b')"
PAGED = f"concat('Page ', CAST(doc_id AS STRING), ' of 9', {NL}, text, {NL}, ' 7 / 8 ', {NL}, '12', {NL}, 'page x')"
BULLETED = f"concat('- • item', {NL}, '1)   two', {NL}, text, {NL}, '*  x', {NL}, '- plain • stays')"
POWERS = f"concat('1×10 -7 and 2 nd of x10', {NL}, '12 ', text, ' 10 -7')"
HEADED = f"concat('# ', left(replace(text, {NL}, ' '), 20), {NL}, '#### deep', {NL}, text, {NL}, '###### deeper', {NL}, '## back', {NL}, '##### end')"
REPEATED = f"concat(repeat(concat('running head', {NL}), CAST(doc_id % 12 AS INT)), text)"
LISTED = f"concat('# Title', {NL}, 'intro', {NL}, '1) one', {NL}, text, {NL}, {NL}, {NL}, {NL}, '## End', {NL}, {NL}, 'x  ')"
FRONT = f"concat('---', {NL}, 'a: ', CAST(doc_id AS STRING), {NL}, '---', {NL}, text)"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _text(name: str, injected: str, change, sql: str) -> None:
    """A query that gives the sha256 and length of the changed text of every document."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = table(spark, sf_dir, "documents").select("doc_id", F.expr(injected).alias("t")).select("doc_id", change(F.col("t")).alias("t"))
        return out.select("doc_id", F.sha2("t", 256).alias("digest"), F.length("t").cast("long").alias("n"))

    QUERIES[name] = run
    ORACLES[name] = f"WITH i AS (SELECT doc_id, {injected} AS t FROM documents), o AS (SELECT doc_id, {sql} AS t FROM i) SELECT doc_id, sha256(t) AS digest, CAST(length(t) AS BIGINT) AS n FROM o"


def _lines(sql: str) -> str:
    return f"array_to_string([{sql} FOR x IN string_split(t, {NL})], {NL})"


_MARK = r"(^|\n)([ \t]*(?:[-*+]|[0-9]+[.)]))"
_text("collapse_newlines", SPACED, markdown.collapse_newlines, rf"regexp_replace(t, '\n{{3,}}', concat({NL}, {NL}), 'g')")
_text("strip_broken_links", LINKED, markdown.strip_broken_links, r"regexp_replace(regexp_replace(t, '\[([^\]]*)\]\(\s*\)', '\1', 'g'), '\[([^\]]*)\]\(\s*#\s*\)', '\1', 'g')")
_text("strip_trailing_whitespace", TRAILED, markdown.strip_trailing_whitespace, _lines(r"regexp_replace(x, '\s+$', '')"))
_text("fix_ligatures", GLYPHS, markdown.fix_ligatures, "".join("replace(" for _ in markdown.LIGATURES) + "t" + "".join(f", '{g}', '{x}')" for g, x in markdown.LIGATURES.items()))
_text("strip_invisible", GLYPHS, markdown.strip_invisible, f"translate(t, '{markdown.INVISIBLE}', '')")
_text("blank_page_numbers", PAGED, markdown.blank_page_numbers, _lines(r"CASE WHEN regexp_matches(trim(x), '(?i)^(?:page\s+)?[0-9]+(?:\s*/\s*[0-9]+|\s+of\s+[0-9]+)?\s*$') THEN '' ELSE x END"))
_text("strip_bullet_glyphs", BULLETED, markdown.strip_bullet_glyphs, rf"regexp_replace(replace(regexp_replace(t, '{_MARK}[ \t]+[{markdown.BULLETS}][ \t]*(\S)', '\1\2 \3', 'g'), '', ''), '{_MARK}[ \t]{{2,}}(\S)', '\1\2 \3', 'g')")
_text("join_superscripts", POWERS, markdown.join_superscripts, "regexp_replace(regexp_replace(t, '([×x]10)\\s+([-−]?[0-9]{1,3})\\b', '\\1^\\2', 'g'), '\\b([0-9]+)[ \\t]+(st|nd|rd|th)\\b', '\\1\\2', 'g')")
_text("strip_frontmatter", FRONT, markdown.strip_frontmatter, r"regexp_replace(t, '^(?s)---\n.*?\n---\n', '')")
_text("collapse_and_trim", LISTED, markdown.collapse_and_trim, rf"concat(regexp_replace(regexp_replace(t, '\n{{3,}}', concat({NL}, {NL}), 'g'), '^\s+|\s+$', '', 'g'), {NL})")


def repair_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "documents").select("doc_id", F.expr(HEADED).alias("t")).select("doc_id", ordered.repair_headings(F.col("t")).alias("t"))
    return out.select("doc_id", F.sha2("t", 256).alias("digest"))


QUERIES["repair_headings"] = repair_headings
# A heading's level is the least, over the headings up to it, of their level plus the number of headings since.
ORACLES["repair_headings"] = rf"""
WITH i AS (SELECT doc_id, string_split({HEADED}, {NL}) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM i),
h AS (SELECT *, nullif(length(regexp_extract(x, '^(#{{1,6}})\s+(.*)$', 1)), 0) AS level FROM l),
c AS (SELECT *, count(level) OVER w AS k FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT *, k + min(level - k) OVER (PARTITION BY doc_id ORDER BY i) AS lowest FROM c)
SELECT doc_id, sha256(string_agg(CASE WHEN level IS NULL THEN x ELSE concat(repeat('#', CAST(lowest AS INT)), ' ', regexp_extract(x, '^(#{{1,6}})\s+(.*)$', 2)) END, {NL} ORDER BY i)) AS digest
FROM e GROUP BY doc_id
"""


def blank_repetitive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at most 80 characters that a document repeats 8 times or more. Lines are counted by document and line, so a long text spreads over tasks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(REPEATED).alias("t"))
    lines = docs.select("doc_id", F.explode(F.split("t", "\n", -1)).alias("line")).select("doc_id", markdown.stripped(F.col("line")).alias("line"))
    often = lines.filter((F.col("line") != "") & (F.length("line") <= 80)).groupBy("doc_id", "line").count().filter("count >= 8")
    found = often.groupBy("doc_id").agg(F.collect_set("line").alias("repetitive"))
    out = docs.join(found, "doc_id", "left").select("doc_id", F.when(F.col("repetitive").isNull(), F.col("t")).otherwise(markdown.blank_repetitive_lines(F.col("t"), F.col("repetitive"))).alias("t"))
    return out.select("doc_id", F.sha2("t", 256).alias("digest"))


QUERIES["blank_repetitive_lines"] = blank_repetitive_lines
ORACLES["blank_repetitive_lines"] = rf"""
WITH i AS (SELECT doc_id, string_split({REPEATED}, {NL}) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM i),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, trim(x)) AS n FROM l)
SELECT doc_id, sha256(string_agg(CASE WHEN trim(x) <> '' AND length(trim(x)) <= 80 AND n >= 8 THEN '' ELSE x END, {NL} ORDER BY i)) AS digest FROM c GROUP BY doc_id
"""


def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr(HEADED)
    plain = F.regexp_replace("t", r"\s", "")
    docs = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return docs.select(
        "doc_id", markdown.approx_tokens(F.col("t")).alias("approx_tokens"), markdown.estimated_tokens(F.col("t")).alias("estimated_tokens"), markdown.count_headings(F.col("t")).cast("int").alias("headings"),
        F.length("t").cast("int").alias("chars"), F.regexp_count("t", F.lit(r"\S+")).cast("int").alias("words"), F.round(F.length(F.regexp_replace(plain, r"[^A-Za-z]", "")) / F.length(plain), 6).alias("ascii_share"),
        decisions.fits_in_context(markdown.estimated_tokens(F.col("t")), 4096, 500, 1.2, 2048).alias("fits"), F.size(markdown.sections(F.col("t"))).alias("n_sections"),
    )


QUERIES["text_metrics"] = text_metrics
ORACLES["text_metrics"] = rf"""
WITH i AS (SELECT doc_id, {HEADED} AS t FROM documents), j AS (SELECT *, CAST(greatest(1, trunc(length(t) / 3.7::DOUBLE)) AS INT) AS e, regexp_replace(t, '\s', '', 'g') AS p FROM i)
SELECT doc_id, CAST(greatest(1, length(regexp_replace(t, '^\s+|\s+$', '', 'g')) // 4) AS INT) AS approx_tokens, e AS estimated_tokens,
  CAST(len(regexp_extract_all(t, '(?m)^#{{1,6}}\s')) AS INT) AS headings, CAST(length(t) AS INT) AS chars, CAST(len(regexp_extract_all(t, '\S+')) AS INT) AS words,
  round(length(regexp_replace(p, '[^A-Za-z]', '', 'g')) / length(p), 6) AS ascii_share,
  e + 500 + trunc(e * 1.2::DOUBLE) <= 4096 AND trunc(e * 1.2::DOUBLE) <= 2048 AS fits, CAST(len([x FOR x IN string_split(regexp_replace(t, '(?m)^(#{{1,2}}\s)', chr(1) || '\1', 'g'), chr(1)) IF trim(x, concat(' ', chr(9), chr(10))) <> '']) AS INT) AS n_sections
FROM j
"""


def normalized_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "documents").select("doc_id", F.expr(LISTED).alias("t")).select("doc_id", markdown.normalize_markdown(F.col("t")).alias("t"))
    return out.select("doc_id", F.sha2("t", 256).alias("digest"))


QUERIES["normalize_markdown"] = normalized_markdown
ORACLES["normalize_markdown"] = rf"""
WITH i AS (SELECT doc_id, string_split(concat(regexp_replace(regexp_replace({LISTED}, '\n{{3,}}', concat({NL}, {NL}), 'g'), '^\s+|\s+$', '', 'g'), {NL}), {NL}) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM i),
n AS (SELECT *, coalesce(lead(x) OVER (PARTITION BY doc_id ORDER BY i), '') AS y FROM l),
j AS (SELECT doc_id, string_agg(CASE WHEN regexp_matches(x, '^#{{1,6}}\s+\S+') AND trim(y) <> '' THEN concat(x, {NL}) ELSE x END, {NL} ORDER BY i) AS t FROM n GROUP BY doc_id)
SELECT doc_id, sha256(concat(regexp_replace(regexp_replace(regexp_replace(t, '(?m)^(\s*)([0-9]+)\)\s+', '\1\2. ', 'g'), '\n{{3,}}', concat({NL}, {NL}), 'g'), '^\s+|\s+$', '', 'g'), {NL})) AS digest FROM j
"""


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content = F.sha2("text", 256)
    parts: list[Column] = [F.lit("t1"), F.lit("p1"), F.col("source"), F.col("doc_id"), F.lit("v1"), F.col("doc_id") % 5, content]
    return docs.select("doc_id", content.alias("content_hash"), decisions.chunk_id(parts).alias("chunk_id"), markdown.safe_filename(F.concat(F.lit(" a/b:"), "source")).alias("file"))


QUERIES["chunk_ids"] = chunk_ids
ORACLES["chunk_ids"] = """
WITH i AS (SELECT doc_id, source, sha256(text) AS c FROM documents), h AS (SELECT *, sha256(concat_ws(':', 't1', 'p1', source, doc_id, 'v1', doc_id % 5, c)) AS h FROM i)
SELECT doc_id, c AS content_hash, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1), substr(h, 18, 3), '-', substr(h, 21, 12)) AS chunk_id,
  translate(trim(concat(' a/b:', source)), '/:', '__') AS file
FROM h
"""


def ledger_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run counts, completion and failure rates by tenant; events stand for runs, purchases for completed and errors for failed ones."""
    runs = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("tenant"), "event_type", "user_id")
    share = lambda kind: F.round(F.count_if(F.col("event_type") == kind) / F.count("*"), 4)
    return runs.groupBy("tenant").agg(F.count("*").alias("runs"), F.count_distinct("user_id").alias("documents"), share("purchase").alias("completion_rate"), share("error").alias("failure_rate"))


QUERIES["ledger_metrics"] = ledger_metrics
ORACLES["ledger_metrics"] = """
SELECT user_id % 10 AS tenant, count(*) AS runs, count(DISTINCT user_id) AS documents, round(count(*) FILTER (event_type = 'purchase') / count(*), 4) AS completion_rate,
  round(count(*) FILTER (event_type = 'error') / count(*), 4) AS failure_rate FROM events GROUP BY ALL
"""
