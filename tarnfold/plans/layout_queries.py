"""Queries over recognised pages: tables, characters, paragraphs, columns and orders with a tolerance, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfold.functions import decisions
from tarnfold.operators import characters, layout, paragraphs, tables
from tarnfold.plans.text_queries import NL
from tarnfold.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def rows_of(spark, sf_dir, base: str, columns: dict[str, str]):
    """A table's distinct rows as boxes."""
    return table(spark, sf_dir, base).selectExpr(*[f"{e} AS `{c}`" for c, e in columns.items()]).distinct()


def boxes_sql(name: str, base: str, columns: dict[str, str]) -> str:
    return f"{name} AS (SELECT DISTINCT " + ", ".join(f'{e} AS "{c}"' for c, e in columns.items()) + f" FROM {base})"


# Sixteen orders are a table's rows, three kinds of lines its columns; the first row has the titles. Columns lie 100 apart, rows 20.
_GRID = "l_orderkey % 16"
_CELL = {
    "doc_id": "l_orderkey // 160", "page": "l_orderkey // 16", "table": "1", "box": "l_orderkey * 10000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber", "row": _GRID, "column": "l_linenumber % 3", "x0": "l_linenumber % 3 * 100 + l_partkey / 1000", "x1": "l_linenumber % 3 * 100 + l_partkey / 1000 + 10",
    "top": f"CAST({_GRID} * 20 AS DOUBLE)", "bottom": f"CAST({_GRID} * 20 + 10 AS DOUBLE)", "text": f"CASE WHEN {_GRID} = 0 THEN concat('Title of ', CAST(l_linenumber % 3 AS VARCHAR(9))) ELSE CAST(l_partkey AS VARCHAR(9)) END",
}
_SPARK_CELL = {c: e.replace("l_orderkey // 160", "l_orderkey DIV 160").replace("l_orderkey // 16", "l_orderkey DIV 16").replace("VARCHAR(9)", "STRING") for c, e in _CELL.items()}
# A table of fewer than four rows keeps a column of one cell; in the others it would move, so they are left to the tests.
_WHOLE = f"""{boxes_sql("c", "lineitem", _CELL)}, n AS (SELECT page, count(DISTINCT "row") AS n_rows, count(DISTINCT "column") AS n_cols FROM c GROUP BY page), lone AS (SELECT DISTINCT page FROM c JOIN n USING (page) WHERE n_rows >= 4 GROUP BY page, "column" HAVING count(DISTINCT "row") = 1),
t AS (SELECT page, n_rows, n_cols, dense_rank() OVER (PARTITION BY page ORDER BY "row") AS r, dense_rank() OVER (PARTITION BY page ORDER BY "column") AS k, "row", x0, box, text FROM c JOIN n USING (page) WHERE page NOT IN (FROM lone))"""


def _cells(spark, sf_dir):
    cells = rows_of(spark, sf_dir, "lineitem", _SPARK_CELL)
    cells = cells.withColumns({"kind": F.lit("table"), "row_top": F.col("top"), "row_height": F.lit(10.0), "col_left": F.col("column") * 100.0, "col_right": F.col("column") * 100.0 + 70, "header": F.col("row") == 0})
    cells = cells.withColumns({c: F.lit(None).cast("double") for c in ("area_left", "area_right", "area_top", "area_bottom")})
    # A row is one of 31 remainders and so a bit of its own: rows are counted without a shuffle of each.
    held = table(spark, sf_dir, "lineitem").selectExpr(*[f"{_SPARK_CELL[c]} AS `{c}`" for c in ("page", "row", "column")]).groupBy("page", "column").agg(F.expr("bit_or(shiftleft(1L, CAST(`row` AS INT)))").alias("rows"))
    lone = held.groupBy("page").agg(F.bit_count(F.bit_or("rows")).alias("n"), F.min(F.bit_count("rows")).alias("least")).filter("n >= 4 AND least = 1").select("page")
    return cells.join(lone, "page", "left_anti")


@query("tables_built", f"""WITH {_WHOLE}, g AS (SELECT page, n_rows, n_cols, r, k, "row", string_agg(text, ' ' ORDER BY x0, box) AS text FROM t GROUP BY ALL), rc AS (SELECT DISTINCT page, n_rows, n_cols, r, "row" FROM g),
e AS (SELECT rc.*, x.k FROM rc JOIN (SELECT DISTINCT page, k FROM g) x USING (page)), h AS (SELECT e.*, CASE WHEN e."row" = 0 THEN 'th' ELSE 'td' END AS tag, g.text FROM e LEFT JOIN g USING (page, r, k)),
l AS (SELECT page, n_rows, n_cols, r, concat('<tr>', string_agg(CASE WHEN text IS NULL THEN concat('<', tag, '></', tag, '>') ELSE concat('<', tag, ' >', text, '</', tag, '>') END, '' ORDER BY k), '</tr>') AS line FROM h GROUP BY ALL)
SELECT page, CAST(n_rows AS INT) AS n_rows, CAST(n_cols AS INT) AS n_cols, 0 AS n_spans, sha256(concat('<table>', {NL}, string_agg(line, {NL} ORDER BY r), {NL}, '</table>')) AS digest FROM l GROUP BY page, n_rows, n_cols""")
def tables_built(spark, sf_dir):
    return tables.tables(_cells(spark, sf_dir), described=False).select("page", "n_rows", "n_cols", "n_spans", F.sha2("html", 256).alias("digest"))


@query("tables_described", f"""WITH {_WHOLE}, g AS (SELECT page, n_cols, r, k, "row", CASE WHEN "row" = 0 THEN string_agg(trim(text), ' ' ORDER BY x0, box) ELSE string_agg(trim(text), '' ORDER BY x0, box) END AS text FROM t GROUP BY page, n_cols, r, k, "row"), h AS (SELECT page, k, text AS title FROM g WHERE "row" = 0), x AS (SELECT DISTINCT page, true AS titled FROM h),
l AS (SELECT g.page, r, CASE WHEN x.titled IS NULL AND n_cols <= 2 THEN string_agg(text, '：' ORDER BY k) ELSE string_agg(CASE WHEN title IS NULL THEN text ELSE concat(title, '：', text) END, '; ' ORDER BY k) END AS line FROM g LEFT JOIN h USING (page, k) LEFT JOIN x USING (page) WHERE "row" <> 0 GROUP BY g.page, r, x.titled, n_cols)
SELECT page, line FROM l""")
def tables_described(spark, sf_dir):
    return tables.tables(_cells(spark, sf_dir), html=False).select("page", F.explode("described").alias("line"))


# Order lines as characters on pages of 32 orders, half of them as boxes.
_PAGE = {"doc_id": "l_orderkey % 50", "page": "l_orderkey"}
_CHAR = _PAGE | {"char": "l_linenumber * 100000 + l_partkey", "text": "CASE WHEN l_partkey % 9 = 0 THEN ' ' ELSE 'x' END", "x0": "CAST(l_partkey % 300 AS DOUBLE)", "x1": "CAST(l_partkey % 300 + 6 AS DOUBLE)", "top": "CAST(l_suppkey * 7 % 200 AS DOUBLE)", "bottom": "CAST(l_suppkey * 7 % 200 + 2 + l_partkey % 11 AS DOUBLE)"}
_WORD = _PAGE | {"box": "l_linenumber * 100000 + l_suppkey", "x0": "CAST(l_suppkey % 150 AS DOUBLE)", "x1": "CAST(l_suppkey % 150 + 180 AS DOUBLE)", "top": "CAST(l_partkey % 150 AS DOUBLE)", "bottom": "CAST(l_partkey % 150 + 12 + l_suppkey % 30 AS DOUBLE)"}
_FIRST = "QUALIFY row_number() OVER (PARTITION BY page, {0} ORDER BY x0, top, bottom) = 1"


def _first(df, name):
    return df.groupBy("doc_id", "page", name).agg(F.min_by(F.struct(*[c for c in df.columns if c not in ("doc_id", "page", name)]), F.struct("x0", "top", "bottom")).alias("r")).select("doc_id", "page", name, "r.*")


@query("characters_in_boxes", f"""WITH {boxes_sql("c0", "lineitem", _CHAR)}, {boxes_sql("b0", "lineitem WHERE l_linenumber < 4", _WORD)}, c AS (FROM c0 {_FIRST.format("char")}), b AS (FROM b0 {_FIRST.format("box")}),
p AS (SELECT c.page, char, box, c.text, c.bottom - c.top AS h, b.bottom - b.top AS bh, greatest(0, least(c.x1, b.x1) - greatest(c.x0, b.x0)) * greatest(0, least(c.bottom, b.bottom) - greatest(c.top, b.top)) AS a, (c.x1 - c.x0) * (c.bottom - c.top) AS mine, (b.x1 - b.x0) * (b.bottom - b.top) AS its FROM c JOIN b USING (doc_id, page)),
q AS (FROM p WHERE a / mine >= 0.3 QUALIFY row_number() OVER (PARTITION BY page, char ORDER BY a / mine DESC, a / its DESC, box DESC) = 1) SELECT page, char, box FROM q WHERE abs(h - bh) / greatest(h, bh) < 0.7 OR text = ' '""")
def characters_in_boxes(spark, sf_dir):
    chars = _first(rows_of(spark, sf_dir, "lineitem", _CHAR), "char")
    words = _first(table(spark, sf_dir, "lineitem").filter("l_linenumber < 4").selectExpr(*[f"{e} AS `{c}`" for c, e in _WORD.items()]).distinct(), "box")
    return characters.assigned(chars, words).select("page", "char", "box")


@query("box_texts", r"""SELECT conv_id AS doc_id, turn AS box, sha256(regexp_replace(regexp_replace(text, ' +', ' ', 'g'), '(^|[^0-9a-zA-Zа-яА-Я,.?;:!%]) ', '\1', 'g')) AS digest FROM conversations WHERE text <> ''""")
def box_texts(spark, sf_dir):
    """Each turn is a line of a conversation's page, and each of its signs a character there."""
    turns = table(spark, sf_dir, "conversations").filter("text <> ''").select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("page"), F.col("turn").cast("long").alias("box"), "text", (F.col("turn") * 14.0).alias("top"))
    boxes = turns.select("doc_id", "page", "box", F.lit(0.0).alias("x0"), (F.length("text") * 6.0).alias("x1"), "top", (F.col("top") + 12).alias("bottom"))
    signs = turns.select("doc_id", "page", "box", F.posexplode(F.split("text", "")).alias("n", "text"), (F.col("top") + 1).alias("top"))
    chars = signs.select("doc_id", "page", (F.col("box") * 10000000 + F.col("n")).alias("char"), "text", (F.col("n") * 6.0).alias("x0"), (F.col("n") * 6.0 + 5).alias("x1"), "top", (F.col("top") + 10).alias("bottom"))
    return characters.texts(chars, boxes).select("doc_id", "box", F.sha2("text", 256).alias("digest"))


@query("reading_measures", """WITH p AS (SELECT l_orderkey % 50 AS doc_id, l_orderkey AS page, count(*) AS n FROM lineitem GROUP BY ALL), d AS (SELECT doc_id, count(*) AS pages, sum(n) AS n FROM p GROUP BY doc_id),
b AS (SELECT l_orderkey % 50 AS doc_id, avg(CAST(l_quantity AS DOUBLE)) AS t, sum((l_suppkey % 90 + 20) * (l_partkey % 200 + 8)) AS covered FROM lineitem GROUP BY 1), y AS (SELECT l_orderkey % 50 AS doc_id, avg(CAST(l_quantity AS DOUBLE)) AS s FROM lineitem WHERE l_linenumber = 5 GROUP BY 1)
SELECT doc_id, round(t, 9) AS text_confidence, round(coalesce(s, 1), 9) AS layout_confidence, round(least(1.0, covered / (pages * 480000.0)), 9) AS coverage, n < 4 * pages AS scanned FROM d JOIN b USING (doc_id) LEFT JOIN y USING (doc_id)""")
def reading_measures(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 50 AS doc_id", "l_orderkey AS page", "l_linenumber", "CAST(l_quantity AS DOUBLE) AS score", "0D AS x0", "CAST(l_suppkey % 90 + 20 AS DOUBLE) AS x1", "0D AS top", "CAST(l_partkey % 200 + 8 AS DOUBLE) AS bottom")
    pages = lines.select("doc_id", "page").distinct().withColumns({"width": F.lit(600.0), "height": F.lit(800.0)})
    out = characters.reading_measures(pages, lines, lines.filter("l_linenumber = 5"), lines, few=4)
    return out.select("doc_id", *[F.round(c, 9).alias(c) for c in ("text_confidence", "layout_confidence", "coverage")], "scanned")


# Lines of a page, one below the other, some indented beyond or far below the one before.
_LINE = {
    "doc_id": "l_orderkey % 50", "page": "l_orderkey // 4", "box": "l_orderkey * 10000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber", "x0": "CAST(l_suppkey % 4 * 60 AS DOUBLE)", "x1": "CAST(l_suppkey % 4 * 60 + 80 + l_partkey % 100 AS DOUBLE)", "top": "CAST(l_orderkey % 4 * 160 + l_linenumber * 14 + l_partkey % 3 * 9 AS DOUBLE)", "bottom": "CAST(l_orderkey % 4 * 160 + l_linenumber * 14 + l_partkey % 3 * 9 + 10 AS DOUBLE)",
    "text": "CASE l_partkey % 7 WHEN 0 THEN 'It ends!' WHEN 1 THEN 'and so on,' WHEN 2 THEN ' ' WHEN 3 THEN '? really' WHEN 4 THEN 'a' WHEN 5 THEN 'quoted?''' ELSE ' plain words ' END", "layoutno": "l_suppkey % 5 // 4",
}


@query("paragraphs_merged", rf"""WITH RECURSIVE {boxes_sql("x", "lineitem", _LINE)}, o AS (SELECT *, trim(text) AS t, row_number() OVER w AS i, count(*) OVER (PARTITION BY doc_id, page) AS most FROM x WINDOW w AS (PARTITION BY doc_id, page ORDER BY top, x0, box)),
s AS (SELECT doc_id, page, i, most, 1 AS p, x0, x1, top, bottom, layoutno, t AS text, 1 AS began FROM o WHERE i = 1 UNION ALL
SELECT o.doc_id, o.page, o.i, o.most, s.p + CASE WHEN m THEN 0 ELSE 1 END, CASE WHEN m THEN least(s.x0, o.x0) ELSE o.x0 END, CASE WHEN m THEN greatest(s.x1, o.x1) ELSE o.x1 END, CASE WHEN m THEN s.top ELSE o.top END, o.bottom, o.layoutno, CASE WHEN m THEN trim(concat(s.text, ' ', o.t)) ELSE o.t END, CASE WHEN m THEN s.began ELSE o.i END
FROM s JOIN o ON o.doc_id = s.doc_id AND o.page = s.page AND o.i = s.i + 1, LATERAL (SELECT s.text <> '' AND s.layoutno = o.layoutno AND o.top - s.bottom <= 15 AND greatest(0, least(s.x1, o.x1) - greatest(s.x0, o.x0)) / greatest(1, least(s.x1 - s.x0, o.x1 - o.x0)) >= 0.3
AND (NOT regexp_matches(s.text, '[。？！?.!]$') OR regexp_matches(s.text, '[,;:''"，、’”；：-]$') OR regexp_matches(s.text, '[,;:''"，’”、；：].$') OR regexp_matches(o.t, '^[。；？！?”）),，、：]')) AS m))
SELECT page, sha256(concat(text, '|', x0, '|', x1, '|', top, '|', bottom)) AS digest FROM s WHERE (text <> '' OR i = most) QUALIFY i = max(i) OVER (PARTITION BY doc_id, page, p)""")
def paragraphs_merged(spark, sf_dir):
    boxes = rows_of(spark, sf_dir, "lineitem", {c: e.replace("//", "DIV").replace("'quoted?'''", "\"quoted?'\"") for c, e in _LINE.items()}).withColumn("mean_height", F.lit(10.0))
    number = lambda c: F.concat(F.lit("|"), F.col(c).cast("string"))
    return paragraphs.merged_paragraphs(boxes, english=True).select("page", F.sha2(F.concat("text", *map(number, ("x0", "x1", "top", "bottom"))), 256).alias("digest"))


_COLUMN = {"doc_id": "l_orderkey // 3200", "page": "l_orderkey // 64", "box": "l_orderkey * 10000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber", "x0": "CAST(l_linenumber % (1 + l_orderkey // 64 % 4) * 150 AS DOUBLE)", "x1": "CAST(l_linenumber % (1 + l_orderkey // 64 % 4) * 150 + 120 AS DOUBLE)"}


@query("page_columns", f"""WITH {boxes_sql("b", "lineitem", _COLUMN)}, v AS (SELECT page, count(DISTINCT x0) AS n FROM b GROUP BY page) SELECT page, box, CAST(dense_rank() OVER (PARTITION BY page ORDER BY x0) - 1 AS INT) AS "column", CAST(n AS INT) AS columns FROM b JOIN v USING (page)""")
def page_columns(spark, sf_dir):
    return paragraphs.page_columns(rows_of(spark, sf_dir, "lineitem", {c: e.replace("//", "DIV") for c, e in _COLUMN.items()})).select("page", "box", "column", "columns")


@query("document_columns", f"""WITH {boxes_sql("b", "lineitem", _COLUMN)}, v AS (SELECT doc_id, page, count(DISTINCT x0) AS n FROM b GROUP BY ALL), g AS (SELECT doc_id, n, count(*) AS c FROM v GROUP BY ALL) SELECT doc_id, CAST(n AS INT) AS columns, CAST(sum(c) OVER (PARTITION BY doc_id) AS BIGINT) AS pages FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, n) = 1""")
def document_columns(spark, sf_dir):
    boxes = rows_of(spark, sf_dir, "lineitem", {c: e.replace("//", "DIV") for c, e in _COLUMN.items()})
    return paragraphs.document_columns(paragraphs.page_columns(boxes))


_NEAR = {"doc_id": "l_orderkey % 50", "page": "l_orderkey // 8", "box": "l_orderkey * 10000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber", "x0": "CAST(l_partkey % 300 AS DOUBLE)", "x1": "CAST(l_partkey % 300 + 9 AS DOUBLE)", "top": "CAST(l_linenumber * 20 + l_suppkey % 8 AS DOUBLE)", "bottom": "CAST(l_linenumber * 20 + l_suppkey % 8 + 9 AS DOUBLE)"}
_PLACE = f"""WITH {boxes_sql("b", "lineitem", _NEAR)} SELECT page, box, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY CAST(floor(top / 20) AS INT), x0, {{0}}) - 1 AS INT) AS place FROM b"""


def _near(spark, sf_dir):
    return rows_of(spark, sf_dir, "lineitem", {c: e.replace("//", "DIV") for c, e in _NEAR.items()})


@query("tolerant_order", _PLACE.format("box"))
def tolerant_order(spark, sf_dir):
    return layout.placed(_near(spark, sf_dir), lambda boxes: layout.tolerant(boxes, "top", "x0", 10)).select("page", "box", "place")


@query("line_order", _PLACE.format("top, box"))
def line_order(spark, sf_dir):
    return layout.placed(_near(spark, sf_dir), layout.line_order).select("page", "box", "place")


# Orders in pairs of one kind on one place, pairs apart; some without a score.
_TWIN = {"doc_id": "o_orderkey // 400", "page": "o_orderkey // 40", "layout": "o_orderkey", "kind": "CASE WHEN o_orderkey // 2 % 2 = 0 THEN 'table' ELSE 'text' END", "score": "CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE CAST(o_custkey % 7 AS DOUBLE) END", "x0": "CAST(o_orderkey // 2 % 20 * 100 AS DOUBLE)", "x1": "CAST(o_orderkey // 2 % 20 * 100 + 70 + o_orderkey % 2 * 9 AS DOUBLE)", "top": "0.0", "bottom": "50.0"}


@query("layouts_cleaned", f"""WITH {boxes_sql("l", "orders", _TWIN)}, p AS (SELECT *, count(*) OVER w AS n, count(nullif(score, 0)) OVER w AS scores, row_number() OVER (PARTITION BY layout // 2 ORDER BY layout) AS i FROM l WINDOW w AS (PARTITION BY layout // 2)),
q AS (SELECT *, CASE WHEN scores = 2 THEN score ELSE x1 - x0 END AS value FROM p) SELECT page, layout FROM q QUALIFY row_number() OVER (PARTITION BY layout // 2 ORDER BY value DESC, layout DESC) = 1""")
def layouts_cleaned(spark, sf_dir):
    columns = {c: e.replace("//", "DIV").replace("0.0", "0D").replace("'text' END", "'text' END").replace("50D", "50.0D") for c, e in _TWIN.items()} | {"top": "0D", "bottom": "50D"}
    twins = rows_of(spark, sf_dir, "orders", columns)
    pages = twins.select("doc_id", "page").distinct().selectExpr("doc_id", "page", "0D AS x0", "10000D AS x1", "0D AS top", "90D AS bottom")
    return layout.without_lookalikes(twins, pages).select("page", "layout")


@query("right_to_left", r"SELECT doc_id, sha256(array_to_string(list_reverse(regexp_extract_all(text, '(?s)[a-zA-Z0-9 :*./%+-]+|[^a-zA-Z0-9 :*./%+-]')), '')) AS digest FROM documents")
def right_to_left(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(layout.right_to_left(F.col("text")), 256).alias("digest"))


@query("vision_prompts", rf"""SELECT conv_id, turn, sha256(json_extract_string(m, '$[1].content[0].image_url.url')) AS image, sha256(json_extract_string(m, '$[1].content[1].text')) AS asked, json_extract_string(m, '$[0].content') AS system, CAST(json_array_length(m) AS INT) AS messages
FROM (SELECT conv_id, turn, to_json([{{'role': 'system', 'content': 'Correct one page.'}}::JSON, {{'role': 'user', 'content': [{{'type': 'image_url', 'image_url': {{'url': concat('data:image/png;base64,', base64(encode(role))), 'detail': 'high'}}}}::JSON, {{'type': 'text', 'text': concat('As shown:', {NL}, {NL}, '```markdown', {NL}, text, {NL}, '```')}}::JSON]}}::JSON]) AS m FROM conversations)""")
def vision_prompts(spark, sf_dir):
    """Prompts of pages whose image stands in them; what a reader of their JSON finds."""
    turns = table(spark, sf_dir, "conversations")
    m = decisions.vision_messages(decisions.data_uri(F.col("role").cast("binary")), F.col("text"), "Correct one page.", "As shown:")
    got = lambda path: F.get_json_object("m", path)
    return turns.select("conv_id", "turn", m.alias("m")).select("conv_id", "turn", F.sha2(got("$[1].content[0].image_url.url"), 256).alias("image"), F.sha2(got("$[1].content[1].text"), 256).alias("asked"), got("$[0].content").alias("system"), F.json_array_length("m").alias("messages"))
