"""Recognised pages: tables with spans, characters by tiles, paragraphs, columns and orders with a tolerance, against plain versions."""

import random
from functools import cmp_to_key
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnfold.operators import characters, layout, paragraphs, tables
from tarnfold.operators.grouped import plain

CELL = "doc_id long, page int, table int, box long, x0 double, x1 double, top double, bottom double, text string, kind string"
BAND = "doc_id long, page int, table int, band int, kind string, x0 double, x1 double, top double, bottom double"


def cell(box, r, c, text, kind="table", page=0):
    return (1, page, 0, box, c * 100.0 + 5, c * 100.0 + 60, r * 20.0 + 2, r * 20.0 + 16, text, kind)


def bands(rows, cols, header=(), spanning=(), page=0):
    out = [(1, page, 0, 10 + r, "row", 0.0, cols * 100.0, r * 20.0, r * 20.0 + 18) for r in range(rows)]
    out += [(1, page, 0, 30 + c, "column", c * 100.0, c * 100.0 + 90, 0.0, rows * 20.0) for c in range(cols)]
    out += [(1, page, 0, 50 + r, "header", 0.0, cols * 100.0, r * 20.0, r * 20.0 + 18) for r in header]
    return out + [(1, page, 0, 70 + n, "spanning", *area) for n, area in enumerate(spanning)]


def test_a_table_with_spans(spark):
    cells = [cell(1, 0, 0, "Area"), cell(2, 0, 1, "Sums"), cell(3, 1, 1, "old"), cell(4, 1, 2, "new"), cell(5, 2, 0, "North"), cell(6, 2, 1, "7"), cell(7, 2, 2, "9"), cell(8, 3, 0, "South"), cell(9, 3, 1, "8"), (1, 0, 0, 0, 0.0, 90.0, -20.0, -8.0, "Year", "table caption")]
    found = bands(4, 3, header=(0, 1), spanning=[(100.0, 290.0, 0.0, 18.0), (0.0, 90.0, 0.0, 38.0)])
    r = tables.tables(tables.tagged(spark.createDataFrame(cells, CELL), spark.createDataFrame(found, BAND)), english=True).first()
    assert (r["n_rows"], r["n_cols"], r["n_spans"], r["caption"]) == (4, 3, 2, " Year")
    assert r["html"].split("\n") == ["<table><caption> Year</caption>", "<tr><th  rowspan=2>Area</th><th colspan=2>Sums</th></tr>", "<tr><th >old</th><th >new</th></tr>", "<tr><td >North</td><td >7</td><td >9</td></tr>", "<tr><td >South</td><td >8</td><td></td></tr>", "</table>"]
    assert r["described"] == [f"{a}\t—— in “ Year”" for a in ("Area：North; Sums for old：7; Sums for new：9", "Area：South; Sums for old：8")]


def test_spans_are_the_lines_whose_middle_they_hold():
    rng = random.Random(3)
    for _ in range(60):
        rows, cols = rng.randint(2, 5), rng.randint(2, 5)
        r0, c0 = rng.randrange(rows), rng.randrange(cols)
        r1, c1 = rng.randrange(r0, rows), rng.randrange(c0, cols)
        grid = {}
        for r in range(rows):
            for c in range(cols):
                grid[r, c] = [{"text": f"{r}.{c}", "x0": c * 100.0, "x1": c * 100.0 + 60, "top": r * 20.0, "bottom": r * 20.0 + 12, "row_top": None, "col_left": None, "col_right": None, "moved": set(), "area_left": None}]
        grid[r0, c0][0] |= {"area_left": c0 * 100.0, "area_right": c1 * 100.0 + 60, "area_top": r0 * 20.0, "area_bottom": r1 * 20.0 + 12}
        spans = tables.spans_merged(grid, [rows, cols])
        inside = [(r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)]
        assert spans == ({(r0, c0): (r1 - r0 + 1, c1 - c0 + 1)} if len(inside) > 1 else {})
        assert [b["text"] for b in grid[r0, c0]] == [f"{r}.{c}" for r, c in inside] and len(grid) == rows * cols - len(inside) + 1


def test_cells_without_bands_and_lone_columns(spark):
    cells = [cell(10 * r + c, r, c, f"t{r}{c}") for r in range(5) for c in (0, 2)] + [(1, 0, 0, 99, 70.0, 90.0, 42.0, 56.0, "!", "table")]
    cells = [c for c in cells if c[3] != 20] + [cell(200, 0, 0, "other page", page=1), (1, 2, 0, 300, 0.0, 9.0, 0.0, 9.0, "图 1：x", "table"), (1, 3, 0, 400, 0.0, 9.0, 0.0, 9.0, None, None)]
    none = spark.createDataFrame([], BAND)
    got = {r["page"]: r for r in tables.tables(tables.tagged(spark.createDataFrame(cells, CELL), none)).collect()}
    assert (got[0]["n_rows"], got[0]["n_cols"]) == (5, 2) and "<td >!</td><td >t22</td>" in got[0]["html"]
    assert (got[1]["n_rows"], got[1]["n_cols"], got[1]["html"]) == (1, 1, "<table>\n<tr><td >other page</td></tr>\n</table>")
    assert (got[2]["html"], got[2]["caption"], got[2]["n_rows"]) == ("", "图 1：x", 0) and got[3]["n_rows"] == 1
    assert tables.tables(tables.tagged(spark.createDataFrame([], CELL), none)).count() == 0


def test_a_page_of_very_many_characters_is_dealt_over_its_tiles(spark):
    n = 100_000
    at = F.col("id").cast("double")
    chars = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(0).alias("page"), F.col("id").alias("char"), F.lit("x").alias("text"), (at % 400 * 6).alias("x0"), (at % 400 * 6 + 5).alias("x1"), (F.floor(at / 400) * 12.0).alias("top"), (F.floor(at / 400) * 12.0 + 10).alias("bottom"))
    boxes = spark.range(n // 40).select(F.lit(1).alias("doc_id"), F.lit(0).alias("page"), F.col("id").alias("box"), (at % 10 * 240).alias("x0"), (at % 10 * 240 + 239).alias("x1"), (F.floor(at / 10) * 12.0).alias("top"), (F.floor(at / 10) * 12.0 + 11).alias("bottom"))
    tiled = characters._by_tile(chars, characters.TILE).groupBy("_across", "_down").count().agg(F.max("count"), F.count("*")).first()
    assert tiled[0] <= 100 and tiled[1] > 1000
    got = characters.assigned(chars, boxes)
    assert got.count() == n and got.filter("box <> (char DIV 400) * 10 + (char % 400) DIV 40").count() == 0
    assert characters.pairs(chars, boxes).count() == characters.pairs(chars, boxes, side=7.0).count()


def test_which_characters_a_box_takes(spark):
    boxes = spark.createDataFrame([(1, 0, 1, 0.0, 50.0, 0.0, 12.0), (1, 0, 2, 40.0, 90.0, 0.0, 12.0)], "doc_id int, page int, box int, x0 double, x1 double, top double, bottom double")
    rows = [(1, "a", 0.0, 5.0, 1.0, 11.0), (2, " ", 6.0, 8.0, 1.0, 2.0), (3, "b", 9.0, 14.0, 1.0, 11.0), (4, "c", 43.0, 48.0, 1.0, 11.0), (5, "tall", 60.0, 65.0, 0.0, 3.0), (6, "off", 88.0, 100.0, 0.0, 11.0), (7, "é", 70.0, 74.0, 1.0, 11.0), (8, " ", 75.0, 76.0, 1.0, 11.0), (9, None, 80.0, 85.0, 1.0, 11.0)]
    chars = spark.createDataFrame([(1, 0, *r) for r in rows], "doc_id int, page int, char int, text string, x0 double, x1 double, top double, bottom double")
    assert dict(characters.assigned(chars, boxes).select("char", "box").collect()) == {1: 1, 2: 1, 3: 1, 4: 2, 7: 2, 8: 2, 9: 2}
    assert dict(characters.texts(chars, boxes).select("box", "text").collect()) == {1: "a b", 2: "cé"}


def test_characters_of_many_groups_are_ordered_at_once():
    rng = random.Random(4)
    rows, sizes = [], []
    for g in range(300):
        sizes.append(rng.randint(1, 12))
        step = rng.choice([0.0, 1.0, 3.0, 12.0])  # lines that lie apart, and ones that run into each other
        rows.append([{"n": n, "top": rng.randint(0, 5) * step, "x0": float(rng.randint(0, 6)), "bottom": 0.0} for n in range(sizes[-1])])
        for r in rows[-1]:
            r["bottom"] = r["top"] + rng.choice([0.0, 6.0, 10.0]) * (g % 5 > 0)
    want, begin = [], 0
    for group in rows:
        mean = sum(r["bottom"] - r["top"] for r in group) / len(group)
        want += [begin + r["n"] for r in layout.tolerant(group, "top", "x0", mean)]
        begin += len(group)
    flat = [r for group in rows for r in group]
    edges = [np.array([r[c] for r in flat]) for c in ("top", "bottom", "x0")]
    assert characters.in_lines(np.repeat(np.arange(300), sizes), *edges).tolist() == want


def test_characters_of_any_size_find_their_boxes_and_travel_with_what_they_hold(spark):
    rng = random.Random(6)
    edges = lambda most: (x := rng.uniform(-150, 300), x + rng.uniform(1, most), y := rng.uniform(-150, 300), y + rng.uniform(1, most))
    chars = [(1, 0, n, rng.choice(["a", " ", "", None, "xy"]), *edges(rng.choice([8, 60, 200]))) for n in range(300)]
    boxes = [(1, 0, n, *edges(250)) for n in range(60)]
    kind = "x0 double, x1 double, top double, bottom double"
    c, b = spark.createDataFrame(chars, f"doc_id int, page int, char int, text string, {kind}"), spark.createDataFrame(boxes, f"doc_id int, page int, box int, {kind}")
    area = lambda x, y: max(0, min(x[-3], y[-3]) - max(x[-4], y[-4])) * max(0, min(x[-1], y[-1]) - max(x[-2], y[-2]))
    want = {(x[2], y[2]) for x in chars for y in boxes if area(x, y) > 0}
    got = [tuple(r) for r in characters.pairs(c, b).select("char", "box").collect()]
    assert len(got) == len(want) and set(got) == want
    held: dict[int, list] = {}
    for n, box in sorted(characters.assigned(c, b).select("char", "box").collect()):
        held.setdefault(box, []).append(chars[n])
    for r in characters.texts(c, b).collect():
        mean = sum(x[7] - x[6] for x in held[r["box"]]) / len(held[r["box"]])
        text = ""
        for x in layout.tolerant([{"text": x[3] or "", "top": x[6], "x0": x[4]} for x in held[r["box"]]], "top", "x0", mean):
            text += x["text"] if x["text"] != " " or not text else " " * bool(characters.BEFORE_BLANK.match(text[-1]))
        assert r["text"] == text
    plan = characters.texts(c.filter("x1 - x0 < 9"), b)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 2  # characters of either size with boxes; what they hold travels along


def test_lines_that_lie_apart_are_ordered_as_by_comparisons():
    rng, found = random.Random(9), 0
    for _ in range(400):
        step, tolerance = rng.choice([0.0, 1.0, 4.0, 10.0]), rng.choice([0.0, 2.0, 5.0])
        boxes = [{"n": n, "top": rng.randint(0, 6) * step + rng.choice([0.0, 0.5]), "x0": float(rng.randint(0, 5))} for n in range(rng.randint(9, 40))]
        boxes[0]["x0"] = rng.choice([1.0, float("nan")])
        by = lambda a, b: (d > 0) - (d < 0) if abs(d := a["top"] - b["top"]) >= tolerance else (a["x0"] > b["x0"]) - (a["x0"] < b["x0"])  # noqa: E731, B023
        assert [b["n"] for b in layout.tolerant(boxes, "top", "x0", tolerance)] == [b["n"] for b in sorted(boxes, key=cmp_to_key(by))]
        found += bool(tolerance > 0 and layout._by_lines([(b["top"], b["x0"], b["n"]) for b in boxes], tolerance))
    assert 50 < found < 400


def test_rows_of_a_group_hold_plain_values():
    values = [plain(pd.Series(v)) for v in ([1, 2], [1.5, float("nan")], [True, False], ["a", None], np.array([3, 4], np.int32), [np.array([1, 2]), None])]
    assert values[:5] == [[1, 2], [1.5, None], [True, False], ["a", None], [3, 4]] and values[5][0].tolist() == [1, 2] and values[5][1] is None
    assert {type(x) for v in values[:5] for x in v} == {int, float, bool, str, type(None)}


def plain_paragraphs(lines, english):
    """A page's lines (top, x0, box, x1, bottom, text, layoutno), joined one after the other."""
    out = []
    for n, (top, x0, _, x1, bottom, text, layoutno) in enumerate(sorted(lines, key=lambda b: b[:3])):
        last, t = out[-1] if out else None, text.strip()
        if last:
            end = last["text"][-1:] or "x"
            wide = max(1, min(last["x1"] - last["x0"], x1 - x0))
            on = end in paragraphs.GOES_ON or (len(last["text"]) > 1 and last["text"][-2] in paragraphs.GOES_ON_BEFORE) or (t != "" and t[0] in paragraphs.GOES_ON_NEXT)
            over = end in paragraphs.ENDS or (english and end in ".!?")
            if last["text"] and last["layoutno"] == layoutno and top - last["bottom"] <= 15 and max(0, min(last["x1"], x1) - max(last["x0"], x0)) / wide >= 0.3 and (on or not over):
                last.update(text=f"{last['text']} {t}".strip(), bottom=bottom, x0=min(last["x0"], x0), x1=max(last["x1"], x1))
                continue
            if not last["text"]:
                out.pop()
        out.append({"text": t, "x0": x0, "x1": x1, "top": top, "bottom": bottom, "layoutno": layoutno})
    return [(b["text"], b["x0"], b["x1"], b["top"], b["bottom"]) for b in out]


@pytest.mark.parametrize("english", [False, True])
def test_paragraphs(spark, english):
    rng = random.Random(8)
    texts = ["It ends!", "so on,", " ", "？ next", "a", ",", "said.'", " plain ", "？", ""]
    rows = [(p, float(rng.randint(0, 25) * 9), float(rng.randint(0, 5) * 40), n, rng.choice(texts), rng.choice([0, 0, 1, None])) for p in range(40) for n in range(rng.randint(1, 14))]
    rows = [(1, p, n, x0, x0 + 30 + n * 10, top, top + 10, t, lay, 10.0) for p, top, x0, n, t, lay in rows]
    boxes = spark.createDataFrame(rows, "doc_id int, page int, box int, x0 double, x1 double, top double, bottom double, text string, layoutno int, mean_height double")
    got = paragraphs.merged_paragraphs(boxes, english).orderBy("page", "paragraph").collect()
    for p in range(40):
        want = plain_paragraphs([(r[5], r[3], r[2], r[4], r[6], r[7], r[8]) for r in rows if r[1] == p], english)
        assert [tuple(r[c] for c in ("text", "x0", "x1", "top", "bottom")) for r in got if r["page"] == p] == want


def test_paragraphs_without_a_mean_height_and_without_joins(spark):
    rng = random.Random(12)
    rows = [(1, p, n, 0.0, 90.0, float(n * 25), n * 25 + rng.choice([8.0, 16.0]), rng.choice(["a", " ", "b."]), 0, rng.choice([0.0, -1.0])) for p in range(30) for n in range(rng.randint(1, 9))]
    tall = {p: float(np.median([r[6] - r[5] for r in rows if r[1] == p])) for p in range(30)}
    kind = "doc_id int, page int, box int, x0 double, x1 double, top double, bottom double, text string, layoutno int, mean_height double"
    known = spark.createDataFrame([(*r[:9], tall[r[1]]) for r in rows], kind)
    got = paragraphs.merged_paragraphs(spark.createDataFrame(rows, kind), True)
    texts = lambda df: sorted(tuple(r) for r in df.select("page", "paragraph", "text", "top", "bottom").collect())
    assert texts(got) == texts(paragraphs.merged_paragraphs(known, True)) and len(set(tall.values())) > 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("Exchange") == 1


def test_groups_on_a_line_are_the_best_ones():
    rng = np.random.default_rng(2)
    for _ in range(150):
        values = np.unique(rng.integers(0, 40, rng.integers(1, 9)).astype(float))
        counts = rng.integers(1, 4, len(values))
        points = np.repeat(values, counts)
        spread = lambda cut: sum(np.repeat(values[a:b], counts[a:b]).var() * counts[a:b].sum() for a, b in zip(cut, [*cut[1:], len(values)], strict=True))
        for k in range(1, min(4, len(values)) + 1):
            begins = paragraphs.clusters(values, counts, k)
            assert abs(spread([*begins]) - min(spread([0, *c]) for c in combinations(range(1, len(values)), k - 1))) < 1e-6
            if 1 < k < len(points):
                label = np.repeat(np.searchsorted(begins, np.arange(len(values)), side="right"), counts)
                far, score = np.abs(points[:, None] - points), []
                for i in range(len(points)):
                    own = label == label[i]
                    near = min(far[i][label == g].mean() for g in set(label) - {label[i]})
                    a = far[i][own].sum() / max(1, own.sum() - 1)
                    score.append((near - a) / max(a, near) if own.sum() > 1 else 0)
                assert abs(paragraphs.silhouette(values, counts, begins) - np.mean(score)) < 1e-9


def test_columns_of_pages_and_documents(spark):
    rows = [(1, p, n, x + n * n % 11 * 0.7, x + 100.0) for p, starts in enumerate([(0, 300), (0, 300), (0, 200, 400), (50,)]) for n, x in enumerate(float(s) for s in starts for _ in range(6))]
    boxes = spark.createDataFrame([*rows, (2, 0, 0, 5.0, 9.0)], "doc_id int, page int, box int, x0 double, x1 double")
    got = paragraphs.page_columns(boxes)
    assert {(r["doc_id"], r["page"]): r["columns"] for r in got.collect()} == {(1, 0): 2, (1, 1): 2, (1, 2): 3, (1, 3): 1, (2, 0): 1}
    assert [r["column"] for r in got.filter("doc_id = 1 AND page = 2").orderBy("box").collect()] == [0] * 6 + [1] * 6 + [2] * 6
    assert sorted(tuple(r) for r in paragraphs.document_columns(got).collect()) == [(1, 2, 4), (2, 1, 1)]


def test_orders_with_a_tolerance_on_near_ties(spark):
    rng = random.Random(4)
    for _ in range(200):
        rows = [{"top": rng.choice([0, 6, 12, 18, 30]), "x0": rng.choice([0, 5, 9]), "box": n} for n in range(rng.randint(1, 7))]
        got = layout.line_order(rows)
        want = sorted(rows, key=lambda b: (b["top"], b["x0"]))
        for i in range(len(want) - 1):  # neighbours change places while that helps
            while i >= 0 and abs(want[i + 1]["top"] - want[i]["top"]) < 10 and want[i + 1]["x0"] < want[i]["x0"]:
                want[i], want[i + 1] = want[i + 1], want[i]
                i -= 1
        assert got == want
        two = layout.tolerant(rows[:2], "top", "x0", 10)  # of two boxes the rule itself is the order
        if len(two) == 2:
            a, b = two
            assert (a["top"] < b["top"]) if abs(a["top"] - b["top"]) >= 10 else a["x0"] <= b["x0"]
    exact = layout.tolerant(rows, "top", "x0", 0)
    assert exact == sorted(rows, key=lambda b: b["top"])


def test_lookalikes_within_reach_go(spark):
    of = lambda n, x, kind="text", score=None: (1, 0, n, kind, score, x, x + 100.0, 0.0, 10.0)
    rows = [of(0, 0.0, score=0.5), of(1, 4.0, score=0.9), of(2, 8.0, score=0.9), of(3, 300.0), of(4, 0.0, "title"), of(5, 302.0), of(6, 600.0), of(7, 900.0), of(8, 600.0)]
    layouts = spark.createDataFrame(rows, "doc_id int, page int, layout int, kind string, score double, x0 double, x1 double, top double, bottom double")
    boxes = spark.createDataFrame([(1, 0, 1, 395.0, 402.0, 0.0, 10.0)], "doc_id int, page int, box int, x0 double, x1 double, top double, bottom double")
    left = lambda far: sorted(r["layout"] for r in layout.without_lookalikes(layouts, boxes, far).collect())
    assert left(2) == [2, 3, 4, 5, 6, 7, 8]  # 1 over 0, and 2 over 1 as the later of equals
    assert left(3) == [2, 4, 5, 7, 8]  # 5 covers more of the boxes than 3; of 6 and 8, which cover alike, the later


def test_right_to_left(spark):
    rows = spark.createDataFrame([("שלום 12.5% abc",), ("",), (None,), ("אב",)], "t string")
    assert [r[0] for r in rows.select(layout.right_to_left(F.col("t"))).collect()] == [" 12.5% abcםולש", "", None, "בא"]


def test_wide_cells_read_from_left_to_right():
    """Boxes of a cell lie wider apart than the tolerance of columns, so the order with a tolerance is none of the cell's."""
    rng = random.Random(7)
    for _ in range(40):
        places = [(n, r, c, float(rng.randrange(120))) for n, (r, c) in enumerate((r, c) for r in range(16) for c in range(3) for _ in range(4))]
        band = {"row_height": 10.0, "header": False, "caption": False, "cell": "Ca", **dict.fromkeys(("area_left", "area_right", "area_top", "area_bottom"))}
        boxes = [{"box": n, "x0": c * 100 + x, "x1": c * 100 + x + 10, "top": r * 20.0, "bottom": r * 20.0 + 10, "text": f"{n} ", "row": r, "row_top": r * 20.0, "column": c, "col_left": c * 100.0, "col_right": c * 100.0 + 70, **band} for n, r, c, x in places]
        line = lambda r: "; ".join("".join(str(n) for _, n in sorted((x, n) for n, r0, c0, x in places if (r0, c0) == (r, c))) for c in range(3))  # noqa: E731, B023
        assert tables.built(boxes, False)["described"] == [line(r) for r in range(16)]


def test_lines_apart_sort_as_the_comparison_does():
    rng = random.Random(5)
    for step in (0, 1, 3, 10, 25):
        boxes = [{"n": n, "top": rng.randrange(6) * step + rng.choice((0, 0, 0.5, 4)), "x0": rng.randrange(5)} for n in range(rng.randrange(1, 40))]
        for near in (0, 1, 5, 9.5):
            far = lambda a, b: a["x0"] - b["x0"] if abs(a["top"] - b["top"]) < near else a["top"] - b["top"]  # noqa: E731, B023
            assert layout.tolerant(boxes, "top", "x0", near) == sorted(boxes, key=cmp_to_key(far))
