"""Geometry of page layouts over tables of boxes.

A box has doc_id, page, box (its number on the page), x0, x1, top, bottom and text. Boxes
meet layouts of their own page only, by an equality join; what depends on neighbours in
order is worked out a page at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cmp_to_key
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.functions.markdown import collapse_newlines, stripped
from tarnfold.operators.grouped import each_group, typed

PAGE = ["doc_id", "page"]
# Kinds of layouts, those that are noise, captions, and the kinds of a table cell's text, in order.
KINDS = ["text", "title", "figure", "figure caption", "table", "table caption", "header", "footer", "reference", "equation"]
NOISE = ["header", "footer", "reference"]
CAPTION = r"^[图表]+[ 0-9:：]{2,}"
CELLS = [
    (r"^(20|19)[0-9]{2}[年/-][0-9]{1,2}[月/-][0-9]{1,2}日*$", "Dt"), (r"^(20|19)[0-9]{2}年$", "Dt"), (r"^(20|19)[0-9]{2}[年-][0-9]{1,2}月*$", "Dt"), (r"^[0-9]{1,2}[月-][0-9]{1,2}日*$", "Dt"), (r"^第*[一二三四1-4]季度$", "Dt"),
    (r"^(20|19)[0-9]{2}年*[一二三四1-4]季度$", "Dt"), (r"^(20|19)[0-9]{2}[ABCDE]$", "Dt"), (r"^[0-9.,+%/ -]+$", "Nu"), (r"^[0-9A-Z/\._~-]+$", "Ca"), (r"^[A-Z]*[a-z' -]+$", "En"), (r"^[0-9.,+-]+[0-9A-Za-z/$￥%<>（）()' -]+$", "NE"), (r"^.{1}$", "Sg"),
]
FORWARD = "[a-zA-Z0-9 :*./%+-]"
ENGLISH = r"""[ a-zA-Z0-9,/;:'\[\]\(\)!@#$%^&*"?<>._-]{30,}"""


def overlap(a: str, b: str, ratio: bool = True) -> Column:
    """The area that boxes a and b (aliases) share, as a share of a's."""
    c = lambda t, n: F.col(f"{t}.{n}")
    width = F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0"))
    height = F.least(c(a, "bottom"), c(b, "bottom")) - F.greatest(c(a, "top"), c(b, "top"))
    area = F.when((width >= 0) & (height >= 0), width * height).otherwise(0.0)
    return F.when(area > 0, F.coalesce(F.try_divide(area, (c(a, "x1") - c(a, "x0")) * (c(a, "bottom") - c(a, "top"))), F.lit(0.0))).otherwise(0.0) if ratio else area


def best_layout(boxes: DataFrame, layouts: DataFrame, least: float = 0.3) -> DataFrame:
    """boxes with layout: the number of the layout of the page that covers most of the box (then: of which the box covers most; then the last), null below `least`."""
    pairs = boxes.alias("b").join(layouts.alias("l"), PAGE).select(*PAGE, "b.box", F.col("l.layout").alias("layout"), overlap("b", "l").alias("ov"), overlap("l", "b").alias("rev"))
    best = pairs.filter(F.col("ov") >= least).groupBy(*PAGE, "box").agg(F.max_by("layout", F.struct("ov", "rev", "layout")).alias("layout"))
    return boxes.join(best, [*PAGE, "box"], "left")


def nearest_column(boxes: DataFrame, columns: DataFrame) -> DataFrame:
    """boxes with column: the nearest by edges or middle among those of the page with the same layoutno, the first of equals."""
    b, c = (lambda n: F.col(f"b.{n}")), (lambda n: F.col(f"c.{n}"))
    far = F.least(F.abs(b("x0") - c("x0")), F.abs(b("x1") - c("x1")), F.abs(b("x0") + b("x1") - c("x1") - c("x0")) / 2)
    pairs = boxes.alias("b").join(columns.alias("c"), [*PAGE, "layoutno"]).select(*PAGE, "b.box", F.col("c.column").alias("column"), far.alias("far"))
    return boxes.join(pairs.groupBy(*PAGE, "box").agg(F.min_by("column", F.struct("far", "column")).alias("column")), [*PAGE, "box"], "left")


def reading_order(boxes: DataFrame) -> DataFrame:
    """boxes with nth: their place in the document, by page, column, top and left."""
    return boxes.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "column", "top", "x0", "box")))


def is_noise(kind: Column, top: Column, bottom: Column, height: Column) -> Column:
    """Headers, footers and references, but for headers below the top tenth and footers above the bottom tenth."""
    return kind.isin(NOISE) & ~((kind == "footer") & (bottom < height * 0.9)) & ~((kind == "header") & (top > height * 0.1))


def without_noise(boxes: DataFrame) -> DataFrame:
    """Boxes (with kind and page_height) that are no noise, and whose text is none that noise of one kind repeats in the document."""
    noise = F.coalesce(is_noise(F.col("kind"), F.col("top"), F.col("bottom"), F.col("page_height")), F.lit(False))
    again = boxes.filter(noise).groupBy("doc_id", "kind", "text").count().filter("count > 1").select("doc_id", F.col("text").alias("_text")).distinct()
    return boxes.filter(~noise).withColumn("_text", stripped(F.col("text"))).join(again, ["doc_id", "_text"], "left_anti").drop("_text")


def page_heights(boxes: DataFrame) -> DataFrame:
    """The mean and median height of each page's boxes, and how much of the page they cover."""
    h = F.col("bottom") - F.col("top")
    return boxes.groupBy(*PAGE).agg(F.avg(h).alias("mean_height"), F.median(h).alias("median_height"), F.least(F.lit(1.0), F.sum(h * (F.col("x1") - F.col("x0"))) / (F.max("page_width") * F.max("page_height"))).alias("coverage"))


def regions(boxes: DataFrame) -> DataFrame:
    """Boxes with a text, of a known kind (others are text)."""
    kind = F.when(F.col("kind").isin(KINDS), F.col("kind")).otherwise("text")
    return boxes.withColumns({"kind": kind, "text": stripped(F.col("text"))}).filter("text <> ''")


def assembled(boxes: DataFrame) -> DataFrame:
    """doc_id, markdown of boxes in reading order (nth): titles, captions, figures, and a table's html once, where it begins."""
    text, kind = stripped(F.coalesce("text", F.lit(""))), F.col("kind")
    first = F.row_number().over(Window.partitionBy(*PAGE, "layoutno", "kind").orderBy("nth")) == 1
    part = (
        F.when(kind == "title", F.concat(F.lit("## "), text)).when(kind.endswith(" caption"), F.concat(F.lit("*"), text, F.lit("*"))).when(kind == "figure", F.when(text == "", "[Figure]").otherwise(F.concat(F.lit("[Figure: "), text, F.lit("]"))))
        .when((kind == "table") & F.col("html").isNotNull(), F.when(F.col("_first"), F.col("html")).otherwise("")).otherwise(text)
    )
    rows = boxes.withColumn("_first", first).select("doc_id", "nth", part.alias("part")).filter("part <> ''")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("nth", "part"))), lambda p: p["part"])
    return rows.groupBy("doc_id").agg(stripped(collapse_newlines(F.array_join(parts, "\n\n"))).alias("markdown"))


def is_caption(text: Column, kind: Column) -> Column:
    return stripped(text).rlike(CAPTION) | F.coalesce(F.contains(kind, F.lit("caption")), F.lit(False))


def right_to_left(text: Column) -> Column:
    """Text of a script that runs to the left, read the other way: signs in reverse, runs of Latin letters, digits and what goes with them as they are."""
    return F.array_join(F.reverse(F.regexp_extract_all(text, F.lit(f"{FORWARD}+|{FORWARD.replace('[', '[^')}"), F.lit(0))), "")


def cell_kind(text: Column) -> Column:
    """Date, number, code, English, number with words, single sign, short or long text, other."""
    t = stripped(text)
    words = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: F.length(w) > 1))
    out = F.when(t.rlike(CELLS[0][0]), CELLS[0][1])
    for pattern, kind in CELLS[1:]:
        out = out.when(t.rlike(pattern), kind)
    return out.when(words > 11, "Lx").when(words > 3, "Tx").otherwise("Ot")


def kind_of_table(cells: DataFrame) -> DataFrame:
    """The most common kind of cell of each table, of equals the first by name."""
    each = cells.groupBy(*PAGE, "layoutno", cell_kind(F.col("text")).alias("cell")).count()
    return each.groupBy(*PAGE, "layoutno").agg(F.min_by("cell", F.struct(-F.col("count"), "cell")).alias("cell"))


def is_english(boxes: DataFrame) -> DataFrame:
    """Whether the first 30 boxes of a document hold a long run of ASCII."""
    first = boxes.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "box"))).filter("_n <= 30")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("_n", "text"))), lambda x: x["text"])
    return first.groupBy("doc_id").agg(F.array_join(texts, " ").rlike(ENGLISH).alias("english"))


def _by_page(df: DataFrame, order: list[str], change: Callable[[pd.DataFrame], pd.DataFrame], schema: str | None = None) -> DataFrame:
    """change(a page's rows in order) over all pages, one page held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            new = (pdf[PAGE] != pdf[PAGE].shift()).any(axis=1).to_numpy()
            cut = [*np.nonzero(new)[0].tolist(), len(pdf)]
            for a, b in zip(cut[:-2], cut[1:-1], strict=True):
                yield change(pdf.iloc[a:b])
            held = pdf.iloc[cut[-2] :] if len(pdf) else None
        if held is not None and len(held):
            yield change(held)

    return df.repartition(*PAGE).sortWithinPartitions(*PAGE, *order).mapInPandas(run, schema or df.schema)


def suppressed(boxes: DataFrame, most: float = 0.5) -> DataFrame:
    """Non-maximum suppression: of boxes of a page (with score) that overlap by more than `most` of their union, the best stays."""

    def change(p: pd.DataFrame) -> pd.DataFrame:
        x0, y0, x1, y1 = (p[c].to_numpy(float) for c in ("x0", "top", "x1", "bottom"))
        area, alive, kept = (x1 - x0) * (y1 - y0), np.ones(len(p), bool), []
        for i in range(len(p)):
            if alive[i]:
                kept.append(i)
                both = np.maximum(0, np.minimum(x1, x1[i]) - np.maximum(x0, x0[i]) + 1) * np.maximum(0, np.minimum(y1, y1[i]) - np.maximum(y0, y0[i]) + 1)
                alive &= both / (area + area[i] - both) <= most
        return p.iloc[kept]

    ranked = boxes.withColumn("_rank", -F.col("score"))
    return _by_page(ranked, ["_rank", "box"], change).drop("_rank")


def merged_lines(boxes: DataFrame) -> DataFrame:
    """Neighbours in order of a page, column and layout on one line (their middles nearer than a third of the mean height) become one box; edges are averaged as they grow. Tables, figures and equations stay."""

    def change(p: pd.DataFrame) -> pd.DataFrame:
        rows = p.to_dict("records")
        out = rows[:1]
        for b in rows[1:]:
            a = out[-1]
            same = a["column"] == b["column"] and a["layoutno"] is not None and a["layoutno"] == b["layoutno"] and a["kind"] not in ("table", "figure", "equation")
            if same and abs(b["top"] + b["bottom"] - a["top"] - a["bottom"]) / 2 < a["mean_height"] / 3:
                a.update(x1=b["x1"], top=(a["top"] + b["top"]) / 2, bottom=(a["bottom"] + b["bottom"]) / 2, text=a["text"] + b["text"])
            else:
                out.append(b)
        return pd.DataFrame(out, columns=p.columns)

    return _by_page(boxes, ["column", "top", "x0", "box"], change)


FEW = 8  # boxes up to which comparing them is cheaper than finding their lines


def _by_lines(keys: list[tuple[float, float, int]], tolerance: float) -> list[int] | None:
    """Places in order by line and second edge; none if a line is as high as the tolerance or an edge is no number."""
    keys.sort()
    out: list[int] = []
    line: list[tuple[float, float, int]] = []
    for k in keys:
        at = k[0]
        if line and at - line[-1][0] >= tolerance:
            if line[0][0] != line[-1][0]:
                line.sort(key=itemgetter(1, 2))
            out += [x[2] for x in line]
            line = []
        if k[1] != k[1] or not at - (line[0][0] if line else at) < tolerance:
            return None
        line.append(k)
    line.sort(key=itemgetter(1, 2))
    return out + [x[2] for x in line]


def tolerant(boxes: list[dict], first: str, second: str, tolerance: float) -> list[dict]:
    """By one edge, and by the other where that differs by less than the tolerance. This is no total order; a stable merge sort that compares so defines the result. Where lines lie apart that is the order by line and the other edge, which needs no comparisons in Python."""
    if len(boxes) > FEW and tolerance > 0 and (places := _by_lines([(b[first], b[second], n) for n, b in enumerate(boxes)], tolerance)):
        return [boxes[n] for n in places]

    def order(a: dict, b: dict) -> int:
        far = a[first] - b[first]
        far = a[second] - b[second] if abs(far) < tolerance else far
        return (far > 0) - (far < 0)

    return sorted(boxes, key=cmp_to_key(order))


def line_order(boxes: list[dict], near: float = 10) -> list[dict]:
    """By top, then each box goes left past neighbours before it that begin at nearly its height and farther right, up to the first that doesn't."""
    out: list[dict] = []
    for b in sorted(boxes, key=lambda b: (b["top"], b["x0"])):
        at = len(out)
        while at and abs(out[at - 1]["top"] - b["top"]) < near and b["x0"] < out[at - 1]["x0"]:
            at -= 1
        out.insert(at, b)
    return out


def placed(boxes: DataFrame, order: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """boxes with place: their number in the page when `order` has ordered it, given them by box."""
    edges = ["x0", "x1", "top", "bottom"]
    found = each_group(boxes.select(*PAGE, "box", *edges), PAGE, ["box"], lambda rows: [{**{k: b[k] for k in [*PAGE, "box"]}, "place": n} for n, b in enumerate(order(rows))], f"{typed(boxes, *PAGE, 'box')}, place int")
    return boxes.join(found, [*PAGE, "box"])


def without_lookalikes(layouts: DataFrame, boxes: DataFrame, far: int = 2, most: float = 0.7) -> DataFrame:
    """Layouts of a page in order (layout), each held against the first of the next far - 1 that is of its kind and touches it: where one covers more than `most` of the other, the better scored goes on, or without scores the one that covers more of the page's boxes; of equals the later."""
    area = overlap("l", "b", ratio=False)
    shared = layouts.alias("l").join(boxes.alias("b"), PAGE).groupBy(*PAGE, "layout").agg(F.sum(area).alias("held"))
    edges = ["x0", "x1", "top", "bottom"]
    rows = layouts.join(shared, [*PAGE, "layout"], "left").select(*PAGE, "layout", "kind", "score", *edges, F.coalesce("held", F.lit(0.0)).alias("held"))

    def share(a: dict, b: dict) -> float:
        both = max(0, min(a["x1"], b["x1"]) - max(a["x0"], b["x0"])) * max(0, min(a["bottom"], b["bottom"]) - max(a["top"], b["top"]))
        size = (a["x1"] - a["x0"]) * (a["bottom"] - a["top"])
        return both / size if size else 0

    def alike(a: dict, b: dict) -> bool:
        return a["kind"] == b["kind"] and a["x1"] >= b["x0"] and b["x1"] >= a["x0"] and a["bottom"] >= b["top"] and b["bottom"] >= a["top"]

    def change(rows: list[dict]) -> list[dict]:
        stay, at = list(rows), 0
        while at < len(stay) - 1:
            a = stay[at]
            other = next((n for n in range(at + 1, min(at + far, len(stay))) if alike(a, stay[n])), None)
            if other is None or max(share(a, stay[other]), share(stay[other], a)) < most:
                at += 1
                continue
            by = "score" if a["score"] and stay[other]["score"] else "held"
            del stay[other if a[by] > stay[other][by] else at]
        return [{k: b[k] for k in [*PAGE, "layout"]} for b in stay]

    return layouts.join(each_group(rows, PAGE, ["layout"], change, typed(layouts, *PAGE, "layout")), [*PAGE, "layout"], "left_semi")
