"""Lines of a page put together to paragraphs, and pages' columns.

Whether a line goes on with a paragraph depends on how wide the paragraph has become, so a
page's lines are folded in order: the page's lines as one array, and built-in functions
over it. Only edges and signs are folded; texts are joined afterwards, by paragraph.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.functions.markdown import stripped
from tarnfold.operators.grouped import each_group, typed
from tarnfold.operators.layout import PAGE

FAR, SHARED = 1.5, 0.3  # gap in mean heights, and shared width, within which lines belong together
# Signs at a line's end, before its end and at the next line's beginning after which text goes on, and signs that end it.
GOES_ON = ",;:'\"，、’”；：-"
GOES_ON_BEFORE = ",;:'\"，’”、；："
GOES_ON_NEXT = "。；？！?”）),，、："
ENDS, ENDS_ENGLISH = "。？！?", ".!?"


def _is_of(sign: Column, signs: str) -> Column:
    return F.coalesce((F.length(sign) > 0) & F.contains(F.lit(signs), sign), F.lit(False))


def numbered_paragraphs(boxes: DataFrame, english: bool = False) -> DataFrame:
    """boxes (with layoutno and mean_height) and the ascending number of their paragraph in the page. A blank line may belong to the paragraph before it; one that doesn't goes, unless it is the page's last. Order is by top, left edge and box."""
    given = [c for c in boxes.columns if c not in PAGE]
    rows = boxes.withColumn("_text", stripped(F.coalesce("text", F.lit(""))))
    tall = F.coalesce("mean_height", F.lit(10.0))
    end, before = F.right("_text", F.lit(1)), F.when(F.length("_text") > 1, F.substring("_text", -2, 1))
    goes_on = _is_of(end, GOES_ON) | _is_of(before, GOES_ON_BEFORE)
    ends = _is_of(end, ENDS + (ENDS_ENGLISH if english else ""))
    line = F.struct("top", "x0", "box", "x1", "bottom", "layoutno", F.when(tall > 0, tall).alias("tall"), goes_on.alias("goes_on"), (F.length("_text") == 1).alias("single"), _is_of(end, GOES_ON).alias("end_on"), ends.alias("ends"), _is_of(F.left("_text", F.lit(1)), GOES_ON_NEXT).alias("begins_on"), (F.col("_text") == "").alias("blank"), F.struct(*given, "_text").alias("row"))
    pages = rows.groupBy(*PAGE).agg(F.sort_array(F.collect_list(line)).alias("lines"))

    def step(s: Column, b: Column) -> Column:
        p = s["last"]
        wide = F.greatest(F.lit(1.0), F.least(p["x1"] - p["x0"], b["x1"] - b["x0"]))
        shared = F.greatest(F.lit(0.0), F.least(p["x1"], b["x1"]) - F.greatest(p["x0"], b["x0"])) / wide
        near = p["layoutno"].eqNullSafe(b["layoutno"]) & (b["top"] - p["bottom"] <= FAR * F.coalesce(b["tall"], s["median"])) & (shared >= SHARED)
        same = F.coalesce(near & ~p["blank"] & (~p["ends"] | p["goes_on"] | b["begins_on"]), F.lit(False))
        number = s["n"] + F.when(same, 0).otherwise(1)
        # A line of one sign in a paragraph has a blank before it, so only its own sign tells; a blank line leaves the paragraph's signs.
        grown = F.struct(
            F.when(same, F.least(p["x0"], b["x0"])).otherwise(b["x0"]).alias("x0"), F.when(same, F.greatest(p["x1"], b["x1"])).otherwise(b["x1"]).alias("x1"), b["bottom"].alias("bottom"), b["layoutno"].alias("layoutno"),
            F.when(same & b["blank"], p["ends"]).otherwise(b["ends"]).alias("ends"), F.when(same & b["blank"], p["goes_on"]).when(same & b["single"], b["end_on"]).otherwise(b["goes_on"]).alias("goes_on"), (~same & b["blank"]).alias("blank"),
        )
        return F.struct(grown.alias("last"), number.alias("n"), F.array_append(s["numbers"], F.struct(number.alias("paragraph"), (~same & b["blank"]).alias("lone"))).alias("numbers"), s["median"].alias("median"))

    layoutno = rows.schema["layoutno"].dataType.simpleString()
    nothing = F.lit(None).cast(f"struct<x0:double,x1:double,bottom:double,layoutno:{layoutno},ends:boolean,goes_on:boolean,blank:boolean>")
    heights = F.sort_array(F.filter(F.transform("lines", lambda b: b["bottom"] - b["top"]), lambda h: h.isNotNull()))
    middle = F.size(heights) / 2
    median = F.when(F.exists("lines", lambda b: b["tall"].isNull()) & (F.size(heights) > 0), (F.get(heights, F.ceil(middle).cast("int") - 1) * 0.5 + F.get(heights, F.floor(middle).cast("int")) * 0.5))
    start = F.struct(nothing.alias("last"), F.lit(0).alias("n"), F.array().cast("array<struct<paragraph:int,lone:boolean>>").alias("numbers"), median.cast("double").alias("median"))
    folded = pages.select(*PAGE, F.col("lines.row").alias("row"), F.aggregate("lines", start, step, lambda s: s["numbers"]).alias("number"))
    lines = folded.select(*PAGE, F.size("row").alias("_lines"), F.posexplode(F.arrays_zip("row", "number")).alias("_at", "_line"))
    stays = ~F.col("_line.number.lone") | (F.col("_at") + 1 == F.col("_lines"))  # nothing is added to a blank line that begins a paragraph
    named = lines.filter(" AND ".join(f"{c} IS NOT NULL" for c in [*PAGE, "_line.row.box"])).filter(stays)
    return named.select(*PAGE, *[F.col(f"_line.row.{c}").alias(c) for c in [*given, "_text"]], F.col("_line.number.paragraph").alias("paragraph"))


def merged_paragraphs(boxes: DataFrame, english: bool = False) -> DataFrame:
    """doc_id, page, paragraph, layoutno, text, x0, x1, top, bottom: the lines of a paragraph joined by blanks, and the box around them, which ends where the last line does."""
    rows = numbered_paragraphs(boxes, english)
    lines = F.sort_array(F.collect_list(F.struct("top", "x0", "box", "bottom", "_text")))
    out = rows.groupBy(*PAGE, "paragraph").agg(F.min_by("layoutno", F.struct("top", "x0", "box")).alias("layoutno"), lines.alias("l"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    text = F.array_join(F.filter(F.transform("l", lambda b: b["_text"]), lambda t: t != ""), " ")
    return out.select(*PAGE, "paragraph", "layoutno", text.alias("text"), "x0", "x1", F.element_at("l", 1)["top"].alias("top"), F.element_at("l", -1)["bottom"].alias("bottom"))


MOST_COLUMNS, INDENT = 4, 0.12  # columns tried; share of the page's width within which a beginning is the leftmost one


def clusters(values: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Where each of k groups of sorted values begins, with the least sum of squared distances to the groups' means; exact, as groups of values on a line are runs. Of equals the one whose groups begin first."""
    n, sums = np.concatenate(([0.0], np.cumsum(counts))), np.concatenate(([0.0], np.cumsum(counts * values)))
    squares = np.concatenate(([0.0], np.cumsum(counts * values**2)))
    cost = lambda a, b: np.maximum(0.0, squares[b] - squares[a] - (sums[b] - sums[a]) ** 2 / (n[b] - n[a]))
    m = len(values)
    best, cuts = cost(np.zeros(m, int), np.arange(1, m + 1)), []
    for g in range(1, k):
        now, cut = np.full(m, np.inf), np.zeros(m, int)
        for end in range(g, m):  # the last group is values[start..end]
            starts = np.arange(g, end + 1)
            total = best[starts - 1] + cost(starts, np.full(len(starts), end + 1))
            cut[end] = starts[int(np.argmin(np.round(total, 9)))]
            now[end] = best[cut[end] - 1] + cost(cut[end], end + 1)
        best = now
        cuts.append(cut)
    begins, end = [], m - 1
    for cut in reversed(cuts):
        begins.append(int(cut[end]))
        end = begins[-1] - 1
    return np.array([0, *reversed(begins)])


def silhouette(values: np.ndarray, counts: np.ndarray, begins: np.ndarray) -> float:
    """The mean over all points of how much nearer their group is than the next one; a point that is alone counts 0. Distances come from running sums, not from pairs."""
    n, sums = np.concatenate(([0.0], np.cumsum(counts))), np.concatenate(([0.0], np.cumsum(counts * values)))
    ends = np.append(begins[1:], len(values))
    group = np.repeat(np.arange(len(begins)), ends - begins)
    at = np.arange(len(values))
    far = np.empty((len(begins), len(values)))
    for g, (a, b) in enumerate(zip(begins, ends, strict=True)):
        split = np.clip(at, a, b)  # values before this lie left of the point
        far[g] = values * (n[split] - n[a]) - (sums[split] - sums[a]) + (sums[b] - sums[split]) - values * (n[b] - n[split])
    size = n[ends] - n[begins]
    own = far[group, at] / np.maximum(1.0, size[group] - 1)
    others = far / size[:, None]
    others[group, at] = np.inf
    near = others.min(axis=0)
    score = np.where(size[group] > 1, (near - own) / np.maximum(np.maximum(own, near), 1e-300), 0.0)
    return float((score * counts).sum() / counts.sum())


def columns_of(x0: np.ndarray, x1: np.ndarray) -> int:
    """How many columns the boxes of a page begin in: the number of groups with the best silhouette above 0, the fewest of equals."""
    left = x0.min()
    snapped = np.where(np.abs(x0 - left) < INDENT * (x1.max() - left), left, x0)
    values, counts = np.unique(snapped, return_counts=True)
    best, found = 0.0, 1
    for k in range(2, min(MOST_COLUMNS, len(values), len(x0) - 1) + 1):
        score = silhouette(values, counts, clusters(values, counts, k))
        if score > best + 1e-12:
            best, found = score, k
    return found


def page_columns(boxes: DataFrame) -> DataFrame:
    """doc_id, page, box, column (from 0, left to right), columns: how many its page has."""

    def change(rows: list[dict]) -> list[dict]:
        x0, x1 = (np.array([b[c] for b in rows], float) for c in ("x0", "x1"))
        values, counts = np.unique(x0, return_counts=True)
        k = columns_of(x0, x1)
        begins = values[clusters(values, counts, k)]
        return [{**{c: b[c] for c in [*PAGE, "box"]}, "column": int(g), "columns": k} for b, g in zip(rows, np.searchsorted(begins, x0, side="right") - 1, strict=True)]

    return each_group(boxes.select(*PAGE, "box", "x0", "x1"), PAGE, ["box"], change, f"{typed(boxes, *PAGE, 'box')}, column int, columns int")


def document_columns(columns: DataFrame) -> DataFrame:
    """doc_id, columns, pages: the number of columns that most pages of a document have, of equals the smaller. columns: as page_columns gives them."""
    pages = columns.groupBy(*PAGE).agg(F.first("columns").alias("columns"))
    votes = pages.groupBy("doc_id", "columns").count()
    return votes.groupBy("doc_id").agg(F.min_by("columns", F.struct(-F.col("count"), "columns")).alias("columns"), F.sum("count").alias("pages"))
