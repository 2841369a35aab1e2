"""Tables rebuilt from the boxes of recognised cells.

A cell's box has doc_id, page, table, box, x0, x1, top, bottom, text and kind. Joins by page
tag it with the bands that a recogniser found: its row, its column, whether it lies in a
header, and the area that it spans. What depends on a table's boxes in order (its grid,
lone rows and columns, merged areas) is worked out a table at a time; tables are dealt by
their key, and no task holds more than one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from itertools import groupby, product
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.operators.grouped import each_group, typed
from tarnfold.operators.layout import PAGE, best_layout, cell_kind, is_caption, nearest_column, tolerant

TABLE = [*PAGE, "table"]
BANDS = ["row", "row_top", "column", "col_left", "col_right", "header", "area_left", "area_right", "area_top", "area_bottom"]
BUILT = "caption string, html string, described array<string>, n_rows int, n_cols int, n_spans int"
SLACK = 3  # a box without a row band begins a row if it begins at most this far above the end of the one before
MANY = 4  # rows from which a lone column is moved, and columns from which a lone row is
NEAR = 10  # at most, boxes of a cell are on a line
Box = dict
Grid = dict[tuple[int, int], list[Box]]


def tagged(cells: DataFrame, bands: DataFrame) -> DataFrame:
    """cells with the bands they lie in. bands: doc_id, page, table, band, kind (row, header, column, spanning), x0, x1, top, bottom."""
    edges = ["x0", "x1", "top", "bottom"]
    out = cells.withColumn("layoutno", F.col("table"))
    for kind in ("row", "header", "spanning"):
        of = bands.filter(F.col("kind") == kind)
        met = best_layout(out.drop("layout"), of.withColumnRenamed("band", "layout")).withColumnRenamed("layout", f"_{kind}")
        out = met.join(of.select(*PAGE, F.col("band").alias(f"_{kind}"), F.struct(*edges).alias(f"_{kind}_box")), [*PAGE, f"_{kind}"], "left")
    columns = bands.filter("kind = 'column'").withColumn("layoutno", F.col("table"))
    out = nearest_column(out.drop("column"), columns.withColumnRenamed("band", "column"))
    out = out.join(columns.select(*PAGE, F.col("band").alias("column"), F.col("x0").alias("col_left"), F.col("x1").alias("col_right")), [*PAGE, "column"], "left")
    area = F.when(F.col("_spanning").isNotNull(), F.coalesce("_spanning_box", "_header_box"))
    return out.select(
        *cells.columns, F.col("_row").alias("row"), F.col("_row_box.top").alias("row_top"), "column", "col_left", "col_right", F.col("_header").isNotNull().alias("header"),
        area["x0"].alias("area_left"), area["x1"].alias("area_right"), area["top"].alias("area_top"), area["bottom"].alias("area_bottom"), (F.col("_row_box.bottom") - F.col("_row_box.top")).alias("row_height"),
    )


def by_band(boxes: list[Box], band: str, *then: str) -> list[Box]:
    """Neighbours that have a band are ordered by it and by the edges after it; those that have none stay where they are. What came before is no order to rely on: one with a tolerance isn't total."""
    edges = itemgetter(band, *then)
    return [b for known, run in groupby(boxes, key=lambda b: b[band] is not None) for b in (sorted(run, key=edges) if known else run)]


def numbered(boxes: list[Box], line: str, edge: str, begins: Callable[[Box, Box, float], bool]) -> int:
    """Give boxes in order the number of their line, and return how many there are. A line's end is averaged as it goes on."""
    at, end = 0, boxes[0][edge]
    boxes[0][line] = 0
    for last, b in zip(boxes, boxes[1:], strict=False):
        new = begins(last, b, end)
        at, end = (at + 1, b[edge]) if new else (at, (end + b[edge]) / 2)
        b[line] = at
    return at + 1


def begins_row(last: Box, b: Box, end: float) -> bool:
    return last["row"] != b["row"] or (b["row"] is None and b["top"] >= end - SLACK)


def begins_column(last: Box, b: Box, end: float) -> bool:
    of = lambda x: 1 if x["column"] is None else x["column"]
    same = b["column"] is not None and b["column"] == last["column"]
    return of(b) - of(last) == 1 or (b["x0"] >= end and not same)


def lone_joined(grid: Grid, sizes: list[int], axis: int, low: str, high: str) -> None:
    """A line of one cell joins the nearer neighbour that holds nothing beside it; lines after it move up."""
    at = 0
    while at < sizes[axis]:
        held = [k for k in grid if k[axis] == at]
        gaps = {}
        if len(held) == 1:
            for side in (-1, 1):
                beside = grid.get(tuple(x + side * (n == axis) for n, x in enumerate(held[0])))
                line = [b for k, cell in grid.items() if k[axis] == at + side for b in cell]
                if line and not (beside and beside[0]["text"]):
                    box = grid[held[0]][0]
                    gaps[side] = min(box[low] - b[high] if side < 0 else b[low] - box[high] for b in line)
        if not gaps:
            at += 1
            continue
        to = at - 1 if gaps.get(-1, float("inf")) < gaps.get(1, float("inf")) else at + 1
        for b in grid[held[0]]:
            b["moved"].add(axis)
        joined: Grid = {}
        for k in sorted(grid, key=lambda k: k == held[0]):  # the lone cell's boxes come last
            place = to if k[axis] == at else k[axis]
            joined.setdefault(tuple(place - (place > at) if n == axis else x for n, x in enumerate(k)), []).extend(grid[k])
        grid.clear()
        grid.update(joined)
        sizes[axis] -= 1


def middles(grid: Grid, size: int, axis: int, low: tuple[str, str], high: tuple[str, str]) -> list[float]:
    """The middle of each line, by the mean edges of the boxes that were on it from the first: the band's edge or the box's own."""
    edges: list[list[tuple[float, float]]] = [[] for _ in range(size)]
    for k, cell in grid.items():
        edges[k[axis]] += [tuple(b[own] if b.get(band) is None else b[band] for band, own in (low, high)) for b in cell if axis not in b["moved"]]
    return [sum(a for a, _ in e) / len(e) + (sum(z for _, z in e) - sum(a for a, _ in e)) / len(e) / 2 if e else float("nan") for e in edges]


def spans_merged(grid: Grid, sizes: list[int]) -> dict[tuple[int, int], tuple[int, int]]:
    """Cells of a spanned area become one, at its first; returns the rows and columns that each takes. Texts that repeat what is there aren't added."""
    if not any(b["area_left"] is not None for cell in grid.values() for b in cell):
        return {}
    rows = middles(grid, sizes[0], 0, ("row_top", "top"), ("", "bottom"))
    cols = middles(grid, sizes[1], 1, ("col_left", "x0"), ("col_right", "x1"))
    of: dict[tuple[int, int], tuple[int, int]] = {}
    done: set[int] = set()
    for k in product(*map(range, sizes)):
        areas = [b for b in grid.get(k, []) if b["area_left"] is not None and id(b) not in done]
        within = lambda lines, a, z: [n for n, x in enumerate(lines) if areas and any(b[a] <= x <= b[z] for b in areas)]
        down, across = {k[0], *within(rows, "area_top", "area_bottom")}, {k[1], *within(cols, "area_left", "area_right")}
        if len(down) < 2 and len(across) < 2:
            continue
        block = list(product(range(min(down), max(down) + 1), range(min(across), max(across) + 1)))
        merged: list[Box] = []
        for c in block:
            text = "".join(b["text"] for b in grid.get(c, []))
            merged += grid.get(c, []) if text != "".join(b["text"] for b in merged) else []
            grid.pop(c, None)
            of.pop(c, None)
        done |= {id(b) for b in merged}
        grid[block[0]] = merged
        of[block[0]] = (max(down) - min(down) + 1, max(across) - min(across) + 1)
    return of


def header_rows(grid: Grid, rows: int) -> list[int]:
    """Rows of which most cells are in a header or, in a table of numbers, no number."""
    most = Counter(b["cell"] for b in sorted((b for cell in grid.values() for b in cell), key=lambda b: b["nth"])).most_common(1)[0][0]
    out, of = [], {r: [] for r in range(rows)}
    for k, cell in grid.items():
        of[k[0]].append(cell)
    for r, cells in of.items():
        said = [any(b["header"] for b in cell) or most == "Nu" for cell in cells if not most == cell[0]["cell"] == "Nu"]
        out += [r] if cells and sum(said) > len(cells) / 2 else []
    return out


def as_html(grid: Grid, sizes: list[int], spans: dict, headers: list[int], caption: str) -> str:
    covered = {(r, c) for (r0, c0), (down, across) in spans.items() for r in range(r0, r0 + down) for c in range(c0, c0 + across)} - set(spans)
    lines, known = ["<table>" + (f"<caption>{caption}</caption>" if caption else "")], set()
    for r in range(sizes[0]):
        tag, parts, texts = "th" if r in headers else "td", [], []
        for k in ((r, c) for c in range(sizes[1])):
            cell = grid.get(k)
            if k in covered:
                continue
            if not cell:
                parts.append(f"<{tag}></{tag}>")
                continue
            if len(cell) == 1:
                texts.append(cell[0]["text"])
            else:
                near = min(min(b["bottom"] - b["top"] for b in cell) / 2, NEAR)
                texts.append(" ".join(b["text"] for b in tolerant(cell, "top", "x0", near)))
            down, across = spans.get(k, (1, 1))
            size = (f"colspan={across}" if across > 1 else "") + (f" rowspan={down}" if down > 1 else "") if spans else ""
            parts.append(f"<{tag} {size}>{texts[-1]}</{tag}>")
        if r in headers and known.issuperset(texts):
            continue  # a header that repeats
        known |= set(texts) if r in headers else set()
        lines.append(f"<tr>{''.join(parts)}</tr>" if parts else "")
    return "\n".join([*lines, "</table>"])


def titles(grid: Grid, sizes: list[int], headers: list[int], english: bool) -> dict[int, list[str]]:
    """The titles of columns by header row: blanks take the row's above, and each row takes in those of header rows right above it."""
    link, out, last = " for " if english else "的", {}, [""] * sizes[1]
    for r in headers:
        own = [" ".join(b["text"].strip() for b in grid.get((r, c), [])) for c in range(sizes[1])]
        if any(own):
            out[r] = last = [a or b for a, b in zip(own, last, strict=True)]
    for i in out:
        for j in range(i + 1, sizes[0]):
            if j not in out:
                break
            for c, (up, low) in enumerate(zip(out[i], out[j], strict=True)):
                if up and up not in low:
                    out[j][c] = low + link + up if len(low) > len(up) else up + link + low
    return out


def as_sentences(grid: Grid, sizes: list[int], spans: dict, headers: list[int], caption: str, english: bool) -> list[str]:
    """A line for each row below its titles; a spanned text stands in all of its cells."""
    full = dict(grid)
    for (r0, c0), (down, across) in spans.items():
        full |= {(r, c): grid[r0, c0] for r in range(r0, r0 + down) for c in range(c0, c0 + across)}
    above, out = titles(full, sizes, headers, english), []
    for r in (r for r in range(sizes[0]) if r not in above):
        title = above.get(max((h for h in above if h < r), default=0), [])
        cells = [(c, "".join(b["text"].strip() for b in full.get((r, c), []))) for c in range(sizes[1])]
        if not title and sizes[1] <= 2:
            parts, joint = [t for _, t in cells if t], "："
        else:
            parts, joint = [f"{title[c]}：{t}" if title and title[c] else t for c, t in cells if t], "; "
        out += [joint.join(parts)] if parts else []
    where = f"\t——{' in ' if english else '来自'}“{caption}”" if caption else ""
    return [line + where for line in out]


def built(boxes: list[Box], english: bool, html: bool = True, described: bool = True) -> dict:
    """One table from its boxes, in their number's order; what isn't wanted stays empty."""
    near = sum(b["bottom"] - b["top"] for b in boxes) / 2 / len(boxes)
    boxes = tolerant(boxes, "top", "x0", near)
    caption = "".join((" " if english else "") + b["text"] for b in boxes if b["caption"])
    cells = [b | {"moved": set(), "nth": n} for n, b in enumerate(b for b in boxes if not b["caption"])]
    if not cells:
        return {"caption": caption, "html": "", "described": [], "n_rows": 0, "n_cols": 0, "n_spans": 0}
    high = min((b["row_height"] for b in cells if b["row"] is not None), default=0)
    wide = min((b["col_right"] - b["col_left"] for b in cells if b["column"] is not None), default=0)
    down = by_band(tolerant(cells, "top", "x0", high / 2), "row", "x0", "nth")
    sizes = [numbered(down, "rn", "bottom", begins_row)]
    across = by_band(tolerant(down, "x0", "top", wide / 2), "column", "top", "x0", "nth")
    sizes.append(numbered(across, "cn", "x1", begins_column))
    grid: Grid = {}
    for b in across:
        grid.setdefault((b["rn"], b["cn"]), []).append(b)
    if sizes[0] >= MANY:
        lone_joined(grid, sizes, 1, "x0", "x1")
    if sizes[1] >= MANY:
        lone_joined(grid, sizes, 0, "top", "bottom")
    headers = header_rows(grid, sizes[0])
    spans = spans_merged(grid, sizes)
    sentences = as_sentences(grid, sizes, spans, headers, caption, english) if described else []
    return {"caption": caption, "html": as_html(grid, sizes, spans, headers, caption) if html else "", "described": sentences, "n_rows": sizes[0], "n_cols": sizes[1], "n_spans": len(spans)}


def tables(cells: DataFrame, english: bool = False, html: bool = True, described: bool = True) -> DataFrame:
    """One row a table. cells: boxes as `tagged` gives them; a table of captions alone has no rows. html and described are made where they are wanted, else they are empty."""
    rows = cells.withColumns({"caption": F.coalesce(is_caption(F.col("text"), F.col("kind")), F.lit(False)), "cell": cell_kind(F.col("text")), "text": F.coalesce("text", F.lit(""))})

    wanted = [*TABLE, "box", "x0", "x1", "top", "bottom", "text", "caption", "cell", *BANDS, "row_height"]
    return each_group(rows.select(*wanted), TABLE, ["box"], lambda boxes: [{k: boxes[0][k] for k in TABLE} | built(boxes, english, html, described)], f"{typed(rows, *TABLE)}, {BUILT}")
