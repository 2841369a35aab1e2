"""Characters of a page's text layer joined to the boxes that a detector found.

Page, character and box meet by tiles: a character goes to the tile where it begins, and a
box to all that it touches and those before them. A character longer or higher than half a
tile goes to all that it touches; its pairs count in the one tile that holds the corner
where they begin to overlap. A page of very many characters is so dealt over its tiles, and
no character meets boxes from elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.operators.grouped import typed, whole_groups
from tarnfold.operators.layout import PAGE, overlap, tolerant

TILE = 64.0  # length of a tile's side, in the unit of the boxes
LEAST, UNLIKE = 0.3, 0.7  # of a character that its box covers; difference of heights from which they don't belong together
BEFORE_BLANK = re.compile(r"[0-9a-zA-Zа-яА-Я,.?;:!%]")  # fixed value: signs that a blank may follow


def _tiles(low: Column, high: Column, side: float) -> Column:
    return F.explode(F.sequence(F.floor(low / side), F.floor(high / side)))


def _by_tile(rows: DataFrame, side: float) -> DataFrame:
    return rows.withColumn("_across", _tiles(F.col("x0"), F.col("x1"), side)).withColumn("_down", _tiles(F.col("top"), F.col("bottom"), side))


def pairs(chars: DataFrame, boxes: DataFrame, side: float = TILE) -> DataFrame:
    """Each overlapping pair once: (page, char, box, ov: share of the character, rev: share of the box, and the heights)."""
    fit, wide = _met(chars, boxes, side)
    kept = [*PAGE, "char", "box", "text", "ov", "rev", "height", "box_height"]
    return fit.select(*kept).union(wide.select(*kept))


def _met(chars: DataFrame, boxes: DataFrame, side: float) -> tuple[DataFrame, DataFrame]:
    """The pairs of characters of at most half a tile, and of the others. Each of the former is one row, in the tile where it begins; boxes also go to the tiles before them, so it meets all its boxes there."""
    edges = ["x0", "x1", "top", "bottom"]
    rows = chars.select(*PAGE, "char", "text", *edges)
    fits = F.coalesce((F.col("x1") - F.col("x0") <= side / 2) & (F.col("bottom") - F.col("top") <= side / 2), F.lit(False))
    small = rows.filter(fits).withColumns({"_across": F.floor(F.col("x0") / side), "_down": F.floor(F.col("top") / side)})
    reach = boxes.select(*PAGE, "box", *edges).withColumn("_across", _tiles(F.col("x0") - side, F.col("x1"), side)).withColumn("_down", _tiles(F.col("top") - side, F.col("bottom"), side))
    tall = lambda t: F.col(f"{t}.bottom") - F.col(f"{t}.top")
    first = lambda edge, tile: F.floor(F.greatest(F.col(f"c.{edge}"), F.col(f"b.{edge}")) / side) == F.col(tile)

    def joined(of: DataFrame, once: Column) -> DataFrame:
        met = of.alias("c").join(reach.alias("b"), [*PAGE, "_across", "_down"]).filter((overlap("c", "b", ratio=False) > 0) & once)
        return met.select(*PAGE, "_across", "_down", "char", "box", *[F.col(f"c.{e}").alias(e) for e in ("text", "x0", "top", "bottom")], overlap("c", "b").alias("ov"), overlap("b", "c").alias("rev"), tall("c").alias("height"), tall("b").alias("box_height"))

    return joined(small, F.lit(True)), joined(_by_tile(rows.filter(~fits), side), first("x0", "_across") & first("top", "_down"))


def _taken(chars: DataFrame, boxes: DataFrame, side: float) -> DataFrame:
    """As `assigned`, with the characters' text, x0, top and bottom. A character that fits a tile finds its box there, without another shuffle."""
    held = F.struct("box", "text", "height", "box_height", "x0", "top", "bottom")
    best = [met.filter(F.col("ov") >= LEAST).groupBy(*PAGE, *tile, "char").agg(F.max_by(held, F.struct("ov", "rev", "box")).alias("b")).select(*PAGE, "char", "b") for met, tile in zip(_met(chars, boxes, side), (["_across", "_down"], []), strict=True)]
    unlike = (F.col("b.box_height") > 0) & (F.abs(F.col("b.height") - F.col("b.box_height")) / F.greatest("b.height", "b.box_height") >= UNLIKE) & (F.col("b.text") != " ")
    return best[0].union(best[1]).filter(~F.coalesce(unlike, F.lit(False))).select(*PAGE, "char", *[f"b.{c}" for c in ("box", "text", "x0", "top", "bottom")])


def assigned(chars: DataFrame, boxes: DataFrame, side: float = TILE) -> DataFrame:
    """(page, char, box): the box that covers most of the character (then: of which the character covers most; then the last), if that is LEAST of it. Where the heights differ by UNLIKE of the greater, only a blank stays. `char` is a key of the page."""
    return _taken(chars, boxes, side).select(*PAGE, "char", "box")


def in_lines(group: np.ndarray, top: np.ndarray, bottom: np.ndarray, x0: np.ndarray) -> np.ndarray:
    """Places of characters that lie group after group (numbered from 0), each group in the order that `tolerant` gives with its mean height. Where lines lie apart that is the order by line and left edge, found for all groups at once; other groups are compared one by one."""
    count = np.bincount(group)
    begin = np.cumsum(count) - count
    mean = np.bincount(group, weights=bottom - top) / count
    order = np.lexsort((top, group))
    at, owner = top[order], group[order]
    gap, near = np.diff(at, prepend=at[:1]), mean[owner]
    new = (np.diff(owner, prepend=-1) != 0) | ~(gap < near)
    line = np.cumsum(new) - 1
    starts = np.nonzero(new)[0]
    range_of = np.maximum.reduceat(at, starts) - at[starts]
    sure = (range_of < mean[owner[starts]] * (1 - 1e-9)) | (range_of == 0)
    inner = ~(np.diff(owner, prepend=-1) != 0)
    unsure = np.bincount(owner[starts[~sure]], minlength=len(count)) + np.bincount(owner[inner & (np.abs(gap - near) <= near * 1e-9)], minlength=len(count)) > 0
    unsure |= ~np.isfinite(mean) | ~(mean > 0)
    out = order[np.lexsort((order, x0[order], line))]
    for g in np.nonzero(unsure)[0].tolist():
        rows = [{"n": n, "top": t, "bottom": b, "x0": x} for n, (t, b, x) in enumerate(zip(*(v[begin[g] : begin[g] + count[g]].tolist() for v in (top, bottom, x0)), strict=True))]
        out[begin[g] : begin[g] + count[g]] = begin[g] + np.array([r["n"] for r in tolerant(rows, "top", "x0", sum(r["bottom"] - r["top"] for r in rows) / len(rows))])
    return out


def _texts_of(part: pa.Table, begin: np.ndarray) -> list[str]:
    """The text of each group of characters; groups begin at `begin`."""
    size = np.diff(np.append(begin, part.num_rows))
    group = np.repeat(np.arange(len(begin)), size)
    order = in_lines(group, *(part[c].to_numpy() for c in ("top", "bottom", "x0")))
    coded = part["text"].combine_chunks().dictionary_encode()
    signs = coded.dictionary.to_pylist()
    sign, group = coded.indices.to_numpy(zero_copy_only=False)[order], group  # an order keeps groups where they are
    blank, empty, before = (np.array([f(s) for s in signs], bool) for f in (lambda s: s == " ", lambda s: not s, lambda s: bool(s and BEFORE_BLANK.match(s[-1]))))
    some = ~empty[sign]
    sign, group = sign[some], group[some]
    first = np.diff(group, prepend=-1) != 0
    after = np.append(False, before[sign[:-1]]) if len(sign) else first
    stays = ~blank[sign] | first | after
    sign, group = sign[stays].tolist(), group[stays]
    ends = np.searchsorted(group, np.arange(len(begin) + 1)).tolist()
    return ["".join([signs[k] for k in sign[a:z]]) for a, z in zip(ends, ends[1:], strict=False)]


def texts(chars: DataFrame, boxes: DataFrame, side: float = TILE) -> DataFrame:
    """(page, box, text) of the boxes that got any: characters by line, lines apart by the mean height; a blank follows a sign that it may follow, once."""
    held = _taken(chars, boxes, side).filter("char IS NOT NULL").withColumn("text", F.coalesce("text", F.lit("")))
    keys = [*PAGE, "box"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, begin in whole_groups(batches, keys):
            text = pa.array(_texts_of(part, begin), pa.string())
            out = part.select(keys).take(pa.array(begin)).append_column("text", text)
            yield from out.filter(pc.not_equal(text, "")).combine_chunks().to_batches()

    return held.repartition(*keys).sortWithinPartitions(*keys, "char").mapInArrow(run, f"{typed(held, *keys)}, text string")


def reading_measures(pages: DataFrame, boxes: DataFrame, layouts: DataFrame, chars: DataFrame, few: int = 10) -> DataFrame:
    """How sure the reading of a document is: mean scores of its boxes and layouts (1 without any), the share of its pages' area that boxes cover (1 at most), and whether its pages (doc_id, page, width, height) hold fewer than `few` characters on average, as scans do. Each table is added up by document before they meet."""
    score = lambda df, name, *more: df.groupBy("doc_id").agg(F.avg("score").alias(name), *more)
    area = F.sum((F.col("x1") - F.col("x0")) * (F.col("bottom") - F.col("top"))).alias("covered")
    out = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.col("width") * F.col("height")).alias("area"))
    for part in (score(boxes, "text_confidence", area), score(layouts, "layout_confidence"), chars.groupBy("doc_id").agg(F.count("*").alias("characters"))):
        out = out.join(part, "doc_id", "left")
    count = F.coalesce("characters", F.lit(0))
    return out.select(
        "doc_id", *[F.coalesce(c, F.lit(1.0)).alias(c) for c in ("text_confidence", "layout_confidence")], F.coalesce(F.least(F.lit(1.0), F.try_divide("covered", "area")), F.lit(0.0)).alias("coverage"), (count < few * F.col("pages")).alias("scanned")
    )
