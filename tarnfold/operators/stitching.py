"""Pages of a document stitched to one text.

A page's text depends on the page before as it was changed, so a document's pages are
folded in order: one group a document, its pages sorted by Spark, held one document at a
time. What a boundary does is decided by the last lines of the text so far and the first
of the next page; nothing else of the text is looked at again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "markdown string, page_count int, pages_processed int, duplicate_lines_removed int, tables_merged int, headings_merged int"
# Headings and table rows at a page's edge, and how many lines are compared.
HEADING, ROW, TAIL = re.compile(r"^(#{1,6})\s+(.+)$"), re.compile(r"^\|.+\|$"), 3


def edge(lines: list[str], n: int) -> list[str]:
    """The first n lines that aren't blank (the last ones for a negative n), stripped."""
    out = []
    for x in lines if n > 0 else reversed(lines):
        if x.strip():
            out.append(x.strip())
            if len(out) == abs(n):
                break
    return out


def joined_at(before: str, page: str, depth: int | None = None) -> tuple[str, str, dict[str, int]]:
    """The text so far and the page after what they share at their edge is taken out or moved, and what was done.

    With a depth, edges are known to have so many lines, which end at line feeds alone: no
    more are compared or moved, so what lies next to an edge may be equal to it.
    """
    split = str.splitlines if depth is None else (lambda t: t.split("\n"))
    done = {"lines": 0, "tables": 0, "headings": 0}
    held, lines = split(before), split(page)
    tail = set(edge(held, -(depth or TAIL)))
    while tail and done["lines"] < len(lines) and lines[done["lines"]].strip() in tail:
        tail.discard(lines[done["lines"]].strip())
        done["lines"] += 1
    # A page is put together anew only if a rule looked into it.
    page = "\n".join(lines[done["lines"] :]) if held and edge(held, -1) else page
    lines = split(page)
    if all(e and ROW.match(e[0]) for e in (edge(held, -1), edge(lines, 1))):
        rows = next((i for i, x in enumerate(lines[:depth]) if x.strip() and not ROW.match(x.strip())), len(lines[:depth]))
        before, page = before.rstrip() + "\n" + "\n".join(lines[:rows]), "\n".join(lines[rows:])
        done["tables"] = 1
        held, lines = split(before), split(page)
    titles = [HEADING.match(e[0]) if e else None for e in (edge(held, -1), edge(lines, 1))]
    if all(titles) and titles[0][2].strip() == titles[1][2].strip():
        at = next(i for i, x in enumerate(lines) if HEADING.match(x.strip()))
        page = "\n".join(lines[:at] + lines[at + 1 :])
        done["headings"] = 1
    return before, page, done


def stitch(pages: list[tuple[int, str]], comments: bool = True, depth: int | None = None) -> tuple:
    """The row of SCHEMA for a document's pages, in order."""
    texts: list[str] = []
    total = {"lines": 0, "tables": 0, "headings": 0}
    for number, page in pages:
        page = (page or "").strip()
        if not page:
            continue
        if texts:
            texts[-1], page, done = joined_at(texts[-1], page, depth)
            total = {k: v + done[k] for k, v in total.items()}
        texts.append(f"<!-- page {number} -->\n\n{page}" if comments else page)
    return "\n\n".join(texts).strip() + "\n" if pages else "", len(pages), len(texts), total["lines"], total["tables"], total["headings"]


def stitched(pages: DataFrame, document: str = "doc_id", page: str = "page_num", text: str = "markdown", comments: bool = True, depth: int | None = None) -> DataFrame:
    """A row a document: its key and the columns of SCHEMA. Rows of one document and page follow each other by text. For depth see joined_at."""
    kind = dict(pages.dtypes)[document]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, str]] = []
        now = None

        columns = [document, *[c.split()[0] for c in SCHEMA.split(", ")]]

        for pdf in batches:
            done = []  # the documents that end in a batch leave together
            for d, n, t in zip(pdf[document].tolist(), pdf[page].tolist(), pdf[text].tolist(), strict=True):
                if held and d != now:
                    done.append((now, *stitch(held, comments, depth)))
                    held = []
                now = d
                held.append((n, t))
            if done:
                yield pd.DataFrame(done, columns=columns)
        if held:
            yield pd.DataFrame([(now, *stitch(held, comments, depth))], columns=columns)

    rows = pages.select(document, page, text).repartition(F.col(document)).sortWithinPartitions(document, page, text)
    return rows.mapInPandas(run, f"{document} {kind}, {SCHEMA}")
