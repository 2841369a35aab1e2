"""Chunkers of markdown: a text column to an array of chunks, in order.

Documents are chunked where they lie, one Arrow batch at a time, so nothing is shuffled.
A block grammar (fences, headings, tables, lists, paragraphs) finds what must stay whole,
and one greedy packer fills chunks from blocks or paragraphs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnfold.functions import markdown

CHUNK = "array<struct<index int, text string, section_path array<string>, parent_header_id string, sibling_ids array<string>>>"

# The line grammar. B is a blank inside a line.
B = r"[^\S\n]"
FENCE = rf"{B}*+```"
HEADING = rf"(?P<level>#{{1,6}}){B}+(?P<title>.+?){B}*+(?=\n|\Z)"
CELL = rf"{B}*+(?::?-{{3,}}:?{B}*+)?"
RULE = rf"{CELL}(?:\|{CELL})+(?=\n|\Z)"
ROW = rf"(?:{B}*+\|.*|.*\|{B}*+)(?=\n|\Z)"
ITEM = rf"{B}*+(?:[-*+]|\d+\.){B}"
FOLLOWS = rf"(?:{ITEM}|{B}{{2,}}+\S)"
BLOCKS = re.compile(
    rf"(?m)^(?:(?P<code>{FENCE}.*(?:\n(?!{FENCE}).*)*+(?:\n{FENCE}.*)?)|(?P<heading>{HEADING})|(?P<table>{ROW}\n{RULE}(?:\n{ROW})*+)"
    rf"|(?P<list>{ITEM}.*(?:(?:\n{B}*+(?=\n))*+\n{FOLLOWS}.*)*)|(?P<blank>{B}*+$)|(?P<line>.+))"
)
SECTION = re.compile(rf"(?m)^(?=#{{1,6}}{B}+.+$)")
TITLE = re.compile(rf"(#{{1,6}}){B}+(.+)")


def blocks(text: str) -> Iterator[tuple[str, str, int]]:
    """(kind, text, heading level or 0) of a text's blocks; neighbouring plain lines are one paragraph."""
    lines: list[str] = []
    for m in BLOCKS.finditer(text):
        kind = m.lastgroup if m.lastgroup in ("code", "table", "list", "blank", "line") else "heading"
        if kind == "line":
            lines.append(m[0])
            continue
        if lines:
            yield "paragraph", "\n".join(lines), 0
            lines = []
        if kind == "heading":
            yield kind, m[0].strip(), len(m["level"])
        elif kind == "list":
            yield kind, re.sub(rf"\n(?:{B}*+\n)+", "\n\n", m[0]), 0
        elif kind != "blank":
            yield kind, m[0], 0
    if lines:
        yield "paragraph", "\n".join(lines), 0


class Path:
    """The titles above a place: a heading closes all of its level and below."""

    def __init__(self) -> None:
        self.open: list[tuple[int, str]] = []

    def enter(self, level: int, title: str) -> None:
        self.open = [x for x in self.open if x[0] < level] + [(level, title)]

    def titles(self) -> list[str]:
        return [t for _, t in self.open]


def packed(parts: Iterable[str], size: Callable[[str], int], more: Callable[[int, int], bool]) -> Iterator[list[str]]:
    """Runs of parts: the next joins while `more` allows, given the run's size and the part's."""
    run: list[str] = []
    total = 0
    for part in parts:
        n = size(part)
        if run and not more(total, n):
            yield run
            run, total = [], 0
        run.append(part)
        total += n
    if run:
        yield run


def _tokens(text: str) -> int:
    n = len(text.strip())
    return max(1, n // 4) if n else 0


def _semantic(target: int, most: int) -> Callable[[str], list[dict]]:
    def chunks(text: str) -> list[dict]:
        sections: list[tuple[list[str], list[str]]] = [([], [])]
        path = Path()
        for kind, raw, level in blocks(re.sub(r"\r\n?", "\n", text).strip()):
            if kind == "heading":
                path.enter(level, raw.lstrip("#").strip())
                sections.append((path.titles(), []))
            sections[-1][1].append(raw.strip("\n"))
        out = []
        for titles, parts in sections:
            for run in packed(parts, _tokens, lambda now, n: now + n <= most or now < target):
                out.append({"text": "\n\n".join(run).strip(), "section_path": titles})
        return [c for c in out if c["text"]]

    return chunks


def _paragraphs(text: str, most: int) -> Iterator[str]:
    """Blank-line paragraphs packed to `most` characters with their joiners; longer ones are cut."""
    short: list[str] = []

    def flush() -> Iterator[str]:
        for run in packed(short, lambda p: len(p) + 2, lambda now, n: now + n - 2 <= most):
            yield "\n\n".join(run)
        short.clear()

    for p in filter(None, (x.strip() for x in text.strip().split("\n\n"))):
        if len(p) <= most:
            short.append(p)
            continue
        yield from flush()
        yield from filter(None, (p[a : a + most].strip() for a in range(0, len(p), most)))
    yield from flush()


def _paragraph(most: int) -> Callable[[str], list[dict]]:
    return lambda text: [{"text": c, "section_path": []} for c in _paragraphs(text, most)]


def _hierarchical(most: int) -> Callable[[str], list[dict]]:
    def chunks(text: str) -> list[dict]:
        path, out = Path(), []
        for section in SECTION.split(text.strip()):
            m = TITLE.match(section)
            if m:
                path.enter(len(m[1]), m[2].strip())
            titles = path.titles()
            out += [{"text": c, "section_path": titles, "parent_header_id": titles[-2] if len(titles) > 1 else None} for c in _paragraphs(section, most)]
        family: dict[str, list[str]] = {}
        for i, c in enumerate(out):
            if c["parent_header_id"]:
                family.setdefault(c["parent_header_id"], []).append(str(i))
        for i, c in enumerate(out):
            c["sibling_ids"] = [s for s in family.get(c["parent_header_id"] or "", []) if s != str(i)]
        return out

    return chunks


def _chunker(chunks: Callable[[str], list[dict]]):
    @F.pandas_udf(CHUNK)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"parent_header_id": None, "sibling_ids": [], **c, "index": i} for i, c in enumerate(chunks(t))])

    return run


def semantic_chunks(text: Column, target_tokens: int = 320, max_tokens: int = 400) -> Column:
    """Blocks packed by approximate tokens within their section; code, tables and lists are never cut."""
    return _chunker(_semantic(target_tokens, max_tokens))(text)


def paragraph_chunks(text: Column, max_chars: int = 1000) -> Column:
    return _chunker(_paragraph(max_chars))(text)


def hierarchical_chunks(text: Column, max_chars: int = 1000) -> Column:
    """Paragraph chunks of each heading's section, with the heading above and the other chunks under it."""
    return _chunker(_hierarchical(max_chars))(text)


# Line tests as columns. Their patterns.
JB = r"[^\S\n]"


def heading_of(line: Column) -> Column:
    """struct(level, title), null for other lines."""
    pattern = r"^(#{1,6})\s+(.+?)\s*$"
    return F.when(line.rlike(pattern), F.struct(F.length(F.regexp_extract(line, pattern, 1)).alias("level"), markdown.stripped(F.regexp_extract(line, pattern, 2)).alias("title")))


def is_table_line(line: Column) -> Column:
    s = markdown.stripped(line)
    return F.contains(s, F.lit("|")) & (s.startswith("|") | s.endswith("|"))


def is_table_rule(line: Column) -> Column:
    cell = rf"{JB}*+(?::?-{{3,}}:?{JB}*+)?"
    return line.rlike(rf"^{cell}(?:\|{cell})+$")


def is_list_item(line: Column) -> Column:
    return line.rlike(r"^\s*(?:[-*+]\s+|\d+\.\s+)")


def is_continuation(line: Column) -> Column:
    return line.rlike(r"^\s{2,}\S")


def chunk_features(text: Column) -> Column:
    """struct(has_table, is_procedure, has_code)."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.struct((F.exists(lines, is_table_line) & F.exists(lines, is_table_rule)).alias("has_table"), F.coalesce(text, F.lit("")).rlike(r"(?m)^\s*\d+\.\s+").alias("is_procedure"), F.contains(F.coalesce(text, F.lit("")), F.lit("```")).alias("has_code"))
