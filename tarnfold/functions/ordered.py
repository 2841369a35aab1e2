"""Steps in which a line depends on the lines before it, as Arrow-batched functions.

Each is one pass over a text, linear in its length; a fold over an array column would
copy what it has built at every line. A text without the sign that a step looks for is
returned as it came.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What is a heading, a table row and a table's separator.
HEADING = re.compile(r"(?m)^(#{1,6})[^\S\n]+(.*)$")
TITLED = re.compile(r"^(#{1,6})[ \t]+(.*\S)[ \t]*$")
TABLE_ROW = re.compile(r"^[ \t]*\|.*\|[ \t]*$")
TABLE_RULE = re.compile(r"^[ \t]*\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+[ \t]*(?::?-{3,}:?[ \t]*)?\|?[ \t]*$")
ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _mapped(change: Callable[[str], object], shape: str):
    @F.pandas_udf(shape)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else change(t))

    return run


def _counted(change: Callable[[str], tuple[str, int]]):
    @F.pandas_udf("text string, fixes int")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if t is None else change(t) for t in texts], columns=["text", "fixes"]).astype({"fixes": "Int32", "text": object})

    return run


def _levels(text: str) -> str:
    last = 0

    def put(m: re.Match) -> str:
        nonlocal last
        last = min(len(m[1]), last + 1) if last else len(m[1])
        return "#" * last + " " + m[2]

    return HEADING.sub(put, text) if "#" in text else text


def _cells(line: str, floor: int) -> str:
    whole, before = line.strip(), None
    cells = whole[1:-1].split("|")
    for i, cell in enumerate(cells):
        s = cell.strip()
        if s and s == before and len(s) >= floor:
            cells[i] = " " * len(cell)
        before = s or None
    changed = "|" + "|".join(cells) + "|"
    return line if changed == whole else line[: len(line) - len(line.lstrip())] + changed


def _spans(least: int) -> Callable[[str], str]:
    def change(text: str) -> str:
        if "|" not in text:
            return text
        lines = text.split("\n")
        rule = [bool(TABLE_RULE.match(x)) for x in lines] + [False]
        return "\n".join(_cells(x, 1 if rule[i + 1] else least) if not rule[i] and "\\|" not in x and TABLE_ROW.match(x) else x for i, x in enumerate(lines))

    return change


def _headings_once(every: bool, least: int) -> Callable[[str], str]:
    def change(text: str) -> str:
        if "#" not in text:
            return text
        lines = text.split("\n")
        title = {i: m[2].strip() for i, x in enumerate(lines) if (m := TITLED.match(x))}
        times, first = Counter(title.values()), next(iter(title.values()), None)
        met: set[str] = set()
        for i, t in title.items():
            if times[t] >= least and (every or t == first):
                if t in met:
                    lines[i] = ""
                met.add(t)
        return "\n".join(lines)

    return change


def _underlined(text: str) -> tuple[str, int]:
    out, fixes, held = [], 0, None
    for x in text.split("\n"):
        s = x.strip()
        mark = "# " if re.fullmatch("={3,}", s) else "## " if re.fullmatch("-{3,}", s) else None
        if mark and held is not None and held.strip():
            out.append(mark + held.strip())
            held, fixes = None, fixes + 1
            continue
        if held is not None:
            out.append(held)
        held = x
    return "\n".join(out if held is None else [*out, held]), fixes


def _wrapped(text: str) -> tuple[str, int]:
    out, run, fixes = [], [], 0
    for x in text.split("\n"):
        s = x.strip()
        if not s or s.startswith(("#", "```")) or re.match(r"[-*+] ", s):
            if run:
                out.append(" ".join(run))
            fixes, run = fixes + max(0, len(run) - 1), []
            out.append(x)
        else:
            run.append(s)
    if run:
        out.append(" ".join(run))
    return "\n".join(out), fixes + max(0, len(run) - 1)


def _bullets(marker: str) -> Callable[[str], tuple[str, int]]:
    def change(text: str) -> tuple[str, int]:
        out, fenced, fixes = [], False, 0
        for x in text.split("\n"):
            if x.strip().startswith("```"):
                fenced = not fenced
            m = None if fenced else re.match(r"(\s*)[*+] ", x)
            out.append(m[1] + marker + " " + x[m.end() :] if m else x)
            fixes += bool(m)
        return "\n".join(out), fixes

    return change


def repair_headings(text: Column) -> Column:
    """No heading lies more than one level below the one before."""
    return _mapped(_levels, "string")(text)


def html_unescape(text: Column) -> Column:
    """All named, decimal and hexadecimal entities, once."""
    return _mapped(lambda t: html.unescape(t) if "&" in t else t, "string")(text)


def html_unescape_counted(text: Column) -> Column:
    return _counted(lambda t: (html.unescape(t), len(ENTITY.findall(t))) if "&" in t else (t, 0))(text)


def blank_repeated_cells(text: Column, least: int = 20) -> Column:
    """In a table's row, a run of equal neighbouring cells keeps the first; the others become blanks of the same width. Body cells must have `least` characters."""
    return _mapped(_spans(least), "string")(text)


def blank_repeated_headings(text: Column, scope: str = "title", least: int | None = None) -> Column:
    """Later copies of the first heading (scope title) or of any heading (any) become empty where it occurs at least 2 or 3 times."""
    every = scope == "any"
    return _mapped(_headings_once(every, least if least is not None else 3 if every else 2), "string")(text)


def headings_from_underlines(text: Column) -> Column:
    """struct(text, fixes): `===` and `---` under a line become `#` and `##` before it."""
    return _counted(_underlined)(text)


def joined_lines(text: Column) -> Column:
    """struct(text, fixes): neighbouring plain lines become one; empty lines, headings, list items and fences stay and part them."""
    return _counted(_wrapped)(text)


def one_bullet(text: Column, marker: str = "-") -> Column:
    """struct(text, fixes): one marker for all list items outside code fences."""
    return _counted(_bullets(marker))(text)
