"""Queries on rows that the given tables don't hold, against their SQL."""

import json
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tarnfold import catalog
from tarnfold.operators import stitching


@pytest.fixture
def same_as_sql(spark, tmp_path):
    def check(name: str, table: str, rows: pa.Table) -> None:
        pq.write_table(rows, tmp_path / f"{table}.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        df = catalog.queries()[name](spark, f"file://{tmp_path}")
        listed = ", ".join(f'"{c}"' for c in df.columns)
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, con.execute(f"SELECT {listed} FROM ({catalog.oracle_sql()[name]})").fetchall()))

    return check


def test_facts_between_blanks_signs_and_marks(same_as_sql):
    """Blanks and commas between digits, digits and marks outside ASCII, and no text."""
    texts = ["123 of 12 345 or 1,250 x", "call 555 123 4567, 12 500", "x٣٤٥ 1٣٤ é12 ab⃝345", "22² 3½4 ⅷ12 a_12", None, "S600 S600s " * 30, "# a\n# b\n# c\n# d 360,0001 9360,000"]
    rows = [(i * 4 + k, t) for i, t in enumerate(texts) for k in range(4)]
    same_as_sql("fact_guard", "documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))


def test_golden_sets_of_odd_documents(same_as_sql):
    """No text, blanks, breaks of lines of all kinds, no source, no id, a text above 20 million characters."""
    texts = [None, "", " \t", "a\nb\r\nc d\x0be", '"{\\', None, "é" * 5, "plain", "y" * 20_000_001]
    rows = [(i * 3, t, s) for i, t in enumerate(texts) for s in ["s"]] + [(i * 3 + 1, t, None) for i, t in enumerate(texts[:-1])] + [(i * 3 + 2, t, f"s{i % 2}") for i, t in enumerate(texts[:-1])] + [(None, "last", "s")]
    same_as_sql("golden_cases", "documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "source": pa.array([r[2] for r in rows], pa.string())}))


def test_no_row_holds_a_golden_set(spark, same_as_sql):
    """A line is a case, however many a source has, and its place counts over ranges."""
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    known = set(shared.glob("tarnfold-golden-*/source=*"))
    same_as_sql("golden_cases", "documents", pa.table({"doc_id": pa.array(range(2000, 0, -1), pa.int64()), "text": [f"t{i}" for i in range(2000)], "source": ["a" if i % 10 else "b" for i in range(2000)]}))
    lines = [line for folder in set(shared.glob("tarnfold-golden-*/source=*")) - known for f in folder.glob("part-*") for line in f.read_text().splitlines()]
    assert len(lines) == 2000 and all(len(json.loads(line)["cases"]) == 1 for line in lines)


def test_turns_that_are_like_edges(same_as_sql):
    """Lines of a turn that the next one repeats, rows and headings at its ends, blanks, line breaks of all kinds, no text."""
    texts = ["The.", "a\nThe.", "\n\nb", "| c | 3 |\nd", " \n", "e\r\nf\x0bg\x85h i\x1cj\n", "\r", "## Part", "# Part\n\nk", "| b | 2 |", "Report", "Report\nReport", None, "| a | 1 |\n| b | 2 |", "", "l\n\x1c\n"]
    rows = [(c, turn, t if c < len(texts) else texts[(turn * 7 + c * (turn % 5)) % len(texts)]) for c, t in enumerate(texts + ["mixed"] * 20) for turn in range(1 + c % 9 if c % 2 else 8)]
    same_as_sql("stitched_pages", "conversations", pa.table({"conv_id": pa.array([r[0] for r in rows], pa.int64()), "turn": pa.array([r[1] for r in rows], pa.int64()), "text": pa.array([r[2] for r in rows], pa.string())}))


def test_pages_still_share_more_than_a_line():
    assert stitching.joined_at("x\ny\nfoot", "foot\ny\nz")[1:] == ("z", {"lines": 2, "tables": 0, "headings": 0})
    assert stitching.joined_at("x\ny\nfoot", "foot\ny\nz", 1)[1:] == ("y\nz", {"lines": 1, "tables": 0, "headings": 0})


def test_documents_that_sound_like_models(same_as_sql):
    """Own lines that open or close as a model's do, headings, blanks of all kinds at the ends, no text, a long one."""
    texts = ["Here is thing eres.\nb", "Sure, a\nHere is b\nSure, done", "a\n\nLet me know\nI hope this", "If you have it.", "Here is it", "\n\n Below is x \n\n", "\xa0x　", "\x0bx\r", " \r", None, "", " ", "\n", "# A\nb\n## B\n", "I see\n# I see\n\nFeel free", "y" * 190, "z " * 90, "Certainly, no\n\n\n\n\n\nNote: I have kept", "w é\n" * 500_000]
    rows = [(i * 5 + k, t) for i, t in enumerate(texts) for k in range(5)] + [(-7, "Here is x"), (-3, "Sure, y")]
    same_as_sql("model_artifacts", "documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
