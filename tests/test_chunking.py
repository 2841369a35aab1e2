"""The block grammar against a reading line by line, and chunk invariants on random markdown."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tarnfold.functions import chunking
from tarnfold.operators import chunking as C

POOL = ["", "", "  ", "plain text here", "more | pipes", "# One", "## Two words ", "#### Deep", "#no heading", "```", "```py", "  ```", "- item", "* other", "  continued", "12. numbered", "1.not", "| a | b |", "|---|:--:|", "x | y |", "|  |", "--- | ---", "    code-like"]


def by_line(text):
    """The same blocks, read with one look at each line and at what is open."""
    table = lambda x: "|" in x and (x.strip().startswith("|") or x.strip().endswith("|"))
    rule = lambda x: "|" in x and all(re.fullmatch(r"(:?-{3,}:?)?", c.strip()) for c in x.split("|"))
    item = lambda x: re.match(r"\s*([-*+]|\d+\.)\s", x)
    lines, out, i = text.split("\n"), [], 0
    while i < len(lines):
        x, j = lines[i], i + 1
        if x.strip().startswith("```"):
            while j < len(lines) and not lines[j].strip().startswith("```"):
                j += 1
            j = min(j + 1, len(lines))
            out.append(("code", lines[i:j]))
        elif re.match(r"#{1,6}\s+.", x):
            out.append(("heading", [x.strip()]))
        elif table(x) and j < len(lines) and rule(lines[j]):
            j += 1
            while j < len(lines) and table(lines[j]):
                j += 1
            out.append(("table", lines[i:j]))
        elif item(x):
            held = [x]
            while j < len(lines):
                k = j
                while k < len(lines) and not lines[k].strip():
                    k += 1
                if k == len(lines) or not (item(lines[k]) or re.match(r"\s{2,}\S", lines[k])):
                    break
                held += ([""] if k > j else []) + [lines[k]]
                j = k + 1
            out.append(("list", held))
        elif not x.strip():
            out.append(("blank", []))
        elif out and out[-1][0] == "paragraph":
            out[-1][1].append(x)
        else:
            out.append(("paragraph", [x]))
        i = j
    return [(k, "\n".join(v)) for k, v in out if k != "blank"]


@pytest.mark.parametrize("seed", range(300))
def test_blocks(seed):
    rng = random.Random(seed)
    text = "\n".join(rng.choice(POOL) for _ in range(rng.randrange(1, 30))).strip()
    assert [(k, t) for k, t, _ in chunking.blocks(text)] == by_line(text)


def test_chunks_lose_nothing_and_keep_blocks_whole(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(POOL) for _ in range(rng.randrange(1, 200))) for _ in range(40)] + [None, "", "  \n ", "x" * 5000, "# T\n\n" + "word " * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = df.select("doc_id", "text", chunking.semantic_chunks(F.col("text"), 20, 30).alias("s"), chunking.paragraph_chunks(F.col("text"), 100).alias("p"), chunking.hierarchical_chunks(F.col("text"), 100).alias("h")).collect()
    squeeze = lambda t: re.sub(r"\s", "", t)
    for r in got:
        if r["text"] is None:
            assert r["s"] is None and r["p"] is None
            continue
        for kind in "sph":
            assert [c["index"] for c in r[kind]] == list(range(len(r[kind])))
            assert squeeze("".join(c["text"] for c in r[kind])) == squeeze(r["text"])
        assert all(len(c["text"]) <= 100 for c in [*r["p"], *r["h"]])
        for _, block, _ in chunking.blocks(r["text"].strip()):
            assert any(block.strip("\n").strip() in c["text"] for c in r["s"])


def test_paths_and_siblings(spark):
    df = spark.createDataFrame([("# A\n\none\n\n## B\n\ntwo\n\n## C\n\nthree\n\n# D\n\nfour",)], "text string")
    h = df.select(chunking.hierarchical_chunks(F.col("text"), 1000).alias("h")).first()["h"]
    assert [(c["section_path"], c["parent_header_id"], c["sibling_ids"]) for c in h] == [(["A"], None, []), (["A", "B"], "A", ["2"]), (["A", "C"], "A", ["1"]), (["D"], None, [])]


def test_violations_lead_to_paragraphs(spark):
    df = spark.createDataFrame([("x" * 9000,), ("short text",), ("",)], "text string")
    got = {r["text"]: r for r in C.with_chunks(df, "no such strategy", target_tokens=20, max_tokens=30, max_chars=200).collect()}
    long = got["x" * 9000]
    assert long["strategy"] == "paragraph" and len(long["chunks"]) == 45 and long["qa"]["violations"] == ["duplication_ratio=0.978 > limit=0.100"]
    assert got["short text"]["strategy"] == "semantic" and got["short text"]["qa"]["passed"]
    assert got[""]["qa"]["violations"] == ["no_chunks"]


def test_workers_get_few_texts_at_once(spark, tmp_path):
    from tarnfold import session

    spark.range(1).write.parquet(f"{tmp_path}/documents.parquet")
    held = spark.conf.get(session.BATCH, None)
    try:
        for own, want in ((None, "1000"), ("77", "77")):
            spark.conf.unset(session.BATCH)
            if own:
                spark.conf.set(session.BATCH, own)
            session.table(spark, str(tmp_path), "documents")
            assert spark.conf.get(session.BATCH) == want
    finally:
        spark.conf.unset(session.BATCH)
        if held:
            spark.conf.set(session.BATCH, held)
