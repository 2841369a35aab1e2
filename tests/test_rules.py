"""Clean-up rule steps on literals."""

import pytest

from tarnfold.functions import rules


@pytest.mark.parametrize(
    ("kind", "params", "text", "want", "fixes"),
    [
        ("strip_lines_matching", {"pattern": "^draft"}, "draft 1\nkeep\ndraft 2", "keep", 2),
        ("rewrite_pattern", {"pattern": r"(\d+) USD", "replacement": r"$\1"}, "5 USD and 6 USD", "$5 and $6", 2),
        ("strip_headers_footers", {"first_n": 1, "last_n": 1, "patterns": ["^--"]}, "head\na\n-- x\nb\nfoot", "a\nb", 3),
        ("normalize_headings", {}, "Title\n=====\n\nPart\n---\nx\n\n---", "# Title\n\n## Part\nx\n\n---", 2),
        ("fix_numbered_headings", {}, "# 4.2.7 Pumps\n## 3.12 Valves\n#### 9 Ends\n## Plain", "### 4.2.7 Pumps\n## 3.12 Valves\n# 9 Ends\n## Plain", 2),
        ("merge_hardwrapped_paragraphs", {}, "one\n two \nthree\n\n# H\nfour\n- item\nfive\nsix", "one two three\n\n# H\nfour\n- item\nfive six", 3),
        ("fix_bullets", {}, "* a\n```\n* b\n```\n  + c", "- a\n```\n* b\n```\n  - c", 2),
        ("fix_bullets", {}, "no bullets", "no bullets", 0),
    ],
)
def test_step(spark, kind, params, text, want, fixes):
    df = spark.createDataFrame([(text,)], "text string")
    r = rules.apply_rule(df, [(kind, params), ("unknown", {})]).first()
    assert r["text"] == want
    assert r["fix_counts"] == [(kind, fixes)] and r["steps_applied"] == ([kind] if fixes else [])


def test_steps_follow_each_other(spark):
    df = spark.createDataFrame([(1, "* a\nb\nc"), (2, None)], "doc_id int, text string")
    rule = [("fix_bullets", {"marker": "+"}), ("rewrite_pattern", {"pattern": r"\+ ", "replacement": "- "}), ("merge_hardwrapped_paragraphs", {})]
    got = {r["doc_id"]: r["text"] for r in rules.apply_rule(df, rule).collect()}
    assert got == {1: "- a\nb c", 2: None}
