"""The clean-up steps on literals."""

import pytest
from pyspark.sql import functions as F

from tarnfold.functions import decisions, markdown, ordered


@pytest.mark.parametrize(
    ("step", "text", "want"),
    [
        (markdown.collapse_newlines, "one\n\n\ntwo\n\nthree\n\n\n\n", "one\n\ntwo\n\nthree\n\n"),
        (markdown.strip_broken_links, "see [here]( ) or [there](# ), not [this](u)", "see here or there, not [this](u)"),
        (ordered.repair_headings, "### start\n##### far below\ntext\n# up\n### down\n#no", "### start\n#### far below\ntext\n# up\n## down\n#no"),
        (markdown.strip_trailing_whitespace, "kept  inside \t\n\u3000\n end\u00a0", "kept  inside\n\n end"),
        (markdown.join_superscripts, "5x10\n−3 kg by the 22 nd of 10 5", "5x10^−3 kg by the 22nd of 10 5"),
        (markdown.join_superscripts, "5433 stß, ß2 nd, 2 ndx; x10\n5ß x10\v5", "5433stß, ß2nd, 2 ndx; x10^5ß x10\v5"),
        (markdown.strip_bullet_glyphs, "* ▪ cell\n3)    gap\n▪ alone \ue0b7x", "* cell\n3) gap\n▪ alone x"),
        (markdown.normalize_markdown, "## Part\nbody\r\n\r\n\r\n2) item\n", "## Part\n\nbody\n\n2. item\n"),
        (markdown.strip_frontmatter, "---\nk: v\nl: w\n---\nrest\n---\n", "rest\n---\n"),
        (markdown.blank_page_numbers, "12 / 40\nPAGE 2 of 3  \npages 4\n 9", "\n\npages 4\n"),
        (ordered.html_unescape, "a &lt;b&gt; &#228; &#x3b1; &amp;amp; & co", "a <b> ä α &amp; & co"),
        (ordered.blank_repeated_cells, "|x|x|\n|-|-|\n|---|---|\n| y | y |", "|x|x|\n|-| |\n|---|---|\n| y | y |"),
        (ordered.blank_repeated_headings, "# T\na\n## T\n# U\n# U", "# T\na\n\n# U\n# U"),
    ],
)
def test_step(spark, step, text, want):
    assert spark.range(1).select(step(F.lit(text))).first()[0] == want


def test_priority(spark):
    got = spark.createDataFrame([(9.0, False), (2.0, True)], "j double, s boolean").select(decisions.hitl_priority(F.col("j"), F.col("s"))).collect()
    assert [r[0] for r in got] == [1.0, 16.0]
