"""Quality rules over lines that a host repeats across its documents.

A document's lines are normalised (lower case, digit runs as 0, blanks as one space, none at
the ends) and hashed with their host to 64 bits. Each line counts the distinct documents of
its host that hold it; documents with the same whole text are one document, so copies do
not make their own lines boilerplate. A line goes if more than `LEAST_DOCS` documents of
the host and more than `SHARE` of them hold it. A document that loses words is depleted if
less than `LEFT` of them, or fewer than `LEAST_WORDS`, stay; it is rejected, as is one that
fails the base rules.

Texts are read once: their counts and their lines' hashes are a table that the jobs after it
read. Counting lines is a distinct aggregate by (line, document), then by line, so a line
that a third of all documents hold is a row a task when it meets; giving verdicts back is a
join on the line, whose large partitions Spark splits. Texts move only if cleaned ones are
asked for, and only those that lose a line.

Defined cases: a null text is the empty one: no words, failed; null and empty hosts are one
host; null ids and repeated rows are rows of their own and each gets a verdict; blank lines
are never counted nor removed; a very long text is one row of a task, and its words are
held together to find repeated windows; an empty table gives no rows; columns named like
an output are replaced in the counts, and kept as they are in cleaned documents.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from tarnfold.llm.workspace import BLANKS, Workspace

LEAST_DOCS, SHARE = 10, 0.01  # a line goes beyond both: documents of its host, share of the host's documents
LEFT, LEAST_WORDS = 0.5, 10  # of a document that lost lines: share of its words, and words, that stay
MOST_REPEATED = 20  # percent of words in repeated windows
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
GROUP = 1 << 18  # words that are compared together, or one document's


def repeats(words: list[list[bytes]]) -> list[int]:
    """How many words of each document lie in a WINDOW of words that it holds twice or more. Numbers stand for words and windows exactly, one to one."""
    lengths = np.array([len(w) for w in words])
    total = int(lengths.sum())
    if total < WINDOW:
        return [0] * len(words)
    one = pd.factorize(np.fromiter(chain.from_iterable(words), object, total))[0].astype(np.int64)
    base = one.max() + 1
    window = one
    for k in range(1, WINDOW):  # numbers of k words and the next word's, numbered anew
        window = pd.factorize(window[:-1] * base + one[k:])[0].astype(np.int64)
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(words)), lengths)
    inside = doc[: len(window)] == doc[WINDOW - 1 :]
    at = np.nonzero(inside)[0]
    same = pd.factorize(window[at] * len(words) + doc[at])[0]
    at = at[np.bincount(same)[same] > 1] if len(at) else at
    open_, close = np.bincount(at, minlength=total + 1), np.bincount(at + WINDOW, minlength=total + 1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(open_ - close)[:total] > 0)))
    return np.diff(covered[np.concatenate(([0], ends))]).tolist()


@F.pandas_udf(LongType())
def repeated_words(texts: pd.Series) -> pd.Series:
    """Documents are taken side by side up to GROUP words."""
    out, held, size = [], [], 0
    for text in texts:
        words = text.encode().split()  # bytes are split at the six blanks alone
        if held and size + len(words) > GROUP:
            out += repeats(held)
            held, size = [], 0
        held.append(words)
        size += len(words)
    return pd.Series(out + (repeats(held) if held else []))


def normal_lines(text: Column) -> Column:
    """The normalised lines of a text, in place; one that isn't blank has as many words as spaces and one more."""
    low = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), "[\\x20\\x09\\x0B-\\x0D]+", " ")
    return F.transform(F.split(low, "\n"), lambda x: F.trim(x))


def counted(docs: DataFrame, host: str = "source") -> DataFrame:
    """Each document's counts, its host, its text's hash, and its lines' hashes (0: blank) and numbers of words, in order."""
    text, h = F.coalesce("text", F.lit("")), F.coalesce(F.col(host), F.lit(""))
    words_of = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    lines = F.transform(normal_lines(text), lambda x: F.struct(F.when(x == "", F.lit(0).cast("long")).otherwise(F.xxhash64(h, x)).alias("line"), F.when(x == "", 0).otherwise(words_of(x)).alias("words")))
    full = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    return docs.withColumns({
        "lines": lines, "host": F.xxhash64(h), "digest": F.xxhash64(text),
        "word_chars": F.length(F.regexp_replace(text, f"[{BLANKS}]+", "")).cast("long"), "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size(full) - F.size(F.array_distinct(full))).cast("long"), "n_repeat_words": repeated_words(text),
    }).withColumns({
        "n_words": F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + x["words"]),
    }).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def frequent_lines(docs: DataFrame) -> DataFrame:
    """host, line, held: lines of counted documents beyond both limits."""
    lines = docs.select("host", "digest", F.explode("lines.line").alias("line")).filter("line <> 0")
    held = lines.groupBy("host", "line").agg(F.count_distinct("digest").alias("held")).filter(F.col("held") > LEAST_DOCS)
    hosts = docs.groupBy("host").agg(F.count_distinct("digest").alias("docs"))
    return held.join(hosts, "host").filter(F.col("held") > SHARE * F.col("docs")).drop("docs")


def judged(ws: Workspace, docs: DataFrame, host: str = "source", texts: bool = False) -> DataFrame:
    """doc_id (with texts: all columns of docs) with row, the counts, removed words, the removed lines' hashes, and whether the document is kept."""
    keep = [F.col(c) for c in docs.columns] if texts else [F.col("doc_id")]
    inputs = docs.select(F.struct(*keep).alias("doc"), "text", F.col(host).alias("_host"))
    rows = ws.save(counted(inputs, "_host").drop("text", "_host").withColumn("row", F.monotonically_increasing_id()), "counted")
    frequent = ws.save(frequent_lines(rows), "frequent")
    lines = rows.select("row", F.explode("lines").alias("x")).select("row", "x.*").filter("line <> 0")
    lost = lines.join(frequent.select("line"), "line", "left_semi").groupBy("row").agg(F.sum("words").alias("removed"), F.collect_set("line").alias("gone"))
    out = rows.join(lost, "row", "left").withColumn("removed", F.coalesce("removed", F.lit(0)))
    stay = F.col("n_words") - F.col("removed")
    depleted = (F.col("removed") > 0) & ((stay < LEFT * F.col("n_words")) | (stay < LEAST_WORDS))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


@F.pandas_udf(StringType())
def without_lines(text: pd.Series, lines: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the lines that have one of the hashes."""
    out = []
    for t, hashes, g in zip(text, lines, gone, strict=True):
        away = set(g.tolist())
        out.append("\n".join(x for x, h in zip(t.split("\n"), hashes.tolist(), strict=True) if h not in away))
    return pd.Series(out)


def clean(ws: Workspace, docs: DataFrame, host: str = "source") -> DataFrame:
    """docs that are kept, without the lines that their hosts repeat; other columns stay as they are."""
    rows = judged(ws, docs, host, texts=True).filter("kept")
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(without_lines(F.coalesce("doc.text", F.lit("")), F.col("lines.line"), F.coalesce("gone", F.array().cast("array<bigint>"))))
    return rows.select(F.col("doc").alias("_doc"), text.alias("_text")).select(*[F.col("_text").alias(c) if c == "text" else F.col(f"_doc.{c}") for c in docs.columns])


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(Workspace(spark, "op11"), spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("removed").alias("n_removed_words"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, host, t, doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
e AS (SELECT r, unnest(words) AS w1, unnest(range(len(words))) AS i FROM w),
v AS (SELECT *, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4, lead(w1, 4) OVER o AS w5 FROM e WINDOW o AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, w5 IS NOT NULL AND count(*) OVER (PARTITION BY r, w1, w2, w3, w4, w5) > 1 AS twice FROM v),
c AS (SELECT r, count(*) FILTER (WHERE covered) AS n FROM (SELECT r, bool_or(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM g) GROUP BY r),
l AS (SELECT r, host, t, x.line AS line, x.words AS words FROM (SELECT r, host, t, unnest(list_transform(lines, lambda x: {'line': trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')), 'words': len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))})) AS x FROM w)),
h AS (SELECT host, count(DISTINCT t) AS docs FROM d GROUP BY host),
f AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT t) AS held FROM l GROUP BY ALL) JOIN h USING (host) WHERE held > 10 AND held > 0.01 * docs),
m AS (SELECT r, sum(words) AS removed FROM l JOIN f USING (host, line) GROUP BY r),
s AS (SELECT doc_id, len(words) AS n_words, len(array_to_string(words, '')) AS word_chars, len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(removed, 0) AS removed
  FROM w LEFT JOIN c USING (r) LEFT JOIN m USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (removed > 0 AND (n_words - removed < 0.5 * n_words OR n_words - removed < 10)) AS kept, CAST(removed AS BIGINT) AS n_removed_words FROM s
"""
