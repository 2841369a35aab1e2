"""How filters of a chain overlap, over every order in which they can run.

Each document has a mask: one bit a filter that it fails. Documents are added up to cells,
one for each part, mask and label, so that all orders are worked out over at most 32 masks
a part whatever the corpus. The cells are unpivoted against the steps of all orders; a
running bit-or over the steps before tells what a cell had failed already, conditional sums
give the metrics of each step, and totals over a filter's window give its Shapley sum.

A document is a copy if a smaller id has the same text. Copies are counted by (text, part,
label, id), then by (text, part, label): the least id and how many rows carry it are partial
aggregates, so a text that a third of all rows share is a few rows by the time they meet.

Defined cases: a null text is the empty one (no words; with no other fault it fails A
alone); a null part is the empty string; rows of one id and text are separate documents of
which none is the other's copy; a null id is smaller than none and has no smaller one, and
no label; labels that repeat an id count if any of them holds, null labels hold nowhere;
ids that a third of all rows share meet their labels one row a text; an empty table
gives no part and so no rows; further columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfold.llm.workspace import BLANKS, UPPER

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3  # words; distinct words and capitals in percent
SIGNS = r"[#$%&*|]"
LABEL = ["good", "toxic"]


def orders(filters: str) -> list[str]:
    """All orders of the filters' letters."""
    return ["".join(p) for p in permutations(filters)]


def text_mask(text: Column) -> Column:
    """Bits of A to D; words are found once."""
    t = F.coalesce(text, F.lit(""))
    once = lambda value, change: F.transform(F.array(value), change)[0]
    counts = once(F.regexp_extract_all(t, F.lit(f"[^{BLANKS}]+"), F.lit(0)), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).cast("long").alias("distinct")))
    few = once(counts, lambda c: F.when(c["all"] < LEAST_WORDS, 1).otherwise(0) + F.when(100 * c["distinct"] < LEAST_DISTINCT * c["all"], 2).otherwise(0))
    capitals = (F.length(t) - F.length(F.translate(t, UPPER, ""))).cast("long")
    return few + F.when(100 * capitals > MOST_CAPITALS * F.length(t), 4).otherwise(0) + F.when(t.rlike(SIGNS), 8).otherwise(0)


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic. A row without an id meets no label; it is dealt by its text's digest, so such rows aren't one task."""
    held = [F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))]
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(*held)
    met = (F.coalesce("doc_id", F.xxhash64("digest")) == F.col("_id")) & F.col("doc_id").isNotNull()
    return rows.join(known, met, "left").drop("_id").withColumns({c: F.coalesce(c, F.lit(False)) for c in LABEL})


def cells(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, mask, good, toxic, n: how many documents of the part have that mask and label."""
    t = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), text_mask(F.col("text")).alias("mask"), F.unhex(F.sha2(t, 256)).alias("digest"))
    rows = rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    same = labelled(rows, labels).groupBy("digest", "mask", "part", *LABEL).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_null")
    )
    first = F.when(F.col("least") == F.min("least").over(Window.partitionBy("digest")), F.col("n_least")).otherwise(0) + F.col("n_null")
    both = same.withColumn("first", first).select("part", *LABEL, F.explode(F.array(F.struct("mask", F.col("first").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("first")).alias("n")))).alias("c"))
    return both.groupBy("part", *LABEL, "c.mask").agg(F.sum("c.n").alias("n")).filter("n > 0")


def against_steps(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Each cell at each step of each order, with the letter and the bit of the step's filter."""
    each = cells.withColumn("filter_order", F.explode(F.lit(orders(filters))))
    each = each.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter"))
    return each.withColumns({"step": F.col("at") + 1, "bit": F.expr(f"shiftleft(1, position(letter, '{filters}') - 1)")}).drop("at")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, filter_order, step and its counts, for every part, order and step."""
    grid = against_steps(cells(docs, labels, part))
    here = F.col("mask").bitwiseAND(F.col("bit"))
    run = Window.partitionBy("part", *LABEL, "mask", "filter_order").orderBy("step")
    before = F.coalesce(F.bit_or(here).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grid = grid.withColumns({"fails": here > 0, "gone": before > 0})
    count = lambda when, name: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).alias(name)
    fails, gone = F.col("fails"), F.col("gone")
    out = grid.groupBy("part", "filter_order", "step", "letter").agg(
        count(~fails & ~gone, "kept"), count(fails & ~gone, "removed"), count(fails & gone, "redundant"), count(F.col("mask") == F.col("bit"), "unique_fails"),
        count(fails & ~gone & F.col("good"), "good_lost"), count(fails & ~gone & F.col("toxic"), "toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def op12_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, CAST(coalesce(good, false) AS INT) AS good, CAST(coalesce(toxic, false) AS INT) AS toxic, CAST(len(words) < 200 AS INT) AS A, CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT) AS B,
  CAST(100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) AS INT) AS C, CAST(regexp_matches(t, '[#$%&*|]') AS INT) AS D, CAST(coalesce(doc_id > first, false) AS INT) AS E FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, good, toxic, [A, B, C, D, E] AS m, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(range(5)) AS i), p AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT list_aggregate(list_transform(o, lambda k: 'ABCDE'[k + 1]), 'string_agg', '') AS filter_order, o, unnest(range(1, 6)) AS step FROM p),
g AS (SELECT c.*, s.filter_order, s.step, o[step] AS k, m[o[step] + 1] = 1 AS fails, len(list_filter(o[1:step - 1], lambda k: m[k + 1] = 1)) > 0 AS gone, list_sum(m) = 1 AND m[o[step] + 1] = 1 AS alone FROM c, s),
r AS (SELECT part, filter_order, step, k, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails AND NOT gone THEN n * good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN n * toxic ELSE 0 END) AS toxic_lost FROM g GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM r
"""
