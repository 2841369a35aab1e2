"""URL filter: rules first, then trust and distrust propagated over the links between hosts.

A rule (host, path) fits its host and all subdomains if the url's path starts with
the rule's; the longest wins. Urls that no rule judges get their host's verdict. Trust
is a personalised PageRank from the pages that rules allow, along links; distrust one
from the pages that rules block, against links, since linking to a blocked host speaks
against the linker. Both are in units of seed pages (the usual rank over 1 - DAMPING),
so a host without links keeps its own seeds in full; a host is blocked if distrust exceeds trust by
at least `THRESHOLD` times its own pages.

Links are counted by pair of hosts before anything else (a host with a third of all
pages is one row for each host that it links to), and every round is written to the
shared folder. Rounds go on until the largest part that one sends is SETTLED of the largest
seed: each sends DAMPING of the one before at most, so about 130 rounds reach that on any graph, however long its chains.

Defined cases: a null url or one without `://` has an empty host and path, fits no
rule and is allowed; a null html has no links; relative links stay within a host and
move nothing; repeated rows count as pages of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.llm.workspace import Workspace, ascii_lower

# The rules of the query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
DAMPING, SETTLED, THRESHOLD = 0.85, 1e-9, 0.5  # part of a rank sent on; share of the largest seed below which nothing is; net distrust a page that blocks
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as host and path joined; null if none does."""
    out = None
    for h, p, _ in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, h + p) if out is None else out.when(fits, h + p)
    return out if out is not None else F.lit(None).cast("string")


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, share: the part of src's links to other hosts that go to dst."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("to"))
    target = host_of(F.when(F.startswith("to", F.lit("//")), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to")))
    return links.select("src", target.alias("dst")).filter((F.col("src") != F.col("dst")) & (F.col("dst") != "") & (F.col("src") != "")).groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, ws: Workspace) -> DataFrame:
    """host, trust, distrust: both ranks at once, as moves in two directions over the same links."""
    outs, ins = links.groupBy("src").agg(F.sum("n").alias("total")), links.groupBy("dst").agg(F.sum("n").alias("total"))
    forth = links.join(outs, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("n") / F.col("total")).alias("share"))
    back = links.join(ins, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), (F.col("n") / F.col("total")).alias("share"))
    moves = ws.save(forth.unionByName(back), "moves")
    start = seeds.select(F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("allowed").alias("seed")), F.struct(F.lit("distrust").alias("kind"), F.col("blocked").alias("seed")))).alias("x"), "host").select("x.kind", "host", F.col("x.seed").cast("double").alias("seed"))
    start = ws.save(start, "seeds")
    # What a round sends on is kept apart from what has come: the rank is the sum of all rounds, and the end is when the largest part sent is small.
    most = start.agg(F.max("seed")).first()[0] or 0.0
    rank = start.withColumnRenamed("seed", "rank")
    sent, rounds = rank.filter("rank > 0"), 0
    while most > 0 and not moves.isEmpty():
        part = moves.join(sent.withColumnRenamed("host", "a"), ["kind", "a"]).groupBy("kind", F.col("b").alias("host")).agg((DAMPING * F.sum(F.col("rank") * F.col("share"))).alias("rank"))
        sent = ws.save(part, f"sent/round={rounds}")
        rounds += 1
        largest = sent.agg(F.max("rank")).first()[0] or 0.0
        if largest < SETTLED * most:
            break
    if rounds:
        rank = rank.unionByName(ws.spark.read.schema(sent.schema).parquet(f"{ws.path}/sent").select(*rank.columns))
    return rank.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], name: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    ws = Workspace(pages.sparkSession, name)
    verdict_of = {h + p: v for h, p, v in rules}
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    named = named.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.when(F.col("rule").isin([r for r, v in verdict_of.items() if v == "allow"]), "allow").when(F.col("rule").isNotNull(), "block")
    judged = named.withColumn("by_rule", by_rule)
    seeds = judged.filter("host <> ''").groupBy("host").agg(F.count(F.when(F.col("by_rule") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("by_rule") == "block", 1)).alias("blocked"), F.count("*").alias("pages"))
    seeds = ws.save(seeds, "hosts")
    rank = propagate(seeds, ws.save(host_links(named), "links"), ws)
    speaks = F.round(F.col("distrust") - F.col("trust"), 9) >= THRESHOLD * F.col("pages")
    bad = rank.join(seeds, "host").filter(speaks).select("host", F.lit(True).alias("bad"))
    out = judged.drop("html").join(bad, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), RULES, "op1")


def _oracle() -> str:
    """The same walk, some rounds longer."""
    quoted = LINK.replace("'", "''")
    fits = "\n".join(f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
    allow = ", ".join(f"'{h + p}'" for h, p, v in RULES if v == "allow")
    lower = "translate(coalesce(regexp_extract({}, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE named AS MATERIALIZED (
  SELECT page_id, {lower.format("url")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages
), ruled AS MATERIALIZED (SELECT *, CASE
{fits}
  END AS rule FROM named), judged AS MATERIALIZED (
  SELECT *, CASE WHEN rule IN ({allow}) THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS by_rule FROM ruled
), found AS (SELECT host AS src, unnest(regexp_extract_all(html, '{quoted}', 1)) AS url FROM named
), links AS MATERIALIZED (
  SELECT src, {lower.format("CASE WHEN starts_with(url, '//') THEN concat('http:', url) ELSE url END")} AS dst, count(*) AS n FROM found GROUP BY ALL
), link AS MATERIALIZED (SELECT * FROM links WHERE src <> dst AND dst <> '' AND src <> ''
), moves AS MATERIALIZED (
  SELECT 'trust' AS kind, src AS a, dst AS b, n / sum(n) OVER (PARTITION BY src) AS share FROM link
  UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM link
), hosts AS MATERIALIZED (
  SELECT host, count(*) FILTER (WHERE by_rule = 'allow') AS allowed, count(*) FILTER (WHERE by_rule = 'block') AS blocked, count(*) AS n_pages
  FROM judged WHERE host <> '' GROUP BY host
), rank0s AS (SELECT 'trust' AS kind, host, CAST(allowed AS DOUBLE) AS seed FROM hosts UNION ALL SELECT 'distrust', host, CAST(blocked AS DOUBLE) FROM hosts
), walk AS (
  SELECT kind, host, seed AS rank, 0 AS step FROM rank0s WHERE seed > 0
  UNION ALL SELECT kind, b, {DAMPING} * sum(rank * share), step + 1 FROM walk JOIN moves USING (kind) WHERE host = a AND step < 300 GROUP BY kind, b, step
), ranked AS (SELECT kind, host, sum(rank) AS rank FROM walk GROUP BY ALL)
, bad AS (
  SELECT host FROM hosts JOIN ranked USING (host) GROUP BY host, n_pages
  HAVING round(sum(CASE kind WHEN 'distrust' THEN rank ELSE -rank END), 9) >= {THRESHOLD} * n_pages
)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM judged
"""


ORACLE_SQL = _oracle()
