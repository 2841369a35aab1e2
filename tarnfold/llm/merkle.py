"""Merkle manifest of a dataset: a tree a language, a tree over their roots, and a proof a record.

Leaves are numbered within their tree by one range sort and the counts of its partitions.
Each task then pushes its leaves on a stack of peaks, as in a mountain range: whenever the
last `BASE` peaks are the children of one node they carry into it, the way digits carry,
and the node is recorded. A stack is put away at each aligned block of `BASE ** SPAN`
leaves, so it holds a bounded number of leaves and what is left are the block's peaks.
Peaks of blocks that a partition's edge cuts, and of whole blocks, meet in rounds, grouped
by aligned blocks of `BASE ** SPAN` times the size, until each tree has one. A tree's last
run of nodes may be short: the tree's number of leaves tells it, so it is hashed as it is,
without padding. Going back down, each round adds the siblings between a node and its peak,
and a leaf's proof is what it passed within its block, its peak's siblings and those of
its tree's root.

Hashes are over lower-case hex text; tables hold the 32 bytes.

Defined cases: null columns are `-`; a null id comes first, and rows of one id follow their
leaf's digest, so equal rows, in whatever order, give the same tree; a null partition column is
a tree of its own, before the empty string's; a tree of one leaf is that leaf, and a proof
without siblings is empty; an empty table gives no rows and no root; further columns, also
those named like an output, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tarnfold.llm.workspace import Workspace

BASE, SPAN = 2, 12  # children of a node; levels that a block grows by
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

Node = tuple[int, int]  # level, place in it


def hashed(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """`-` for null, else the length in bytes, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(**instead: Column) -> Column:
    """The digest of a record; `instead` has other values for some columns."""
    return F.unhex(F.sha2(F.concat(*[field(instead.get(c, F.col(c))) for c in FIELDS]), 256))


def tree_key(value: Column) -> Column:
    """Bytes that sort null first, then by UTF-8."""
    return F.coalesce(F.concat(F.lit(bytearray(b"\x01")), value.cast("string").cast("binary")), F.lit(bytearray()))


def climb(nodes: list[tuple[int, int, str]], n: int, base: int) -> tuple[dict[Node, str], list[list[Node]]]:
    """Push nodes (level, place, digest), each beginning where the one before ends, on a stack of peaks of a tree with n leaves. The digests of all nodes by place, and which each push completed."""
    stack: list[list[Node]] = []  # runs of siblings that aren't complete yet
    known, made = {}, []
    for level, at, digest in nodes:
        new, done = (level, at), []
        known[new] = digest
        while True:
            level, at = new
            width = -(-n // base**level)
            run = [*stack.pop(), new] if at % base and stack and stack[-1][-1] == (level, at - 1) else [new]
            first, last = run[0][1], at % base == base - 1 or at == width - 1
            if width == 1 or first % base or not last:
                stack.append(run)
                break
            new = (level + 1, at // base)
            known[new] = hashed("".join(known[x] for x in run))
            done.append(new)
        made.append(done)
    return known, made


def passed(node: Node, known: dict[Node, str], n: int, base: int) -> tuple[Node, str]:
    """The peak above a node, and the digests of all siblings on the way to it."""
    (level, at), path = node, []
    width = -(-n // base**level)
    while width > 1 and (level + 1, at // base) in known:
        first = at - at % base
        path += [known[level, s] for s in range(first, min(first + base, width)) if s != at]
        level, at, width = level + 1, at // base, -(-width // base)
    return (level, at), "".join(path)


def fold(digest: str, at: int, n: int, path: str, base: int = BASE) -> tuple[str, str]:
    """The root that a leaf's digest and its siblings give, and the siblings that are left."""
    while n > 1:
        first = at - at % base
        size = min(base, n - first)
        siblings = [path[64 * i : 64 * i + 64] for i in range(size - 1)]
        siblings.insert(at - first, digest)
        digest, path = hashed("".join(siblings)), path[64 * (size - 1) :]
        at, n = at // base, -(-n // base)
    return digest, path


def climbed(nodes: DataFrame, span: int) -> DataFrame:
    """Nodes (tree, n, level, at, digest, others), sorted within partitions by tree and first leaf, with their peak among what follows each other in aligned blocks of BASE ** span leaves: p_level, p_at, p_digest, the path there, and the nodes completed."""

    base = BASE  # the tasks get the value of now

    def of_run(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].iat[0])
        given = list(zip(rows["level"].tolist(), rows["at"].tolist(), [d.hex() for d in rows["digest"]], strict=True))
        known, made = climb(given, n, base)
        peaks = [passed((k, j), known, n, base) for k, j, _ in given]
        return rows.assign(
            p_level=[p[0] for p, _ in peaks], p_at=[p[1] for p, _ in peaks], p_digest=[bytes.fromhex(known[p]) for p, _ in peaks], path=[bytes.fromhex(x) for _, x in peaks],
            made=[[{"level": k, "at": j, "digest": bytes.fromhex(known[k, j])} for k, j in new] for new in made],
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for rows in batches:
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            size = base ** rows["level"].astype("int64")
            first = rows["at"] * size
            block = first // base**span
            new = (rows["tree"] != rows["tree"].shift()) | (block != block.shift()) | (first != (first + size).shift())
            cut = [*new.to_numpy().nonzero()[0].tolist(), len(rows)]
            for a, b in zip(cut[:-2], cut[1:-1], strict=True):
                yield of_run(rows.iloc[a:b])
            held = rows.iloc[cut[-2] :] if len(rows) else None
        if held is not None and len(held):
            yield of_run(held)

    return nodes.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema) + ", p_level int, p_at long, p_digest binary, path binary, made array<struct<level:int,at:bigint,digest:binary>>")


def peaks(mapped: DataFrame) -> DataFrame:
    """Each peak once: by the node with which it begins."""
    begins = F.expr(f"at * CAST(power({BASE}, level) AS LONG) = p_at * CAST(power({BASE}, p_level) AS LONG)")
    return mapped.filter(begins).select("tree", "n", F.col("p_level").alias("level"), F.col("p_at").alias("at"), F.col("p_digest").alias("digest"))


class Forest:
    """The trees over leaves: a table of tree (bytes), digest, those it is sorted by, and further columns."""

    def __init__(self, ws: Workspace, leaves: DataFrame, order: list[str], name: str) -> None:
        """Number the leaves, and merge peaks, round by round, until each tree has one."""
        self.ws, self.name = ws, name
        self.leaves = self._numbered(leaves, order)
        self.most = self.leaves.agg(F.max("n")).first()[0] or 0
        found = ws.save(peaks(self._local()), f"{name}_peaks0")
        self.rounds: list[DataFrame] = []
        span = SPAN
        while not self.rounds or BASE**span < self.most:
            span += SPAN
            first = F.expr(f"at * CAST(power({BASE}, level) AS LONG)")
            met = found.withColumn("first", first).repartition("tree", F.floor(F.col("first") / BASE**span)).sortWithinPartitions("tree", "first").drop("first")
            self.rounds.append(ws.save(climbed(met, span), f"{name}_round{len(self.rounds)}"))
            found = peaks(self.rounds[-1])
        self.roots = found.select("tree", "digest")

    def _numbered(self, leaves: DataFrame, order: list[str]) -> DataFrame:
        """leaves with at and n. A partition's rows of a tree are numbered by the rows of the partitions before it; equal rows are dealt at random."""
        keys = ["tree", *order, "_any"]
        ranged = leaves.withColumn("_any", F.rand(7)).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_any")
        ranged = self.ws.save(ranged.withColumn("_row", F.monotonically_increasing_id()), f"{self.name}_leaves").withColumn("_part", F.shiftright("_row", 33))
        held = ranged.groupBy("tree", "_part").agg(F.min("_row").alias("first"), F.count("*").alias("rows"))
        before = "OVER (PARTITION BY tree ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        shifts = held.select("tree", "_part", F.expr(f"coalesce(sum(rows) {before}, 0) - first").alias("_shift"), F.expr("sum(rows) OVER (PARTITION BY tree)").alias("n"))
        shifts = self.ws.save(shifts, f"{self.name}_shifts")
        return ranged.join(shifts, ["tree", "_part"]).withColumn("at", F.col("_row") + F.col("_shift")).drop("_row", "_part", "_shift")

    def _local(self) -> DataFrame:
        """Leaves with their peak in their block. They are stored in order; the sort keeps that, however they met their numbers."""
        return climbed(self.leaves.withColumn("level", F.lit(0)).sortWithinPartitions("tree", "at"), SPAN)

    def records(self) -> DataFrame:
        """All nodes: tree, level, at, digest."""
        out = self.leaves.select("tree", F.lit(0).alias("level"), "at", "digest")
        for mapped in [self._local(), *self.rounds]:
            out = out.unionByName(mapped.select("tree", F.explode("made").alias("m")).select("tree", "m.*"))
        return out

    def above(self) -> DataFrame:
        """tree, level, at, path, root of the peaks that blocks of leaves have: the siblings from there to the root."""
        last = self.rounds[-1]
        out = last.select("tree", "level", "at", "path", F.col("p_digest").alias("root"))
        for mapped in reversed(self.rounds[:-1]):
            up = out.select("tree", F.col("level").alias("p_level"), F.col("at").alias("p_at"), F.col("path").alias("rest"), "root")
            out = mapped.join(up, ["tree", "p_level", "p_at"]).select("tree", "level", "at", F.concat("path", "rest").alias("path"), "root")
        return out

    def proofs(self, above: DataFrame | None = None) -> DataFrame:
        """The leaves' columns with at, n, path and what `above` has beside: one row a leaf. The peaks are a small share of the leaves; Spark joins them as their size asks."""
        above = self.above() if above is None else above
        up = above.withColumnsRenamed({"level": "p_level", "at": "p_at", "path": "rest"})
        found = self._local().drop("level", "p_digest", "made").join(up, ["tree", "p_level", "p_at"])
        return found.withColumn("path", F.concat("path", "rest")).drop("p_level", "p_at", "rest")


def manifest(ws: Workspace, docs: DataFrame, part: str = "lang", **tampered: Column) -> tuple[Forest, Forest]:
    """The trees by part, and the tree over their roots. `tampered` gives a second digest a record, of other values, or null."""
    leaves = docs.select("doc_id", tree_key(F.col(part)).alias("tree"), leaf().alias("digest"), *[c.alias(k) for k, c in tampered.items()])
    trees = Forest(ws, ws.save(leaves, "digests"), ["doc_id", "digest"], "trees")
    ws.drop("digests")
    roots = trees.roots.select(F.col("tree").alias("part"), F.lit(bytearray()).alias("tree"), "digest")
    return trees, Forest(ws, roots, ["part"], "top")


def proven(trees: Forest, top: Forest) -> DataFrame:
    """Each record with its place and siblings in its tree, its tree's place and number of trees, subroot, root and the siblings of both trees in one path."""
    up = top.proofs().select(F.col("part").alias("tree"), F.col("at").alias("top_at"), F.col("n").alias("top_n"), F.col("path").alias("top_path"), F.col("root").alias("top_root"))
    above = trees.above().join(up, "tree").select("tree", "level", "at", F.concat("path", "top_path").alias("path"), F.col("root").alias("subroot"), F.col("top_root").alias("root"), "top_at", "top_n")
    return trees.proofs(trees.ws.save(above, "above"))


@F.pandas_udf(BinaryType())
def folded(digest: pd.Series, at: pd.Series, n: pd.Series, top_at: pd.Series, top_n: pd.Series, path: pd.Series) -> pd.Series:
    """The root that a record's digest gives with the siblings of its tree and of the tree of trees."""
    out = []
    for d, a, m, b, k, p in zip(digest, at, n, top_at, top_n, path, strict=True):
        subroot, rest = fold(d.hex(), a, m, p.hex())
        out.append(bytes.fromhex(fold(subroot, b, k, rest)[0]))
    return pd.Series(out)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    trees, top = manifest(Workspace(spark, "op13"), docs, tampered=F.when(chosen, leaf(n_chars=F.col("n_chars") + 1)))
    rows = proven(trees, top).withColumn("folded", folded(F.coalesce("tampered", "digest"), "at", "n", "top_at", "top_n", "path"))
    text = lambda c: F.lower(F.hex(c))
    return rows.select(
        "doc_id", text("digest").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), F.sha2(text("path"), 256).alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified")
    )


_FIELD = "coalesce(concat(octet_length(encode({0})), ':', {0}), '-')"
_LEAF = "sha256(concat(" + ", ".join(_FIELD.format(f"CAST({c} AS VARCHAR)") for c in FIELDS) + "))"
_CRC = "list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)))"
_UP = "SELECT {0} level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {1} WHERE n > 1 GROUP BY ALL"
_FOLD = "SELECT {0}, p.level + 1, p.i // 2, (p.n + 1) // 2, concat(path, s.h), sha256(CASE WHEN p.i % 2 = 1 THEN concat(s.h, folded) ELSE concat(folded, s.h) END) FROM {1} p LEFT JOIN {2} s ON {3} s.level = p.level AND s.i = xor(p.i, 1) WHERE p.n > 1"
ORACLE_SQL = f"""
WITH RECURSIVE a AS (SELECT doc_id, lang, {_LEAF} AS leaf, CASE WHEN xor({_CRC}, 4294967295) % 7 = 0 THEN {_LEAF.replace("n_chars", "(n_chars + 1)")} END AS bad FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM a),
t AS (SELECT lang, 0 AS level, i, n, leaf AS h FROM d UNION ALL {_UP.format("lang,", "t")}),
r AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS top_i, count(*) OVER () AS top_n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, top_i AS i, top_n AS n, subroot AS h FROM r UNION ALL {_UP.format("", "u")}),
p AS (SELECT lang, i AS leaf_i, 0 AS level, i, n, '' AS path, coalesce(bad, leaf) AS folded FROM d UNION ALL {_FOLD.format("p.lang, leaf_i", "p", "t", "s.lang IS NOT DISTINCT FROM p.lang AND")}),
q AS (SELECT p.lang, leaf_i, 0 AS level, top_i AS i, top_n AS n, path, folded FROM p JOIN r ON r.lang IS NOT DISTINCT FROM p.lang WHERE p.n = 1 UNION ALL {_FOLD.format("p.lang, leaf_i", "q", "u", "")})
SELECT d.doc_id, d.leaf, r.subroot, u.h AS root, sha256(path) AS proof_sha256, folded AS folded_root, folded = u.h AS verified
FROM d JOIN r ON r.lang IS NOT DISTINCT FROM d.lang JOIN q ON q.lang IS NOT DISTINCT FROM d.lang AND q.leaf_i = d.i AND q.n = 1 JOIN u ON u.n = 1
"""
