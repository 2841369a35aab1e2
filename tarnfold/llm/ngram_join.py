"""Exact similarity join on word n-gram sets with adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their sets of 5-word shingles is at
least 0.8. Equal sets collapse to one representative first. Exact document counts of
all shingles order each set from rare to common. A set of n shingles has a prefix of
n - ceil(0.8 n) + l shingles: of two similar sets, the prefixes share at least the
smaller l. Each document's l grows with its estimated candidate cost (the postings that
its prefix would meet), so costly documents must share more before they are verified.

Documents that share a prefix shingle and have sizes that may link form neighbourhoods.
Whole sets travel once, to their neighbourhood. A small neighbourhood is verified in
one cell. A large one is dealt into cells of at most `CELL_DOCS` documents: cells are
joined within, their components by representatives, and only documents outside the
largest component meet the others, cell by cell. So a large group of near copies costs
little more than its size, and no link between different texts is lost: what is
skipped are pairs that are connected already.

Defined cases: A-Z are lower-cased, words are runs of non-blank bytes; fewer than five
words make one shingle; a null or empty text has none and links with nothing; rows
with equal text, also with equal id, are one class; a null id counts as larger than all
others, and is a component of its own if nothing smaller is reachable.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfold.llm.blocks import BITS, NO_ID, Blocks, document_counts, mix, opened, power_tables, unsqueeze
from tarnfold.llm.workspace import Workspace

WORDS, PERCENT = 5, 80
CELL_DOCS, CELL_SHINGLES = 512, 1_000_000
MOST_ROUNDS = 500  # of components; they settle in about the square of the logarithm of the longest chain, and more is an error
HOT = 1024  # documents of a shingle that share a hub; a more common one gets several, and a hub of hubs
SLICE = 1 << 18  # bytes hashed at once
COSTS = [64, 1024, 16384]  # estimated candidates from which one more shared shingle is asked for
PICKED, TOTALS, PLACED = 0, 1 << 20, 1 << 21  # kinds of replies to blocks
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


# Bytes with A-Z lower-cased, and a factor for each word of a shingle.
_VALUE = np.array([x + 33 if 65 <= x <= 90 else x + 1 for x in range(256)], np.uint64)
_FACTORS = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def word_hashes(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every word of a block.

    A word's hash is a difference of running sums of its bytes times powers of an odd
    base, turned back by the inverse power of where it begins. Stretches of about SLICE
    bytes, which end where a word begins, are summed at a time.
    """
    inside = ~_BLANK[text]
    begins = np.zeros(len(text) + 1, bool)
    begins[starts] = True
    start = np.nonzero(inside & (np.append(True, ~inside[:-1]) | begins[:-1]))[0]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    end = np.nonzero(inside & (np.append(~inside[1:], True) | begins[1:]))[0]
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + SLICE)))
        low, n = int(start[i]), int(end[j - 1] - start[i]) + 1
        power, inverse = power_tables(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[text[low : low + n]] * power[:n], out=sums[1:])
        at = start[i:j] - low
        out[i:j] = (sums[end[i:j] - low + 1] - sums[at]) * inverse[at]
        i = j
    return mix(out + (end - start + 1).astype(np.uint64)), np.searchsorted(starts, start, side="right") - 1


def shingle_sets(row) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of a block's documents, one document after the other, and their bounds."""
    _, starts, text = opened(row)
    n_docs = len(starts) - 1
    word, doc = word_hashes(text, starts)
    n_words = np.bincount(doc, minlength=n_docs)
    begin = np.cumsum(n_words) - n_words
    # Where a document's shingles lie: as many as its words less four, one if it has fewer words, none without.
    n = np.where(n_words >= WORDS, n_words - WORDS + 1, (n_words > 0).astype(np.int64))
    bound = np.concatenate(([0], np.cumsum(n)))
    h = np.empty(bound[-1], np.uint64)
    long = n_words >= WORDS
    if long.any():
        count = len(word) - WORDS + 1
        every = word[:count] * _FACTORS[0]
        for k in range(1, WORDS):
            every += word[k : count + k] * _FACTORS[k]
        h[np.repeat(long, n)] = mix(every[doc[:count] == doc[WORDS - 1 :]])
    for d in np.nonzero(~long & (n_words > 0))[0]:
        h[bound[d]] = np.frombuffer(hashlib.blake2b(word[begin[d] : begin[d] + n_words[d]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[bound[:-1][n > 0]] = True
    kept = np.concatenate(([0], np.cumsum(new)))
    return h[new], kept[bound]


def _kind(row, low: int, high: int) -> list[bytes]:
    return [r["reply"] for r in (row.replies if row.replies is not None else []) if low <= r["part"] < high]


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for row in pdf.itertuples():
            ids = opened(row)[0]
            h, b = shingle_sets(row)
            sigs = [hashlib.blake2b(h[b[i] : b[i + 1]].tobytes(), digest_size=16).digest() for i in range(len(ids))]
            yield pd.DataFrame({"key": (row.block << 16) + np.arange(len(ids)), "row": np.frombuffer(row.rows, np.int64), "doc_id": ids, "n": np.diff(b), "sig": sigs})


def _picked_sets(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of the block's representatives, and their sets."""
    got = _kind(row, PICKED, TOTALS)
    rows = np.frombuffer(got[0], np.int32) if got else np.zeros(0, np.int32)
    h, b = shingle_sets(row)
    size = b[rows + 1] - b[rows]
    at = np.repeat(b[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return rows, h[at.astype(np.int64)], np.concatenate(([0], np.cumsum(size))).astype(np.int64)


def _counts(row) -> tuple[np.ndarray, np.ndarray]:
    _, h, _ = _picked_sets(row)
    return np.unique(h >> np.uint64(64 - BITS), return_counts=True)


def _ordered(row, wanted: set[int] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, int]]:
    """(row, shingles from rare to common, their document counts, base prefix, l) of each representative, or of those wanted."""
    rows, h, b = _picked_sets(row)
    short = h >> np.uint64(64 - BITS)
    replies = _kind(row, TOTALS, PLACED)
    total = np.concatenate([unsqueeze(r, np.uint32) for r in replies]) if replies else np.zeros(0, np.uint32)
    # Totals come in the order of the block's distinct hashes.
    order = np.argsort(short)
    sorted_short = short[order]
    count = np.empty(len(h), np.int64)
    if len(h):
        count[order] = total[np.cumsum(np.append(False, sorted_short[1:] != sorted_short[:-1]))]
    for i, r in enumerate(rows.tolist()):
        if wanted is not None and r not in wanted:
            continue
        s, c = h[b[i] : b[i + 1]], count[b[i] : b[i + 1]]
        n = len(s)
        # Sets are sorted, so a stable sort orders by count, then hash; counts beyond 65,535 count as that.
        rare = np.argsort(np.minimum(c, 65535).astype(np.uint16), kind="stable")
        s, c = s[rare], c[rare]
        prefix = n - -(-PERCENT * n // 100) + 1
        cost = int((c[:prefix] - 1).sum())
        yield r, s, c, prefix, 1 + sum(cost >= x for x in COSTS)


def _postings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for row in pdf.itertuples():
            tokens, keys, sizes, times = [], [], [], []
            for r, s, c, prefix, _ in _ordered(row):
                shared = s[:prefix][c[:prefix] > 1]
                tokens.append(shared)
                times.append(c[:prefix][c[:prefix] > 1])
                keys.append(np.full(len(shared), (row.block << 16) + r))
                sizes.append(np.full(len(shared), len(s)))
            if tokens:
                yield pd.DataFrame({"token": np.concatenate(tokens).view(np.int64), "key": np.concatenate(keys), "n": np.concatenate(sizes), "c": np.concatenate(times)})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sets of placed representatives, one row each."""
    for pdf in batches:
        for row in pdf.itertuples():
            got = _kind(row, PLACED, 2 * PLACED)
            if not got:
                continue
            place = {int(r): (int(nb), int(g)) for r, nb, g in np.frombuffer(got[0], np.int64).reshape(-1, 3)}
            out = [(nb, g, (row.block << 16) + r, len(s), prefix, times, s.tobytes()) for r, s, _, prefix, times in _ordered(row, set(place)) for nb, g in [place[r]]]
            yield pd.DataFrame(out, columns=["nb", "g", "key", "n", "prefix", "times", "set"])


def components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """node, label: the smallest node of each connected component, for nodes of edges (a, b), by alternating large and small stars until a round changes nothing."""
    now, before = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), None
    for i in range(MOST_ROUNDS):
        now = ws.save(now, f"{name}{i}")
        if i:
            ws.drop(f"{name}{i - 1}")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        before = mark
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least.hint("shuffle_hash"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small.hint("shuffle_hash"), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).filter("a <> b")
        now = joined.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")


class _Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def _incidence(parts: list[np.ndarray]) -> np.ndarray:
    """Shared entries of each pair of sets, by products of column blocks of the incidence matrix."""
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    token, column, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    keep = times[column] > 1
    doc, column = doc[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    out = np.zeros((len(parts), len(parts)), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, (a, a + 4096))
        x = np.zeros((len(parts), 4096), np.float32)
        x[doc[lo:hi], column[lo:hi] - a] = 1
        out += x @ x.T
    return out


def linked(sets: list[np.ndarray], prefix: np.ndarray, times: np.ndarray, joined: np.ndarray, asking: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect documents of a cell which are not connected yet (joined: labels of what is); with asking, only pairs that hold one of those."""
    m = len(sets)
    n = np.array([len(s) for s in sets])
    union = _Union(m)
    first: dict[int, int] = {}
    for i, x in enumerate(joined.tolist()):
        union.join(i, first.setdefault(x, i))
    shared = _incidence([s[: p + t - 1] for s, p, t in zip(sets, prefix, times, strict=True)])
    need = np.minimum(times[:, None], times[None, :])
    small, big = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
    maybe = np.triu((shared >= need) & (100 * small >= PERCENT * big), 1)
    if asking is not None:
        maybe &= asking[:, None] | asking[None, :]
    maybe &= joined[:, None] != joined[None, :]
    a, b = np.nonzero(maybe)
    if not len(a):
        return []
    if len(a) > 2000:
        both = _incidence(sets)[a, b]
        good = np.nonzero(100 * both >= PERCENT * (n[a] + n[b] - both))[0]
        a, b, checked = a[good], b[good], True
    else:
        checked = False
    held: dict[int, np.ndarray] = {}
    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        if union.find(i) == union.find(j):
            continue
        if not checked:
            for k in (i, j):
                if k not in held:
                    held[k] = np.sort(sets[k])
            both = len(np.intersect1d(held[i], held[j], assume_unique=True))
            if 100 * both < PERCENT * (n[i] + n[j] - both):
                continue
        union.join(i, j)
        out.append((i, j))
    return out


def _cells(asked: bool):
    """Groups of rows (sorted by cell) to the links found in each; a cell is held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.drop_duplicates("key")
            key = rows["key"].to_numpy()
            sets = [np.frombuffer(b, np.uint64) for b in rows["set"]]
            joined = rows["label"].to_numpy() if asked else key
            got = linked(sets, rows["prefix"].to_numpy(), rows["times"].to_numpy(), joined, rows["ask"].to_numpy(bool) if asked else None) if len(rows) > 1 else []
            if not asked:  # stars: every document with the smallest of its component, the cell's rows being sorted by key
                union = _Union(len(rows))
                for i, j in got:
                    union.join(i, j)
                got = [(i, union.find(i)) for i in range(len(rows)) if union.find(i) != i]
            return pd.DataFrame({"a": key[[i for i, _ in got]].astype(np.int64), "b": key[[j for _, j in got]].astype(np.int64)})

        held: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            cells = pdf[["nb", "u", "s"]].to_numpy()
            cut = np.nonzero((cells[1:] != cells[:-1]).any(axis=1))[0] + 1
            bounds = [0, *cut.tolist(), len(pdf)]
            found = [solve(pdf.iloc[a:b]) for a, b in zip(bounds[:-2], bounds[1:-1], strict=True)]
            if found:
                yield pd.concat(found, ignore_index=True)
            held = pdf.iloc[bounds[-2] :]
        if held is not None and len(held):
            yield solve(held)

    return run


def _solve(cells: DataFrame, asked: bool) -> DataFrame:
    return cells.repartition("nb", "u", "s").sortWithinPartitions("nb", "u", "s", "key").mapInPandas(_cells(asked), "a long, b long")


def _reply(df: DataFrame, columns: list[str], part: int, dtype: str) -> DataFrame:
    """Rows of (block, columns) as one reply a block; at most BLOCK_ROWS entries each."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(columns[0])
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "part": [part], "reply": [pdf[columns].to_numpy().astype(dtype).tobytes()]})

    return df.groupBy("block").applyInPandas(pack, "block long, part int, reply binary")


def _labels(stars: DataFrame) -> DataFrame:
    """node, label from edges (member, smallest of its component)."""
    return stars.select(F.col("a").alias("node"), F.col("b").alias("label")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def near_labels(blocks: Blocks, reps: DataFrame, ws: Workspace) -> DataFrame:
    """node, label of the representatives' keys that link: the smallest key of the component of all links."""
    block_of, row_of = F.shiftright("key", 16).alias("block"), F.col("key").bitwiseAND(0xFFFF).alias("row")
    picked = ws.save(_reply(reps.select(block_of, row_of), ["row"], PICKED, "int32"), "picked")
    totals = document_counts(blocks, _counts, picked).withColumn("part", (F.col("part") + TOTALS).cast("int"))
    known = picked.union(ws.save(totals, "totals"))
    postings = ws.save(blocks.map(_postings, "token long, key long, n long, c long", known), "postings")
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / PERCENT))).cast("int")
    part = F.pmod(F.xxhash64("key"), F.ceil(F.col("c") / HOT))
    own = Window.partitionBy("token", "level", "part")
    leveled = postings.select("token", "key", level.alias("level"), part.alias("part")).withColumn("near", F.min("key").over(own))
    inner = leveled.groupBy("token", "level", "part").agg(F.first("near").alias("near"))
    hubs = inner.groupBy("token", "level").agg(F.min("near").alias("hub"))
    above = hubs.select("token", (F.col("level") - 1).alias("level"), F.col("hub").alias("next"))
    many = inner.join(hubs.hint("shuffle_hash"), ["token", "level"]).filter("near <> hub").select("near", "hub")
    edges = leveled.select(F.col("key").alias("a"), F.col("near").alias("b")).union(many).union(hubs.join(above.hint("shuffle_hash"), ["token", "level"]).select("hub", "next"))
    near = ws.save(components(edges, ws, "near"), "near")
    sized = near.join(reps.select(F.col("key").alias("node"), "n"), "node").groupBy("label").agg(F.count("*").alias("m"), F.sum("n").alias("shingles"))
    cells = F.greatest(F.ceil(F.col("m") / CELL_DOCS), F.when(F.col("m") > 2, F.ceil(F.col("shingles") / CELL_SHINGLES)).otherwise(1)).cast("long")
    placed = near.join(sized.filter("m > 1").select("label", cells.alias("g")), "label").select(F.col("node").alias("key"), F.col("label").alias("nb"), "g")
    place = ws.save(_reply(placed.select(block_of, row_of, "nb", "g"), ["row", "nb", "g"], PLACED, "int64"), "place")
    sets = ws.save(blocks.map(_sets, "nb long, g long, key long, n long, prefix long, times long, set binary", known.union(place)), "sets")
    ws.drop("postings")
    s = F.pmod(F.xxhash64("key"), F.col("g"))
    within = ws.save(_solve(sets.withColumns({"u": F.lit(0).cast("long"), "s": s}), False), "within")
    large = sets.filter("g > 1")
    if large.isEmpty():
        return _labels(within)
    # Cells of a neighbourhood are joined by their components' smallest members, a neighbourhood's all in cells of their own.
    inner = within.join(large.select(F.col("key").alias("a")), "a", "left_semi")
    heads = large.join(inner.select(F.col("b").alias("key")).distinct(), "key", "left_semi")
    many = heads.groupBy("nb").agg(F.ceil(F.count("*") / CELL_DOCS).cast("long").alias("h"))
    across = ws.save(_solve(heads.join(many, "nb").withColumns({"u": F.lit(1).cast("long"), "s": F.pmod(F.xxhash64("key", F.lit(1)), F.col("h"))}).drop("h"), False), "across")
    joined = inner.union(across)
    label = components(joined, ws, "joined")
    named = large.select("key", "nb").join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    named = ws.save(named, "named")
    counted = named.groupBy("nb", "label").count()
    most = counted.groupBy("nb").agg(F.max(F.struct("count", "label")).alias("x")).select("nb", F.col("x.label").alias("most"))
    asks = named.join(most, "nb").withColumn("ask", F.col("label") != F.col("most"))
    groups = asks.groupBy("nb").agg(F.ceil(F.sum(F.col("ask").cast("long")) / CELL_DOCS).cast("long").alias("us")).filter("us > 0")
    rows = large.join(asks.select("key", "label", "ask"), "key").join(groups, "nb").withColumn("s", s)
    every = F.sequence(F.lit(0).cast("long"), F.col("us") - 1)
    met = rows.select("*", F.explode(every).alias("u")).withColumn("ask", F.lit(False))
    asking = rows.filter("ask").withColumn("u", F.pmod(F.xxhash64("key", F.lit(2)), F.col("us"))).drop("s").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).alias("s"))
    columns = ["nb", "u", "s", "key", "prefix", "times", "set", "label", "ask"]
    # The asking row of a document sorts before its other one, so it is the one that stays in a cell.
    both = asking.select(columns).union(met.select(columns))
    outside = both.repartition("nb", "u", "s").sortWithinPartitions("nb", "u", "s", "key", F.desc("ask")).mapInPandas(_cells(True), "a long, b long")
    whole = components(joined.union(ws.save(outside, "outside")), ws, "whole")
    small = within.join(large.select(F.col("key").alias("a")), "a", "left_anti")
    return _labels(small).union(whole)


def _classed(docs: DataFrame, ws: Workspace, name: str, row: str | None = None) -> DataFrame:
    """row, doc_id (NO_ID if null), n_shingles, class and component_id of every row of docs; class is null without shingles."""
    with Blocks(docs, name, row) as blocks:
        rows = ws.save(blocks.map(_describe, "key long, row long, doc_id long, n long, sig binary"), "rows")
        reps = ws.save(rows.filter("n > 0").groupBy("sig").agg(F.min("key").alias("key"), F.min("doc_id").alias("least"), F.first("n").alias("n")), "reps")
        label = ws.save(near_labels(blocks, reps, ws), "labels").withColumnRenamed("node", "key")
    of = reps.join(label, "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = of.groupBy("label").agg(F.min("least").alias("component_id"))
    found = of.join(least, "label").select("sig", F.col("label").alias("class"), "component_id")
    return rows.join(found, "sig", "left").select("row", "doc_id", F.col("n").alias("n_shingles"), "class", F.coalesce("component_id", "doc_id").alias("component_id"))


_TABLES = ["rows", "reps", "labels", "sets", "near", "within", "totals", "picked", "place"]


def classes(docs: DataFrame, name: str = "ngram") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    ws = Workspace(docs.sparkSession, name)
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    out = ws.save(_classed(docs, ws, name).select(null("doc_id"), "n_shingles", null("component_id")), "out")
    ws.drop(*_TABLES)
    return out


def op5_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), "op5")


def keep_first(docs: DataFrame, name: str = "ngram") -> DataFrame:
    """One row of each class of near copies: that of the smallest id, of several with that id the first read; columns unchanged.

    Rows are told apart by a number of their own, never by id: rows of one id (or of
    none) with unrelated texts are classes of their own and all stay, as does every row
    without shingles. docs is written once with the numbers, since a second evaluation
    might deal rows in another order.
    """
    ws = Workspace(docs.sparkSession, f"{name}_first")
    number = "_tarnfold_row"
    keyed = ws.save(docs.withColumn(number, F.monotonically_increasing_id()), "keyed")
    work = Workspace(docs.sparkSession, name)
    found = work.save(_classed(keyed, work, name, number).select("row", "doc_id", "class"), "out")
    work.drop(*_TABLES)
    first = found.filter("class is not null").groupBy("class").agg(F.min(F.struct("doc_id", "row")).alias("first")).select(F.col("first.row").alias(number))
    kept = ws.save(first.union(found.filter("class is null").select(F.col("row").alias(number))), "kept")
    return keyed.join(kept, number, "left_semi").drop(number)
