"""Exact substring deduplication by a distributed merge sort of suffixes.

A byte is removed if a string of 50 bytes that covers it also starts in a document
with a smaller id. Every such string holds an anchor: the position with the least hash
of `GRAM` bytes among its first `SPREAD` positions, the same in each copy of the
string. So only suffixes at anchors are sorted.

1. Blocks exchange the hashes of their anchors' grams; anchors whose gram occurs in a
   single document drop out.
2. Blocks sort the other anchors' suffixes (50 bytes), merge equal ones with equal
   left contexts (so that a passage in a third of all documents is one entry a block),
   and send front-coded runs, cut by hash of the gram.
3. Reducers combine the runs with a loser tree that compares only beyond the common
   prefixes it already knows. The prefix lengths give the groups of equal right
   sides for every split of the 50 bytes at the anchor; left contexts refine them, and
   each entry learns which of its strings start in a smaller document.
4. Blocks mark the covered bytes.

Defined cases: a null text counts as empty; a null id counts as larger than all
others; rows with equal ids don't remove from each other; matches never cross
documents; texts under 50 bytes keep all bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.llm.blocks import BITS, NO_ID, RANGES_PER_BLOCK, Blocks, cut_by_range, document_counts, mix, opened, rolling_hash, squeeze, unsqueeze
from tarnfold.llm.workspace import Workspace

LENGTH, GRAM = 50, 24
SPREAD = LENGTH - GRAM + 1
SLICE = 1 << 16
MASKS = 1 << 20  # parts of the second reply come after those of the first


def anchor_positions(text: np.ndarray) -> np.ndarray:
    """The anchor of the string from each position, leftmost of equal hashes; never falls. Worked out in slices that fit a cache."""
    out = np.empty(max(0, len(text) - LENGTH + 1), np.int64)
    for a in range(0, len(out), SLICE):
        h = rolling_hash(text[a : a + SLICE + LENGTH - 1], GRAM)
        m = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= SPREAD:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        m = np.minimum(m[: len(m) - (SPREAD - size)], m[SPREAD - size :])
        out[a : a + SLICE] = (m & np.uint64(0xFFFFFFFF)).astype(np.int64) + a
    return out


def anchors(ids: np.ndarray, starts: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """position, first and last window, document and gram hash of each anchor of a block."""
    at = anchor_positions(text)
    size = np.diff(starts)
    doc = np.repeat(np.arange(len(size)), size)[: len(at)]
    fine = np.nonzero(np.arange(len(at)) + LENGTH <= starts[doc + 1])[0]
    if not len(fine):
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    at, doc = at[fine], doc[fine]
    cut = np.nonzero((np.diff(at, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))[0]
    last = np.append(cut[1:], len(at)) - 1
    position = at[cut]
    gram = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, GRAM)[position]).view(np.uint64)
    h = mix(gram[:, 0])
    for k in range(1, GRAM // 8):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + gram[:, k])
    return position, fine[cut], fine[last], doc[cut], mix(h) >> np.uint64(64 - BITS)


def _gram_counts(row) -> tuple[np.ndarray, np.ndarray]:
    _, _, _, doc, gram = anchors(*opened(row))
    if not len(gram):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    order = np.argsort(gram, kind="stable")  # documents lie in order already
    g, d = gram[order], doc[order]
    g = g[np.append(True, (g[1:] != g[:-1]) | (d[1:] != d[:-1]))]
    first = np.nonzero(np.append(True, g[1:] != g[:-1]))[0]
    return g[first], np.diff(np.append(first, len(g)))


def _take(text: np.ndarray, start: np.ndarray, size: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows of `size` bytes from each start, 0 outside [low, high)."""
    padded = np.concatenate((np.zeros(size, np.uint8), text, np.zeros(size, np.uint8)))
    out = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, size)[start + size])
    cut = np.nonzero((start < low) | (start + size > high))[0]  # few rows reach beyond their document
    if len(cut):
        at = start[cut, None] + np.arange(size)
        out[cut] *= (at >= low[cut, None]) & (at < high[cut, None])
    return out


def _of_distinct(values: np.ndarray, per_distinct: np.ndarray) -> np.ndarray:
    """For each value, the entry of per_distinct, which is in the order of the distinct values."""
    order = np.argsort(values)
    ranked = values[order]
    out = np.empty(len(values), per_distinct.dtype)
    out[order] = per_distinct[np.cumsum(np.append(False, ranked[1:] != ranked[:-1]))]
    return out


def entries(row, totals: np.ndarray) -> dict | None:
    """A block's anchors whose gram other documents hold too, with the bytes to both sides."""
    ids, starts, text = opened(row)
    at, first, last, doc, gram = anchors(ids, starts, text)
    if not len(gram):
        return None
    keep = _of_distinct(gram, totals) > 1
    at, first, last, doc, gram = at[keep], first[keep], last[keep], doc[keep], gram[keep]
    if not len(at):
        return None
    low, high = starts[doc], starts[doc + 1]
    right = _take(text, at, LENGTH, low, high)
    left = np.ascontiguousarray(_take(text, at - (SPREAD - 1), SPREAD - 1, low, high)[:, ::-1])
    rlen, llen = np.minimum(high - at, LENGTH), np.minimum(at - low, SPREAD - 1)
    return {"ids": ids, "at": at, "first": first, "last": last, "doc": doc, "gram": gram, "right": right, "left": left, "rlen": rlen, "llen": llen}


_MIX = np.cumprod(np.full(LENGTH + SPREAD - 1, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def distinct(e: dict, ranges: int) -> dict:
    """Equal contexts as one entry each, with the smallest id that holds it; `of` is each anchor's entry. Sorted by hash range, then suffix."""
    right, left, part = e["right"], e["left"], cut_part(e["gram"], ranges)
    h = mix((e["rlen"] * 64 + e["llen"]).astype(np.uint64))
    for j in range(LENGTH):
        h += right[:, j] * _MIX[j]
    for j in range(SPREAD - 1):
        h += left[:, j] * _MIX[LENGTH + j]
    h = mix(mix(h) + e["gram"])
    _, pick, of = np.unique(h, return_index=True, return_inverse=True)
    same = (right == right[pick[of]]).all() and (left == left[pick[of]]).all() and (e["rlen"] == e["rlen"][pick[of]]).all() and (e["llen"] == e["llen"][pick[of]]).all()
    if not same:  # two contexts of one hash: compare them whole
        whole = np.column_stack([right, left, e["rlen"].astype(np.uint8), e["llen"].astype(np.uint8)])
        _, pick, of = np.unique(whole, axis=0, return_index=True, return_inverse=True)
    least = np.full(len(pick), NO_ID)
    np.minimum.at(least, of, e["ids"][e["doc"]])
    key = np.empty((len(pick), LENGTH + 4), np.uint8)
    key[:, :4] = part[pick].astype(">u4").view(np.uint8).reshape(-1, 4)
    key[:, 4:] = right[pick]
    order = np.argsort(key.view(f"S{LENGTH + 4}").ravel(), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    pick = pick[order]
    return {"of": rank[of], "least": least[order], "part": part[pick], "right": right[pick], "left": left[pick], "rlen": e["rlen"][pick], "llen": e["llen"][pick]}


def cut_part(gram: np.ndarray, ranges: int) -> np.ndarray:
    order = np.argsort(gram, kind="stable")
    cut = cut_by_range(gram[order], ranges)
    out = np.empty(len(gram), np.int64)
    out[order] = np.repeat(np.arange(ranges), np.diff(cut))
    return out


def front_code(right: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Length of the prefix shared with the row before, and the bytes beyond it."""
    same = np.ones(right.shape, bool)
    same[0] = False
    same[1:] = right[1:] == right[:-1]
    shared = np.where(same.all(axis=1), right.shape[1], np.argmin(same, axis=1)).astype(np.uint8)
    rest = right[np.arange(right.shape[1])[None, :] >= shared[:, None]]
    return shared, rest.tobytes()


def front_decode(shared: np.ndarray, rest: bytes) -> list[bytes]:
    out, at, before = [], 0, b""
    for n in shared.tolist():
        stop = at + LENGTH - n
        before = before[:n] + rest[at:stop]
        out.append(before)
        at = stop
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """Order of all rows of sorted runs (numbered run after run) and each one's common prefix with the row before.

    A loser tree. known[r] is the prefix that run r's head shares with the last row
    put out; heads with different known prefixes are ordered without a look at their
    bytes, others are compared beyond it only.
    """
    k = 1
    while k < len(runs):
        k *= 2
    offset, total = [], 0
    for strings, _ in runs:
        offset.append(total)
        total += len(strings)
    head = [strings[0] if strings else None for strings, _ in runs] + [None] * (k - len(runs))
    # A run that has ended knows less than any other, so it loses at once.
    place, known = [0] * k, [0 if x is not None else -1 for x in head]
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two heads; the loser learns what it shares with the winner."""
        p, q = known[a], known[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        x, y = head[a], head[b]
        if x == y:
            if p >= 0:
                known[b] = LENGTH
            return a, b
        u, v = int.from_bytes(x[p:], "big"), int.from_bytes(y[p:], "big")
        n = LENGTH - ((u ^ v).bit_length() + 7) // 8
        if u < v:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    nodes = [0] * k + list(range(k))
    for i in range(k - 1, 0, -1):
        nodes[i], loser[i] = play(nodes[2 * i], nodes[2 * i + 1])
    order, common = [], []
    w = nodes[1] if k > 1 else 0
    for _ in range(total):
        order.append(offset[w] + place[w])
        common.append(known[w])
        strings, lcps = runs[w]
        place[w] += 1
        if place[w] < len(strings):
            head[w], known[w] = strings[place[w]], lcps[place[w]]
        else:
            head[w], known[w] = None, -1
        i = (w + k) >> 1
        while i:
            b = loser[i]
            if known[w] < known[b]:
                w, loser[i] = b, w
            elif known[w] == known[b]:
                w, loser[i] = play(w, b)
            i >>= 1
    if common:
        common[0] = 0
    return order, common


def smaller_starts(common: np.ndarray, left: np.ndarray, rlen: np.ndarray, llen: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Bit o of an entry: the string of o bytes before its anchor and LENGTH - o from it starts in a smaller document."""
    out = np.zeros(len(least), np.uint32)
    near = np.append(common[1:], 0)
    busy = np.nonzero((common >= GRAM) | (near >= GRAM))[0]
    side = np.zeros(len(busy), np.uint64)
    for o in range(SPREAD):
        if o:
            side = side * np.uint64(0x100000001B3) + left[busy, o - 1].astype(np.uint64) + np.uint64(1)
            side ^= side >> np.uint64(29)
        group = np.cumsum(common < LENGTH - o)[busy]
        fine = np.nonzero((rlen[busy] >= LENGTH - o) & (llen[busy] >= o))[0]
        if not len(fine):
            continue
        d = least[busy[fine]]
        # Only equality counts, so one hash of the group and the left side is sorted.
        both = mix(side[fine] + mix(group[fine].astype(np.uint64)))
        order = np.argsort(both)
        both = both[order]
        new = np.append(True, both[1:] != both[:-1])
        first = np.nonzero(new)[0]
        lowest = np.minimum.reduceat(d[order], first)[np.cumsum(new) - 1]
        hit = lowest < d[order]
        out[busy[fine[order[hit]]]] |= np.uint32(1 << o)
    return out


def _total_of(row) -> np.ndarray:
    parts = [unsqueeze(r["reply"], np.uint32) for r in (row.replies if row.replies is not None else []) if r["part"] < MASKS]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _send(ranges: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                e = entries(row, _total_of(row))
                if e is None:
                    continue
                d = distinct(e, ranges)
                cut = np.searchsorted(d["part"], np.arange(ranges + 1))
                full = np.nonzero(cut[1:] > cut[:-1])[0].tolist()
                parts = [slice(cut[r], cut[r + 1]) for r in full]
                coded = [front_code(d["right"][p]) for p in parts]
                yield pd.DataFrame({
                    "part": full, "block": row.block, "shared": [squeeze(shared) for shared, _ in coded], "rest": [squeeze(np.frombuffer(rest, np.uint8)) for _, rest in coded], "left": [squeeze(d["left"][p].reshape(-1)) for p in parts],
                    "sizes": [squeeze((d["rlen"][p] * 64 + d["llen"][p]).astype(np.uint16)) for p in parts], "least": [squeeze(d["least"][p]) for p in parts],
                })

    return run


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs, sorted by part, to masks; one part is held at a time."""

    def solve(part: int, rows: list) -> Iterator[pd.DataFrame]:
        runs, left, sizes, least = [], [], [], []
        for row in rows:
            shared = unsqueeze(row.shared, np.uint8)
            runs.append((front_decode(shared, unsqueeze(row.rest, np.uint8).tobytes()), shared.tolist()))
            left.append(unsqueeze(row.left, np.uint8).reshape(-1, SPREAD - 1))
            sizes.append(unsqueeze(row.sizes, np.uint16))
            least.append(unsqueeze(row.least, np.int64))
        order, common = merge_runs(runs)
        order = np.array(order)
        size, side, ids = np.concatenate(sizes)[order], np.concatenate(left)[order], np.concatenate(least)[order]
        mask = np.empty(len(order), np.uint32)
        mask[order] = smaller_starts(np.array(common), side, (size // 64).astype(np.int64), (size % 64).astype(np.int64), ids)
        cut = np.cumsum([0, *(len(strings) for strings, _ in runs)])
        yield pd.DataFrame({"block": [row.block for row in rows], "part": part + MASKS, "reply": [squeeze(mask[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]})

    held: list = []
    for pdf in batches:
        for row in pdf.itertuples():
            if held and held[0].part != row.part:
                yield from solve(held[0].part, held)
                held = []
            held.append(row)
    if held:
        yield from solve(held[0].part, held)


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def covered(row, ranges: int) -> np.ndarray:
    """The removed bytes of a block."""
    ids, starts, text = opened(row)
    change = np.zeros(len(text) + 1, np.int32)
    e = entries(row, _total_of(row))
    masks = [unsqueeze(r["reply"], np.uint32) for r in (row.replies if row.replies is not None else []) if r["part"] >= MASKS]
    if e is not None:
        d = distinct(e, ranges)
        mask = np.concatenate(masks)[d["of"]].astype(np.int64)
        mask[ids[e["doc"]] > d["least"][d["of"]]] = -1  # a smaller document of the block has the same context
        n = e["last"] - e["first"] + 1
        owner = np.repeat(np.arange(len(n)), n)
        window = np.repeat(e["first"] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        hit = window[(mask[owner] >> (e["at"][owner] - window)) & 1 == 1]
        np.add.at(change, hit, 1)
        np.add.at(change, hit + LENGTH, -1)
    return np.cumsum(change[:-1]) > 0


def _cut(ranges: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                ids, starts, text = opened(row)
                gone = covered(row, ranges)
                out = []
                for i, doc in enumerate(ids.tolist()):
                    g, t = gone[starts[i] : starts[i + 1]], text[starts[i] : starts[i + 1]]
                    spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
                    out.append((None if doc == NO_ID else doc, len(t), int(g.sum()), spans, hashlib.sha256(t[~g].tobytes()).hexdigest()))
                frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
                yield frame.astype({"doc_id": "Int64", "kept_sha256": object})

    return run


def deduplicated(docs: DataFrame, name: str = "suffix") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs."""
    spark = docs.sparkSession
    ws = Workspace(spark, name)
    with Blocks(docs, name) as blocks:
        ranges = max(1, -(-blocks.count // RANGES_PER_BLOCK))
        totals = ws.save(document_counts(blocks, _gram_counts), "totals")
        sent = blocks.map(_send(ranges), "part int, block long, shared binary, rest binary, left binary, sizes binary, least binary", totals)
        masks = ws.save(sent.repartition(ranges, "part").sortWithinPartitions("part", "block").mapInPandas(_merge, "block long, part int, reply binary"), "masks")
        out = ws.save(blocks.map(_cut(ranges), OUT, totals.union(masks)), "out")
    ws.drop("totals", "masks")
    return out


def op7_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"), "op7")
