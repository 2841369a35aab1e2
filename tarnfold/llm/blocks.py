"""Packed blocks of documents and exchanges of sorted hash runs between them.

Documents are packed, as they are read, into rows of about `BLOCK_BYTES` of text, kept
in a table bucketed by block. What a block learns from others comes back to it keyed
by its number, so joins never move text, and no key, however common, is more than one
entry of a block's run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.llm.workspace import Workspace

BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 1 << 16
RANGES_PER_BLOCK = 2  # hash ranges, and so reducers, follow the number of blocks
BITS = 48
NO_ID = 2**63 - 1  # stands for a null id, above all others

SCHEMA = "block long, rows binary, ids binary, starts binary, text binary"


def _pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Texts are cut out of the batches' own buffers, run by run, and never become objects."""
    base, seq = TaskContext.get().partitionId() << 24, 0
    held: list[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]] = []  # bytes, lengths, ids, row numbers
    size = n = 0

    def out() -> pa.RecordBatch:
        text, lengths, ids, rows = zip(*held, strict=True)
        starts = np.concatenate(([0], np.cumsum(np.concatenate(lengths)))).astype(np.int64)
        packed = [starts.tobytes() if c is None else np.concatenate(c).tobytes() for c in (rows, ids, None)]
        return pa.RecordBatch.from_arrays([pa.array([base + seq], pa.int64()), *[pa.array([x], pa.binary()) for x in (*packed, b"".join(text))]], names=["block", "rows", "ids", "starts", "text"])

    for batch in batches:
        ids, texts, rows = batch.column("doc_id"), batch.column("text"), batch.column("row")
        ids = pc.fill_null(ids, NO_ID).to_numpy()
        rows = rows.to_numpy()
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        data, i = texts.buffers()[2], 0
        while i < len(texts):
            j = min(int(np.searchsorted(at, at[i] + most - size, side="right")) - 1, i + BLOCK_ROWS - n, len(texts))
            j = max(j, i if n else i + 1)  # a text beyond the size is a block of its own
            if j > i:
                held.append((data[at[i] : at[j]].to_pybytes() if at[j] > at[i] else b"", np.diff(at[i : j + 1]), ids[i:j], rows[i:j]))
                size, n, i = size + int(at[j] - at[i]), n + j - i, j
            if i < len(texts):
                yield out()
                held, size, n, seq = [], 0, 0, seq + 1
    if n:
        yield out()


class Blocks:
    """A bucketed table of blocks in the shared folder; use as a context manager. row, a long column of docs, travels along as each document's `rows`."""

    def __init__(self, docs: DataFrame, name: str, row: str | None = None) -> None:
        self.spark: SparkSession = docs.sparkSession
        self.table = f"tarnfold_{name}_{uuid.uuid4().hex}"
        packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(row).alias("row") if row else F.lit(0).cast("long").alias("row")).mapInArrow(partial(_pack, most=BLOCK_BYTES), SCHEMA)
        self.buckets = max(1, min(20_000, docs.rdd.getNumPartitions()))
        self.ws = Workspace(self.spark, f"{name}_blocks")  # a bucketed table needs a name, but its files lie where all executors read, whatever the warehouse is
        packed.write.option("compression", "zstd").option("path", f"{self.ws.path}/blocks").bucketBy(self.buckets, "block").saveAsTable(self.table)
        self.count = self.spark.table(self.table).select("block").count()

    def __enter__(self) -> Blocks:
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        self.ws.drop("blocks")

    def map(self, run: Callable, schema: str, replies: DataFrame | None = None) -> DataFrame:
        """run(iterator of frames) over the blocks, with the replies (block, part, reply) to each as an array in order of part."""
        df = self.spark.table(self.table)
        if replies is None:
            return df.mapInPandas(run, schema)
        own = replies.repartition(self.buckets, "block").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "reply"))).alias("replies"))
        return df.join(own, "block", "left").mapInPandas(run, schema)


def opened(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, starts and bytes of a block."""
    return np.frombuffer(row.ids, np.int64), np.frombuffer(row.starts, np.int64), np.frombuffer(row.text, np.uint8)


def replies_of(row) -> list[bytes]:
    return [] if row.replies is None else [r["reply"] for r in row.replies]


def squeeze(a: np.ndarray) -> bytes:
    """Bytes of an array, plane by plane, compressed: high planes that are 0 cost nothing."""
    raw = np.ascontiguousarray(a)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unsqueeze(b: bytes, dtype: type) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    planes = pa.decompress(b[8:], n, codec="zstd", asbytes=True)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def cut_by_range(values: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of the equal hash ranges starts in sorted values below 2^BITS."""
    edges = (np.arange(ranges + 1, dtype=np.float64) * (2.0**BITS / ranges)).astype(np.uint64)
    edges[-1] = np.uint64(1 << BITS)
    return np.searchsorted(values, edges)


def document_counts(blocks: Blocks, hashes: Callable[[object], tuple[np.ndarray, np.ndarray]], replies: DataFrame | None = None) -> DataFrame:
    """(block, part, reply): in how many documents, over all blocks, each of a block's hashes occurs.

    hashes(row) gives a block's sorted distinct hashes below 2^BITS and in how many of
    its documents each occurs. A reply holds the totals in the same order, for one
    hash range.
    """
    ranges = max(1, -(-blocks.count // RANGES_PER_BLOCK))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                values, n = hashes(row)
                cut = cut_by_range(values, ranges)
                full = np.nonzero(cut[1:] > cut[:-1])[0].tolist()
                parts = [slice(cut[r], cut[r + 1]) for r in full]
                n = n.astype(np.uint32)
                yield pd.DataFrame({"part": full, "block": row.block, "run": [squeeze(np.diff(values[p], prepend=np.uint64(0))) for p in parts], "n": [squeeze(n[p]) for p in parts]})

    def solve(part: int, runs: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
        total, where = np.unique(np.concatenate([v for _, v, _ in runs]), return_inverse=True)
        sums = np.minimum(np.bincount(where, weights=np.concatenate([n for _, _, n in runs]), minlength=len(total)), 2**32 - 1).astype(np.uint32)
        cut = np.cumsum([0, *(len(v) for _, v, _ in runs)])
        yield pd.DataFrame({"block": [b for b, _, _ in runs], "part": part, "reply": [squeeze(sums[where[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        now = -1
        for pdf in batches:
            for row in pdf.itertuples():
                if held and row.part != now:
                    yield from solve(now, held)
                    held = []
                now = row.part
                held.append((row.block, np.cumsum(unsqueeze(row.run, np.uint64), dtype=np.uint64), unsqueeze(row.n, np.uint32)))
        if held:
            yield from solve(now, held)

    sent = blocks.map(send, "part int, block long, run binary, n binary", replies)
    return sent.repartition(ranges, "part").sortWithinPartitions("part", "block").mapInPandas(merge, "block long, part int, reply binary")


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, base, np.uint64))), dtype=np.uint64)


# An odd number, so that its powers have inverses modulo 2^64.
BASE = 0x9E3779B97F4A7C15
SPAN = 1 << 19  # bytes that one table of powers serves
_POWERS = powers(BASE, SPAN), powers(pow(BASE, -1, 2**64), SPAN)


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of BASE and of its inverse for n bytes and more."""
    return _POWERS if n <= SPAN else (powers(BASE, n), powers(pow(BASE, -1, 2**64), n))


def rolling_hash(b: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the `width` bytes from each position (positions too near the end get none): a difference of running sums of bytes times powers, turned back by the inverse power of the position."""
    n = len(b) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = power_tables(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=sums[1:])
    return mix((sums[width : width + n] - sums[:n]) * inverse[:n])


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xE7037ED1A0B428DB)
    return h ^ (h >> np.uint64(29))
