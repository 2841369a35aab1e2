"""Rows of a key in order, one key at a time: for what a window function can't express."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


def plain(column: pd.Series) -> list:
    """A column's values as Python's own, None where there is none."""
    if not column.hasnans:
        return column.tolist()
    values = column.astype(object).to_numpy(copy=True)
    values[column.isna().to_numpy()] = None
    return values.tolist()


def each_group(df: DataFrame, keys: list[str], order: list[str], change: Callable[[list[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """change(a key's rows in order) over all keys. Keys are dealt by hash and sorted with their rows by Spark, which may spill; a task holds one key's rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None
        rows: list[dict] = []
        columns: list[str] | None = None
        for batch in batches:
            done: list[dict] = []
            names = list(batch.columns)
            values = [plain(s) for _, s in batch.items()]
            for key, *row in zip(zip(*(values[names.index(k)] for k in keys), strict=True), *values, strict=True):
                row = dict(zip(names, row, strict=True))
                if rows and key != held:
                    done += change(rows)
                    rows = []
                held = key
                rows.append(row)
            if done:
                columns = columns or list(done[0])
                yield pd.DataFrame(done, columns=columns)
        if rows and (last := list(change(rows))):
            yield pd.DataFrame(last, columns=columns)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1 << 14) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, of `least` rows or more but for the last, and where each group begins in them. Rows of a group come one after the other; a table holds the rows of several batches, or one group."""
    held: list[pa.RecordBatch] = []
    rows, wanted = 0, least

    def begins(part: pa.Table) -> np.ndarray:
        new = np.zeros(part.num_rows, bool)
        new[:1] = True
        for k in keys:
            codes = part[k].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        return np.nonzero(new)[0]

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < wanted:
            continue
        part = pa.Table.from_batches(held)
        at = begins(part)
        last = int(at[-1])
        if last:
            yield part.slice(0, last), at[:-1]
        held, rows = part.slice(last).to_batches(), part.num_rows - last
        wanted = max(least, 2 * rows)  # a group of very many rows is looked through again only when it has doubled
    if rows:
        part = pa.Table.from_batches(held)
        yield part, begins(part)


def typed(df: DataFrame, *names: str) -> str:
    """Columns of df as the beginning of a schema."""
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
