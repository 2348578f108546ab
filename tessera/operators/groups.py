"""Whole groups of rows as Arrow batches, for numeric kernels that look at all rows of a group together.

One exchange and one sort by the key; a kernel sees many whole groups at once, never a part of one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that begin and end with groups; the rows come in the order of the key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key)
        last = pc.sum(pc.equal(k, k[-1])).as_py() if k[-1].is_valid else b.num_rows
        if held and last == b.num_rows and held[-1].column(key)[-1].equals(k[-1]):
            held.append(b)
            continue
        # Groups end before the last rows of this batch, so all that is held goes with what precedes them.
        if held or last < b.num_rows:
            if table := [*held, *([b.slice(0, b.num_rows - last)] if last < b.num_rows else [])]:
                yield pa.Table.from_batches(table).combine_chunks()
        held = [b.slice(b.num_rows - last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def column(table: pa.Table, name: str, null: int = 0) -> np.ndarray:
    """A column of whole numbers as 64-bit ones."""
    return pc.fill_null(table.column(name).cast(pa.int64()), null).to_numpy()


def group_numbers(table: pa.Table, key: str) -> np.ndarray:
    """The number, from 0, of each row's group."""
    k, n = table.column(key), table.num_rows
    new = np.zeros(n, np.int64)
    if n > 1:
        null = pc.is_null(k).to_numpy()
        new[1:] = pc.fill_null(pc.not_equal(k.slice(1), k.slice(0, n - 1)), False).to_numpy() | (null[1:] != null[:-1])
    return new.cumsum()


def blocks(counts: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of items whose counts add up to ``most`` at most; an item beyond it stands alone."""
    total, a = np.concatenate([[0], counts.cumsum()]), 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(total, total[a] + most, "right")) - 1)
        yield a, b
        a = b


def by_group(df: DataFrame, key: str, kernel: Callable[[pa.Table], pa.Table], schema) -> DataFrame:
    """The rows that a kernel makes of whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, key):
            yield from kernel(table).to_batches(max_chunksize=1 << 16)

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def by_batch(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.Table], schema) -> DataFrame:
    """The rows that a kernel makes of batches of rows, each of which holds all it needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from kernel(b).to_batches(max_chunksize=1 << 16)

    return df.mapInArrow(run, schema)


def nested(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """How many values each row's list has (null: none), and all values in a row."""
    return pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


def places(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each item the numbers from ``first`` on, ``counts`` of them, one after another."""
    return np.arange(counts.sum()) - np.repeat(counts.cumsum() - counts - first, counts)
