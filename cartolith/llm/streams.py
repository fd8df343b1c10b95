"""Helpers for Arrow functions: groups of a sorted stream, and lists as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups of equal values in the first ``keys`` columns of a stream sorted by them; keys are non-null numbers."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        changed = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            changed |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-2], cuts[1:-1]):
            yield pa.Table.from_batches([*held, batch.slice(a, b - a)])
            held = []
        held.append(batch.slice(cuts[-2], cuts[-1] - cuts[-2]))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def numbers(column) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def matrix(column, width: int, kind=np.float64) -> np.ndarray:
    """Rows of equally long lists without nulls as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return numbers(flat.flatten()).astype(kind, copy=False).reshape(len(column), width)
