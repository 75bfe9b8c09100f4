"""Rows of a key as they come, one after the other, from sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], at_least: int = 1 << 15) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, first row of each run) in tables of `at_least` rows or more that end where a key ends.

    The rows of a partition must be sorted by the keys. What is held at once is `at_least` rows, a batch and the
    longest run.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= at_least:
            table = pa.Table.from_batches(held).combine_chunks()
            starts = _starts(table, keys)
            cut = int(starts[-1])
            if cut:
                yield table.slice(0, cut), starts[:-1]
            held, n = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
            at_least = max(at_least, 2 * n)
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _starts(table, keys)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        v = table[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)
