"""Groups of consecutive rows in a task's Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of equal values in the first ``keys`` columns (longs) of sorted batches, each a table.

    A run may cross batches; at most one run and one batch are held.
    """
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        marks = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)])
        starts = np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1
        edges = [0, *starts.tolist(), len(marks)]
        for low, high in zip(edges, edges[1:]):
            if held and not (marks[low] == last).all():
                yield pa.concat_tables(held)
                held = []
            held.append(rows.slice(low, high - low))
            last = marks[low]
    if held:
        yield pa.concat_tables(held)
