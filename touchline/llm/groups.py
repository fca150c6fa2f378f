"""Rows of one key together, inside a partition that is sorted by the key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a stored table of ids that are sent to every task at most.
SMALL_ROWS = 1_000_000


def row_key(id_column: str, text_column: str) -> Column:
    """What a row is known by where ids may repeat: a hash of its id and text."""
    return F.xxhash64(F.col(id_column).cast("long"), F.col(text_column).cast("string"))


def small(stored: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A stored table of a few ids per row, marked for broadcast if a count finds it small.

    Beyond that the join shuffles; the rows that come out are the same.
    """
    return F.broadcast(stored) if stored.count() <= rows else stored


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """One table for each run of equal values of a long column without nulls."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        edges = [0, *cuts.tolist(), len(keys)]
        for at, to in zip(edges, edges[1:]):
            if held and keys[at] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, to - at))
            last = keys[at]
    if held:
        yield pa.Table.from_batches(held)


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column end to end, and where each row's begin."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0]: offsets[-1]]
    return values, (offsets - offsets[0]).astype(np.int64)
