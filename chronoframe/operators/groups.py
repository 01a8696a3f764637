"""Python work on many small groups at a time.

A grouped pandas function is called once per group, which costs several
milliseconds however few rows the group has.  Here a task sorts its groups one
after another and takes them from the Arrow batches as they come, so that one
call gets the groups of a whole batch; only a group that is longer than a batch
is put together first."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _changes(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Rows whose keys are not those of the row before; NULL equals NULL."""
    new = np.zeros(max(table.num_rows - 1, 0), bool)
    for k in keys:
        column = table.column(k).combine_chunks()
        column = column.dictionary_encode(null_encoding="encode") if not pa.types.is_dictionary(column.type) else column
        new |= np.diff(column.indices.to_numpy(zero_copy_only=False)) != 0
    return np.flatnonzero(new) + 1


def _whole(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and where each group starts."""
    open_parts: list[pa.Table] = []             # of the group that may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        before = [open_parts[-1].slice(open_parts[-1].num_rows - 1)] if open_parts else []
        starts = _changes(pa.concat_tables([t.select(list(keys)) for t in [*before, table]]), keys) - len(before)
        if not len(starts):
            open_parts.append(table)
            continue
        cut = int(starts[-1])
        closed = pa.concat_tables([*open_parts, table.slice(0, cut)])
        if closed.num_rows:
            shift = closed.num_rows - cut
            yield closed.combine_chunks(), np.concatenate([[0], starts[:-1] + shift])
        open_parts = [table.slice(cut)]
    if open_parts:
        yield pa.concat_tables(open_parts).combine_chunks(), np.zeros(1, np.int64)


def map_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[pa.Table, np.ndarray], dict],
               schema: str) -> DataFrame:
    """``fn(table, starts)`` for tables of whole groups of ``keys``, rows in
    ``order``; it returns the columns of ``schema``, as Arrow arrays or numpy ones."""
    keys = list(keys)

    def run(batches):
        for table, starts in _whole(batches, keys):
            out = pa.table(fn(table, starts))
            yield from out.combine_chunks().to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def map_rows(df: DataFrame, fn: Callable[[pa.Table], dict], schema: str, rows: int) -> DataFrame:
    """``fn`` over tables of at most ``rows`` rows, each a group of its own."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = pa.table(fn(pa.Table.from_batches([batch.slice(at, rows)])))
                yield from out.combine_chunks().to_batches()

    return df.mapInArrow(run, schema)


def matrix(column) -> np.ndarray:
    """A column of equally long arrays of numbers as rows; NULL entries as NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def arrays(rows: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as a column of arrays."""
    n, k = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(np.ascontiguousarray(rows, float).ravel()))
