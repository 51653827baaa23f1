"""Work in tasks on batches of whole sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .sequence import dealt

ROWS = 20_000


def _edges(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where sequences of sorted rows begin, and the number of rows."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for k in keys:
        codes = pc.dictionary_encode(column(table, k), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.append(np.flatnonzero(new), len(table))


def column(table: pa.Table, name: str) -> pa.Array:
    x = table.column(name)
    return x.chunk(0) if x.num_chunks == 1 else x.combine_chunks() if x.num_chunks else pa.array([], x.type)


def _once(table: pa.Table, edges: np.ndarray, keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    """One row of each day."""
    t = column(table, "t").to_numpy()
    first = np.append(True, t[1:] != t[:-1])
    first[edges[:-1]] = True
    if not first.all():
        table = table.filter(pa.array(first))
        edges = _edges(table, keys)
    return table, edges


def whole_sequences(batches: Iterable[pa.RecordBatch], keys: list[str], once: bool = True, rows: int = ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole sequences from rows sorted by ``keys`` and t, and where each begins; of ``rows`` rows or so, or one sequence."""
    held: list[pa.Table] = []
    n, due = 0, rows

    def ready(table: pa.Table, edges: np.ndarray) -> tuple[pa.Table, np.ndarray]:
        return _once(table, edges, keys) if once else (table, edges)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        n += batch.num_rows
        if n < due:
            continue
        table = pa.concat_tables(held).combine_chunks()
        edges = _edges(table, keys)
        if len(edges) == 2:  # a long sequence that may go on
            held, due = [table], 2 * n
            continue
        yield ready(table.slice(0, edges[-2]).combine_chunks(), edges[:-1])
        held, n, due = [table.slice(edges[-2]).combine_chunks()], int(edges[-1] - edges[-2]), rows + int(edges[-1] - edges[-2])
    if n:
        table = pa.concat_tables(held).combine_chunks()
        yield ready(table, _edges(table, keys))


def on_sequences(panel: DataFrame, keys: list[str], work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str, once: bool = True) -> DataFrame:
    """``work`` (table, edges) -> rows, on batches of whole sequences (``keys``), dealt by the first key and sorted by day.

    Of rows of one day, ``once`` leaves any one.
    """
    days = dealt(panel, keys[0]).sortWithinPartitions(*keys, "t")
    return days.mapInArrow(lambda batches: (out for table, edges in whole_sequences(batches, keys, once) for out in work(table, edges)), schema)


def at(x: pa.Array, rows: np.ndarray) -> pa.Array:
    return x.take(pa.array(rows))


def lists(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as arrays."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel()))
