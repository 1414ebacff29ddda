"""Helpers of this package: whole-table batches, output batches and the shared folder."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa

from scorelake.session import materialise, shared_folder

__all__ = ["frugal", "materialise", "pieces", "rows", "shared_folder"]

PIECE_BYTES = 4 << 20


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of ``column``, one row at least."""
    start, size = 0, 0
    values = batch.column(batch.schema.get_field_index(column))
    for i in range(len(batch)):
        if not values[i].is_valid:
            continue
        size += len(values[i].as_buffer()) if hasattr(values[i], "as_buffer") else 8
        if size > limit:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < len(batch) or not len(batch):
        yield batch.slice(start)


def rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type)
                                       for c, f in zip(columns, schema, strict=True)], schema=schema)


Batches = Iterator[pa.RecordBatch]


def frugal(fn: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """After a task's last batch, give freed memory back to the system: Python workers live on between
    tasks, beside the JVM and other workers of their executor."""

    @functools.wraps(fn)
    def run(batches: Batches) -> Batches:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run
