"""Python workers that stay small: they see texts in short batches and hand memory back when a task ends.

Workers live on between tasks, so what one keeps for reuse counts on top of the executor's heap for as long as the executor
lives. Spark's batches have 10,000 rows, which with whole texts are tens of megabytes on both sides of the pipe.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Rows of a batch that has whole texts.
TEXTS = 1000

Batches = Iterator[pa.RecordBatch]


def parts(batches: Batches, rows: int) -> Batches:
    """The same rows in the same order, at most so many in a batch; an empty batch stays one."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Frees what Arrow and the C library hold for reuse, where they can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def lean(run: Callable[[Batches], Batches], rows: int | None = TEXTS) -> Callable[[Batches], Batches]:
    """run for mapInArrow, given batches of at most so many rows (None: as they come); its memory is handed back at the end."""

    def all_(batches: Batches) -> Batches:
        try:
            yield from run(parts(batches, rows) if rows else batches)
        finally:
            give_back()

    return all_
