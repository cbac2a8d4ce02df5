"""Running Python on Arrow batches that stay small however long the texts are."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes that one step of Python works on. A single longer row is a step of its own.
ROWS, BYTES = 2048, 8 << 20


def slices(batch: pa.RecordBatch, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that every piece holds few rows and few bytes."""
    step = max(1, min(rows, int(rows if batch.nbytes <= size else batch.num_rows * size // batch.nbytes)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def give_back() -> None:
    """Return freed memory to the system at a task's end: a worker waits for later stages, and would keep it all that time."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def map_slices(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, size: int = BYTES
) -> DataFrame:
    """``mapInArrow`` with a function that ``make`` builds once per task, so tables it loads are loaded once.

    The function gets pieces of some ``size`` bytes. It may return ``None`` for a piece without output.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            for piece in slices(batch, size=size):
                work = work or make()
                out = work(piece)
                if out is not None and out.num_rows:
                    yield out
        work = batch = piece = out = None
        give_back()

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null is empty."""
    return [t or "" for t in batch.column(name).to_pylist()]
