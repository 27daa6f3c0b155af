"""Helpers shared by the operators that work on Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, scratch_dir

#: bytes that Spark puts into an Arrow batch at most, so that memory does not follow row width
ARROW_BATCH_BYTES = 8_000_000
#: Arrow batches are merged or cut so that a step sees about this many bytes of text
BATCH_BYTES = 12_000_000


def bound_batches(spark: SparkSession) -> None:
    """Have Spark bound its Arrow batches by bytes (a setting of the session)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """The values as strings; null is empty."""
    return [x or "" for x in column.to_pylist()]


def release() -> None:
    """Give memory that a task no longer uses back to the system.

    Python workers live on for later tasks, also of other stages, and would keep it.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def in_arrow(
    df: DataFrame, schema: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
) -> DataFrame:
    """``df.mapInArrow(run)`` whose tasks give their memory back when they end."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(tidy, schema)


def sized(
    batches: Iterable[pa.RecordBatch], column: str, target: int = BATCH_BYTES
) -> Iterator[pa.RecordBatch]:
    """Regroup rows so that each batch holds about ``target`` bytes of ``column``.

    A batch has one row at least, so one very long text makes a batch of its own.
    Order is kept.
    """
    held: list[pa.RecordBatch] = []
    held_bytes = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        sizes = np.asarray(lengths).astype(np.int64)
        start = 0
        total = np.cumsum(sizes)
        while start < batch.num_rows:
            base = total[start - 1] if start else 0
            end = int(np.searchsorted(total, base + target - held_bytes, side="right"))
            end = min(max(end, start + (not held)), batch.num_rows)
            if end > start:
                held.append(batch.slice(start, end - start))
                held_bytes += int(total[end - 1] - base)
            if end < batch.num_rows or held_bytes >= target:
                yield _joined(held)
                held, held_bytes = [], 0
            start = end
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


def over_batches(
    df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch], text: str,
    target: int = BATCH_BYTES,
) -> DataFrame:
    """``df`` through ``work``, batch by batch, where the rows are; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, text, target):
            yield work(batch)

    return in_arrow(df, schema, run)


def lists(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from the values of all rows and the length of each row."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``start, start + 1, ..`` of all pieces, piece after piece."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def row_key(*columns: str) -> Column:
    """A hash of the named columns in which null differs from every value."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in columns])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores if a column has it already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(df: DataFrame, name: str) -> str:
    """A new folder name that all executors and the driver can reach."""
    return f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


__all__ = [
    "bound_batches",
    "free_name",
    "gather",
    "in_arrow",
    "lists",
    "materialize",
    "over_batches",
    "release",
    "row_key",
    "shared_folder",
    "sized",
    "texts_of",
]
