"""Shared pieces of the operators: table reading, folds, stored intermediate tables, Arrow text access."""

from __future__ import annotations

import ctypes
import gc
import pickle
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.session import tune
from ..sources.scratch import shared_folder

SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(column: str = "doc_id", folds: int = 5) -> Column:
    """True for rows of the held-out fold. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % folds == 0


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Shared:
    """A bounded object sent once to every executor. The package travels by value, hence the inner pickle."""

    def __init__(self, spark: SparkSession, value):
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get(self):
        return pickle.loads(self.sent.value)


def kept_in_worker(name: str, make: Callable):
    """An object kept for the life of a Python worker, over its tasks."""
    kept = sys.modules["__main__"].__dict__.setdefault("_glyphaudit_kept", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


@contextmanager
def without_collection():
    """No garbage collection while caches of millions of plain objects without cycles grow; later ones leave them out."""
    gc.disable()
    try:
        yield
    finally:
        gc.freeze()
        gc.enable()


def trimmed(run: Callable) -> Callable:
    """The same function of Arrow batches; what the worker has freed by its end goes back to the system, as workers live on beside the JVM."""
    def batches(given):
        try:
            yield from run(given)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):   # only glibc has it
                pass

    return batches


def text_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; nulls are empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, where, values = column.buffers()
    n = len(column)
    if where is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(where, kind)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    data = data[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def emit(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    n, width = rows.shape[0], rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width)),
                                                  pa.py_buffer(np.ascontiguousarray(rows).tobytes())])
