"""Helpers shared by the operators: tables, saved intermediates, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermark.session import shared_dir

# Task code travels with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
#: Bytes of rows that a task holds for Python at once.
BATCH_BYTES = "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    It cuts the lineage: a lost executor costs its running tasks only, and what
    follows does not compute ``df`` again.
    """
    path = shared_dir(df.sparkSession, label)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: str = BATCH_BYTES) -> Iterator[None]:
    """Jobs run inside send their rows to Python in batches of ``size``; Spark's own bound is eight times that for each task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def words_of(text: Column) -> Column:
    """The words of a text; none for null. Blanks are the ASCII ones only."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def worker_cache(name: str, make):
    """What ``make`` returns, kept for all tasks that a Python worker runs."""
    held = sys.modules.setdefault("_ledgermark_worker_cache", types.ModuleType("_ledgermark_worker_cache"))
    if name not in held.__dict__:
        held.__dict__[name] = make()
    return held.__dict__[name]


def forget_cached() -> None:
    """Give back what other operators keep in this worker."""
    if sys.modules.pop("_ledgermark_worker_cache", None):
        gc.collect()
        give_back()


def give_back() -> None:
    """Return to the system what Arrow's pool and the C library hold free; a worker waits a minute for its next task with it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run):
    """A task's function on Arrow batches that leaves its worker no larger than what it keeps on purpose."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def portions(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of ``column``, one row at least; what a slice took is given back."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    at = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)) // limit
    edges = np.flatnonzero(np.diff(at)) + 1
    for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
        yield batch.slice(start, stop - start)
        pa.default_memory_pool().release_unused()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and each row's offsets (one more than rows); null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def with_columns(batch: pa.RecordBatch, drop: tuple[str, ...] = (), **new: pa.Array) -> pa.RecordBatch:
    """The batch without ``drop`` and with new columns, which replace those of the same name."""
    names = [n for n in batch.schema.names if n not in drop and n not in new]
    arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
    return pa.RecordBatch.from_arrays([*arrays, *new.values()], names=[*names, *new])


def schema_with(df: DataFrame, drop: tuple[str, ...] = (), **new: str):
    """The schema of ``with_columns``, types given as DDL."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    kept = [f for f in df.schema.fields if f.name not in drop and f.name not in new]
    return StructType([*kept, *(StructField(n, _parse_datatype_string(t)) for n, t in new.items())])
