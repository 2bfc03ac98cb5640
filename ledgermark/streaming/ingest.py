"""New completion files, once each (STM-1).

A stream takes in the files that arrived; which keys have been stored is state
of the stream, kept by key in RocksDB, so a batch neither lists nor reads what
earlier ones wrote. Only the first row of a key within a batch is left to
settle: Arrow tasks keep each key's first row of what they hold, then of what a
shuffle by key brings together, and what reaches the state is one row a key. A
key that many rows share is reduced before the shuffle. Rows that wait for the
last of their key wait on disk.
"""

from __future__ import annotations

import itertools
import os
import sys
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH = "batch_id"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Where a row stands among all arrivals; the line is counted while reading.
_LINE = "_line"
_ORDER = ["_mtime", "_file", "_block", _LINE]
#: Bytes of rows that a task holds in memory.
HELD_BYTES = 32 << 20
#: Bytes of rows that go to a task at once.
BATCH_BYTES = "8m"


def read_ingested(spark: SparkSession, out_dir: str, schema: str) -> DataFrame:
    """What has been ingested so far, with the number of its batch."""
    stored = f"{schema}, {BATCH} bigint"
    try:
        return spark.read.schema(stored).parquet(out_dir)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], stored)


def _same(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value but the first equals the one before; null equals null."""
    column = column.combine_chunks()
    here, before = column.slice(1), column.slice(0, len(column) - 1)
    equal = pc.or_(pc.fill_null(pc.equal(here, before), False), pc.and_(here.is_null(), before.is_null()))
    return equal.to_numpy(zero_copy_only=False)


def first_places(batches: list[pa.RecordBatch], keys: list[str], order: list[str]) -> np.ndarray:
    """Where the first row of every key stands, counted over all batches, ascending; only keys and places are sorted."""
    table = pa.Table.from_batches([b.select([*keys, *order]) for b in batches])
    if not table.num_rows:
        return np.zeros(0, np.int64)
    ranked = pc.sort_indices(table, sort_keys=[(n, "ascending") for n in [*keys, *order]])
    sorted_keys = table.select(keys).take(ranked)
    repeated = np.ones(table.num_rows - 1, bool)
    for key in keys:
        repeated &= _same(sorted_keys.column(key))
    return np.sort(ranked.to_numpy().astype(np.int64)[np.concatenate([[True], ~repeated])])


def first_rows(batches: list[pa.RecordBatch], keys: list[str], order: list[str]) -> list[pa.RecordBatch]:
    """The first row of every key, in batches cut from the given ones."""
    winners = first_places(batches, keys, order)
    ends = np.cumsum([b.num_rows for b in batches])
    cut = np.split(winners, np.searchsorted(winners, ends[:-1]))
    return [b.take(pa.array(rows - (end - b.num_rows))) for b, rows, end in zip(batches, cut, ends, strict=True) if len(rows)]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    line = 0
    for batch in batches:
        lines = pa.array(np.arange(line, line + batch.num_rows), pa.int64())
        line += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, lines], names=[*batch.schema.names, _LINE])


def _combined(keys: list[str], order: list[str]):
    """A task that numbers its lines and passes on each key's first row of what it can hold; what is full is passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in _numbered(batches):
            held.append(batch)
            size += batch.nbytes
            if size > HELD_BYTES:
                held = first_rows(held, keys, order)
                size = sum(b.nbytes for b in held)
                if size > HELD_BYTES // 2:
                    yield from held
                    held, size = [], 0
        yield from first_rows(held, keys, order) if held else []

    return run


def _settled(keys: list[str], order: list[str]):
    """A task that passes on each key's first row; rows wait in a file of the task's own, keys and places in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        with tempfile.SpooledTemporaryFile(HELD_BYTES, dir=folder if os.path.isdir(folder) else None) as rows:
            places = []
            with pa.ipc.new_stream(rows, first.schema) as writer:
                for batch in itertools.chain([first], batches):
                    writer.write_batch(batch)
                    # copied, as a selection would keep the whole batch
                    places.append(batch.select([*keys, *order]).take(pa.array(np.arange(batch.num_rows))))
            winners, start = first_places(places, keys, order), 0
            places.clear()
            rows.seek(0)
            for batch in pa.ipc.open_stream(rows):
                low, high = np.searchsorted(winners, [start, start + batch.num_rows])
                if high > low:
                    yield batch.take(pa.array(winners[low:high] - start))
                start += batch.num_rows

    return run


def ingest_completions_stream(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint: str,
    schema: str,
    keys: tuple[str, ...] = ("id", "sample_idx"),
    max_files: int = 1000,
) -> None:
    """STM-1: take in the JSON line files that arrived since the last run, first row per key.

    First is by time of the file, its path, block and line; null keys are equal.
    Each micro-batch owns the folder of its batch number and overwrites it; a
    replayed batch starts from the state of the one before, so it leaves one
    copy. The number of shuffle partitions is that of the first run. A task
    holds the keys and places of its share of a batch, which ``max_files``
    bounds; the rows themselves wait on the executor's disk.
    """
    arrived = (
        spark.readStream.schema(schema)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", max_files)
        .json(in_dir)
        .select(
            "*",
            F.col("_metadata.file_modification_time").alias("_mtime"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
        )
    )
    numbered = StructType([*arrived.schema.fields, StructField(_LINE, LongType())])
    here = arrived.mapInArrow(_combined(list(keys), _ORDER), numbered)
    firsts = here.repartition(*keys).mapInArrow(_settled(list(keys), _ORDER), numbered)
    fresh = firsts.drop(*_ORDER).dropDuplicates(list(keys))

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/{BATCH}={batch_id}")

    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        query = fresh.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
