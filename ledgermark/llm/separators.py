"""Operator 5: documents of flat token files, found by their end-of-document ids.

A token file is nothing but ids of one width, little-endian; no index says
where documents begin. Files are read in blocks of ``BLOCK`` tokens, any task any
block, and each block is searched at once for the end-of-document id. A block
knows its own separators only; where its first document began is the last
separator of the blocks before it, and how many documents ended before is their
number. Both come from a prefix scan over blocks, in two levels: ``SPAN`` blocks
are summed up, the sums scanned, and each span scans its own blocks, so a file
of a third of all tokens is many groups.

Files lie where Arrow's file systems reach them (local paths, ``file:``, ``hdfs:``,
``s3:`` ...). A document may be empty. Tokens after the last separator are a
document that is not closed. An empty file has none.
"""

from __future__ import annotations

import sys
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermark.llm.shared import portions, saved, worker_cache
from ledgermark.session import shared_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 1 << 20
SPAN = 1024
#: Bytes of an id: type.
KINDS = {2: "<u2", 4: "<u4"}


def write_token_files(docs: DataFrame, ids_of, separator: int, key: str = "doc_id", text: str = "text", width: int = 2) -> tuple[str, DataFrame]:
    """Write one flat file a partition, a separator after each document.

    ``ids_of`` is called in the tasks, without arguments, for a function that
    turns a list of texts into lists of ids. Returns the folder and ``file,
    ordinal, key``: which documents went into which file, in order. A task that
    is run again writes a new file, and only the one listed counts.
    """
    folder, kind = shared_dir(docs.sparkSession, "token-files"), KINDS[width]

    def run(batches):
        encode, system, out, name, at = ids_of(), None, None, f"{uuid.uuid4().hex}.bin", 0
        try:
            for batch in batches:
                for part in portions(batch, "text"):
                    if out is None:
                        system, path = fs.FileSystem.from_uri(folder)
                        system.create_dir(path, recursive=True)
                        out = system.open_output_stream(f"{path}/{name}")
                    for ids in encode([t or "" for t in part.column(1).to_pylist()]):
                        out.write(np.asarray([*ids, separator], kind).tobytes())
                    n = part.num_rows
                    files = pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([name])).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([files, pa.array(np.arange(at, at + n, dtype=np.int64)), part.column(0)], names=["file", "ordinal", key])
                    at += n
        finally:
            if out is not None:
                out.close()

    kept = docs.select(key, F.col(text).alias("text"))
    listed = kept.mapInArrow(run, f"file string, ordinal bigint, {key} {dict(kept.dtypes)[key]}")
    return folder, saved(listed, "token-order")


def token_blocks(files: DataFrame, folder: str, width: int = 2, block: int = BLOCK) -> DataFrame:
    """``file, block, n_tokens``: the blocks of each distinct ``file``, spread over the tasks."""

    def run(batches):
        for batch in batches:
            system, path = fs.FileSystem.from_uri(folder)
            sizes = [system.get_file_info(f"{path}/{name}").size or 0 for name in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s // width for s in sizes], pa.int64())], names=["file", "size"])

    sized = files.select("file").distinct().mapInArrow(run, "file string, size bigint")
    last = F.greatest(F.ceil(F.col("size") / block) - 1, F.lit(0))
    blocks = sized.filter("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"))
    n = F.least(F.lit(block), F.col("size") - F.col("block") * block)
    return saved(blocks.select("file", "block", n.cast("bigint").alias("n_tokens")), "blocks").repartition("file", "block")


def separators(blocks: DataFrame, folder: str, separator: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """``file, block, n_tokens, ends``: the places of the separator in each block, counted from the file's start."""
    kind = KINDS[width]

    def run(batches):
        for batch in batches:
            system, path = fs.FileSystem.from_uri(folder)
            for i in range(batch.num_rows):
                name, at, n = (batch.column(c)[i].as_py() for c in range(3))
                with system.open_input_file(f"{path}/{name}") as file:
                    file.seek(at * block * width)
                    tokens = np.frombuffer(file.read(n * width), kind)
                ends = np.flatnonzero(tokens == separator) + at * block
                listed = pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends, pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, listed], names=["file", "block", "n_tokens", "ends"])

    return blocks.mapInArrow(run, "file string, block bigint, n_tokens bigint, ends array<bigint>")


def documents(found: DataFrame, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """``file, ordinal, start, n_tokens, closed``: the documents of each file, blocks stitched together."""
    found = saved(found, "separators")
    number = F.floor(F.col("block") / span).alias("span")
    own = found.select("file", "block", number, F.size("ends").cast("bigint").alias("n"), F.array_max("ends").alias("end"))
    spans = own.groupBy("file", "span").agg(F.sum("n").alias("n"), F.max("end").alias("end"), F.max("block").alias("last"))
    ahead = Window.partitionBy("file").orderBy("span")
    earlier = ahead.rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        "file", "span",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n"),
        F.max("end").over(earlier).alias("_end"),
        F.when(F.lead("span").over(ahead).isNull(), F.col("last")).alias("_last"),
    )
    before = Window.partitionBy("file", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = own.join(spans, ["file", "span"]).select(
        "file", "block",
        (F.col("_n") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("ordinal"),
        (F.greatest(F.col("_end"), F.max("end").over(before)) + 1).alias("start"),
        (F.col("block") == F.coalesce("_last", F.lit(-1))).alias("final"),
    )
    rows = found.join(scanned, ["file", "block"]).withColumn("start", F.coalesce("start", F.lit(0)))
    closed = F.transform("ends", lambda end, i: F.struct(
        (F.col("ordinal") + i).alias("ordinal"),
        F.when(i == 0, F.col("start")).otherwise(F.get(F.col("ends"), i - 1) + 1).alias("start"),
        end.alias("end"), F.lit(True).alias("closed"),
    ))
    start = F.coalesce(F.array_max("ends") + 1, F.col("start"))
    rows = rows.withColumn("_size", F.col("n_tokens") + F.col("block") * block).withColumn("_start", start)
    tail = F.struct((F.col("ordinal") + F.size("ends")).alias("ordinal"), F.col("_start").alias("start"), F.col("_size").alias("end"), F.lit(False).alias("closed"))
    open_end = F.when(F.col("final") & (F.col("_start") < F.col("_size")), F.array(tail)).otherwise(F.filter(F.array(tail), lambda _: F.lit(False)))
    each = rows.select("file", F.inline(F.concat(closed, open_end)))
    return each.select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "closed")


def tiktoken_ids(ranks_path: str, pattern: str):
    """An ``ids_of`` that encodes with a rank file."""
    with open(ranks_path, "rb") as file:
        data = file.read()

    def ids_of():
        def make():
            import base64

            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
            encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            return lambda texts: map(encoding.encode_ordinary, texts)

        return worker_cache(f"tiktoken-{hash((data, pattern))}", make)

    return ids_of
