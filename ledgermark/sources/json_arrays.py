"""SRC-1 for large files: one JSON array read by many tasks, wherever its lines end.

The text reader cuts a file into blocks and, with ``}`` for a line's end, each
block into fragments that no object's inside can make longer than an object.
Whether a fragment stands inside a string, and how deep, depends on all before
it, so there are three steps:

1. every block is scanned alone for both cases, that it starts outside a string
   and that it starts inside one; only numbers leave the scan;
2. a prefix sum over the blocks of a file settles which case holds and at what
   depth each block starts;
3. the objects that lie within a block are put together where they are read.
   Only the fragments of those that cross a block's border are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Blocks up to which their starts (some 300 bytes each, path included) are broadcast; beyond it lines are dealt to them.
BROADCAST_BLOCKS = 100_000

_BLOCK = ["file_path", "block_start"]
_CASES = ("outside", "inside")
_NONE = 2**62
_SUMMARY = "file_path string, block_start bigint, lo bigint, hi bigint, quotes bigint, " + ", ".join(
    f"{case}_{name} bigint" for case in _CASES for name in ("depth", "least", "ends", "first", "last")
)


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _opened(marks: Column) -> Column:
    """Braces that open outside strings, of a text that starts outside one and holds nothing but quotes and such braces."""
    return F.when(F.contains(marks, F.lit("{")), _count(F.regexp_replace(marks, r'"[^"]*("|\z)', ""), "{")).otherwise(0)


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """Every stretch up to a ``}`` with its place, whether it turns inside to outside, and by how much it deepens in either case."""
    lines = spark.read.option("lineSep", "}").text(path).select(
        F.concat("value", F.lit("}")).alias("value"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line"),
    )
    # an escape never spans a fragment: its second character is never a closing brace
    marks = lines.withColumn("_marks", F.regexp_replace("value", r'(?s)\\.|[^"{\\]+', ""))
    turns = marks.withColumn("turns", _count(F.col("_marks"), '"') % 2)
    return (
        turns.withColumn("outside", _opened(F.col("_marks")) - F.when(F.col("turns") == 0, 1).otherwise(0))
        .withColumn("inside", _opened(F.concat(F.lit('"'), "_marks")) - F.when(F.col("turns") == 1, 1).otherwise(0))
        .drop("_marks")
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The stretches of a batch that come from one block, with its place."""
    if not batch.num_rows:
        return
    new = np.zeros(batch.num_rows, dtype=bool)
    new[0] = True
    for name in _BLOCK:
        column = batch.column(name)
        new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    for start, end in pairwise([*np.flatnonzero(new).tolist(), batch.num_rows]):
        run = batch.slice(start, end - start)
        yield (run.column("file_path")[0].as_py(), run.column("block_start")[0].as_py()), run


def _numbers(run: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [run.column(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in names]


class _Scan:
    """What a block does to quotes and depth, for both cases; its last fragment is told apart, as that may be the array's own end."""

    def __init__(self, place: tuple[str, int], lo: int):
        self.place = place
        self.lo = self.hi = lo
        self.quotes = 0
        # depth, least depth before the last fragment, how often that is met, and where first and last
        self.cases = {case: [0, _NONE, 0, -1, -1] for case in _CASES}
        self.empty = True

    def add(self, run: pa.RecordBatch) -> None:
        line, turns, outside, inside = _numbers(run, "line", "turns", "outside", "inside")
        before = (np.cumsum(turns) - turns + self.quotes) % 2
        steps = {"outside": np.where(before == 0, outside, inside), "inside": np.where(before == 0, inside, outside)}
        for case, (depth, *found) in self.cases.items():
            depths = depth + np.cumsum(steps[case])
            # the fragment that was last so far is not any more
            seen = depths[:-1] if self.empty else np.concatenate([[depth], depths[:-1]])
            at = line[:-1] if self.empty else np.concatenate([[self.hi], line[:-1]])
            if len(seen) and (least := int(seen.min())) <= found[0]:
                hits = at[seen == least]
                ends, first = (found[1], found[2]) if least == found[0] else (0, int(hits[0]))
                found = [least, ends + len(hits), first, int(hits[-1])]
            self.cases[case] = [int(depths[-1]), *found]
        self.quotes = int((self.quotes + turns.sum()) % 2)
        self.hi, self.empty = int(line[-1]), False

    def row(self) -> list:
        return [*self.place, self.lo, self.hi, self.quotes, *self.cases["outside"], *self.cases["inside"]]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in _SUMMARY.split(", ")]
    types = pa.schema([(name, pa.string() if name == "file_path" else pa.int64()) for name in names])
    scan = None
    for batch in batches:
        done = []
        for place, run in _runs(batch):
            if scan is None or scan.place != place:
                if scan is not None:
                    done.append(scan.row())
                scan = _Scan(place, run.column("line")[0].as_py())
            scan.add(run)
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in done], types)
    if scan is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, scan.row(), strict=True))], types)


def _starts(fragments: DataFrame) -> DataFrame:
    """For each block: its lines, the number of objects that end before it, and the first and last line that end one in it.

    The prefix sums run over one row of numbers a block, 800,000 for a file of 100 TB in blocks of 128 MB.
    """
    scanned = fragments.select(*_BLOCK, "line", "turns", "outside", "inside").mapInArrow(_summaries, _SUMMARY)
    earlier = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)

    def before(name: str) -> Column:
        return F.coalesce(F.sum(name).over(earlier), F.lit(0))

    settled = scanned.withColumn("_inside", before("quotes") % 2 == 1)
    for name in ("depth", "least", "ends", "first", "last"):
        settled = settled.withColumn(name, F.when(F.col("_inside"), F.col(f"inside_{name}")).otherwise(F.col(f"outside_{name}")))
    settled = settled.withColumn("_level", before("depth"))
    within, at_end = F.col("least") == -F.col("_level"), F.col("depth") == -F.col("_level")
    settled = settled.select(
        *_BLOCK,
        "lo",
        "hi",
        F.when(within, F.col("first")).when(at_end, F.col("hi")).alias("first"),
        F.when(at_end, F.col("hi")).when(within, F.col("last")).alias("last"),
        (F.when(within, F.col("ends")).otherwise(0) + F.when(at_end, 1).otherwise(0)).alias("ends"),
    )
    return settled.withColumn("done", before("ends"))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Objects of the lines between two ends of one block; what is open at a batch's end waits for the next.

    An object's fragments lie side by side in the batch, so that its text is a stretch of the column's bytes.
    """
    types = pa.schema([("file_path", pa.string()), ("pos", pa.int64()), ("value", pa.string())])
    place, open_, quotes, depth, pos = None, b"", 0, 0, 0
    for batch in batches:
        for here, run in _runs(batch):
            if here != place:
                place, open_, quotes, depth, pos = here, b"", 0, 0, run.column("done")[0].as_py() + 1
            turns, outside, inside = _numbers(run, "turns", "outside", "inside")
            before = (np.cumsum(turns) - turns + quotes) % 2
            depths = depth + np.cumsum(np.where(before == 0, outside, inside))
            quotes, depth = int((quotes + turns.sum()) % 2), int(depths[-1])
            text = run.column("value").cast(pa.string())
            offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
            data = text.buffers()[2]
            ends = offsets[1:][depths == 0]
            if not len(ends):
                open_ += data[offsets[0] : offsets[-1]].to_pybytes()
                continue
            objects = pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(np.concatenate([offsets[:1], ends])), data])
            if open_:
                first = pa.array([(open_ + data[offsets[0] : ends[0]].to_pybytes()).decode()])
                objects = pa.concat_arrays([first, objects[1:]])
            places = pa.array(np.arange(pos, pos + len(ends)))
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(here[0]), len(ends)), places, objects], schema=types)
            open_, pos = data[ends[-1] : offsets[-1]].to_pybytes(), pos + len(ends)


def read_large_json_array(spark: SparkSession, path: str, schema: str | T.StructType, place: bool = False, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """SRC-1: the objects of files that each hold one JSON array of objects, every file read by as many tasks as it has blocks.

    Rows are those of ``readers.read_json_array`` for valid files in UTF-8; ``place`` adds ``file_path`` and ``pos``,
    the object's number in its file from 0. A file that holds one object gives one row; an empty file, an empty array
    and elements that are not objects give none. An object that does not fit the schema gives nulls, or its text where
    the schema has ``_corrupt_record``. Files are not validated: one that is cut off gives its last object as far as it goes.

    The blocks are scanned at once, by a job of its own; the rows are read when asked for, and it is an error if
    the files are cut into other blocks by then. Objects are held one at a time, blocks never.
    """
    fragments = _fragments(spark, path)
    starts = _starts(fragments).persist()
    known = starts.withColumnsRenamed({"file_path": "_path", "block_start": "_start"})
    same = (F.col("file_path") == F.col("_path")) & (F.col("block_start") == F.col("_start"))
    if starts.count() <= broadcast_blocks:
        placed = fragments.join(F.broadcast(known), same, "left")
    else:
        placed = fragments.join(known, same, "left").sortWithinPartitions(*_BLOCK, "line")
    fits = F.coalesce(F.col("line").between(F.col("lo"), F.col("hi")), F.lit(False))
    placed = placed.withColumn("line", F.when(fits, F.col("line")).otherwise(F.raise_error(F.lit("blocks differ from those scanned")).cast("bigint")))
    between = F.coalesce((F.col("line") > F.col("first")) & (F.col("line") <= F.col("last")), F.lit(False))
    found = "file_path string, pos bigint, value string"
    whole = placed.filter(between).select(*_BLOCK, "value", "turns", "outside", "inside", "done").mapInArrow(_whole, found)
    after = F.coalesce(F.col("line") > F.col("last"), F.lit(False))
    pieces = placed.filter(~between).select(
        "file_path", (F.col("done") + F.when(after, F.col("ends")).otherwise(0)).alias("pos"), F.struct("block_start", "line", "value").alias("p")
    )
    in_order = F.array_join(F.array_sort(F.collect_list("p"))["value"], "")
    crossing = pieces.groupBy("file_path", "pos").agg(in_order.alias("value"))
    objects = whole.unionByName(crossing).withColumn("value", F.regexp_replace("value", r"\A[^{]*", "")).filter("value != ''")
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    read = F.from_json("value", fields, {"mode": "PERMISSIVE"}).alias("_r")
    return objects.select(read, *(["file_path", "pos"] if place else [])).select("_r.*", *(["file_path", "pos"] if place else []))
