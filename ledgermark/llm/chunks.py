"""Operator 6: substring de-duplication by content-defined chunks.

A gear hash rolls over the bytes of each text: every step doubles it and adds a
number fixed for the byte, so it depends on the last ``WINDOW`` bytes only. A
chunk ends where it falls into the lowest of ``SPACING`` parts of its range and
has not done so in the ``SHORTEST`` bytes before. That depends on the bytes near
by alone, so the same passage is cut alike wherever it stands, after one window
and one chunk, and an insertion shifts nothing behind it. A stretch without an
end is cut every ``LONGEST`` bytes.

A chunk is a repeat if its digest occurs in a document of smaller id, or
earlier in its own. Runs of repeats that hold ``MIN_WORDS`` words or more are
cut out at word boundaries; shorter ones (common phrases) stay. A passage of 50
words leaves such a run behind its first chunk. The first document of every
passage keeps it, so at least one copy stays.

Two shuffles hold eight bytes of digest and the id for each distinct chunk of a
document; the first adds up before it shuffles, and a very common chunk is
split in the second by the skew join. A document receives at most its own
chunks back. At 10**12 chunks some thousand 64-bit digests agree by chance;
a run of 12 words takes several in a row.

Null and empty texts have no chunks and stay as they are. Rows that share an
id count as one document for each other. A null id comes before all others.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermark.llm.shared import forget_cached, portions, saved, schema_with, text_bytes, tidied, with_columns
from ledgermark.llm.shingles import byte_codes, is_blank, stretch_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 16
SPACING = 24
SHORTEST = 8
LONGEST = 128
MIN_WORDS = 12


def gear() -> np.ndarray:
    """The number of each byte value, from a digest of it."""
    return np.array([int.from_bytes(hashlib.md5(b"gear" + bytes((b,))).digest()[:4], "big") for b in range(256)], np.uint32)


def chunk_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each chunk and of each text's first chunk; both closed by an end."""
    n = len(data)
    rolled = gear()[data]
    starts = offsets[:-1]
    # where a window would reach over the start of its text, only the text's own bytes count
    age = np.arange(n) - np.repeat(starts, np.diff(offsets))
    width = 1
    while width < WINDOW:
        shifted = np.zeros(n, np.uint32)
        shifted[width:] = rolled[:-width] if width < n else 0
        shifted[age < width] = 0
        rolled = rolled + (shifted << np.uint32(width))
        width *= 2
    cuts = np.flatnonzero(rolled < np.uint32((1 << 32) // SPACING)) + 1
    owner = np.searchsorted(offsets, cuts - 1, "right")
    lone = np.ones(len(cuts), bool)
    lone[1:] = (np.diff(cuts) > SHORTEST) | (np.diff(owner) > 0)
    cuts = cuts[lone]
    ends = np.searchsorted(cuts, offsets, "right").tolist()
    listed, chunks, firsts = cuts.tolist(), [], []
    for i in range(len(offsets) - 1):
        at, stop = int(offsets[i]), int(offsets[i + 1])
        firsts.append(len(chunks))
        if at == stop:
            continue
        chunks.append(at)
        for cut in [*listed[ends[i] : ends[i + 1]], stop]:
            while cut - at > LONGEST:
                at += LONGEST
                chunks.append(at)
            if cut < stop:
                at = cut
                chunks.append(at)
    firsts.append(len(chunks))
    return np.array([*chunks, n], np.int64), np.array(firsts, np.int64)


def _digests(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return stretch_hashes(byte_codes(7)[data], bounds[:-1], bounds[1:]).view(np.int64)


def _seen_before(digests: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Whether a chunk occurs earlier in its own text."""
    owner = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    order = np.lexsort((np.arange(len(digests)), digests, owner))
    again = np.zeros(len(digests), bool)
    if len(digests):
        same = (digests[order][1:] == digests[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        again[order[1:]] = same
    return again


def chunk_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, digest``: each text's distinct chunks. A null id is the smallest one."""

    def run(batches):
        forget_cached()
        for batch in batches:
            for part in portions(batch, "text"):
                data, offsets = text_bytes(part.column(1))
                bounds, firsts = chunk_bounds(data, offsets)
                digests = _digests(data, bounds)
                fresh = ~_seen_before(digests, firsts)
                ids = np.repeat(part.column(0).to_numpy(), np.diff(firsts))
                yield pa.RecordBatch.from_arrays([pa.array(ids[fresh]), pa.array(digests[fresh])], names=["id", "digest"])

    return docs.select(_id(key).alias("id"), F.col(text).alias("text")).mapInArrow(tidied(run), "id bigint, digest bigint")


def _id(key: str):
    return F.coalesce(F.col(key).cast("bigint"), F.lit(-(2**63)))


def repeats(digests: DataFrame) -> DataFrame:
    """``id, digests``: for each document its chunks that a smaller id has."""
    held = digests.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    later = digests.join(held.select("digest", "first"), "digest").filter(F.col("id") > F.col("first"))
    return later.groupBy("id").agg(F.collect_set("digest").alias("digests"))


def _cut_out(data: np.ndarray, blank: np.ndarray, bounds: np.ndarray, repeated: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Byte spans of the runs to remove from one text, at word boundaries."""
    flags = np.concatenate(([0], repeated.astype(np.int8), [0]))
    edges = np.flatnonzero(np.diff(flags))
    spans = []
    for first, last in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        a, b = int(bounds[first]), int(bounds[last])
        while 0 < a < b and not blank[a] and not blank[a - 1]:
            a += 1
        while a < b < len(data) and not blank[b] and not blank[b - 1]:
            b -= 1
        inside = ~blank[a:b]
        words = int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(b > a and inside[0])
        if words >= min_words:
            spans.append((a, b))
    return spans


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``, and what was cut.

    Adds ``n_chunks``, ``n_repeated`` (chunks), ``removed`` (spans of the original
    text in characters); columns so named are replaced.
    """
    docs = docs.drop("_id", "_repeated")
    digests = chunk_digests(docs, key, text)
    found = repeats(saved(digests, "chunks")).withColumnRenamed("id", "_id").withColumnRenamed("digests", "_repeated")
    rows = docs.withColumn("_id", _id(key)).join(found, "_id", "left").drop("_id")

    def run(batches):
        blanks = is_blank()
        for batch in batches:
            for part in portions(batch, text):
                data, offsets = text_bytes(part.column(part.schema.get_field_index(text)))
                bounds, firsts = chunk_bounds(data, offsets)
                digests = _digests(data, bounds)
                repeated = _seen_before(digests, firsts)
                blank = blanks[data]
                texts, spans, counts = [], [], []
                for i, (known, old) in enumerate(
                    zip(part.column(part.schema.get_field_index("_repeated")), part.column(part.schema.get_field_index(text)), strict=True)
                ):
                    a, b = int(firsts[i]), int(firsts[i + 1])
                    flags = repeated[a:b]
                    if known.is_valid:
                        flags = flags | np.isin(digests[a:b], known.values.to_numpy(zero_copy_only=False))
                    counts.append(int(flags.sum()))
                    start, stop = int(offsets[i]), int(offsets[i + 1])
                    own = data[start:stop]
                    cut = _cut_out(own, blank[start:stop], np.append(bounds[a:b], stop) - start, flags, min_words) if flags.any() else []
                    if not cut:
                        texts.append(old.as_py()), spans.append([])
                        continue
                    kept, at, place, listed = [], 0, 0, []
                    for x, y in cut:
                        kept.append(own[at:x].tobytes())
                        place += len(kept[-1].decode())
                        length = len(own[x:y].tobytes().decode())
                        listed.append({"start": place, "stop": place + length})
                        place, at = place + length, y
                    kept.append(own[at:].tobytes())
                    texts.append(b"".join(kept).decode()), spans.append(listed)
                new = {
                    text: pa.array(texts, pa.string()),
                    "n_chunks": pa.array(np.diff(firsts), pa.int64()),
                    "n_repeated": pa.array(counts, pa.int64()),
                    "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                }
                yield with_columns(part, ("_repeated",), **new)

    types = {text: "string", "n_chunks": "bigint", "n_repeated": "bigint", "removed": "array<struct<start:bigint,stop:bigint>>"}
    return rows.mapInArrow(tidied(run), schema_with(rows, ("_repeated",), **types))
