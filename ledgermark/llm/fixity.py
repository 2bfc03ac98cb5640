"""Operator 1: Merkle fixity audit of WARC replicas.

Each record is hashed once, in a pass over the archives. A tree is built over
ordered offset ranges: an entry for each offset, a leaf for each ``RANGE`` bytes
of an archive, and above it a node for every ``FANOUT`` nodes, up to one root an
archive. Children are bounded by construction, so no node gathers more than
that, whatever an archive's size. An audit compares the roots of two replicas
and goes down level by level, into branches that differ only; entries and
records are read for leaves that differ.

Records that share an offset form one entry, an order-free sum of their hashes
with their number. A null offset counts as -1, null data as empty, a null
archive as an archive of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermark.llm.shared import saved

RANGE = 1 << 16
FANOUT = 16
LANES = 8


def warc_record(url: Column, payload: Column) -> Column:
    """A response record as text: header, payload, end."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def record_hashes(records: DataFrame) -> DataFrame:
    """``replica, archive, offset, record_id, length, sha256`` from ``replica, archive, offset, record_id, data``."""
    data = F.coalesce(F.col("data").cast("binary"), F.lit(b""))
    return records.select(
        "replica",
        F.coalesce(F.col("archive").cast("string"), F.lit("")).alias("archive"),
        F.coalesce(F.col("offset"), F.lit(-1)).cast("bigint").alias("offset"),
        "record_id",
        F.octet_length(data).cast("bigint").alias("length"),
        F.sha2(data, 256).alias("sha256"),
    )


def entries(hashes: DataFrame) -> DataFrame:
    """One hash for each offset of a replica's archive."""
    lanes = [F.sum(F.conv(F.substring("sha256", 1 + 8 * i, 8), 16, 10).cast("bigint")).cast("string") for i in range(LANES)]
    parts = [F.col("offset").cast("string"), F.count(F.lit(1)).cast("string"), *lanes]
    return hashes.groupBy("replica", "archive", "offset").agg(F.sha2(F.concat_ws(":", *parts), 256).alias("hash"))


def _parents(nodes: DataFrame, place: Column) -> DataFrame:
    """Nodes one level up; ``place`` is the parent's number from the child's ``at``."""
    children = F.sort_array(F.collect_list(F.struct("at", "hash")))
    listed = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["at"].cast("string"), c["hash"])), ",")
    return nodes.groupBy("replica", "archive", place.alias("_up")).agg(F.sha2(listed, 256).alias("hash")).withColumnRenamed("_up", "at")


def build_tree(hashes: DataFrame) -> list[DataFrame]:
    """The levels of all trees, entries first, roots last: ``replica, archive, at, hash``.

    Height follows from the largest offset. Each level is written once, and the
    next is built from it.
    """
    levels = [saved(entries(hashes).withColumnRenamed("offset", "at"), "entries")]
    top = levels[0].agg(F.max("at").alias("at")).first()["at"]
    width, up = RANGE, F.floor((F.col("at") + 1) / RANGE)
    while True:
        levels.append(saved(_parents(levels[-1], up), f"level-{len(levels)}"))
        if top is None or top + 1 < width:
            return levels
        width, up = width * FANOUT, F.floor(F.col("at") / FANOUT)


def differing(levels: list[DataFrame], one: str, other: str) -> DataFrame:
    """``archive, at``: the offsets at which two replicas differ, found from the roots down."""
    bad = None
    for depth in range(len(levels) - 1, -1, -1):
        nodes = levels[depth]
        if bad is not None:
            up = F.floor((F.col("at") + 1) / RANGE) if depth == 0 else F.floor(F.col("at") / FANOUT)
            branches = bad.select("archive", F.col("at").alias("_up"))
            nodes = nodes.withColumn("_up", up).join(branches, ["archive", "_up"], "left_semi")
        side = lambda name, column: nodes.filter(F.col("replica") == name).select("archive", "at", F.col("hash").alias(column))  # noqa: E731, B023
        both = side(one, "_one").join(side(other, "_other"), ["archive", "at"], "full")
        bad = both.filter(~F.col("_one").eqNullSafe(F.col("_other"))).select("archive", "at")
    return bad


def audit(hashes: DataFrame, one: str, other: str) -> DataFrame:
    """A row for each damaged offset: what is there in either replica, and ``kind``.

    ``kind`` is ``missing`` (not in ``other``), ``extra`` (not in ``one``) or ``changed``.
    Where several records share the offset, the smallest id, the summed length
    and the smallest digest stand for them.
    """
    levels = build_tree(hashes)
    bad = saved(differing(levels, one, other).withColumnRenamed("at", "offset"), "damage")
    found = hashes.join(bad, ["archive", "offset"], "left_semi")

    def of(name, column, agg):
        return agg(F.when(F.col("replica") == name, F.col(column)))

    rows = found.groupBy("archive", "offset").agg(
        F.min("record_id").alias("record_id"),
        of(one, "length", F.sum).alias("length_one"),
        of(other, "length", F.sum).alias("length_other"),
        of(one, "sha256", F.min).alias("sha256_one"),
        of(other, "sha256", F.min).alias("sha256_other"),
    )
    kind = F.when(F.col("sha256_other").isNull(), "missing").when(F.col("sha256_one").isNull(), "extra").otherwise("changed")
    start = F.floor((F.col("offset") + 1) / RANGE) * RANGE
    return rows.select("archive", start.alias("range_start"), "offset", "record_id", kind.alias("kind"), "length_one", "length_other", "sha256_one", "sha256_other")
