"""Operator 7: mix sources to target weights by systematic sampling.

Every source has a weight and a target: its share of all words by weight, at
most ``most`` times its own words, and what it cannot take goes to the others
by weight. A document's expected copies are its source's target over the
source's words. Expected copies are summed over the source's documents in an
order fixed by size and by a digest of the key, a random offset of the source
is added, and a document is emitted once for each whole number its stretch
crosses. As sizes stand in order, the words taken come near the target, and no
document is taken more than ``most`` times.

The prefix sum is cut into blocks of a source (documents of about one size and
one part of the digest range): block counts are added up per source (245,000
blocks at most), and each block numbers its own documents. A source with a
third of all rows is thousands of blocks. Rows are shuffled once, with what
they carry; the sums come to a block as rows of it, not through a join.

Null texts count as size 0. Documents without words, and sources without, take
no words. Rows of equal key are told apart by size; equal rows share what
falls to them. A null source is a source of its own, the last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermark.llm.shared import WORD, saved

WEIGHTS = (5, 2, 1)
MOST = 3


def size_of(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target``: one row a source, from rows of ``source`` and ``size``.

    Sources in order of their code points, null last, take the weights in turn.
    Going up by words per weight, all sources before the first that can take
    its share are held at ``most`` times their words. Sources are one row each,
    so these windows hold no documents.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int"))
    exact = lambda c: c.cast("decimal(38,0)")
    rows = own.withColumn("weight", weight).withColumn("held", F.col("source_size") * most)
    everywhere = Window.partitionBy(F.lit(0))
    order = Window.orderBy(F.col("held") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("rest", exact(F.sum("source_size").over(everywhere)) - exact(F.coalesce(F.sum("held").over(before), F.lit(0))))
        .withColumn("weights", F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("place", F.row_number().over(order))
        .withColumn("free", exact(F.col("rest") * F.col("weight")) <= exact(F.col("held")) * F.col("weights"))
    )
    first = F.min_by(F.struct("rest", "weights", "place"), F.when(F.col("free"), F.col("place"))).over(everywhere)
    rows = rows.withColumn("level", first)
    share = F.col("level.rest").cast("double") * F.col("weight") / F.col("level.weights")
    target = F.when(F.col("place") < F.col("level.place"), F.col("held").cast("double")).otherwise(share)
    return rows.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _size_class(size: Column) -> Column:
    """Four classes to each doubling of size."""
    digits = F.length(F.bin(size))
    return digits * 8 + F.call_function("shiftright", size, F.greatest(digits - 3, F.lit(0)))


def _source_name(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def mix(
    docs: DataFrame, sized: DataFrame | None = None, key: str = "doc_id", seed: str = "mix", weights: Sequence[int] = WEIGHTS, most: int = MOST
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``.

    ``docs`` holds ``source`` and ``text``, or ``size`` already; all its other
    columns are carried, but for those named as the ones added or as the
    helpers ``_source, _class, _part, _head, _at, _of``. ``sized`` (``key``, ``source``, ``size``) may hold the same
    rows, counted before. The offset of a source is a digest of ``seed`` and
    its name, so a rerun takes the same copies.
    """
    docs = docs.drop("_source", "_class", "_part", "_head", "_at", "_of")
    names = docs.columns
    if "size" not in names:
        docs = docs.withColumn("size", size_of(F.col("text")))
    sized = docs.select(key, "source", "size") if sized is None else sized

    def placed(df):
        digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
        return (
            df.withColumn("_source", _source_name(F.col("source")))
            .withColumn("_class", _size_class(F.col("size")).cast("int"))
            .withColumn("_part", F.substring(digest, 1, 3))
        )

    named = targets(sized, weights, most).withColumn("_source", _source_name(F.col("source"))).drop("source")
    blocks = placed(sized).groupBy("_source", "_class", "_part").agg(F.count(F.lit(1)).alias("_n"))
    up = Window.partitionBy("_source").orderBy("_class", "_part").rowsBetween(Window.unboundedPreceding, -1)
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("_source")).cast("binary")), 1, 8), 16, 10)
    blocks = (
        blocks.withColumn("_before", F.coalesce(F.sum("_n").over(up), F.lit(0)))
        .join(named, "_source")
        .withColumn("_offset", drawn.cast("double") / 4294967296.0)
    )
    facts = F.struct("_before", "source_size", "target", "_offset")
    heads = blocks.select("_source", "_class", "_part", facts.alias("_head"))
    rows = placed(docs).unionByName(heads, allowMissingColumns=True)
    block = Window.partitionBy("_source", "_class", "_part").orderBy(F.col("_head").isNull(), F.col(key), "size")
    rows = rows.withColumn("_at", F.row_number().over(block) - 1)
    rows = rows.withColumn("_of", F.first("_head", ignorenulls=True).over(block)).filter(F.col("_head").isNull())
    rate = F.when(F.col("_of.source_size") > 0, F.col("_of.target") / F.col("_of.source_size")).otherwise(0.0)
    place = F.col("_of._before") + F.col("_at")
    crossed = lambda n: F.floor(rate * n + F.col("_of._offset"))
    return rows.select(
        *[n for n in names if n not in ("size", "source_size", "target", "copies")],
        "size",
        F.col("_of.source_size").alias("source_size"),
        F.col("_of.target").alias("target"),
        (crossed(place.cast("double")) - crossed((place - 1).cast("double"))).cast("bigint").alias("copies"),
    )


def mixture_of(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each document's size and the words the mix takes of it; texts are read once."""
    sized = saved(docs.select(key, "source", size_of(F.col("text")).alias("size")), "mix-sizes")
    rows = mix(sized, sized, key)
    return rows.select(key, "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The mixed corpus: every document as often as it is taken. Columns ``size, source_size, target, copies`` are dropped."""
    rows = mix(docs.drop("size"), None, key).filter(F.col("copies") > 0)
    names = [n for n in rows.columns if n not in ("size", "source_size", "target", "copies")]
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*names)
