"""The next row in key order, without bringing the rows together in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of keys for each shuffle partition.
RANGES_PER_PARTITION = 4


def range_number(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are not above ``key``, by halving; 0 for null."""
    if not bounds:
        return F.lit(0)
    listed = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # folded into a literal
    steps = F.array(*[F.lit(1 << i) for i in range(len(bounds).bit_length() - 1, -1, -1)])
    # a place beyond the end is null, so it is never taken
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(listed, at + step - 1) <= key, at + step).otherwise(at))
    return F.coalesce(found, F.lit(0))


def in_ranges(df: DataFrame, key: str, ties: Column) -> tuple[DataFrame, Window]:
    """Rows dealt out by ranges of ``key``, each range closed by the row after it.

    Range bounds come from an approximate quantile sketch of the key (a bounded
    number of values); they shape the partitions, not the result. The first row
    of each following range is added to a range's end with ``_extra`` true, so
    ``lead`` over the window returned reaches the next row everywhere; the last
    range is closed by the very first row. Drop ``_extra`` rows afterwards.
    The broadcast holds one key a range.
    """
    ranges = RANGES_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = df.agg(F.percentile_approx(key, shares, 10 * ranges).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    rows = df.withColumn("_range", range_number(F.col(key), bounds)).withColumn("_extra", F.lit(False))
    rows = rows.withColumn("_tie", ties)
    null_first = F.struct(F.col(key).isNotNull().alias("some"), F.col(key).alias("key"))
    firsts = rows.groupBy("_range").agg(F.min(null_first).alias("_first"))
    everywhere = Window.partitionBy(F.lit(0)).orderBy("_range")  # one row a range
    whole = everywhere.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = firsts.select(
        F.coalesce(F.lead("_first").over(everywhere), F.first("_first").over(whole)).alias("_first"),
        F.col("_range").alias("_closes"),
    )
    closing = (
        rows.join(F.broadcast(following), null_first == F.col("_first"))
        .withColumn("_range", F.col("_closes"))
        .withColumn("_extra", F.lit(True))
        .select(rows.columns)
    )
    order = Window.partitionBy("_range").orderBy("_extra", F.col(key).asc_nulls_first(), "_tie")
    return rows.unionByName(closing), order
