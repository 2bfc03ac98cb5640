"""Operator 8: URL filters with dated lists, evaluated as of each capture.

Dated entries (add or remove a pattern) become validity intervals, and every
capture is held against the entries in force at its fetch time. A pattern is a
domain, which covers its subdomains, or a host with a path, which covers that
page with any query. An entry is in force from its date on, up to the date of
its removal.

The as-of join is a prefix sum. Each list is a bit; an interval adds its bit
at its start and takes it away at its end, so the sum of all changes of a
pattern up to a time is the set of lists it is on. Captures and changes of a
pattern are cut into hours: the hours' sums are added up first, and each hour
adds up its own rows. Nothing is paired, so the work is linear, and a host with
a third of the captures is as many groups as it has hours.

A null or unreadable URL or a null time is on no list. Captures equal in id,
URL and time are one. Adding and removing at the same time counts as adding.
Entries without a known list, pattern or date are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000  # microseconds
MOST_LISTS = 62


def intervals(entries: DataFrame) -> DataFrame:
    """``list, pattern, since, until``: when each pattern was on each list; ``until`` is null while it is.

    ``entries`` holds ``list, pattern, adds`` (boolean) and ``at``, in any order. Entries that change nothing are skipped.
    """
    dated = entries.filter("list is not null and pattern is not null and at is not null")
    states = dated.groupBy("list", "pattern", "at").agg(F.max(F.coalesce("adds", F.lit(False))).alias("on"))
    order = Window.partitionBy("list", "pattern").orderBy("at")
    changes = states.withColumn("_was", F.coalesce(F.lag("on").over(order), F.lit(False))).filter("`on` <> _was")
    spans = changes.withColumn("until", F.lead("at").over(order)).filter("`on`")
    return spans.select("list", "pattern", F.col("at").alias("since"), "until")


def pattern_key(pattern: Column) -> Column:
    """The key of a list pattern: lower-case, without a scheme, ``www.`` kept."""
    bare = F.regexp_replace(F.lower(F.trim(pattern)), "^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(bare, "/+$", "")


def url_keys(url: Column) -> Column:
    """The patterns that would cover a URL, the narrowest first: its page, its host, the domains above.

    An array of at most one more than the labels of the host; empty for what is no URL.
    """
    shape = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^?#]*)"
    host, path = F.lower(F.regexp_extract(url, shape, 1)), F.regexp_replace(F.lower(F.regexp_extract(url, shape, 2)), "/+$", "")
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pages = F.when(path != "", F.array(F.concat(host, path))).otherwise(F.array().cast("array<string>"))
    return F.when(F.coalesce(host, F.lit("")) != "", F.concat(pages, domains)).otherwise(F.array().cast("array<string>"))


def evaluate(
    captures: DataFrame, entries: DataFrame, lists: Sequence[str], key: str = "page_id", url: str = "url", at: str = "fetched_at", allow: Sequence[str] = ()
) -> DataFrame:
    """``key, url, at, lists, blocked, pattern`` of each capture.

    ``lists`` names up to 62 lists; those also in ``allow`` lift every block.
    ``lists`` in the result are those the capture was on, in that order, and
    ``pattern`` is the narrowest pattern that put it on one.
    """
    if len(lists) > MOST_LISTS:
        raise ValueError(f"{len(lists)} lists, at most {MOST_LISTS}")
    bit = F.create_map(*[x for i, name in enumerate(lists) for x in (F.lit(name), F.lit(1 << i))])
    spans = intervals(entries).filter(F.col("list").isin(*lists)).select(pattern_key(F.col("pattern")).alias("key"), bit[F.col("list")].alias("bit"), "list", "since", "until")
    # spellings of one pattern may overlap in one list: count the list once
    edges = spans.select("key", "list", "bit", F.explode(F.array(F.struct(F.col("since").alias("at"), F.lit(1).alias("n")), F.struct(F.col("until").alias("at"), F.lit(-1).alias("n")))).alias("e"))
    edges = edges.filter("e.at is not null").groupBy("key", "list", "bit", "e.at").agg(F.sum("e.n").alias("n"))
    line = Window.partitionBy("key", "list").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    edges = edges.withColumn("_now", F.sum("n").over(line))
    edges = edges.select("key", F.unix_micros("at").alias("at"), (F.when((F.col("_now") > 0) & (F.col("_now") == F.col("n")), F.col("bit")).when((F.col("_now") == 0) & (F.col("n") < 0), -F.col("bit"))).alias("change"))
    edges = edges.filter("change is not null").groupBy("key", "at").agg(F.sum("change").alias("change"))

    facts = captures.select(F.col(key).alias("_id"), F.col(url).alias("_url"), F.col(at).alias("_fetched")).distinct()
    asked = facts.select("_id", "_url", "_fetched", F.unix_micros("_fetched").alias("at"), F.posexplode_outer(url_keys(F.col("_url"))).alias("level", "key"))
    asked = asked.withColumn("_asks", F.lit(True))
    hour = lambda df: df.withColumn("hour", F.floor(F.col("at") / HOUR))
    asked, edges = hour(asked), hour(edges)

    hours = edges.select("key", "hour", "change").unionByName(asked.filter("key is not null and hour is not null").select("key", "hour", F.lit(0).cast("bigint").alias("change")))
    hours = hours.groupBy("key", "hour").agg(F.sum("change").alias("change"))
    before = Window.partitionBy("key").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    heads = hours.withColumn("_sum", F.sum("change").over(before)).filter("_sum <> 0")
    heads = heads.select("key", "hour", F.col("_sum").alias("change"))
    rows = asked.unionByName(edges, allowMissingColumns=True).unionByName(heads, allowMissingColumns=True)
    # what came before the hour, then changes, then captures of the same time
    within = Window.partitionBy("key", "hour").orderBy(F.col("at").asc_nulls_first(), F.col("_asks").isNotNull())
    held = rows.withColumn("mask", F.coalesce(F.sum("change").over(within.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    held = held.filter(F.col("_asks") & True).withColumn("mask", F.when(F.col("at").isNotNull() & F.col("key").isNotNull(), F.col("mask")).otherwise(0))
    found = held.groupBy("_id", "_url", "_fetched").agg(
        F.bit_or("mask").alias("mask"), F.min(F.when(F.col("mask") != 0, F.col("level"))).alias("level")
    )
    names = F.filter(F.array(*[F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.lit(name)) for i, name in enumerate(lists)]), lambda x: x.isNotNull())
    block = sum(1 << i for i, name in enumerate(lists) if name not in allow)
    lift = sum(1 << i for i, name in enumerate(lists) if name in allow)
    blocked = (F.col("mask").bitwiseAND(block) != 0) & (F.col("mask").bitwiseAND(lift) == 0)
    return found.select(
        F.col("_id").alias(key), F.col("_url").alias(url), F.col("_fetched").alias(at),
        names.alias("lists"), blocked.alias("blocked"), F.get(url_keys(F.col("_url")), F.col("level")).alias("pattern"),
    )
