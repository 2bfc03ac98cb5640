"""Operator 13: personal data by fixed patterns and bootstrapped contextual extraction.

Four patterns give the base spans of a text (email, ip, card, phone). They are
the seeds, wherever in a token they stand. Every identifier-like item of the
text, which is one of those, a number of several groups or a token with a digit
or an @, stands in up to three lexical patterns made of the words next to it. Patterns and items' values form a graph whose distinct edges
are scored in rounds:

- a pattern scores, for a kind, the confidence of its values in that kind over
  the number of its values plus one, so what it holds besides lowers it and one
  with fewer than four values cannot pass;
- a value that is no seed has the best score of the patterns that passed.

After ``ROUNDS`` rounds, items in a pattern that passed are spans of its kind if
they touch no base span. All scores are whole parts per million. A context that
says nothing special (most words of prose) also holds dates and counts, and so
stays below the threshold.

Everything is DataFrame functions. A text is read once and is not shuffled; its
spans come from alternating stretches and matches, whose lengths are summed up
in blocks. Patterns have no backtracking into what they consumed, so a pass is
linear in the text. Only edges, scores and accepted spans are shuffled, grouped
with partial sums; a context or value that a third of all items share is one
row after that.

Defined cases: null text is empty. Rows are told apart by position, so repeated
and null ids keep a result each. Contexts are the words within ``CONTEXT`` code
points before and after an item, no further than the next item; ``^`` and ``$``
stand for the ends of the text and ``#`` for another item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermark.llm.shared import BLANKS, let, saved

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
ACCEPT = 800_000  # parts per million
CONTEXT = 48

# The same matches as the plain patterns: a start inside a run that an earlier start has read cannot match.
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
IN = r"[^\x20\x09-\x0D]"  # a character of a token
EDGE = r"[^\p{L}0-9\x20\x09-\x0D]"
#: What a base span may look like; numbers must be long enough, the rest is checked on the match.
LONG_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11}+(?:[\x20-]?[0-9])*+"
LONG_PHONE = r"(?=\+[0-9](?:[\x20().-]*+[0-9]){8})" + PHONE
LOOKS = f"{EMAIL}|{IP}|{LONG_PHONE}|{LONG_CARD}"
# An identifier or groups of digits that edges of their token may surround, or else a token with a digit or @ and
# no identifier inside, or else an identifier inside a token.
ITEM = (
    rf"(?:(?<!{IN})(?:{PHONE}(?:{EDGE}++(?!{IN}))?+|(?:(?!\+){EDGE})*+(?:{PHONE}|{IP}|{EMAIL}|{CARD}){EDGE}*+(?!{IN})"
    rf"|(?={IN}*?[\p{{L}}0-9])(?!{IN}*?(?:{LOOKS}))[^\x20\x09-\x0D0-9@]*+[0-9@]{IN}*+)"
    rf"|(?:{LOOKS})(?:{EDGE}++(?!{IN}))?+)"
)

BLOCK = 256


def running(lengths: Column) -> Column:
    """Sums of an array of longs up to and with each element, added up in blocks, so that arrays copied stay short."""
    none = F.array().cast("array<bigint>")
    added = lambda state, x: F.struct((state["at"] + x).alias("at"), F.concat(state["out"], F.array(state["at"] + x)).alias("out"))
    blocks = lambda all_: F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int"))), lambda b: F.slice(all_, b * BLOCK + 1, BLOCK)
    )
    sums = lambda cut: F.transform(cut, lambda block: F.aggregate(block, F.lit(0).cast("bigint"), lambda a, x: a + x))
    begin = lambda at: F.struct(at.cast("bigint").alias("at"), none.alias("out"))
    ends = lambda cut: F.aggregate(sums(cut), begin(F.lit(0)), added, lambda s: s["out"])
    within = lambda block, end: F.aggregate(
        block, begin(end - F.aggregate(block, F.lit(0).cast("bigint"), lambda a, x: a + x)), added, lambda s: s["out"]
    )
    return let(lengths, lambda all_: let(blocks(all_), lambda cut: F.flatten(F.zip_with(cut, ends(cut), within))))


def matches(text: Column, pattern: str) -> Column:
    """``start, stop, value, before, after`` of each match, leftmost and not overlapping; code points, end exclusive.

    ``before`` and ``after`` are what stands between the match and its neighbours.
    """
    length = lambda s: F.length(s).cast("bigint")

    def placed(found: Column, gaps: Column) -> Column:
        stops = running(F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: length(m) + length(g)))
        return let(
            stops,
            lambda at: F.transform(
                found,
                lambda m, i: F.struct(
                    (F.get(at, i) - length(m)).alias("start"), F.get(at, i).alias("stop"), m.alias("value"), F.get(gaps, i).alias("before"), F.get(gaps, i + 1).alias("after")
                ),
            ),
        )

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda m: let(F.split(text, pattern, -1), lambda g: placed(m, g)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, k: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - k + 1, F.lit(1)).cast("int")
        twice = digit * (2 - k % 2)
        return total + twice - F.when(twice > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


#: By kind: pattern, a character without which there is none, and what a match must pass.
BASE = {
    "email": (EMAIL, "@", lambda value: F.lit(True)),
    "ip": (IP, ".", lambda value: value.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}\z")),
    "card": (CARD, None, lambda value: let(_digits(value), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))),
    "phone": (PHONE, "+", lambda value: F.length(_digits(value)).between(9, 15)),
}


def base_spans(text: Column) -> Column:
    """All base spans: ``start, kind`` (its place in ``KINDS``)``, stop``, in that order."""
    parts = []
    for kind, (pattern, needed, passes) in BASE.items():
        kept = F.filter(matches(text, pattern), lambda m: passes(m["value"]))
        spans = F.transform(kept, lambda m: F.struct(m["start"], F.lit(KINDS.index(kind)).alias("kind"), m["stop"]))
        none = F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>")
        parts.append(F.when(F.contains(text, F.lit(needed)) if needed else text.rlike("[0-9]"), spans).otherwise(none))
    return F.array_sort(F.concat(*parts))


def _kind_of(value: Column) -> Column:
    """The kind of which the whole value is an instance, or null."""
    found = F.lit(None).cast("int")
    for kind, (pattern, _, passes) in BASE.items():
        found = F.when(value.rlike(rf"^(?:{pattern})\z") & passes(value), KINDS.index(kind)).otherwise(found)
    return found


def items(text: Column) -> Column:
    """Identifier-like items: ``start, stop, kind`` (null if no seed)``, value`` (a hash) and its lexical ``patterns``."""

    def words(stretch: Column) -> Column:
        return F.filter(F.split(F.lower(stretch), BLANKS), lambda w: w != "")

    def one(m: Column, first: Column, last: Column) -> Column:
        leading = F.length(F.regexp_extract(m["value"], r"^[^\p{L}0-9+]*+", 0)).cast("bigint")
        core = F.regexp_replace(F.substring(m["value"], leading.cast("int") + 1, F.length(m["value"])), r"(?<=[\p{L}0-9])[^\p{L}0-9]++$", "")
        edge = F.array(F.when(first, "^").otherwise("#"))
        left = F.concat(edge, words(F.substring(m["before"], -CONTEXT, CONTEXT)))
        right = F.concat(words(F.substring(m["after"], 1, CONTEXT)), F.array(F.when(last, "$").otherwise("#")))

        def made(core: Column, left: Column, right: Column) -> Column:
            near = F.element_at(left, -1)
            patterns = F.array(
                F.concat(near, F.lit(" _")),
                F.concat(near, F.lit(" _ "), F.element_at(right, 1)),
                F.concat(F.when(F.size(left) > 1, F.get(left, F.size(left) - 2)).otherwise(""), F.lit(" "), near, F.lit(" _")),
            )
            start = m["start"] + leading
            return F.struct(
                start.alias("start"),
                (start + F.length(core)).alias("stop"),
                _kind_of(core).alias("kind"),
                F.xxhash64(F.lower(core)).alias("value"),
                F.array_distinct(patterns).alias("patterns"),
            )

        return let(core, lambda c: let(left, lambda l: let(right, lambda r: made(c, l, r))))

    found = let(matches(text, ITEM), lambda all_: F.transform(all_, lambda m, i: one(m, i == 0, i == F.size(all_) - 1)))
    none = F.array().cast("array<struct<start:bigint,stop:bigint,kind:int,value:bigint,patterns:array<string>>>")
    return F.when(text.rlike("[0-9@]"), found).otherwise(none)


def listed(spans: Column) -> Column:
    """``kind:start:stop`` of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def accepted_patterns(found: DataFrame, rounds: int = ROUNDS, accept: int = ACCEPT) -> DataFrame:
    """``pattern, kind, score`` of the lexical patterns that pass, from items (``kind, value, patterns``)."""
    c = F.col
    edges = saved(found.select(F.explode("patterns").alias("pattern"), "value").distinct(), "pii-edges")
    seeds = saved(found.filter("kind is not null").select("value", "kind").distinct().withColumn("score", F.lit(1_000_000).cast("bigint")), "pii-seeds")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    known = seeds
    for turn in range(rounds):
        held = edges.join(known, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("held"))
        scored = held.join(sizes, "pattern").select("pattern", "kind", F.expr("held div (n + 1)").alias("score"))
        passed = saved(scored.filter(c("score") >= accept), "pii-patterns")
        if turn + 1 < rounds:
            reached = edges.join(passed, "pattern").join(seeds.select("value"), "value", "left_anti")
            known = saved(seeds.unionByName(reached.groupBy("value", "kind").agg(F.max("score").alias("score"))), "pii-values")
    return passed


def personal_data(docs: DataFrame, rounds: int = ROUNDS, accept: int = ACCEPT) -> DataFrame:
    """``doc_id, base`` and ``spans`` (arrays of ``start, kind, stop``, sorted) for each row of ``docs``."""
    c = F.col
    text = F.coalesce(c("text"), F.lit(""))
    read = docs.select("doc_id", base_spans(text).alias("base"), items(text).alias("items"), F.monotonically_increasing_id().alias("row"))
    read = saved(read, "pii-read")
    found = read.select("row", F.explode("items").alias("item")).select("row", "item.*")
    passed = accepted_patterns(found, rounds, accept)
    unseen = found.filter("kind is null").select("row", "start", "stop", F.explode("patterns").alias("pattern")).join(passed, "pattern")
    best = unseen.groupBy("row", "start", "stop").agg(F.max(c("score") * len(KINDS) - c("kind")).alias("best"))
    more = best.select("row", "start", F.pmod(-c("best"), F.lit(len(KINDS))).cast("int").alias("kind"), "stop", F.lit(False).alias("own"))
    touched = read.join(more.select("row").distinct(), "row", "left_semi")
    base = touched.select("row", F.explode("base").alias("s")).select("row", "s.start", "s.kind", "s.stop", F.lit(True).alias("own"))
    # A document's spans by position: an added one must start after base spans before it end, and end before the next one starts.
    by_place = Window.partitionBy("row").orderBy("start", F.desc("own"))
    behind = F.max(F.when(c("own"), c("stop"))).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.first(F.when(c("own"), c("start")), ignorenulls=True).over(by_place.rowsBetween(1, Window.unboundedFollowing))
    clear = F.coalesce(behind <= c("start"), F.lit(True)) & F.coalesce(ahead >= c("stop"), F.lit(True))
    added = base.unionByName(more).withColumn("clear", clear).filter("not own and clear")
    lists = added.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "stop")).alias("added"))
    spans = F.when(c("added").isNull(), c("base")).otherwise(F.array_sort(F.concat("base", "added")))
    return read.join(lists, "row", "left").select("doc_id", "base", spans.alias("spans"))
