"""Operator 3: quality rules whose cutoffs come from quantile sketches.

Word and line counts of each text give four rates: symbols, repeated lines and
repeated words a hundred, and mean word length. Rates are counted into buckets
whose bounds grow by two per cent. Such counts per language and source are a
quantile sketch: sketches merge by adding, so a language's sketch is the sum of
its sources' and nothing has to be sorted or gathered. Only texts that pass the
base rules are counted.

A group's quantiles stand at the quartiles, the median and wherever the rest of
the texts is halved again, down to a thousandth. Each is drawn towards the
language's, and that one towards all texts', by as much as few texts lie beyond
it: ``STRENGTH`` texts of the wider group count with the group's own. So there
is no size at which a group changes its rule.

Word length is held between fences ``REACH`` interquartile ranges beyond the
quartiles. The other rates are 0 for most texts, and their tail sets the fence.
A tail grows by some factor whenever the texts beyond it are halved. A factor
above ``JUMP`` is no tail of one kind of text (such a tail would have no mean
twice over): another kind begins there, and the fence stands in the middle of
the first such jump, by ratio. A tail without a jump ends one more of its own
steepest steps beyond its last quantile. Values below ``LEAST`` count as that, a
rounding size: what can stand in a short text once.

The fences are joined back and the rates held against them.

Null and wordless texts fail the base rules. Null languages and sources are
groups of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermark.llm.shared import let, saved, words_of

PLACE_BITS = 26
PLACE = (1 << PLACE_BITS) - 1

#: Share by which bucket bounds grow, and where the first bucket ends.
GROWTH = 1.02
SMALLEST = 0.01
REACH = 3.0
JUMP = 4.0
#: Texts of the wider group that count with those beyond a quantile.
STRENGTH = 8.0

#: Rate: its rounding size, the least there can be in the shortest text that passes, 50 words in lines of ten: one
#: symbol, five characters, one repeated line, one window of three words found twice.
LEAST = {"symbols": 2.0, "word_length": 0.1, "dup_lines": 20.0, "repeats": 12.0}

#: Quantiles: the lower quartile, then the upper half, halved until a thousandth is left.
QUANTILES = [0.25, *[1 - 2.0**-k for k in range(1, 11)]]


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed``.

    Columns so named are replaced; columns that start with ``_q_`` are dropped.
    """
    c, own = F.col, F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_q_words", words_of(c(text))).withColumn("_q_n", F.size("_q_words"))
    lines = F.filter(F.split(own, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_q_lines", lines)
    windows = F.when(
        c("_q_n") >= 3,
        F.transform(F.sequence(F.lit(0), c("_q_n") - 3), lambda i: F.xxhash64(*[F.get(c("_q_words"), i + j) for j in range(3)])),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_q_windows", windows)
    # sorted by the hash's first 38 bits, repeats are neighbours; few texts have any
    packed = F.transform(c("_q_windows"), lambda h, i: h.bitwiseAND(~PLACE).bitwiseOR(i.cast("bigint")))
    df = df.withColumn("_q_sorted", F.sort_array(packed))

    def near(array, part):
        def test(x, i):
            before, after = F.get(array, i - 1), F.get(array, i + 1)
            return F.coalesce(part(x) == part(before), F.lit(False)) | F.coalesce(part(x) == part(after), F.lit(False))

        return F.filter(array, test)

    candidates = near(c("_q_sorted"), lambda x: F.shiftright(x, PLACE_BITS))
    df = df.withColumn("_q_near", candidates)

    # then by the whole hash
    def exact(x):
        place = x.bitwiseAND(PLACE).cast("int")
        return F.struct(F.get(c("_q_windows"), place).alias("hash"), place.alias("place"))

    df = df.withColumn("_q_exact", F.sort_array(F.transform(c("_q_near"), exact)))
    places = F.transform(near(c("_q_exact"), lambda x: x["hash"]), lambda x: x["place"])
    df = df.withColumn("_q_places", F.sort_array(places))
    # a window reaches three words on, or to the next repeated window
    reach = F.transform(c("_q_places"), lambda p, i: F.least(F.lit(3), F.coalesce(F.get(c("_q_places"), i + 1) - p, F.lit(3))))
    repeated = F.aggregate(reach, F.lit(0), lambda a, x: a + x)
    blank = F.regexp_replace(own, r"[\x20\x09-\x0D]+", "")
    counts = {
        "n_words": c("_q_n"),
        "word_chars": F.length(blank),
        "n_symbols": F.length(F.regexp_replace(own, r"[^#*$%&|<>]+", "")),
        "n_dup_lines": F.size("_q_lines") - F.size(F.array_distinct("_q_lines")),
        "n_repeat_words": repeated,
        "n_lines": F.size("_q_lines"),
    }
    kept = [n for n in docs.columns if n not in counts and n != "base_failed" and not n.startswith("_q_")]
    df = df.select(*kept, *[v.cast("bigint").alias(n) for n, v in counts.items()])
    return df.withColumn("base_failed", (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words")))


def rates() -> dict[str, Column]:
    """The four rates; 0 where there is nothing to divide by."""
    c = F.col
    per = lambda part, whole, by: F.coalesce(by * c(part) / F.nullif(c(whole), F.lit(0)), F.lit(0.0))
    return {
        "symbols": per("n_symbols", "n_words", 100.0),
        "word_length": per("word_chars", "n_words", 1.0),
        "dup_lines": per("n_dup_lines", "n_lines", 100.0),
        "repeats": per("n_repeat_words", "n_words", 100.0),
    }


def bucket_of(rate: Column) -> Column:
    return F.when(rate <= SMALLEST, 0).otherwise(F.ceil(F.log(rate / SMALLEST) / F.log(F.lit(GROWTH)))).cast("int")


def value_of(bucket: Column) -> Column:
    """The middle of a bucket; 0 for the first."""
    return F.when(bucket == 0, 0.0).otherwise(SMALLEST * F.pow(F.lit(GROWTH), bucket - 0.5))


def _name(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("v"), F.col(column)), F.lit("n"))


def sketches(counted: DataFrame) -> DataFrame:
    """``lang, source, rate, bucket, n``: rows of a group are its sketch; sum to merge."""
    named = counted.filter(~F.col("base_failed")).select(_name("lang").alias("lang"), _name("source").alias("source"), *[r.alias(n) for n, r in rates().items()])
    long = named.select("lang", "source", F.explode(F.create_map(*[x for n in LEAST for x in (F.lit(n), F.col(n))])).alias("rate", "value"))
    return long.groupBy("lang", "source", "rate", bucket_of(F.col("value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """``by, rate, docs, q``: the quantiles of sketches merged by ``by``.

    A group and rate has no more buckets than the range of doubles gives (2,000).
    """
    merged = sketch.groupBy(*by, "rate", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "rate")
    merged = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("docs", F.sum("n").over(group))
    at = lambda q: value_of(F.min(F.when(F.col("upto") >= F.ceil(F.col("docs") * q), F.col("bucket"))))
    return merged.groupBy(*by, "rate").agg(F.max("docs").alias("docs"), F.array(*map(at, QUANTILES)).alias("q"))


def _of(values: dict[str, float]) -> Column:
    return F.create_map(*[x for n, v in values.items() for x in (F.lit(n), F.lit(v))])[F.col("rate")]


def drawn(own: Column, docs: Column, prior: Column) -> Column:
    """Quantiles drawn towards ``prior``, by ratio; what is missing is the other."""
    beyond = F.array(*[F.lit(min(q, 1 - q)) for q in QUANTILES])
    least = _of(LEAST)

    def one(q: Column, i: Column) -> Column:
        weight = docs * F.get(beyond, i) / (docs * F.get(beyond, i) + STRENGTH)
        return F.exp(weight * F.log(F.greatest(q, least)) + (1 - weight) * F.log(F.greatest(F.get(prior, i), least)))

    return F.when(own.isNull(), prior).when(prior.isNull(), own).otherwise(F.transform(own, one))


def upper(q: Column) -> Column:
    """The upper fence of a rate by its tail, from the median on."""
    floor = F.transform(F.slice(q, 2, len(QUANTILES) - 1), lambda x: F.greatest(x, _of(LEAST)))

    def fence(tail: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.size(tail) - 2), lambda i: F.struct(F.get(tail, i).alias("a"), F.get(tail, i + 1).alias("b")))
        jumps = F.filter(steps, lambda s: s["b"] > JUMP * s["a"])
        steepest = F.array_max(F.transform(steps, lambda s: s["b"] / s["a"]))
        first = F.get(jumps, F.lit(0))
        return F.when(F.size(jumps) > 0, F.sqrt(first["a"] * first["b"])).otherwise(F.element_at(tail, -1) * steepest)

    return let(floor, fence)


def with_fences(found: DataFrame) -> DataFrame:
    """Add ``low`` and ``high`` to quantiles (``rate, q``)."""
    span = REACH * F.greatest(F.get("q", F.lit(2)) - F.get("q", F.lit(0)), _of(LEAST))
    two_sided = F.col("rate") == "word_length"
    low = F.when(two_sided, F.get("q", F.lit(0)) - span).otherwise(-1.0)
    return found.withColumn("low", low).withColumn("high", F.when(two_sided, F.get("q", F.lit(2)) + span).otherwise(upper(F.col("q"))))


def thresholds(counted: DataFrame) -> DataFrame:
    """``lang, source, fence`` (a struct of each rate's ``low`` and ``high``) for each group."""
    sketch = saved(sketches(counted), "quality-sketches")
    named = lambda df, name: df.withColumnsRenamed({"docs": f"{name}_docs", "q": name})
    rates_of = F.explode(F.array(*map(F.lit, LEAST))).alias("rate")
    groups = counted.select(_name("lang").alias("lang"), _name("source").alias("source")).distinct().select("*", rates_of)
    found = groups.join(named(quantiles(sketch, ["lang", "source"]), "_own"), ["lang", "source", "rate"], "left")
    found = found.join(named(quantiles(sketch, ["lang"]), "_lang"), ["lang", "rate"], "left").join(named(quantiles(sketch, []), "_all"), "rate", "left")
    found = found.withColumn("_wide", drawn(F.col("_lang"), F.col("_lang_docs"), F.col("_all")))
    found = with_fences(found.select("lang", "source", "rate", drawn(F.col("_own"), F.col("_own_docs"), F.col("_wide")).alias("q")))
    ends = [F.max(F.when(F.col("rate") == n, F.struct("low", "high"))).alias(n) for n in LEAST]
    return found.groupBy("lang", "source").agg(*ends).select("lang", "source", F.struct(*LEAST).alias("fence"))


def judged(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """Add ``kept``: past the base rules and within all fences of the row's group."""
    inside = F.lit(True)
    for name, rate in rates().items():
        inside = inside & rate.between(F.col(f"fence.{name}.low"), F.col(f"fence.{name}.high"))
    counted = counted.drop("_lang", "_source", "fence", "kept")
    keyed = counted.withColumn("_lang", _name("lang")).withColumn("_source", _name("source"))
    # Saved, they are of known size: a few groups are broadcast, and a group with most rows is no task of its own.
    limits = saved(limits, "quality-fences").select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "fence")
    joined = keyed.join(limits, ["_lang", "_source"], "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).drop("_lang", "_source", "fence")
