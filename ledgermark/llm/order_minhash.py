"""Operator 2: Order MinHash fingerprints, sensitive to edit distance.

K-mers are runs of ``k`` words; a text of fewer words is one k-mer, and a text
without words has none. Each occurrence of a k-mer is numbered within its text,
so a passage said twice differs from one said once. A row of ``size`` orders is
used, rotations of one hash: order ``b`` starts at the ``b``-th part of the
hash range and goes round. In each order the ``length`` smallest numbered
k-mers are taken, put back in the order of the text, and hashed as a tuple. Two
texts are alike as far as their tuples agree, which falls with reordering as
well as with changed words (order-free sketches see the latter only).

Everything is column expressions on the row, with primitive sorts: one long
holds 38 bits of hash and 26 bits of place, and 2**26 words are more than an
array of strings can hold. Null is taken as empty. All texts without words have
the same fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermark.llm.neighbours import in_ranges
from ledgermark.llm.shared import words_of

PLACE_BITS = 26
PLACE = (1 << PLACE_BITS) - 1
HASH = ~PLACE

K = 5
LENGTH = 2
SIZE = 64  # a power of two


def _hash_part(packed: Column) -> Column:
    return F.shiftright(packed, PLACE_BITS)


def with_signature(df: DataFrame, text: str, out: str, k: int = K, length: int = LENGTH, size: int = SIZE) -> DataFrame:
    """Add the signature of ``text``: an array of ``size`` hashes of 32 bits.

    A column named ``out`` is replaced; columns that start with ``_omh_`` are dropped.
    """
    c = F.col
    bits = size.bit_length() - 1
    kept = [n for n in df.columns if n != out and not n.startswith("_omh_")]
    df = df.withColumn("_omh_words", F.transform(words_of(c(text)), lambda w: F.xxhash64(w)))
    runs = F.transform(
        F.sequence(F.lit(0), F.size("_omh_words") - k), lambda i: F.xxhash64(*[F.get(c("_omh_words"), i + j) for j in range(k)])
    )
    kmers = (
        F.when(F.size("_omh_words") >= k, runs)
        .when(F.size("_omh_words") > 0, F.array(F.xxhash64("_omh_words")))
        .otherwise(F.array().cast("array<bigint>"))
    )
    packed = F.transform(kmers, lambda h, i: h.bitwiseAND(HASH).bitwiseOR(i.cast("bigint")))
    df = df.withColumn("_omh_sorted", F.sort_array(packed)).withColumn("_omh_n", F.size("_omh_sorted"))
    at = F.when(c("_omh_n") > 0, F.sequence(F.lit(0), c("_omh_n") - 1)).otherwise(F.array().cast("array<int>"))

    # occurrences of one k-mer stand together; those after the first get a hash of their own
    def begins(i):
        here, before = F.get(c("_omh_sorted"), i), F.get(c("_omh_sorted"), i - 1)
        return (i == 0) | (_hash_part(here) != _hash_part(before))

    df = df.withColumn("_omh_starts", F.filter(at, begins))

    def numbered(start, r):
        stop = F.coalesce(F.get(c("_omh_starts"), r + 1), c("_omh_n"))
        again = lambda x, o: F.xxhash64(_hash_part(x), o).bitwiseAND(HASH).bitwiseOR(x.bitwiseAND(PLACE))
        run = F.slice(c("_omh_sorted"), start + 1, stop - start)
        return F.transform(run, lambda x, o: F.when(o == 0, x).otherwise(again(x, o)))

    repeats = F.size("_omh_starts") < c("_omh_n")
    df = df.withColumn(
        "_omh_order",
        F.when(repeats, F.sort_array(F.flatten(F.transform(c("_omh_starts"), numbered)))).otherwise(c("_omh_sorted")),
    )

    # where each order starts: the first hash not below its part of the range
    def part(i):
        return F.shiftright(F.get(c("_omh_order"), i), 64 - bits).cast("int") + size // 2

    df = df.withColumn("_omh_firsts", F.filter(at, lambda i: (i == 0) | (part(i) != part(i - 1))))

    def upto(f, r):
        before = F.when(r == 0, F.lit(-1)).otherwise(part(F.get(c("_omh_firsts"), r - 1)))
        return F.array_repeat(f, part(f) - before)

    left = F.lit(size - 1) - part(c("_omh_n") - 1)
    starts = F.concat(F.flatten(F.transform(c("_omh_firsts"), upto)), F.array_repeat(F.lit(0), left))

    def tuple_hash(start, b):
        taken = [F.get(c("_omh_order"), (start + j) % c("_omh_n")) for j in range(length)]
        turned = [F.shiftleft(x, 64 - PLACE_BITS).bitwiseOR(F.shiftrightunsigned(x, PLACE_BITS)) for x in taken]
        in_text_order = F.sort_array(F.array(*turned))
        hashes = [F.get(in_text_order, j).bitwiseAND((1 << (64 - PLACE_BITS)) - 1) for j in range(length)]
        return F.xxhash64(b, *hashes).bitwiseAND(0xFFFFFFFF)

    signature = F.when(c("_omh_n") > 0, F.transform(starts, tuple_hash)).otherwise(F.array_repeat(F.lit(0).cast("bigint"), size))
    return df.select(*kept, signature.alias(out))


def likeness(a: Column, b: Column) -> Column:
    """The share of tuples two signatures have in common, 0 to 1."""
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)
    return F.size(same) / F.size(a)


def as_text(signature: Column) -> Column:
    """A signature as one hexadecimal string."""
    return F.lower(F.array_join(F.transform(signature, lambda h: F.lpad(F.hex(h), 8, "0")), ""))


def edited_by_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and its likeness to the next.

    The edited text ends with the start of the next text, in place of its own
    second half. Rows of the same key follow each other by their text; the next
    of the last is the first. Texts are shuffled once.
    """
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows, order = in_ranges(rows, key, F.xxhash64("_text"))
    rows = rows.withColumn("_next", F.lead("_text").over(order)).withColumn("n_chars", F.length("_text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("_text"), F.lit(1), F.col("n_chars") - half),
        F.substring(F.coalesce(F.col("_next"), F.lit("")), F.lit(1), half),
    )
    rows = rows.withColumn("_edited", edited).drop("_next")
    rows = with_signature(with_signature(rows, "_text", "_own"), "_edited", "_other").drop("_text")
    rows = rows.withColumn("_following", F.lead("_own").over(order)).filter(~F.col("_extra"))
    return rows.select(
        key,
        F.col("n_chars").cast("bigint").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        as_text(F.col("_own")).alias("fingerprint"),
        as_text(F.col("_other")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_other")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_following")).alias("near_next"),
    )
