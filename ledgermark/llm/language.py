"""Operator 4: language identification by fusing evidence.

A text's likelihood comes from byte trigrams of labelled texts. What a page
declares, the suffix of its address and its host are further evidence, and how
far each can be trusted is measured on all rows: the languages read off the
texts alone are counted by declaration, by suffix, by host and by domain. A
host's prior is its own counts smoothed towards its domain's, which are
smoothed towards all rows'; a row's own text is left out of its counts. The
posterior is the product of all, by language, normalised.

A row is rejected if its text has fewer than ``MIN_LETTERS`` letters or no
language reaches ``MIN_POSTERIOR``. Trigrams are not independent, so a text counts
as ``MOST_EVIDENCE`` of them at most, whole texts being read all the same.

The model is fitted on about ``SAMPLE`` rows of each label, drawn by a digest of id
and text; a label with no more rows gives all, so every label is a language at
any size of the input. It is a table of 65,536 hashed trigrams by language (256 KB
each); what no text of a language has is as unlikely in a rare one as in the
commonest, so that odd texts don't fall to the rare. Counts
cover all rows and are added up before they are shuffled, and a common host is
one row of the table joined back. Null or unknown declarations, suffixes and
hosts are values of their own. Null and empty texts are rejected.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermark.llm.shared import forget_cached, portions, saved, schema_with, text_bytes, tidied, with_columns

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 1_500
DIGESTS = 1 << 40
CELLS = 1 << 16
MOST_EVIDENCE = 200
STRENGTH = 10.0
MIN_LETTERS = 3
MIN_POSTERIOR = 0.6


def trigram_cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts, and each text's number of them. A-Z count as a-z, digits as one."""
    fold = np.arange(256, dtype=np.uint32)
    fold[65:91] += 32
    fold[48:58] = 48
    folded = fold[data]
    cells = (folded[:-2] * np.uint32(0x9E3779B1) + folded[1:-1] * np.uint32(0x85EBCA77) + folded[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)
    counts = np.maximum(np.diff(offsets) - 2, 0)
    starts, kept = offsets[:-1][counts > 0], counts[counts > 0]
    marks = np.zeros(len(data) + 1, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + kept, -1)
    firsts = np.cumsum(marks[:-1])[: len(cells)] > 0
    return cells[firsts] if len(data) > 2 else np.zeros(0, np.uint32), counts


def _letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """ASCII letters and bytes of other scripts in each text."""
    flags = np.zeros(256, np.int64)
    flags[65:91] = flags[97:123] = 1
    flags[0xC3:0xF5] = 1
    sums = np.concatenate(([0], np.cumsum(flags[data])))
    return np.diff(sums[offsets])


def training_rows(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """About ``sample`` rows of each label; all rows of a label with no more than that."""
    known = labelled.filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    common = known.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > sample).collect()  # a row a language
    if not common:
        return known
    limits = F.create_map(*[F.lit(x) for r in common for x in (r["label"], max(1, sample * DIGESTS // r["n"]))])
    return known.filter(F.pmod(F.xxhash64(F.lit("language"), key, text), F.lit(DIGESTS)) < F.coalesce(limits[F.col(label)], F.lit(DIGESTS)))


def train(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """The languages and the log probability of each trigram cell by language."""
    drawn = training_rows(labelled, text, label, key, sample)

    def run(batches):
        forget_cached()
        for batch in batches:
            for part in portions(batch, "text"):
                labels = np.array(part.column(0).to_pylist(), object)
                cells, counts = trigram_cells(*text_bytes(part.column(1)))
                owners = np.repeat(labels, counts)
                for name in set(labels.tolist()):
                    found, times = np.unique(cells[owners == name], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(times.astype(np.int64))], names=["label", "cell", "n"])

    rows = drawn.select(F.col(label).alias("label"), F.col(text).alias("text")).mapInArrow(tidied(run), "label string, cell bigint, n bigint")
    counted = rows.groupBy("label", "cell").agg(F.sum("n").alias("n")).toPandas()  # at most a row a cell and language
    names = sorted(counted["label"].unique().tolist())
    table = np.full((CELLS, max(len(names), 1)), 0.1)
    totals = counted.groupby("label")["n"].sum()
    for i, name in enumerate(names):
        own = counted[counted["label"] == name]
        table[:, i] *= totals[name] / totals.max()
        table[own["cell"].to_numpy(), i] += own["n"].to_numpy()
    return names, np.log(table / table.sum(axis=0)).astype(np.float32)


def text_scores(rows: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """``rows`` without ``text``, with ``row`` (a digest of id and text), ``letters`` and ``scores`` (log likelihood by language)."""
    shipped = rows.sparkSession.sparkContext.broadcast(table)  # 65,536 cells by language

    def run(batches):
        forget_cached()
        for batch in batches:
            for part in portions(batch, "text", 1 << 19):
                data, offsets = text_bytes(part.column(part.schema.get_field_index("text")))
                cells, counts = trigram_cells(data, offsets)
                sums = np.zeros((len(cells) + 1, table_width))
                np.cumsum(shipped.value[cells], axis=0, dtype=np.float64, out=sums[1:])
                ends = np.concatenate(([0], np.cumsum(counts)))
                scores = (sums[ends[1:]] - sums[ends[:-1]]) * (np.minimum(counts, MOST_EVIDENCE) / np.maximum(counts, 1))[:, None]
                listed = pa.array(list(scores), pa.list_(pa.float64()))
                yield with_columns(part, ("text",), letters=pa.array(_letters(data, offsets)), scores=listed)

    table_width = table.shape[1]
    read = rows.withColumn("row", F.xxhash64("id", "text"))
    return read.mapInArrow(tidied(run), schema_with(read, ("text",), letters="bigint", scores="array<double>"))


def with_sources(scored: DataFrame) -> DataFrame:
    """``id, row, letters, scores, declared, suffix, host, domain`` from ``declared, address, host`` as they were found."""
    host = F.lower(F.coalesce("host", F.lit("")))
    labels = F.split(host, r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    suffix = F.regexp_extract(F.lower(F.coalesce("address", F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*://)?[^/?#:]*\.([a-z]+)(?:[:/?#]|$)", 1)
    declared = F.regexp_extract(F.lower(F.coalesce("declared", F.lit(""))), "^[a-z]+", 0)
    return scored.select("id", "row", "letters", "scores", declared.alias("declared"), suffix.alias("suffix"), host.alias("host"), domain.alias("domain"))


def _best(scores: Column) -> Column:
    """Place of the highest score, the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def fused(evidence: DataFrame, names: list[str]) -> DataFrame:
    """Add ``text_language``, ``language``, ``posterior`` and ``kept``."""
    n = len(names)
    if not n:
        nothing = F.lit(None).cast("string")
        return evidence.select("id", "row", "declared", "suffix", "host", nothing.alias("text_language"), nothing.alias("language"), F.lit(0.0).alias("posterior"), F.lit(False).alias("kept"))
    readable = F.col("letters") >= MIN_LETTERS
    rows = evidence.withColumn("_own", F.when(readable, _best(F.col("scores"))))
    one = lambda i: F.when(F.col("_own") == i, 1).otherwise(0)
    sums = F.array(*[F.sum(one(i)) for i in range(n)])

    def counted(by, name):
        return rows.groupBy(by).agg(sums.alias(name))

    whole = rows.agg(sums.alias("c")).first()["c"] or [0] * n
    total = sum(c or 0 for c in whole)
    start = F.array(*[F.lit(((c or 0) + 1.0) / (total + n)) for c in whole])
    minus = F.array(*[one(i).cast("double") for i in range(n)])  # the row itself
    for by in ("declared", "suffix", "host", "domain"):
        rows = rows.join(counted(by, f"_{by}"), by)

    def smoothed(counts, prior):
        own = F.zip_with(counts, minus, lambda c, m: c - m)
        size = F.aggregate(own, F.lit(0.0), lambda a, c: a + c)
        return F.zip_with(own, prior, lambda c, p: (c + STRENGTH * p) / (size + STRENGTH))

    rows = rows.withColumn("_prior", smoothed(F.col("_host"), smoothed(F.col("_domain"), start)))
    evidences = [F.transform("_prior", lambda p: F.log(p)), *[_log_share(F.col(f"_{by}"), minus, whole, n) for by in ("declared", "suffix")]]
    joint = F.col("scores")
    for more in evidences:
        joint = F.zip_with(joint, more, lambda a, b: a + b)
    rows = rows.withColumn("_joint", joint)
    weights = F.aggregate(F.col("_joint"), F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("_joint")))
    rows = rows.withColumn("posterior", F.when(readable, 1.0 / weights).otherwise(0.0))
    listed = F.array(*map(F.lit, names))
    return rows.select(
        "id", "row", "declared", "suffix", "host",
        F.get(listed, F.col("_own")).alias("text_language"),
        F.when(readable, F.get(listed, _best(F.col("_joint")))).alias("language"),
        "posterior", (readable & (F.col("posterior") >= MIN_POSTERIOR)).alias("kept"),
    )


def _log_share(counts: Column, minus: Column, whole: list[int], n: int) -> Column:
    """Log share of a value among the rows of each language, the row itself left out."""
    sizes = F.array(*[F.lit(float(c or 0) + n) for c in whole])
    own = F.zip_with(counts, minus, lambda c, m: c - m + 1.0)
    return F.zip_with(own, sizes, lambda c, s: F.log(c / s))


def identified(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """Decisions for ``rows`` (``id, text, declared, address, host``), the model fitted on ``labelled`` (``doc_id, text, lang``)."""
    names, table = train(labelled)
    return fused(saved(with_sources(text_scores(rows, names, table)), "language-evidence"), names)


def accepted(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows; ``lang`` is what a document declares and ``source`` its host."""
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.lit(None).cast("string").alias("address"), F.col("source").alias("host"))
    free = "_" * (1 + max(map(len, docs.columns)))  # longer than any name the documents have
    own_id, own_row = f"{free}id", f"{free}row"
    rejected = identified(rows, docs).filter(~F.col("kept")).select(F.col("id").alias(own_id), F.col("row").alias(own_row)).distinct()
    # Saved, the rejects are of known size: few are broadcast, and the texts stay where they are.
    rejected = saved(rejected, "language-rejected")
    return docs.join(rejected, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64("doc_id", "text") == F.col(own_row)), "left_anti")
