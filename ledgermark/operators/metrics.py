"""Accuracy and breakdowns over scored rows (AGG-3..9, WIN-2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Reported scales and operators.
SCALES = ("", "thousand", "million", "billion", "percent")
OPERATORS = (
    "Span-in-text", "Cell-in-table", "Spans", "Sum", "Count", "Average",
    "Multiplication", "Division", "Difference", "Change ratio",
)

# Answer types and where an answer comes from.
ANSWER_SOURCES = ("table", "text", "table-text")


def _right(flag: str | Column) -> Column:
    return F.coalesce(F.col(flag) if isinstance(flag, str) else flag, F.lit(False)).cast("bigint")


def accuracy(df: DataFrame, flag: str = "is_correct", by: list[str] | None = None) -> DataFrame:
    """AGG-3: correct, total and their ratio; a null flag is wrong."""
    right = F.sum(_right(flag))
    return df.groupBy(*(by or [])).agg(
        F.coalesce(right, F.lit(0)).alias("correct"),
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.avg(_right(flag)), F.lit(0.0)).alias("accuracy"),
    )


def overall_metrics(scored: DataFrame) -> DataFrame:
    """AGG-4: mean EM, F1, scale EM and operator EM over all gold rows, 0 when there are none."""
    has_ops = {"pred_op", "gold_op"} <= set(scored.columns)
    op_right = (F.col("pred_op") == F.col("gold_op")) if has_ops else F.lit(False)
    return scored.agg(
        F.coalesce(F.avg("em"), F.lit(0.0)).alias("em"),
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1"),
        F.coalesce(F.avg(_right("scale_em")), F.lit(0.0)).alias("scale_em"),
        F.coalesce(F.avg(_right(op_right)), F.lit(0.0)).alias("op_em"),
        F.count(F.lit(1)).alias("total"),
    )


def metric_pivot(
    scored: DataFrame,
    metric: str = "em",
    row: str = "answer_type",
    column: str = "answer_from",
    values: tuple[str, ...] = ANSWER_SOURCES,
) -> DataFrame:
    """AGG-5: mean of a metric by answer type and source, absent cells 0."""
    return scored.groupBy(row).pivot(column, list(values)).agg(F.avg(metric)).na.fill(0.0)


def count_pivot(
    scored: DataFrame,
    metric: str = "em",
    row: str = "answer_type",
    column: str = "answer_from",
    values: tuple[str, ...] = ANSWER_SOURCES,
) -> DataFrame:
    """AGG-6: number of scored rows by answer type and source, absent cells 0."""
    return scored.groupBy(row).pivot(column, list(values)).agg(F.count(metric)).na.fill(0)


def _breakdown(scored: DataFrame, name: str, domain: tuple[str, ...], group: Column, counted: Column, right: Column) -> DataFrame:
    """Correct and total per domain value; the domain is fixed, so it is the tiny left side of the join."""
    tallies = (
        scored.filter(counted)
        .groupBy(group.alias(name))
        .agg(F.sum(_right(right)).alias("correct"), F.count(F.lit(1)).alias("total"))
    )
    values = scored.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, domain))).alias(name))
    ratio = F.coalesce(F.try_divide(F.col("correct").cast("double"), F.col("total").cast("double")), F.lit(0.0))
    return values.join(tallies, name, "left").select(
        name,
        F.coalesce("correct", F.lit(0)).alias("correct"),
        F.coalesce("total", F.lit(0)).alias("total"),
        ratio.alias("accuracy"),
    )


def scale_breakdown(scored: DataFrame) -> DataFrame:
    """AGG-7: scale hits per gold scale over the fixed scales."""
    return _breakdown(
        scored, "scale", SCALES, F.col("scale"), F.lit(True), F.col("pred_scale") == F.col("scale")
    )


def op_breakdown(scored: DataFrame, with_ignored: bool = False) -> DataFrame:
    """AGG-8: operator hits per gold operator; rows without a predicted operator do not count."""
    domain = OPERATORS + (("ignore",) if with_ignored else ())
    return _breakdown(
        scored, "gold_op", domain, F.col("gold_op"), F.col("pred_op").isNotNull(), F.col("pred_op") == F.col("gold_op")
    )


#: What one pass over the scored rows leaves: how often, sums, and how many had a value.
_TALLIES = ("n", "em", "em_n", "f1", "f1_n", "scale_right", "op_right", "op_seen")
_DIMENSIONS = ("answer_type", "answer_from", "scale", "gold_op")
#: Grouping ids: a bit is set for each dimension, in order, that is summed over.
_ALL, _BY_TYPE, _BY_SCALE, _BY_OP = 0b1111, 0b0011, 0b1101, 0b1110


def evaluation_cells(scored: DataFrame) -> DataFrame:
    """AGG-4 to AGG-8 in one pass: tallies by GROUPING SETS of everything, type and source, scale, and operator.

    The rows are combined once by all four dimensions, and the grouping sets run
    over those few rows. Scales and operators that are always reported, and the
    total of no rows, come in as rows of zeros; nothing is joined.
    """
    has_ops = {"pred_op", "gold_op"} <= set(scored.columns)
    gold_op = F.col("gold_op") if has_ops else F.lit(None).cast("string")
    seen = F.col("pred_op").isNotNull() if has_ops else F.lit(False)
    right = F.col("pred_op") == F.col("gold_op") if has_ops else F.lit(False)
    fine = scored.groupBy("answer_type", "answer_from", "scale", gold_op.alias("gold_op")).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("em").cast("double"), F.lit(0.0)).alias("em"),
        F.count("em").alias("em_n"),
        F.coalesce(F.sum("f1").cast("double"), F.lit(0.0)).alias("f1"),
        F.count("f1").alias("f1_n"),
        F.sum(_right("scale_em")).alias("scale_right"),
        F.sum(_right(right)).alias("op_right"),
        F.sum(_right(seen)).alias("op_seen"),
    )
    text, none = fine.schema["scale"].dataType, F.lit(None)
    listed = [(v, None) for v in SCALES] + [(None, v) for v in OPERATORS]
    zeros = scored.sparkSession.createDataFrame(listed, "scale string, gold_op string").select(
        none.cast("string").alias("answer_type"),
        none.cast("string").alias("answer_from"),
        F.col("scale").cast(text).alias("scale"),
        "gold_op",
        *[F.lit(0).cast(fine.schema[t].dataType).alias(t) for t in _TALLIES],
    )
    sets = [[], ["answer_type", "answer_from"], ["scale"], ["gold_op"]]
    sums = [F.sum(t).alias(t) for t in _TALLIES]
    return fine.unionByName(zeros).groupingSets(sets, *_DIMENSIONS).agg(F.grouping_id().alias("cells"), *sums)


def _mean(total: str, count: str) -> Column:
    return F.coalesce(F.try_divide(F.col(total).cast("double"), F.col(count).cast("double")), F.lit(0.0))


def overall_from(cells: DataFrame) -> DataFrame:
    """AGG-4 from ``evaluation_cells``."""
    return cells.filter(F.col("cells") == _ALL).select(
        _mean("em", "em_n").alias("em"),
        _mean("f1", "f1_n").alias("f1"),
        _mean("scale_right", "n").alias("scale_em"),
        _mean("op_right", "n").alias("op_em"),
        F.col("n").alias("total"),
    )


def pivot_from(cells: DataFrame, metric: str | None, values: tuple[str, ...] = ANSWER_SOURCES) -> DataFrame:
    """AGG-5 of a metric, or AGG-6 without one, from ``evaluation_cells``."""
    own = _mean(metric, f"{metric}_n") if metric else F.col("em_n")
    typed = cells.filter((F.col("cells") == _BY_TYPE) & (F.col("n") > 0))
    found = [F.coalesce(F.max(F.when(F.col("answer_from") == v, own)), F.lit(0 if not metric else 0.0)).alias(v) for v in values]
    return typed.groupBy("answer_type").agg(*found)


def breakdown_from(cells: DataFrame, name: str) -> DataFrame:
    """AGG-7 (``scale``) or AGG-8 (``gold_op``) from ``evaluation_cells``."""
    group, domain, right, total = {"scale": (_BY_SCALE, SCALES, "scale_right", "n"), "gold_op": (_BY_OP, OPERATORS, "op_right", "op_seen")}[name]
    rows = cells.filter((F.col("cells") == group) & F.col(name).isin(*domain))
    return rows.select(name, F.col(right).alias("correct"), F.col(total).alias("total"), _mean(right, total).alias("accuracy"))


def listed_reports(cells: DataFrame) -> DataFrame:
    """``report, row, column, value``: every report of ``evaluation_cells`` in one result, in one pass over it."""
    entry = lambda report, row, column, value: F.struct(
        F.lit(report).alias("report"), row.alias("row"), column.alias("column"), value.cast("double").alias("value")
    )
    name, c, every = F.lit, F.col, F.lit("all")
    of = {
        _ALL: [entry("overall", every, name(k), v) for k, v in (
            ("em", _mean("em", "em_n")), ("f1", _mean("f1", "f1_n")), ("scale_em", _mean("scale_right", "n")),
            ("op_em", _mean("op_right", "n")), ("total", c("n")),
        )],
        _BY_TYPE: [entry(f"{k}_by_type", c("answer_type"), c("answer_from"), v) for k, v in (
            ("em", _mean("em", "em_n")), ("f1", _mean("f1", "f1_n")), ("count", c("em_n")),
        )],
        _BY_SCALE: [entry("by_scale", c("scale"), name(k), v) for k, v in (
            ("correct", c("scale_right")), ("total", c("n")), ("accuracy", _mean("scale_right", "n")),
        )],
        _BY_OP: [entry("by_op", c("gold_op"), name(k), v) for k, v in (
            ("correct", c("op_right")), ("total", c("op_seen")), ("accuracy", _mean("op_right", "op_seen")),
        )],
    }
    entries = F.lit(None)
    for cells_id, made in of.items():
        entries = F.when(F.col("cells") == cells_id, F.array(*made)).otherwise(entries)
    reported = (c("cells") == _ALL) | ((c("cells") == _BY_TYPE) & (c("n") > 0)) | ((c("cells") == _BY_SCALE) & c("scale").isin(*SCALES)) | ((c("cells") == _BY_OP) & c("gold_op").isin(*OPERATORS))
    return cells.filter(reported).select(F.explode(entries).alias("e")).select("e.*")


def weighted_mean(df: DataFrame, value: str, weight: str, pos: str, by: list[str] | None = None) -> DataFrame:
    """AGG-9: weighted sum, weight, their ratio, and the value at the last position."""
    total = F.sum(F.col(value) * F.col(weight))
    return df.groupBy(*(by or [])).agg(
        total.alias("sum"),
        F.sum(weight).alias("count"),
        F.try_divide(total, F.sum(weight)).alias("avg"),
        F.max_by(value, pos).alias("last"),
    )


def running_total(
    df: DataFrame, pos: str, values: dict[str, Column], by: list[str] | None = None, block: int = 100_000, levels: int = 3
) -> DataFrame:
    """Cumulative sums in the order of ``pos``, without one task seeing the whole order.

    ``pos`` is an integer, unique within ``by``. Positions are cut into blocks
    of ``block``, those into blocks of blocks, and so on; every level is summed
    and then accumulated inside the level above. A window partition holds at
    most ``block`` rows, and the top one a row per ``block**levels`` positions:
    with the defaults under 20,000 for the whole range of a long, however
    sparse the positions are.
    """
    keys, names = list(by or []), list(values)
    carried = [f"_s_{n}" for n in names]

    def totals(window: Window) -> list[Column]:
        return [F.coalesce(F.sum(c).over(window), F.lit(0)).alias(c) for c in carried]

    rows = df.select("*", *[v.alias(f"_s_{n}") for n, v in values.items()], F.floor(F.col(pos) / block).cast("bigint").alias("_b1"))
    sums, level = [rows], rows
    for i in range(1, levels + 1):
        up = [F.floor(F.col(f"_b{i}") / block).cast("bigint").alias(f"_b{i + 1}")] if i < levels else []
        level = level.groupBy(*keys, f"_b{i}").agg(*[F.sum(c).alias(c) for c in carried]).select("*", *up)
        sums.append(level)

    # What precedes each block, from the top level down. A block's own offset enters its window
    # as one more row ahead of the others: no joins, so the block sums are shuffled once and reused.
    over_all = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    preceding = (Window.unboundedPreceding, -1)
    offsets = sums[levels].select(*keys, f"_b{levels}", *totals(over_all.orderBy(f"_b{levels}").rowsBetween(*preceding)))
    for i in range(levels - 1, 0, -1):
        both = sums[i].unionByName(offsets, allowMissingColumns=True)
        inside = Window.partitionBy(*keys, f"_b{i + 1}").orderBy(F.col(f"_b{i}").asc_nulls_first()).rowsBetween(*preceding)
        offsets = both.select(*keys, f"_b{i}", *totals(inside)).filter(F.col(f"_b{i}").isNotNull())
    both = rows.withColumn("_row", F.lit(True)).unionByName(offsets, allowMissingColumns=True)
    upto = Window.partitionBy(*keys, "_b1").orderBy(F.col("_row").asc_nulls_first(), pos).rowsBetween(Window.unboundedPreceding, 0)
    return both.select("*", *[F.sum(f"_s_{n}").over(upto).alias(n) for n in names]).filter("_row").select(*df.columns, *names)


def running_accuracy(df: DataFrame, pos: str, flag: str = "is_correct", by: list[str] | None = None, block: int = 100_000) -> DataFrame:
    """WIN-2: accuracy of the rows up to and including each one, in processing order."""
    sums = running_total(df, pos, {"correct_so_far": _right(flag), "seen_so_far": F.lit(1).cast("bigint")}, by, block)
    return sums.withColumn("accuracy_so_far", F.col("correct_so_far") / F.col("seen_so_far"))


def percentages(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """SCO-8 report form: percentages with two decimals."""
    shown = [F.translate(F.format_number(F.col(c) * 100, 2), ",", "").alias(c) for c in columns]
    return metrics.select(*shown)
