"""Tables in text and out of it (TAB-1, TAB-3, TAB-6, FLT-4, PRJ-3 from rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermark.functions.common import ColumnOrName, as_col, bind
from ledgermark.functions.numbers import strip_digit_commas
from ledgermark.functions.tables import table_line
from ledgermark.operators.conversations import gathered

#: What a pattern's blank class stands for.
_BLANKS = " \t\n\x0b\f\r"


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def _bare(line: Column) -> Column:
    """A line without its outer bars."""
    return F.btrim(line, F.lit("|"))


def _cells(bare: Column) -> Column:
    return F.transform(F.split(bare, r"\|"), _trimmed)


def _last_lines(lines: Column) -> Column:
    """``line, start, stop``: for each row name the cells, by place, that no later line of that name has.

    A line that is longer than those after it is left with the places they
    lack. For each length that occurs, the last line of a name with at least
    that many cells has the places from the next shorter length up to it.
    """
    ranked = F.array_sort(F.transform(lines, lambda x, k: F.struct(x["name"].alias("name"), k.alias("k"), x["n"].alias("n"))))
    lengths = lambda order: F.array_sort(F.array_distinct(F.transform(order, lambda x: x["n"])))

    def lasts(long_enough: Column, start: Column, stop: Column) -> Column:
        last = F.filter(long_enough, lambda x, k: ~x["name"].eqNullSafe(F.get(long_enough, k + 1)["name"]))
        return F.transform(last, lambda x: F.struct(F.get(lines, x["k"]).alias("line"), start.alias("start"), stop.alias("stop")))

    return bind(
        ranked,
        lambda order: bind(
            lengths(order),
            lambda found: F.flatten(
                F.transform(
                    found,
                    lambda n, i: bind(F.filter(order, lambda x: x["n"] >= n), lambda held: lasts(held, F.coalesce(F.get(found, i - 1), F.lit(0)), n)),
                )
            ),
        ),
    )


def parse_markdown_table(df: DataFrame, table_id: str = "table_id", text: str = "text", keep_last: bool = True) -> DataFrame:
    """TAB-1: ``table_id, row_key, column, value`` with the row and column positions.

    Blanks in headers become underscores, the second line is skipped, the first
    cell names the row and short rows are cut. A name used twice in a text, for a
    row or in the header, keeps its last cell unless ``keep_last`` is off; texts
    that share an id stay apart. Which lines stand is settled from the row names
    and lengths before any cell is parsed, in the row that holds the text: one
    scan, no shuffle, and only the lines that are left are exploded.
    """
    lines = F.split(_trimmed(F.col(text)), "\n")
    split = df.select(table_id, lines.alias("_lines"))
    names = F.transform(_cells(_bare(F.get("_lines", F.lit(0)))), lambda h: F.replace(h, F.lit(" "), F.lit("_")))
    body = F.transform(F.slice("_lines", F.lit(3), F.size("_lines")), lambda line, i: F.struct(i.alias("at"), line.alias("line")))
    filled = F.filter(body, lambda x: x["line"] != "")
    parts = split.select(table_id, names.alias("_h"), F.transform(filled, lambda x: F.struct(x["at"], _bare(x["line"]).alias("bare"))).alias("_b"))
    bars = lambda bare: F.length(bare) - F.length(F.replace(bare, F.lit("|"), F.lit("")))
    named = F.transform(
        "_b",
        lambda x: F.struct(
            x["at"], x["bare"], _trimmed(F.substring_index(x["bare"], "|", 1)).alias("name"), F.least(F.size("_h"), bars(x["bare"]) + 1).alias("n")
        ),
    )
    parts = parts.select(table_id, "_h", named.alias("_b"))
    whole = F.transform("_b", lambda x: F.struct(x.alias("line"), F.lit(0).alias("start"), x["n"].alias("stop")))
    rows = parts.select(table_id, "_h", F.explode(_last_lines(F.col("_b")) if keep_last else whole).alias("_r"))
    rows = rows.select(table_id, "_h", "_r.line.*", "_r.start", "_r.stop").withColumn("_c", F.slice(_cells(F.col("bare")), F.lit(1), F.col("n")))
    cells = F.transform("_c", lambda c, i: F.struct(i.alias("at"), F.get(F.col("_h"), i).alias("name"), c.alias("value")))
    if keep_last:
        # places are those of a header name's first use; within a line the last cell of a name stands
        own = lambda p: (F.array_position("_h", p["name"]) > F.col("start")) & (F.array_position("_h", p["name"]) <= F.col("stop"))
        settled = bind(cells, lambda all_: F.filter(all_, lambda p: own(p) & ~F.exists(all_, lambda q: (q["name"] == p["name"]) & (q["at"] > p["at"]))))
        plain = (F.size(F.array_distinct("_h")) == F.size("_h")) & (F.col("start") == 0) & (F.col("stop") == F.col("n"))
        cells = F.when(plain, cells).otherwise(settled)
    return rows.select(table_id, F.col("name").alias("row_key"), F.col("at").alias("row_pos"), F.explode(cells).alias("_p")).select(
        table_id, "row_key", F.col("_p.name").alias("column"), F.col("_p.value").alias("value"), "row_pos", F.col("_p.at").alias("col_pos")
    )


def year_cells(long: DataFrame, table_id: str = "table_id") -> DataFrame:
    """Integer cells of year rows: lower-cased columns, digit commas removed, null where not an integer; ``pos`` is the cell's place."""
    return long.select(
        table_id,
        (F.col("row_pos").cast("bigint") * F.lit(1 << 31) + F.col("col_pos")).alias("pos"),
        F.lower("row_key").try_cast("bigint").alias("year"),
        F.lower("column").alias("column"),
        strip_digit_commas(F.lower("value")).try_cast("bigint").alias("value"),
    ).filter(F.col("year").isNotNull())


def to_year_rows(long: DataFrame, columns: list[str], table_id: str = "table_id") -> DataFrame:
    """TAB-3: one row per table and year, one whole-number column per name in ``columns``.

    Of columns that differ in case only, and of years written in two ways, the
    later integer stands, whatever the layout of the rows.
    """
    cells = year_cells(long, table_id)
    named = [F.max_by("value", F.when((F.col("column") == c) & F.col("value").isNotNull(), F.col("pos"))).alias(c) for c in columns]
    return cells.groupBy(table_id, "year").agg(*named)


def complete_tables(long: DataFrame, variables: list[str], years: Column, table_id: str = "table_id") -> DataFrame:
    """FLT-4: tables that hold an integer for every year and variable asked for.

    ``years`` is an int array expression. Counting the cells that are there
    replaces building the grid, so a table costs one row per map task.
    """
    cells = year_cells(long, table_id).filter(F.col("column").isin(variables) & F.col("value").isNotNull())
    wanted = cells.filter(F.array_contains(years, F.col("year"))).groupBy(table_id, "year", "column").agg(F.count(F.lit(1)).alias("_n"))
    found = wanted.groupBy(table_id).agg(F.count(F.lit(1)).alias("_found"))
    return found.filter(F.col("_found") == F.size(F.array_distinct(years)) * len(set(variables))).select(table_id)


def has_complete_series(cells: ColumnOrName, variables: ColumnOrName, years: ColumnOrName) -> Column:
    """FLT-4 on one row: ``cells`` maps column -> year text -> cell text."""
    table = as_col(cells)
    return F.coalesce(
        F.forall(
            as_col(variables),
            lambda v: bind(
                F.try_element_at(table, v),
                lambda series: F.forall(
                    as_col(years),
                    lambda y: F.try_element_at(series, y.cast("string")).try_cast("bigint").isNotNull(),
                ),
            ),
        ),
        F.lit(False),
    )


def pair_table_text(samples: DataFrame) -> DataFrame:
    """TAB-6: a sample gives its table with unrelated text, and its text with an unrelated table."""
    pair = F.array(
        F.struct(F.lit("table").alias("part"), F.col("table").alias("table"), F.col("table_text").alias("text"), F.col("table_value").alias("payload")),
        F.struct(F.lit("text").alias("part"), F.col("text_table").alias("table"), F.col("text").alias("text"), F.col("text_value").alias("payload")),
    )
    return samples.select("sample_id", F.explode(pair).alias("_p")).select("sample_id", "_p.*")


def table_lines(rows: DataFrame, keys: list[str], pos: str, cells: ColumnOrName) -> DataFrame:
    """PRJ-3 for tables held as rows: ``keys, pos, line``; the lines in order of ``pos`` are the table."""
    return rows.select(*keys, pos, F.concat(table_line(cells), F.lit("\n")).alias("line"))


def whole_tables(lines: DataFrame, keys: list[str], pos: str, most: int) -> DataFrame:
    """``keys, line``: whole tables of up to ``most`` lines; a longer one is an error."""
    return gathered(lines, keys, [pos], "line", most)
