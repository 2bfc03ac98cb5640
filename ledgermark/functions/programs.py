"""Calculation programs: tokens, infix text, evaluation (PRJ-4..6, EXE-1, EXE-2)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermark.functions import assignments
from ledgermark.functions.answers import ANSWER, flag_answer, number_answer
from ledgermark.functions.common import ColumnOrName, as_col, bind, last_of

# Program operations and the sign each one is written with.
OPERATION_SIGNS = {
    "add": "+",
    "subtract": "-",
    "multiply": "*",
    "divide": "/",
    "exp": "^",
    "greater": ">",
    "table_sum": "sum",
    "table_average": "average",
    "table_max": "max",
    "table_min": "min",
}


def program_tokens(program: ColumnOrName) -> Column:
    """PRJ-4: ``op(``, first argument, second argument, ``)`` for each step."""
    # a mark no token can hold stands for the separator, so one pass finds all tokens
    marked = F.replace(as_col(program), F.lit(", "), F.lit("\x01"))
    return F.regexp_extract_all(marked, F.lit(r"([^()\x01]*\(|\)|[^()\x01]+)"), F.lit(0))


def program_arg(arg: ColumnOrName) -> Column:
    """PRJ-5: ``#n`` -> ``xn``; constants lose their prefix, a leading m is a minus."""
    def spelled(named: Column) -> Column:
        bare = F.replace(F.replace(named, F.lit("const_"), F.lit("")), F.lit("CONST_"), F.lit(""))
        signed = lambda b: F.when(F.lower(F.substr(b, F.lit(1), F.lit(1))) == "m", F.concat(F.lit("-"), F.substr(b, F.lit(2)))).otherwise(b)
        return F.when(named.contains("const") | named.contains("CONST"), bind(bare, signed)).otherwise(named)

    return bind(F.replace(as_col(arg), F.lit("#"), F.lit("x")), spelled)


def program_steps(program: ColumnOrName) -> Column:
    """Steps as ``array<struct<op, a, b>>``; tokens left over after whole steps are ignored."""

    def build(tokens: Column) -> Column:
        count = F.floor(F.size(tokens) / 4).cast("int")
        return F.when(count < 1, F.array().cast("array<struct<op:string,a:string,b:string>>")).otherwise(
            F.transform(
                F.sequence(F.lit(0), count - 1),
                lambda i: F.struct(
                    F.replace(F.get(tokens, i * 4), F.lit("("), F.lit("")).alias("op"),
                    F.get(tokens, i * 4 + 1).alias("a"),
                    F.get(tokens, i * 4 + 2).alias("b"),
                ),
            )
        )

    return bind(program_tokens(program), build)


def _sign_map() -> Column:
    return F.create_map(*[F.lit(x) for pair in OPERATION_SIGNS.items() for x in pair])


def program_to_infix(program: ColumnOrName) -> Column:
    """PRJ-6: ``x0 = a - b; ans = x0 / c``; null if an operation is unknown."""

    def render(steps: Column) -> Column:
        def line(step: Column, i: Column) -> Column:
            target = F.when(i == F.size(steps) - 1, F.lit("ans")).otherwise(F.concat(F.lit("x"), i.cast("string")))
            sign = F.try_element_at(_sign_map(), step["op"])
            first = program_arg(step["a"])
            body = F.when(step["op"].contains("table"), F.concat(sign, F.lit("("), first, F.lit(")"))).otherwise(
                F.concat(first, F.lit(" "), sign, F.lit(" "), program_arg(step["b"]))
            )
            return F.concat(target, F.lit(" = "), body)  # null for an unknown operation

        known = lambda lines: F.when(~F.exists(lines, lambda x: x.isNull()), F.array_join(lines, "; "))
        return bind(F.transform(steps, line), known)

    return bind(program_steps(program), render)


def _row_values(table: Column, label: Column) -> Column:
    """Numbers of the table row named ``label``; null if there is no such row or a cell is no number."""
    row = F.get(F.filter(table, lambda r: F.trim(F.get(r, F.lit(0))) == F.trim(label)), F.lit(0))
    cells = F.transform(
        F.slice(row, 2, F.greatest(F.size(row) - 1, F.lit(0))),
        lambda c: F.translate(F.substring_index(c, "(", 1), "$, ", "").try_cast("double"),
    )
    return F.when((F.size(cells) > 0) & ~F.exists(cells, lambda c: c.isNull()), cells)


def evaluate_program(program: ColumnOrName, table: ColumnOrName | None = None) -> Column:
    """EXE-1: run the steps left to right; a tagged answer, null on any failure.

    ``#n`` is the result of step n and ``greater`` gives a flag. Table
    operations need ``table``, rows of cells with the row name first.
    """

    def operand(arg: Column, done: Column) -> Column:
        constant = F.regexp_replace(F.substr(arg, F.lit(7)), "^[mM]", "-")
        return (
            F.when(arg.startswith("#"), F.get(done, F.substr(arg, F.lit(2)).try_cast("int")))
            .when(arg.startswith("const_") | arg.startswith("CONST_"), constant.try_cast("double"))
            .otherwise(arg.try_cast("double"))
        )

    def apply(done: Column, step: Column) -> Column:
        op = step["op"]
        x, y = operand(step["a"], done), operand(step["b"], done)
        value = (
            F.when(op == "add", x + y)
            .when(op == "subtract", x - y)
            .when(op == "multiply", x * y)
            .when(op == "divide", F.try_divide(x, y))
            .when(op == "exp", F.pow(x, y))
            .when(op == "greater", (x > y).cast("int").cast("double"))
        )
        if table is not None:
            cells = _row_values(as_col(table), step["a"])
            total = F.aggregate(cells, F.lit(0.0), lambda s, v: s + v)
            value = (
                value.when(op == "table_sum", total)
                .when(op == "table_average", F.try_divide(total, F.size(cells).cast("double")))
                .when(op == "table_max", F.array_max(cells))
                .when(op == "table_min", F.array_min(cells))
            )
        return F.array_append(done, value)

    def run(steps: Column) -> Column:
        results = F.aggregate(steps, F.array().cast("array<double>"), apply)
        return bind(
            results,
            lambda r: F.when(
                (F.size(r) > 0) & ~F.exists(r, lambda v: v.isNull() | F.isnan(v)),
                F.when(last_of(steps)["op"] == "greater", flag_answer(last_of(r) > 0)).otherwise(number_answer(last_of(r))),
            ),
        )

    return bind(program_steps(program), run)


def run_assignments(code: ColumnOrName, keys: tuple[str, ...] = ("ans",), budget: int = assignments.BUDGET) -> Column:
    """EXE-2: struct of ``ok``, ``reason`` (why there is no result) and one tagged answer per key.

    ``budget`` bounds the work of one program; one beyond it has no result and
    says so in ``reason``.

    The one step that leaves the JVM: Arrow batches holding only the code
    column. Each distinct program of a batch is run once.
    """
    ddl = "struct<ok:boolean,reason:string," + ",".join(f"`{k}`:{ANSWER.simpleString()}" for k in keys) + ">"

    @F.arrow_udf(ddl)
    def evaluate(codes: pa.Array) -> pa.Array:
        return assignments.evaluate_batch(codes, keys, budget)

    return evaluate(as_col(code))
