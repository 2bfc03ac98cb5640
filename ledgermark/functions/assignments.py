"""Straight-line assignment programs, run inside Arrow tasks (EXE-2).

Numbers, names, arithmetic, comparisons, lists and a few functions; anything
else, and any error, makes the whole program fail. Nothing is executed as code.

Samples of a model are mostly the same few programs with other numbers. The
programs of a batch that differ in their numbers alone share a shape, which is
parsed once; its arithmetic runs on whole columns, one for each place where a
number stands. Rows that leave the ordinary (whole numbers beyond 62 bits, a
division by zero, a result of another type) are run by themselves, with the same
result, and so are programs with quoted text or of a rare shape.
"""

from __future__ import annotations

import ast
import operator
import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

#: Work one program may take, in units of about a machine word handled; stands in for a limit of five seconds.
BUDGET = 50_000_000

_BINARY = {
    ast.Add: operator.add,
    ast.Sub: operator.sub,
    ast.Mult: operator.mul,
    ast.Div: operator.truediv,
    ast.FloorDiv: operator.floordiv,
    ast.Mod: operator.mod,
    ast.Pow: operator.pow,
}
_UNARY = {ast.USub: operator.neg, ast.UAdd: operator.pos, ast.Not: operator.not_}
_COMPARE = {
    ast.Gt: operator.gt,
    ast.GtE: operator.ge,
    ast.Lt: operator.lt,
    ast.LtE: operator.le,
    ast.Eq: operator.eq,
    ast.NotEq: operator.ne,
}
_CALLS = {"sum": sum, "len": len, "min": min, "max": max, "round": round, "abs": abs, "int": int, "float": float}


class Rejected(Exception):
    """The program uses something outside the allowed arithmetic, or too much of it."""


def _size(value) -> int:
    """Machine words a value takes."""
    if isinstance(value, int):
        return value.bit_length() // 64 + 1
    if isinstance(value, (str, list)):
        return len(value) + 1
    return 1


class _Program:
    """Names bound by a program, and the work left to it."""

    def __init__(self, budget: int):
        self.names: dict = {}
        self.left = budget

    def spend(self, work: int) -> None:
        self.left -= work
        if self.left < 0:
            raise Rejected("over budget")

    def binary(self, op: type, left, right):
        if isinstance(left, (int, float)) and isinstance(right, (int, float)):
            whole = isinstance(left, int) and isinstance(right, int)
            if whole and op is ast.Pow:
                self.spend((abs(right) * left.bit_length() // 64 + 1) ** 2)
            elif whole and op in (ast.Mult, ast.Div, ast.FloorDiv, ast.Mod):
                self.spend(_size(left) * _size(right))
            else:
                self.spend(_size(left) + _size(right))
            value = _BINARY[op](left, right)
            if isinstance(value, complex):
                raise Rejected("not a real number")
            return value
        if op is ast.Add and type(left) is type(right) and isinstance(left, (str, list)):
            self.spend(len(left) + len(right))
            return left + right
        raise Rejected("operands")

    def value(self, node: ast.expr):
        self.spend(1)
        match node:
            case ast.Constant(value=v) if v is None or isinstance(v, (bool, int, float, str)):
                return v
            case ast.Name(id=name):
                return self.names[name]
            case ast.BinOp(left=left, op=op, right=right) if type(op) in _BINARY:
                return self.binary(type(op), self.value(left), self.value(right))
            case ast.UnaryOp(op=op, operand=operand) if type(op) in _UNARY:
                return self.unary(type(op), self.value(operand))
            case ast.Compare(left=left, ops=[op], comparators=[right]) if type(op) in _COMPARE:
                return self.compare(type(op), self.value(left), self.value(right))
            case ast.List(elts=items) | ast.Tuple(elts=items):
                values = [self.value(item) for item in items]
                if any(isinstance(v, list) for v in values):  # shared sublists can print without bound
                    raise Rejected("nested list")
                return values
            case ast.Subscript(value=items, slice=index):
                return self.subscript(self.value(items), self.value(index))
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in _CALLS:
                given = [self.value(a) for a in args]
                self.spend(sum(map(_size, given)))
                if name == "round" and len(given) > 1 and isinstance(given[1], int):
                    self.spend((abs(given[1]) // 19 + 1) ** 2)
                return self.call(name, given)
        raise Rejected(type(node).__name__)

    def unary(self, op: type, value):
        return _UNARY[op](value)

    def compare(self, op: type, left, right):
        return _COMPARE[op](left, right)

    def subscript(self, items, index):
        return items[index]

    def call(self, name: str, given: list):
        return _CALLS[name](*given)

    def run(self, tree: ast.Module) -> None:
        for line in tree.body:
            match line:
                case ast.Assign(targets=[ast.Name(id=name)], value=value):
                    self.names[name] = self.value(value)
                case ast.AugAssign(target=ast.Name(id=name), op=op, value=value) if type(op) in _BINARY:
                    self.names[name] = self.binary(type(op), self.names[name], self.value(value))
                case ast.Expr(value=ast.Call(func=ast.Name(id="print"), args=shown)):
                    for arg in shown:  # shown nowhere, but a fault in it is a fault
                        self.value(arg)
                case ast.Expr(value=value):
                    self.value(value)
                case _:
                    raise Rejected(type(line).__name__)


_FAULTS = (ArithmeticError, LookupError, TypeError, ValueError, SyntaxError, RecursionError, MemoryError)


def _why(fault: Exception) -> str:
    return f"refused: {fault}" if isinstance(fault, Rejected) else f"failed: {type(fault).__name__}"


def _run(source: str, budget: int) -> tuple[dict | None, str | None]:
    """Names bound by a straight-line program; or None and why, if any part of it fails."""
    program = _Program(budget)
    try:
        program.run(ast.parse(source))
        return program.names, None
    except (Rejected, *_FAULTS) as fault:
        return None, _why(fault)


# A number as Python writes one, not part of a name or of another number.
_NUMBER = re.compile(r"(?<![\w.])((?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[0-9]+[eE][+-]?[0-9]+|[1-9][0-9]*|0)(?![\w.])")
_DIGITS = re.compile("[0-9]+")
_APART = re.compile("['\"\r\f\\\\]")  # quoted text and odd line ends: places of numbers are not told from the text alone
_WIDE, _EXACT = 1 << 62, 1 << 53
_FEW = 8  # rows of a shape that do not repay its columns

Value = object  # a scalar, a column (numpy array) or a list of these


class _OneByOne(Exception):
    """The shape does something that columns do not do alike for all rows."""


class _Shape(_Program):
    """A program run for all rows of a shape at once.

    ``odd`` marks rows to be run by themselves; whatever their places in the
    columns hold is not read.
    """

    def __init__(self, budget: int, places: dict[tuple[int, int], np.ndarray], rows: int):
        super().__init__(budget)
        self.places, self.rows, self.odd = places, rows, np.zeros(rows, bool)

    def column(self, value) -> np.ndarray:
        """A number as a column; flags count as whole numbers."""
        if isinstance(value, np.ndarray):
            return value.astype(np.int64) if value.dtype == bool else value
        if isinstance(value, int) and abs(value) >= _WIDE:
            raise _OneByOne
        return np.full(self.rows, int(value) if isinstance(value, int) else value)

    def each(self, fn, *columns) -> np.ndarray:
        """``fn`` of each row's values as Python has it; the column's type is that of most rows."""
        out = []
        for k, given in enumerate(zip(*(c.tolist() if isinstance(c, np.ndarray) else [c] * self.rows for c in columns), strict=True)):
            try:
                out.append(None if self.odd[k] else fn(*given))
            except (Rejected, *_FAULTS):
                out.append(None)
        kinds = [int if type(v) is int and abs(v) < _WIDE else type(v) if type(v) in (bool, float) else None for v in out]
        kind = max((bool, int, float), key=kinds.count)
        self.odd |= np.array([k is not kind for k in kinds])
        return np.array([v if k is kind else kind() for v, k in zip(out, kinds, strict=True)], {bool: bool, int: np.int64, float: np.float64}[kind])

    def binary(self, op: type, left, right):
        given = (left, right)
        if not any(isinstance(v, np.ndarray) for v in given):
            return super().binary(op, left, right)
        if not all(isinstance(v, (np.ndarray, int, float)) for v in given):
            raise Rejected("operands")
        left, right = map(self.column, given)
        whole = left.dtype == right.dtype == np.int64
        if op is ast.Pow and whole:
            words = np.abs(right.astype(np.float64)) * np.array([v.bit_length() for v in left.tolist()])
            self.odd |= words >= 64
        self.spend(1 if whole and op in (ast.Pow, ast.Mult, ast.Div, ast.FloorDiv, ast.Mod) else 2)
        if op in (ast.Pow, ast.FloorDiv, ast.Mod):
            return self.each(_BINARY[op], left, right)
        if op is ast.Div:
            for side in (left, right):
                if side.dtype == np.int64:
                    self.odd |= np.abs(side) > _EXACT if whole else False
            self.odd |= right == 0
        elif whole:
            self.odd |= np.abs(_BINARY[op](left.astype(np.float64), right.astype(np.float64))) >= _WIDE
        return _BINARY[op](left, right)

    def compare(self, op: type, left, right):
        given = (left, right)
        if not any(isinstance(v, (np.ndarray, list)) for v in given):
            return _COMPARE[op](left, right)
        if not all(isinstance(v, (np.ndarray, int, float)) for v in given):
            raise _OneByOne
        left, right = map(self.column, given)
        if left.dtype != right.dtype:
            for side in (left, right):
                if side.dtype == np.int64:
                    self.odd |= np.abs(side) > _EXACT
        return _COMPARE[op](left, right)

    def unary(self, op: type, value):
        if not isinstance(value, np.ndarray):
            return _UNARY[op](value)
        return value == 0 if op is ast.Not else _UNARY[op](self.column(value))

    def call(self, name: str, given: list):
        fn = _CALLS[name]
        inner = given[0] if len(given) == 1 and isinstance(given[0], list) else None
        if not any(isinstance(v, np.ndarray) for g in given for v in (g if isinstance(g, list) else [g])):
            return fn(*given)
        if name == "round" and len(given) > 1 and isinstance(given[1], np.ndarray) and given[1].dtype != np.float64:
            self.odd |= np.abs(given[1].astype(np.int64)) >= 19
            self.spend(1)
        if inner is not None and name == "len":
            return len(inner)
        if inner is not None and name in ("sum", "min", "max"):
            return self.each(lambda *row: fn(row), *map(self.plain, inner))
        if inner is None and name in ("min", "max", "round", "abs", "int", "float"):
            return self.each(fn, *map(self.plain, given))
        return self.alone()

    def plain(self, value):
        """A number or column; anything else makes rows run by themselves."""
        return value if isinstance(value, (np.ndarray, int, float)) else self.alone()

    def alone(self):
        raise _OneByOne

    def value(self, node: ast.expr):
        place = self.places.get((node.lineno, node.col_offset)) if isinstance(node, ast.Constant) else None
        if place is not None:
            self.spend(1)
            return place
        return super().value(node)

    def subscript(self, items, index):
        if isinstance(items, np.ndarray):
            raise TypeError
        if isinstance(index, np.ndarray) and index.dtype == np.int64 and not self.odd.all():
            shared = int(index[np.argmin(self.odd)])
            self.odd |= index != shared
            index = shared
        return items[index] if not isinstance(index, np.ndarray) else self.alone()

    def listed(self, name: str) -> list:
        """The value of a name in each row that is not odd; None where it is not bound."""
        value, rows = self.names.get(name), np.flatnonzero(~self.odd)
        if isinstance(value, list) and value:
            return [list(row) for row in zip(*(v[rows].tolist() if isinstance(v, np.ndarray) else [v] * len(rows) for v in value), strict=True)]
        return [value] * len(rows)

    def answers(self, name: str) -> pa.Array:
        """``_answers`` of the rows that are not odd."""
        value = self.names.get(name)
        if not isinstance(value, np.ndarray):
            return _answers(self.listed(name))
        column = pa.array(value[~self.odd])
        number = column.cast(pa.int8() if value.dtype == bool else column.type).cast(pa.float64(), safe=False)
        if value.dtype == bool:
            kind, text = "bool", pc.if_else(column, "True", "False")
        elif value.dtype == np.int64:
            kind, text = "int", column.cast(pa.string())
        else:
            kind, text = "float", pa.array(map(repr, column.to_pylist()), pa.string())
        flag = column if value.dtype == bool else pa.nulls(len(column), pa.bool_())
        kinds = pa.array([kind], pa.string()).take(pa.array(np.zeros(len(column), np.int64)))
        return pa.StructArray.from_arrays([kinds, number, text, flag, pa.nulls(len(column), _FIELDS["items"])], list(_FIELDS))


def _columns(source: str, runs: list[pa.Array], odd: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """The numbers of a shape by line and byte, one column each, from the runs of digits of all its rows.

    ``source`` is the first row. Digits outside of numbers (names, say) must be
    those of the first row, and whole numbers must be written plainly and fit
    their column: other rows are marked odd.
    """
    spans = [m.span() for m in _DIGITS.finditer(source)]
    columns, at = {}, 0
    for match in _NUMBER.finditer(source):
        inside = []
        while at < len(spans) and spans[at][0] < match.end():
            if spans[at][0] >= match.start():
                inside.append(at)
            else:
                odd |= _differs(runs[at])
            at += 1
        line = source.rfind("\n", 0, match.start()) + 1
        place = (source.count("\n", 0, match.start()) + 1, len(source[line : match.start()].encode()))
        if match.group().isdigit():
            texts = runs[inside[0]]
            lengths = pc.utf8_length(texts).to_numpy()
            unfit = (lengths > 18) | ((lengths > 1) & pc.starts_with(texts, "0").to_numpy(zero_copy_only=False))
            odd |= unfit
            columns[place] = pc.if_else(pa.array(unfit), "0", texts).cast(pa.int64()).to_numpy()
        else:
            pieces, end = [], match.start()
            for k in inside:
                pieces += [source[end : spans[k][0]], runs[k]]
                end = spans[k][1]
            texts = pc.binary_join_element_wise(*pieces, source[end : match.end()], "")
            columns[place] = np.array(list(map(float, texts.to_pylist())))
    for k in range(at, len(spans)):
        odd |= _differs(runs[k])
    return columns


def _differs(texts: pa.Array) -> np.ndarray:
    return pc.not_equal(texts, texts[0]).to_numpy(zero_copy_only=False)


def _one_by_one(sources: list[str], keys: tuple[str, ...], budget: int) -> pa.StructArray:
    return _struct([_run(source, budget) for source in sources], keys)


def _by_shape(sources: pa.Array, runs: list[pa.Array], keys: tuple[str, ...], budget: int) -> pa.StructArray:
    """``_one_by_one`` for programs that differ in their digits only."""
    shape = _Shape(budget, {}, len(sources))
    first = sources[0].as_py()
    try:
        shape.places = _columns(first, runs, shape.odd)
        with np.errstate(all="ignore"):
            shape.run(ast.parse(first))
        count = len(sources) - int(shape.odd.sum())
        together = _rows(pa.array([True] * count, pa.bool_()), pa.nulls(count, pa.string()), [shape.answers(k) for k in keys], keys)
    except (_OneByOne, RecursionError, MemoryError):
        return _one_by_one(sources.to_pylist(), keys, budget)
    except (Rejected, *_FAULTS) as fault:
        together = _struct([(None, _why(fault))] * (len(sources) - int(shape.odd.sum())), keys)
    if not shape.odd.any():
        return together
    odd = np.flatnonzero(shape.odd)
    apart = _one_by_one(sources.take(pa.array(odd)).to_pylist(), keys, budget)
    order = np.argsort(np.concatenate([np.flatnonzero(~shape.odd), odd]))
    return pa.concat_arrays([together, apart]).take(pa.array(order))


def _evaluate(sources: pa.Array, keys: tuple[str, ...], budget: int) -> pa.StructArray:
    """The programs' results, one parse a shape: a shape is the text with every run of digits made one."""
    shapes = pc.replace_substring_regex(sources, "[0-9]+", "0").dictionary_encode()
    members = np.argsort(shapes.indices.to_numpy(), kind="stable")
    sizes = np.bincount(shapes.indices.to_numpy(), minlength=len(shapes.dictionary))
    ends = np.cumsum(sizes)
    parts = []
    for text, size, end in zip(shapes.dictionary.to_pylist(), sizes.tolist(), ends.tolist(), strict=True):
        own = sources.take(pa.array(members[end - size : end]))
        if size < _FEW or _APART.search(text):
            parts.append(_one_by_one(own.to_pylist(), keys, budget))
            continue
        runs = pc.split_pattern_regex(own, "[^0-9]+").flatten()
        width = len(runs) // size
        outer = [k for k in (0, width - 1) if runs[k].as_py() == ""]  # the text starts or ends without a digit
        columns = [runs.take(pa.array(np.arange(k, len(runs), width))) for k in range(width) if k not in outer]
        parts.append(_by_shape(own, columns, keys, budget))
    return pa.concat_arrays(parts).take(pa.array(np.argsort(members)))


def _float(value) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError, OverflowError):
        return None


def _tagged(value) -> tuple:
    """Kind, number, text, flag and items of a value; all None for no answer."""
    if value is None:
        return (None,) * 5
    text = str(value)
    if isinstance(value, bool):
        return "bool", float(value), text, value, None
    if isinstance(value, (int, float)):
        number = _float(value)
        kind = "text" if number is None else "int" if isinstance(value, int) else "float"
        return kind, number, text, None, None
    if isinstance(value, list):
        return "list", _float(value[0]) if value else None, text, None, [str(v) for v in value]
    return "text", None, text, None, None


# The fields of a tagged answer.
_FIELDS = {
    "kind": pa.string(),
    "num": pa.float64(),
    "text": pa.string(),
    "flag": pa.bool_(),
    "items": pa.list_(pa.string()),
}


def _answers(values: list) -> pa.Array:
    """Values as an Arrow array of tagged answers, null where there is none."""
    columns = zip(*map(_tagged, values), strict=True) if values else [[] for _ in _FIELDS]
    arrays = [pa.array(c, type=t) for c, t in zip(columns, _FIELDS.values(), strict=True)]
    return pa.StructArray.from_arrays(arrays, list(_FIELDS), mask=arrays[0].is_null())


def _rows(ok: pa.Array, reason: pa.Array, answers: list[pa.Array], keys: tuple[str, ...]) -> pa.StructArray:
    return pa.StructArray.from_arrays([ok, reason, *answers], ["ok", "reason", *keys])


def _struct(results: list[tuple[dict | None, str | None]], keys: tuple[str, ...]) -> pa.StructArray:
    ok = pa.array([names is not None for names, _ in results], pa.bool_())
    reason = pa.array([reason for _, reason in results], pa.string())
    return _rows(ok, reason, [_answers([names.get(k) if names else None for names, _ in results]) for k in keys], keys)


def evaluate_batch(codes: pa.Array, keys: tuple[str, ...], budget: int = BUDGET) -> pa.Array:
    """Struct of ``ok``, ``reason`` and one tagged answer per key, for every program of a batch."""
    printed = sys.get_int_max_str_digits()
    sys.set_int_max_str_digits(0)  # a long integer is an answer; the budget bounds it
    try:
        coded = codes.cast(pa.string()).dictionary_encode()
        none = _struct([(None, "no program")], keys)  # for null code
        results = pa.concat_arrays([_evaluate(coded.dictionary, keys, budget), none]) if len(coded.dictionary) else none
    finally:
        sys.set_int_max_str_digits(printed)
    return results.take(pc.fill_null(coded.indices, len(results) - 1))


# Tasks get these functions by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
