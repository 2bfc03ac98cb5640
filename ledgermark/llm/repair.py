"""Operator 12: conversation structure repair by Knuth's lightest derivations.

A conversation should read, by the initials of its roles, ``(s?(ua)+)?``. Repair
items are pairs (rows read, state of that pattern). An edit of the next row, or
an insertion, is a weighted axiom; a hyperedge joins an item and an axiom to a
new item, adds the costs and appends the edit's initial to the audit. An agenda
pops items by (cost, audit); what is popped is final, and it ends when the goal
item, all rows read in a state that may end, is popped.

That order is right: a hyperedge never gives less than the item it starts from
(costs do not fall, and a string is below its own extensions), and it keeps the
order of two derivations of one item. The latter could fail only if one audit
began with the other at the same cost, but then they would differ by insertions,
which cost something.

Scale: a conversation of bounded rows and bytes is sorted into a task and
repaired there. A longer one, which may hold a third of all rows, is cut into
pieces of at most ``PIECE`` rows: all rows are ordered by range, duplicates are
found by grouping digests, each piece gets its lightest derivation from every
state to every state (each one a segment item), and a stream over the pieces
joins segment items to the conversation's. Only the digest of the repaired text
reads a whole conversation in one task, as SHA-256 is a chain; it holds a row
at a time. The audit is one value and is held whole.

Defined cases: a null role or text is one blank. Rows of one turn are ordered by
role, then by text (a digest of it where the conversation is long); equal rows
are each other's duplicates. A null id is one more conversation. An empty role
has no initial and fits nowhere.
"""

from __future__ import annotations

import hashlib
import heapq
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermark.llm.shared import saved

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
MOST_ROWS, MOST_BYTES = 2_000, 8 << 20
PIECE = 1 << 11

BLANK = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: From each state: the initials that may follow and the state after them.
MOVES = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ENDS = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")

Item = tuple[int, int]
Row = tuple[str, bool, bool]  # initial, must go, cut short


def lightest(start: Item, deductions: Callable[[Item], Iterable[tuple[Item, int, str]]], goal: Callable[[Item], bool]) -> dict[Item, tuple[int, str]]:
    """Final (cost, audit) of the items popped, the goal last; all items that can be reached if there is no goal."""
    agenda = [(0, "", start)]
    final: dict[Item, tuple[int, str]] = {}
    while agenda:
        cost, audit, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = (cost, audit)
        if goal(item):
            break
        for reached, more, letter in deductions(item):
            if reached not in final:
                heapq.heappush(agenda, (cost + more, audit + letter, reached))
    return final


def edits_of(rows: list[Row]) -> Callable[[Item], Iterator[tuple[Item, int, str]]]:
    """The hyperedges over a list of rows."""

    def deductions(item: Item) -> Iterator[tuple[Item, int, str]]:
        at, state = item
        for initial, after in MOVES[state].items():
            if initial in ROLES:
                yield (at, after), INSERT, "I"
        if at < len(rows):
            own, must_go, short = rows[at]
            yield (at + 1, state), DELETE, "D"
            if not must_go:
                rest = CUT_SHORT if short else 0
                for initial, after in MOVES[state].items():
                    if initial == own:
                        yield (at + 1, after), KEEP + rest, "K"
                    if initial in ROLES:
                        yield (at + 1, after), REROLE + rest, "R"

    return deductions


def repair(rows: list[Row]) -> tuple[int, str]:
    """Cost and audit of the lightest repair of a whole conversation."""
    goal = lambda item: item[0] == len(rows) and item[1] in ENDS
    return list(lightest((0, START), edits_of(rows), goal).values())[-1]


def segments(rows: list[Row]) -> list[tuple[int, int, int, str]]:
    """From state, to state, cost and audit of the lightest derivations over a piece."""
    found = []
    for state in MOVES:
        final = lightest((0, state), edits_of(rows), lambda item: False)
        found += [(state, after, *final[len(rows), after]) for after in MOVES if (len(rows), after) in final]
    return found


class Repaired:
    """Follows an audit over rows and digests the repaired text."""

    def __init__(self):
        self.state, self.hash, self.empty, self.letters = START, hashlib.sha256(), True, iter("")

    def _add(self, role: str, text: str, initial: str) -> None:
        self.hash.update((("" if self.empty else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.empty, self.state = False, MOVES[self.state][initial]

    def _new_initial(self) -> str:
        return next(i for i in MOVES[self.state] if i in ROLES)

    def row(self, role: str, text: str) -> None:
        """Take the insertions that come first, then the row's own edit."""
        for letter in self.letters:
            if letter == "K":
                return self._add(role, text, role[0])
            initial = None if letter == "D" else self._new_initial()
            if letter == "I":
                self._add(ROLES[initial], "", initial)
            else:
                return self._add(ROLES[initial], text, initial) if initial else None

    def rest(self) -> None:
        """Insertions after the last row."""
        for _ in self.letters:
            initial = self._new_initial()
            self._add(ROLES[initial], "", initial)


def with_faults(rows: DataFrame) -> DataFrame:
    """Add ``blank``, ``short`` and ``initial`` to rows whose ``role`` and ``text`` are not null."""
    bare = F.rtrim(F.col("text"), F.lit(BLANK))
    return rows.select(
        "*",
        (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("short"),
        F.substring("role", 1, 1).alias("initial"),
    )


RESULT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
)
_RESULT = pa.schema(
    [("conv_id", pa.int64())]
    + [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)


def _whole(conv_id: int | None, rows: list[dict]) -> dict:
    """The result of a conversation whose rows are all here, in order."""
    rows = [r for r in rows if r["live"]]
    seen, judged, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for r in rows:
        key = (r["role"], r["text"])
        fault = "blank" if r["blank"] else "duplicate" if key in seen else "truncated" if r["short"] else None
        seen.add(key)
        if fault:
            counts[fault] += 1
        judged.append((r["initial"], fault in ("blank", "duplicate"), fault == "truncated"))
    turns = {r["turn"] for r in rows} - {None}
    cost, audit = repair(judged)
    done = Repaired()
    done.letters = iter(audit)
    for r in rows:
        done.row(r["role"], r["text"])
    done.rest()
    return {
        "conv_id": conv_id,
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **counts,
        "illegal": sum(a[0] + b[0] not in LEGAL for a, b in zip(judged, judged[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": done.hash.hexdigest(),
    }


def _repair_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation; one result a conversation, and no more than one of them held."""
    at, rows, found = None, [], []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row["conv_id"] != at:
                found.append(_whole(at, rows))
                rows = []
            at = row["conv_id"]
            rows.append(row)
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=_RESULT)
            found = []
    if rows:
        yield pa.RecordBatch.from_pylist([_whole(at, rows)], schema=_RESULT)


def _same(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """Join on equal columns, null equal to null; ``right``'s copies go."""
    right = right.withColumnsRenamed({n: f"_{n}" for n in names})
    condition = F.lit(True)
    for n in names:
        condition = condition & left[n].eqNullSafe(right[f"_{n}"])
    return left.join(right, condition, how).drop(*[f"_{n}" for n in names])


def _segments_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by piece; the segment items of each piece."""
    schema = pa.schema(
        [("conv_id", pa.int64()), ("piece", pa.int64()), ("inside", pa.int64()), ("first", pa.string()), ("last", pa.string())]
        + [("start", pa.int64()), ("stop", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]
    )

    def ended(key: tuple, rows: list[Row]) -> pa.RecordBatch:
        inside = sum(a[0] + b[0] not in LEGAL for a, b in zip(rows, rows[1:]))
        head = (*key, inside, rows[0][0], rows[-1][0])
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, (*head, *s), strict=True)) for s in segments(rows)], schema=schema)

    at, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            key = (r["conv_id"], r["piece"])
            if rows and key != at:
                yield ended(at, rows)
                rows = []
            at = key
            rows.append((r["initial"], r["blank"] or r["duplicate"], r["truncated"]))
    if rows:
        yield ended(at, rows)


class _Path:
    """A derivation up to a piece: what it ends with and the derivation before."""

    __slots__ = ("cost", "before", "piece", "start", "stop", "audit")

    def __init__(self, cost, before, piece, start, stop, audit):
        self.cost, self.before, self.piece, self.start, self.stop, self.audit = cost, before, piece, start, stop, audit

    def below(self, other: _Path) -> bool:
        """Order by cost, then by audit; the part that both share is not read."""
        if self.cost != other.cost:
            return self.cost < other.cost
        mine, theirs, a, b = [], [], self, other
        while a is not b and a.before is not None:  # both have as many pieces
            mine.append(a.audit)
            theirs.append(b.audit)
            a, b = a.before, b.before
        return "".join(reversed(mine)) < "".join(reversed(theirs))


def _join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segment items sorted by conversation and piece; the edits of each piece, then one row of totals (piece null)."""
    schema = pa.schema([(n, pa.int64()) for n in ("conv_id", "piece", "start", "cost", "illegal")] + [("audit", pa.string())])

    def ended(conv_id: int | None, paths: dict[int, _Path], illegal: int) -> pa.RecordBatch:
        best = None
        for state in ENDS:
            if state in paths and (best is None or paths[state].below(best)):
                best = paths[state]
        steps, path = [], best
        while path.before is not None:
            steps.append({"conv_id": conv_id, "piece": path.piece, "start": path.start, "audit": path.audit})
            path = path.before
        total = {"conv_id": conv_id, "cost": best.cost, "illegal": illegal, "audit": "".join(s["audit"] for s in reversed(steps))}
        return pa.RecordBatch.from_pylist([*steps, total], schema=schema)

    begun, at, piece = False, None, None
    root = _Path(0, None, None, START, START, "")
    paths, reached, illegal, last = {START: root}, {}, 0, None
    for batch in batches:
        for r in batch.to_pylist():
            if not begun or r["conv_id"] != at:
                if begun:
                    yield ended(at, reached, illegal)
                begun, at, piece = True, r["conv_id"], None
                reached, illegal, last = {START: root}, 0, None
            if r["piece"] != piece:
                illegal += r["inside"] + (last is not None and last + r["first"] not in LEGAL)
                paths, reached, piece, last = reached, {}, r["piece"], r["last"]
            if r["start"] in paths:
                before = paths[r["start"]]
                path = _Path(before.cost + r["cost"], before, r["piece"], r["start"], r["stop"], r["audit"])
                if r["stop"] not in reached or path.below(reached[r["stop"]]):
                    reached[r["stop"]] = path
    if begun:
        yield ended(at, reached, illegal)


def _digest_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each conversation, its pieces' edits, each followed by the piece's rows; the digest of what they give."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    at, done = None, None
    for batch in batches:
        found = []
        for k in range(batch.num_rows):
            conv_id, edits, role, text = (batch.column(n)[k].as_py() for n in ("conv_id", "edits", "role", "text"))
            if done is None or conv_id != at:
                if done is not None:
                    done.rest()
                    found.append({"conv_id": at, "repaired_sha256": done.hash.hexdigest()})
                at, done = conv_id, Repaired()
            if edits is not None:
                done.rest()
                done.letters = iter(edits)
            else:
                done.row(role, text)
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=schema)
    if done is not None:
        done.rest()
        yield pa.RecordBatch.from_pylist([{"conv_id": at, "repaired_sha256": done.hash.hexdigest()}], schema=schema)


def _repair_long(rows: DataFrame, piece: int) -> DataFrame:
    """The same results for conversations of any length, in pieces of at most ``piece`` rows."""
    c = F.col
    rows = rows.withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    order = ["conv_id", "turn", "role", "digest", "spread"]
    # Equal rows may stand in any order, so the last column only lets them be dealt apart.
    rows = rows.withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("spread")
    rows = saved(rows.withColumn("place", F.monotonically_increasing_id()), "repair-rows")
    rows = rows.withColumn("piece", F.floor(c("place") / F.lit(piece)).cast("bigint"))
    firsts = rows.groupBy("conv_id", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    marks = _same(rows.select("conv_id", "turn", "digest", "place", "piece", "initial", "blank", "short"), firsts, ["conv_id", "digest"], "left")
    again = ~c("blank") & F.coalesce(c("place") > c("first"), F.lit(False))
    marks = marks.select("conv_id", "turn", "place", "piece", "initial", "blank", again.alias("duplicate"), (~c("blank") & ~again & c("short")).alias("truncated"))
    marks = saved(marks, "repair-marks")
    turns = marks.groupBy("conv_id", "turn").agg(*[F.sum(c(n).cast("bigint")).alias(n) for n in ("blank", "duplicate", "truncated")])
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    counts = turns.groupBy("conv_id").agg(
        F.coalesce(span, F.lit(0).cast("bigint")).alias("gaps"), *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")]
    )
    ddl = "conv_id bigint, piece bigint, inside bigint, first string, last string, start bigint, stop bigint, cost bigint, audit string"
    dealt = marks.select("conv_id", "piece", "place", "initial", "blank", "duplicate", "truncated")
    parts = dealt.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "place").mapInArrow(_segments_of, ddl)
    parts = saved(parts, "repair-segments").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    steps = saved(parts.mapInArrow(_join_segments, "conv_id bigint, piece bigint, start bigint, cost bigint, illegal bigint, audit string"), "repair-steps")
    none = F.lit(None).cast("string")
    edits = steps.filter("piece is not null").select("conv_id", "piece", F.lit(-1).cast("bigint").alias("place"), c("audit").alias("edits"), none.alias("role"), none.alias("text"))
    stream = edits.unionByName(rows.select("conv_id", "piece", "place", none.alias("edits"), "role", "text"))
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "piece", "place")
    digests = stream.mapInArrow(_digest_stream, "conv_id bigint, repaired_sha256 string")
    totals = steps.filter("piece is null").select("conv_id", "cost", "illegal", "audit")
    joined = _same(_same(counts, totals, ["conv_id"], "inner"), digests, ["conv_id"], "inner")
    return joined.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(rows: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, piece: int = PIECE) -> DataFrame:
    """One row (``RESULT``) a conversation of ``conv_id, turn, role, text, live``.

    Rows that are not ``live`` only say that their conversation exists.
    """
    rows = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text"), F.lit(" ")).alias("text"),
        "live",
    )
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("bytes"))
    long = saved(sizes.filter((F.col("n") > most_rows) | (F.col("bytes") > most_bytes)).select("conv_id"), "repair-long")
    marked = with_faults(rows)
    if long.isEmpty():
        return _in_tasks(marked)
    held = _in_tasks(_same(marked, long, ["conv_id"], "left_anti"))
    lengthy = _repair_long(_same(marked.filter("live"), long, ["conv_id"], "left_semi").drop("live"), piece)
    lengthy = _same(long, lengthy, ["conv_id"], "left").fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"])
    return held.unionByName(lengthy.fillna({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}))


def _in_tasks(marked: DataFrame) -> DataFrame:
    return marked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_repair_whole, RESULT)


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, live`` after the damage that a checksum of id and turn picks for each row."""
    c = F.col
    text_of: Callable[[str], Column] = lambda n: F.coalesce(c(n).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), fate.alias("fate"))
    text = F.when(c("fate").isin(0, 1), F.lit("")).when(c("fate") == 2, F.translate("text", ".!?", "")).otherwise(c("text"))
    role = F.when(c("fate") == 4, F.lit("user")).otherwise(c("role"))
    times = F.sequence(F.lit(1), F.when(c("fate") == 3, 2).otherwise(1))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (c("fate") != 0).alias("live"), times.alias("_times"))
    return rows.select("conv_id", "turn", "role", "text", "live", F.explode("_times").alias("_time")).drop("_time")
