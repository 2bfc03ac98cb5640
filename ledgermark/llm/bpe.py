"""Operator 10: byte-level BPE by a lazily determinised transducer, and a streaming decoder.

A token sequence is the BPE encoding of its bytes exactly if every two
neighbours stay apart when their joint bytes are merged by rank. So a
transducer can guess tokens: a hypothesis is the last token and the bytes read
of the next one, and it lives while those bytes begin a token and the finished
token stands beside the last. Every prefix of the text has one encoding, so
each place where a token may start carries one hypothesis at most. The machine
determinises the set of hypotheses step by step, keeps the transitions it has
met, and emits a token as soon as all living hypotheses agree on it; the
longest token bounds that lookahead.

Texts are split by the tokenizer's pattern first, and each piece is encoded
alone. A piece that is a token itself is that token. Null and empty texts have
no ids. Decoding goes token by token through a UTF-8 state machine, whose state
is the unfinished character.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from ledgermark.llm.shared import give_back, portions, schema_with, tidied, with_columns, worker_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What a worker keeps in each of two generations; states are kept until there are too many.
KEPT_TRANSITIONS = 500_000
KEPT_STATES = 800_000
KEPT_PAIRS = 200_000
KEPT_PIECES = 100_000
KEPT_STRETCHES = 400_000
#: Longer stretches are encoded each time they occur.
LONGEST_KEPT = 64
#: What a worker keeps is a quarter of it where other operators' workers and a full heap share the executor.
SHARED = 4

#: Bytes after which settled tokens are emitted; twice the longest token of any vocabulary used is plenty.
LOOKAHEAD = 1024

_STATE = (1 << 40) - (1 << 8)
#: Ids decoded at once.
RUN = 1 << 16

NEVER = 1 << 62
NONE = 1 << 30


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The token bytes and ids of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Kept(dict):
    """What ``make`` gives for the keys met, in two generations.

    A full generation becomes the old one; what is asked for again moves up, and
    only what was not asked for in a whole generation is made anew.
    """

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key) if self.old else None
        if value is None:
            value = self.make(key)
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
        self[key] = value
        return value


class Transducer:
    """Bytes in, token ids out, one transition a byte.

    A state is the set of living hypotheses, each one number: the last id and
    the place in the tree of token bytes. A transition also names the token
    that ends at its byte, so that the tokens before any start of a token can be
    followed back.
    """

    def __init__(self, ranks: dict[bytes, int], share: int = 1):
        self.ranks, self.share = ranks, share
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.history: dict[int, tuple[list, list]] = {}
        self.places: dict[int, int] = {}  # place and byte: next place
        self.depth = [0]
        self.token_at: dict[int, int] = {}
        for token, rank in ranks.items():
            at = 0
            for byte in token:
                key = at << 8 | byte
                at = self.places.get(key, 0)
                if not at:
                    at = self.places[key] = len(self.depth)
                    self.depth.append(self.depth[key >> 8] + 1)
            self.token_at[at] = rank
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple[int, ...]] = [(NONE << 32,)]
        self.number: dict[tuple[int, ...], int] = {self.states[0]: 0}
        self.steps = Kept(self._step, KEPT_TRANSITIONS // self.share)  # state and byte: id + 1 of the token that ends, next state, eight zeros
        self.pairs = Kept(self._fits, KEPT_PAIRS // self.share)

    def _merges(self, token: int) -> tuple[list, list]:
        """The token's first and its last part over time, each with the rank that ends it."""
        parts = [self.bytes_of[token][i : i + 1] for i in range(len(self.bytes_of[token]))]
        firsts, lasts = [], []
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                break
            if at == 0:
                firsts.append((parts[0], rank))
            if at == len(parts) - 2:
                lasts.append((parts[-1], rank))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [*firsts, (parts[0], NEVER)], [*lasts, (parts[-1], NEVER)]

    def _fits(self, pair: int) -> bool:
        """Whether two tokens stay apart when their joint bytes are merged."""
        last, token = pair >> 32, pair & 0xFFFFFFFF
        for t in (last, token):
            if t not in self.history and t != NONE:
                self.history[t] = self._merges(t)
        firsts = self.history[token][0]
        if firsts[-1][0] != self.bytes_of[token]:
            return False  # no merges make this token
        if last == NONE:
            return True
        lasts, rank_of = self.history[last][1], self.ranks.get
        i = j = 0
        while True:
            (before, until), (after, ends) = lasts[i], firsts[j]
            # of equal ranks the leftmost pair is merged first
            across = rank_of(before + after, NEVER)
            if across < until and across <= ends and across != NEVER:
                return False
            if until <= ends:
                if until == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def _step(self, key: int) -> int:
        living, ended, places, byte = [], 0, self.places, key & 0xFF
        for hypothesis in self.states[key >> 8]:
            at = places.get((hypothesis & 0xFFFFFFFF) << 8 | byte)
            if at is not None:
                living.append(hypothesis & ~0xFFFFFFFF | at)
                # what has been read has one encoding, so one hypothesis ends a token here
                if not ended:
                    token = self.token_at.get(at)
                    if token is not None and self.pairs[hypothesis & ~0xFFFFFFFF | token]:
                        ended = token + 1
        if ended:
            living.append((ended - 1) << 32)
        found = tuple(living)
        number = self.number.get(found)
        if number is None:
            number = self.number[found] = len(self.states)
            self.states.append(found)
        return ended << 40 | number << 8

    def _back(self, path: list[int], upto: int) -> list[int]:
        """The ids of the first ``upto`` bytes, last first."""
        out, length = [], self.length
        while upto > 0:
            token = (path[upto - 1] >> 40) - 1
            out.append(token)
            upto -= length[token]
        return out

    def _agreed(self, path: list[int]) -> tuple[list[int], int]:
        """The ids on which all living hypotheses agree, and their bytes."""
        state = (path[-1] & _STATE) >> 8
        starts = [len(path) - self.depth[h & 0xFFFFFFFF] for h in self.states[state]]
        chains = [self._back(path, start)[::-1] for start in starts]
        common = []
        for ids in zip(*chains, strict=False):
            if len(set(ids)) > 1:
                break
            common.append(ids[0])
        return common, sum(self.length[t] for t in common)

    def encode(self, data: bytes) -> array:
        """The ids of one piece.

        What is settled is emitted every ``LOOKAHEAD`` bytes, so the memory
        does not grow with the piece.
        """
        whole = self.ranks.get(data)
        if whole is not None:
            return array("i", (whole,))
        if len(self.states) > KEPT_STATES // self.share:
            self._forget()
        out, path, step, steps = array("i"), [], 0, self.steps
        append = path.append
        for start in range(0, len(data), LOOKAHEAD):
            if start:
                common, length = self._agreed(path)
                out.extend(common)
                del path[:length]
            for byte in data[start : start + LOOKAHEAD]:
                step = steps[step & _STATE | byte]
                append(step)
        out.extend(self._back(path, len(path))[::-1])
        return out


class TextEncoder:
    """Ids of whole texts.

    A blank between two characters that are no white space starts a piece under
    every pattern of this family, so a text whose blanks are all of that kind
    is cut there, and the pattern is applied to each stretch it has not met.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, share: int = 1):
        self.machine = Transducer(ranks, share)
        self.findall = regex.compile(pattern).findall
        self.pieces = Kept(lambda piece: self.machine.encode(piece.encode()).tobytes(), KEPT_PIECES // share)
        self.stretches = Kept(self._by_pattern, KEPT_STRETCHES // share)
        self.other_blanks = re.compile(r"\A | \Z| \s|\s |\x00").search

    def _by_pattern(self, text: str) -> bytes:
        pieces = self.findall(text)
        if len(pieces) == 1 and len(pieces[0]) == len(text):  # kept as a stretch, or too long to be kept
            return self.machine.encode(text.encode()).tobytes()
        return b"".join([self.pieces[p] if len(p) <= LONGEST_KEPT else self.machine.encode(p.encode()).tobytes() for p in pieces])

    def encode(self, text: str) -> np.ndarray:
        if self.other_blanks(text):
            return np.frombuffer(self._by_pattern(text), np.int32)
        parts = text.replace(" ", "\0 ").split("\0")
        if len(max(parts, key=len)) <= LONGEST_KEPT:
            return np.frombuffer(b"".join(map(self.stretches.__getitem__, parts)), np.int32)
        return np.frombuffer(b"".join([self.stretches[p] if len(p) <= LONGEST_KEPT else self._by_pattern(p) for p in parts]), np.int32)


class Utf8Decoder:
    """Tokens in, text out; the state is the unfinished character.

    Bytes that cannot go on the character begun give U+FFFD, as many as
    Python's own "replace" makes of the whole.
    """

    # lead byte: bytes that follow, lowest and highest second byte
    @staticmethod
    def _lead(byte: int) -> tuple[int, int, int] | None:
        if 0xC2 <= byte <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= byte <= 0xEF:
            return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
        if 0xF0 <= byte <= 0xF4:
            return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
        return None

    def __init__(self):
        self.begun = b""

    def feed(self, data: bytes) -> str:
        """The characters that ``data`` completes."""
        out = []
        for byte in data:
            if self.begun:
                more, low, high = self._lead(self.begun[0])
                if len(self.begun) > 1:
                    low, high = 0x80, 0xBF
                if low <= byte <= high:
                    self.begun += bytes((byte,))
                    if len(self.begun) > more:
                        out.append(self.begun.decode())
                        self.begun = b""
                    continue
                out.append("�")
                self.begun = b""
            if byte < 0x80:
                out.append(chr(byte))
            elif self._lead(byte):
                self.begun = bytes((byte,))
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        """What an unfinished character at the end gives."""
        left, self.begun = self.begun, b""
        return "�" if left else ""


def stream_text(tokens: Iterable[bytes]) -> Iterator[str]:
    """The text of each token in turn, whole characters only."""
    decoder = Utf8Decoder()
    for token in tokens:
        yield decoder.feed(token)
    yield decoder.end()


def text_of(ids: np.ndarray, tokens: np.ndarray, closed: np.ndarray) -> Iterator[str]:
    """The text of ids in parts, by the machine.

    A token that is whole characters leaves the machine at rest, so a run of
    those passes at once; the others go through it one by one.
    """
    decoder, at = Utf8Decoder(), 0
    for place in [*np.flatnonzero(~closed[ids]).tolist(), len(ids)]:
        for start in range(at, place, RUN):
            yield decoder.end() + b"".join(tokens[ids[start : min(start + RUN, place)]].tolist()).decode()
        if place < len(ids):
            yield decoder.feed(tokens[ids[place]])
        at = place + 1
    yield decoder.end()


def _encoder(data: bytes, pattern: str, share: int = 1):
    def make():
        give_back()
        gc.set_threshold(200_000, 50, 1000)  # the tables hold no cycles
        return TextEncoder(read_ranks(data), pattern, share)

    return worker_cache(f"bpe-encoder-{hash((data, pattern, share))}", make)


def _tokens(data: bytes):
    def make():
        ranks = read_ranks(data)
        size = max(ranks.values(), default=-1) + 1
        tokens = np.full(size, b"", object)
        closed = np.zeros(size, bool)
        for token, rank in ranks.items():
            tokens[rank] = token
            try:
                token.decode()
                closed[rank] = True
            except UnicodeDecodeError:
                pass
        return tokens, closed

    return worker_cache(f"bpe-tokens-{hash(data)}", make)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", keep_text: bool = True) -> DataFrame:
    """Add the ids of each text, an empty list for null and empty ones.

    The rank file (under a megabyte, fixed) is read here and goes to the tasks
    as a broadcast. A column named ``ids`` already there is replaced. Rows are
    independent: no shuffle, and memory is bounded by the longest text.
    """
    with open(ranks_path, "rb") as file:
        shipped = df.sparkSession.sparkContext.broadcast(file.read())
    drop = () if keep_text else (text,)

    def run(batches):
        encoder = _encoder(shipped.value, pattern)
        for batch in batches:
            for part in portions(batch, text):
                rows = [
                    encoder.encode(t) if t else np.zeros(0, np.int32)
                    for t in part.column(part.schema.get_field_index(text)).to_pylist()
                ]
                offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
                values = np.concatenate(rows) if rows else np.zeros(0, np.int32)
                yield with_columns(part, drop, **{ids: pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))})

    return df.mapInArrow(run, schema_with(df, drop, **{ids: "array<int>"}))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", data: str = "decoded", text: str | None = None) -> DataFrame:
    """Add the bytes the ids stand for and, if named, their text.

    Null ids give empty bytes; an id that the file lacks is an error. Bytes
    that are no UTF-8 give U+FFFD in the text.
    """
    with open(ranks_path, "rb") as file:
        shipped = df.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        tokens, closed = _tokens(shipped.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            for start in range(0, batch.num_rows, 256):
                part, found = batch.slice(start, 256), column.slice(start, 256)
                rows, texts = [], []
                for row in found:
                    own = row.values.to_numpy(zero_copy_only=False) if row.is_valid else np.zeros(0, np.int32)
                    pieces = tokens[own].tolist()
                    rows.append(b"".join(pieces))
                    if text is not None:
                        texts.append("".join(text_of(own, tokens, closed)))
                new = {data: pa.array(rows, pa.binary())}
                yield with_columns(part, **new, **({text: pa.array(texts, pa.string())} if text else {}))

    return df.mapInArrow(run, schema_with(df, **{data: "binary"}, **({text: "string"} if text else {})))


def digests(df: DataFrame, ranks_path: str, pattern: str, key: str, text: str = "text", share: int = 1) -> DataFrame:
    """``key``, number of ids, and digests of the ids and of the text they decode to, in one pass over each text.

    Every text is encoded, and its ids are decoded again by the state machine;
    neither ids nor texts leave the task. A worker keeps a ``share``-th of the
    tables' usual size; ids do not depend on it.
    """
    with open(ranks_path, "rb") as file:
        shipped = df.sparkSession.sparkContext.broadcast(file.read())

    def row(encoder: TextEncoder, tokens: np.ndarray, closed: np.ndarray, shown: np.ndarray, text: str | None) -> tuple[int, str, str]:
        ids = encoder.encode(text) if text else np.zeros(0, np.int32)
        listed, decoded = hashlib.sha256(), hashlib.sha256()
        for start in range(0, len(ids), RUN):
            listed.update((b" " if start else b"") + b" ".join(shown[ids[start : start + RUN]].tolist()))
        for part in text_of(ids, tokens, closed):
            decoded.update(part.encode())
        return len(ids), listed.hexdigest(), decoded.hexdigest()

    def run(batches):
        encoder, (tokens, closed) = _encoder(shipped.value, pattern, share), _tokens(shipped.value)
        shown = worker_cache(f"bpe-shown-{len(tokens)}", lambda: np.array([str(k).encode() for k in range(len(tokens))], object))
        for batch in batches:
            for part in portions(batch, text):
                rows = [row(encoder, tokens, closed, shown, t) for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                counts, listed, decoded = zip(*rows, strict=True)
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
                arrays = [part.column(part.schema.get_field_index(key)), pa.array(counts, pa.int64()), pa.array(listed), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(tidied(run), f"{key} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
