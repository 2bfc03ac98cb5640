"""Operator 11: hard negatives by Fagin's threshold algorithm.

For each anchor two searches run over all rows: its best rows of the same label
(the positives), then, for each positive, its best rows of another label whose
score stands in a window below the positive's. Scores are inner products of
whole-number vectors; higher ones come first, ties by the smaller id.

Rows are dealt by a hash of their id into blocks of bounded size. A block keeps
one list a dimension, sorted by value. An anchor reads the lists from the end
that its component's sign prefers (sorted access), scores every row met for the
first time on its whole vector (random access), and adds up what an unread row
could reach at best (the threshold). It stops once the threshold is strictly
below the k-th score of each of its windows, so that a tie with a smaller id is
never missed; a window with fewer than k rows goes on until the threshold is
below the window itself, and a search ends when all rows of the block are met.
The depth read doubles each time. Each block gives an anchor's first k, and the
first k of those are the result: exact, without a bound on candidates.

Scale: the anchors are a stated query set. Rows are shuffled once a search;
anchors go to every block as a stream that a task reads batch by batch, so a
task holds one block and one batch of anchors, whatever the number of either.
The label does not place a row, so a label with a third of all rows is spread
evenly. Blocks give at most k rows an anchor and window.

Defined cases: a null id, label, vector or component and a component that is
not finite leave the row out, and so does a vector whose sum of squares passes
2**61, as its scores need not fit in 64 bits. Rows of one id are one row, the
least by label, then vector. A shorter vector counts as ending in zeros. An
anchor without positives, or a positive without negatives, gives no row.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermark.llm.shared import saved

cloudpickle.register_pickle_by_value(sys.modules[__name__])

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # per cent of the positive's score

MOST_SQUARES = float(1 << 61)
LEAST_BLOCK, MOST_BLOCK = 1 << 10, 1 << 16
FIRST_DEPTH = 16


def quantised(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """``vec_id, label, vector``: one row an id, components as whole numbers ``floor(scale * x)``."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    steps = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(scale)))
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sound = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite)
    held = sound.select("vec_id", F.col("label").cast("bigint").alias("label"), steps.alias("vector")).filter(squares <= F.lit(MOST_SQUARES))
    held = held.select("vec_id", "label", F.col("vector").cast("array<int>").alias("vector"))
    least = held.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row"))
    return least.select(F.col("vec_id").cast("bigint").alias("vec_id"), "row.label", "row.vector")


class Lists:
    """Rows of a block: their whole vectors and one ascending list a dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.order = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32))
        self.values = np.take_along_axis(vectors.T, self.order, 1).astype(np.float64)

    def search(self, anchor: np.ndarray, settled: Callable[[np.ndarray, np.ndarray, float], bool]) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the rows met, read until ``settled(places, scores, threshold)``."""
        count, width = self.vectors.shape
        down, up = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        if not len(down) + len(up):  # every score is 0, and nothing is below it
            return np.arange(count), np.zeros(count, self.vectors.dtype)
        met = np.zeros(count, bool)
        places, scores = np.zeros(0, np.int64), np.zeros(0, self.vectors.dtype)
        weights = anchor.astype(np.float64)
        depth = 0
        while len(places) < count:
            deeper = min(count, max(FIRST_DEPTH, 2 * depth))
            fresh = np.zeros(count, bool)
            fresh[self.order[down, count - deeper : count - depth]] = True
            fresh[self.order[up, depth:deeper]] = True
            fresh &= ~met
            met |= fresh
            new = np.flatnonzero(fresh)
            places = np.concatenate([places, new])
            scores = np.concatenate([scores, self.vectors[new] @ anchor])
            depth = deeper
            reach = np.concatenate([weights[down] * self.values[down, count - depth], weights[up] * self.values[up, depth - 1]])
            # The sum is exact below 2**53; beyond, it is raised by more than it can be off.
            bound = np.abs(reach).sum()
            if settled(places, scores, reach.sum() + (bound * 1e-12 + 1 if bound >= 1 << 53 else 0)):
                break
        return places, scores


def _matrix(lists: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Rows of an array column as a matrix; shorter rows end in zeros, more than ``width`` is cut."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    width = int(sizes.max(initial=0)) if width is None else width
    if len(sizes) and (sizes == width).all():
        return values[offsets[0] : offsets[-1]].reshape(len(sizes), width).astype(np.int64)
    matrix = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    column = np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], sizes)
    inside = column < width
    matrix[row[inside], column[inside]] = values[offsets[0] : offsets[-1]][inside]
    return matrix


def _longest(matrix: np.ndarray) -> float:
    return math.sqrt(float((matrix.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0)))


class Block:
    """A block's rows; their lists are made once for each kind of number that is exact for the anchors met."""

    def __init__(self, parts: list[pa.RecordBatch], by_label: bool):
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        self.ids = rows.column("id").to_numpy()
        self.labels = rows.column("label").to_numpy()
        self.matrix = _matrix(rows.column("vector"))
        self.longest = _longest(self.matrix)
        self.by_label = by_label
        self.made: dict = {}

    def number(self, anchors: np.ndarray) -> type:
        """The fastest kind that holds every partial sum of a score exactly."""
        most = self.longest * _longest(anchors)
        return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64

    def lists(self, kind: type, label: int | None) -> Lists | None:
        """All rows, or those of one label."""
        key = (kind, label if self.by_label else None)
        if key not in self.made:
            at = np.flatnonzero(self.labels == label) if self.by_label else slice(None)
            self.made[key] = Lists(self.ids[at], self.labels[at], self.matrix[at].astype(kind))
        return self.made[key]


def _first(places: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Order by score, highest first, then by id."""
    return np.lexsort((ids[places], -scores))


def _positives(lists: Lists, anchor_id: int, anchor: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The anchor's first ``k`` other rows in these lists: id and score."""

    def settled(places: np.ndarray, scores: np.ndarray, threshold: float) -> bool:
        scores = scores[lists.ids[places] != anchor_id]
        return len(scores) >= k and threshold < np.partition(scores, len(scores) - k)[len(scores) - k]

    places, scores = lists.search(anchor, settled)
    other = lists.ids[places] != anchor_id
    places, scores = places[other], scores[other]
    if len(scores) > k:
        near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        places, scores = places[near], scores[near]
    best = _first(places, scores, lists.ids)[:k]
    return [(int(lists.ids[p]), int(s)) for p, s in zip(places[best], scores[best], strict=True)]


def _windows(scores: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """Whole scores s with ``low * positive <= 100 * s <= high * positive``; bounds crossed where there is none."""
    return [(-((-low * s) // 100), (high * s) // 100) for s in scores]


def _negatives(lists: Lists, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """For each window the anchor's first ``k`` rows of another label in it: id and score."""
    open_windows = [w for w in windows if w[0] <= w[1]]
    if not open_windows:
        return [[] for _ in windows]
    least, most = min(w[0] for w in open_windows), max(w[1] for w in open_windows)

    def inside(places: np.ndarray, scores: np.ndarray) -> np.ndarray:
        return (scores >= least) & (scores <= most) & (lists.labels[places] != label)

    def settled(places: np.ndarray, scores: np.ndarray, threshold: float) -> bool:
        if threshold < least:
            return True
        falling = -np.sort(-scores[inside(places, scores)])
        for low, high in open_windows:
            kth = int(np.searchsorted(-falling, -high)) + k - 1
            if not threshold < (max(low, falling[kth]) if kth < len(falling) else low):
                return False
        return True

    places, scores = lists.search(anchor, settled)
    held = inside(places, scores)
    places, scores = places[held], scores[held]
    order = _first(places, scores, lists.ids)
    places, scores = places[order], scores[order]
    found = []
    for low, high in windows:
        start = int(np.searchsorted(-scores, -high)) if low <= high else len(scores)
        stop = min(start + k, int(np.searchsorted(-scores, -low, side="right")))
        found.append([(int(lists.ids[p]), int(s)) for p, s in zip(places[start:stop], scores[start:stop], strict=True)])
    return found


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Slices of equal ``block`` and ``kind``, in order."""
    for batch in batches:
        if batch.num_rows:
            keys = np.stack([batch.column("block").to_numpy(), batch.column("kind").to_numpy()])
            edges = (np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist()
            for start, stop in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                yield int(keys[0, start]), int(keys[1, start]), batch.slice(start, stop - start)


def _over_blocks(search: Callable[[Block, pa.RecordBatch], dict], by_label: bool, schema: pa.Schema):
    """Per task: gather a block's rows, then run ``search`` for each batch of anchors that follows them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, block = None, [], None
        for number, kind, batch in _runs(batches):
            if number != at:
                at, parts, block = number, [], None
            if kind == 0:
                parts.append(batch)
            elif parts:
                block = block or Block(parts, by_label)
                yield pa.RecordBatch.from_pydict(search(block, batch), schema=schema)

    return run


def _blocked(rows: DataFrame, anchors: DataFrame, blocks: int) -> DataFrame:
    """Rows of a block, then all anchors, in one partition for each block (``kind`` 0 and 1)."""
    dealt = rows.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
        F.lit(0).alias("kind"),
        F.col("vec_id").alias("id"),
        "label",
        "vector",
        F.lit(None).cast("array<struct<id:bigint,score:bigint>>").alias("positives"),
    )
    asking = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "label", "vector", "positives"
    )
    return dealt.unionByName(asking).repartitionByRange(blocks, "block").sortWithinPartitions("block", "kind")


def _ask_positives(k: int):
    schema = pa.schema([("anchor_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def search(block: Block, batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in schema.names}
        matrix = _matrix(batch.column("vector"), block.matrix.shape[1])
        kind = block.number(matrix)
        for anchor_id, label, anchor in zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), matrix.astype(kind), strict=True):
            for found, score in _positives(block.lists(kind, label), anchor_id, anchor, k):
                out["anchor_id"].append(anchor_id)
                out["id"].append(found)
                out["score"].append(score)
        return out

    return _over_blocks(search, True, schema)


def _ask_negatives(k: int, low: int, high: int):
    schema = pa.schema([(n, pa.int64()) for n in ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")])

    def search(block: Block, batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in schema.names}
        matrix = _matrix(batch.column("vector"), block.matrix.shape[1])
        kind = block.number(matrix)
        columns = [batch.column(n).to_pylist() for n in ("id", "label", "positives")]
        for anchor_id, label, positives, anchor in zip(*columns, matrix.astype(kind), strict=True):
            windows = _windows([p["score"] for p in positives], low, high)
            for positive, negatives in zip(positives, _negatives(block.lists(kind, None), label, anchor, windows, k), strict=True):
                for found, score in negatives:
                    for name, value in zip(schema.names, (anchor_id, positive["id"], positive["score"], found, score), strict=True):
                        out[name].append(value)
        return out

    return _over_blocks(search, False, schema)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the anchors among ``rows``.

    ``rows`` are those of ``quantised``. ``rank`` numbers the negatives of an
    anchor and positive from 1.
    """
    spark = rows.sparkSession
    rows = saved(rows.select("vec_id", "label", "vector"), "negatives-rows")
    count = rows.count()
    # As many blocks as the cluster has cores, if these are not too small; more, if they would be too large.
    blocks = max(1, -(-count // MOST_BLOCK), min(spark.sparkContext.defaultParallelism, -(-count // LEAST_BLOCK)))
    none = F.lit(None).cast("array<struct<id:bigint,score:bigint>>")
    asking = rows.filter(is_anchor).select(F.col("vec_id").alias("id"), "label", "vector", none.alias("positives"))
    found = _blocked(rows, asking, blocks).mapInArrow(_ask_positives(positives), "anchor_id bigint, id bigint, score bigint")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    best = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    listed = best.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    asking = saved(asking.drop("positives").join(listed, "id"), "negatives-anchors")
    ddl = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    found = _blocked(rows, asking, blocks).mapInArrow(_ask_negatives(negatives, low, high), ddl)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
