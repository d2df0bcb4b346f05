"""Hard negatives by spanning-tree bounds.

Anchors are cut into blocks of bounded size, and every block gets a minimum spanning tree over the distances of its
anchors. A task holds a part of all rows. It scores the tree's root exactly; below, the scores at a parent anchor
plus or minus edge distance times a row's norm bound the scores at the child (a row that was not scored at the parent
hands on its bounds). Only rows whose bounds overlap what still matters, the best positives so far or the
windows of the negatives, are scored again. So results are exact, and rows far outside a window cost no product.

The tree is walked smaller subtrees first, and a parent's bounds go before its last child is entered: as many bounds
are held at once as the logarithm of a block's anchors. A block takes two passes over the rows: positives first,
then negatives within the windows that the positives set. Only a block of anchors is broadcast, at most
``BLOCK_ROWS`` rows and ``BLOCK_BYTES``, and a task returns one list of bounded length an anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.operators.ordered import ordered_scan
from cartlens.staging import stage

#: Anchors broadcast at once.
BLOCK_ROWS, BLOCK_BYTES = 4096, 16 << 20
#: Rows that are scored together, and bytes of their components.
CHUNK_ROWS, CHUNK_BYTES = 4096, 16 << 20
#: Sums of products below this are exact as doubles.
EXACT = 2**53
_ROW = "vec_id long, label long, v array<long>"
#: anchor: number of the anchor; place: of the positive among the anchor's.
_NEGATIVE = ("anchor", "place", "anchor_id", "anchor_label", "positive_id", "positive_score", "negative_score", "negative_id")
_NEGATIVE_ROW = ", ".join(f"{name} long" for name in _NEGATIVE)


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers; shorter ones are filled up with zeros, which change no product."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(lists.value_lengths(), np.int64)
    values = np.asarray(lists.flatten(), np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


# --- the tree of a block of anchors --------------------------------------------------------------------------------


def spanning_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent (-1 for the root) and edge distance of every row in a minimum spanning tree."""
    n = len(v)
    x = v.astype(float)
    parent, near = np.full(n, -1), np.full(n, np.inf)
    open_, at = np.ones(n, bool), 0
    for _ in range(n):
        open_[at] = False
        distance = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        closer = open_ & (distance < near)
        near[closer], parent[closer] = distance[closer], at
        if open_.any():
            at = int(np.where(open_, near, np.inf).argmin()) if np.isfinite(near[open_]).any() else int(open_.argmax())
    near[parent < 0] = 0.0
    return parent, near


def walk(parent: np.ndarray) -> list[int]:
    """Parents before children; of several children the one with the largest subtree last."""
    children: list[list[int]] = [[] for _ in parent]
    roots = [k for k, p in enumerate(parent) if p < 0]
    for k, p in enumerate(parent):
        if p >= 0:
            children[p].append(k)
    down, todo = [], list(roots)
    while todo:
        k = todo.pop()
        down.append(k)
        todo.extend(children[k])
    size = [1] * len(parent)
    for k in reversed(down):
        if parent[k] >= 0:
            size[parent[k]] += size[k]
    order, todo = [], list(roots)
    while todo:
        k = todo.pop()
        order.append(k)
        todo.extend(sorted(children[k], key=size.__getitem__, reverse=True))  # the smallest is taken first
    return order


def _span(table: pa.Table) -> pa.Table:
    """The anchors of a block in walking order, with ``step``, ``parent`` (a step) and ``edge``."""
    table = table.sort_by([("vec_id", "ascending"), ("label", "ascending")])
    width = max(1, max((len(v) for v in table.column("v").to_pylist()), default=1))
    parent, edge = spanning_tree(matrix(table.column("v"), width))
    order = walk(parent)
    step = {k: s for s, k in enumerate(order)}
    taken = table.take(pa.array(order, pa.int64()))
    above = [step[parent[k]] if parent[k] >= 0 else -1 for k in order]
    return pa.table(
        {
            "block": taken.column("block"),
            "step": pa.array(range(len(order)), pa.int32()),
            "parent": pa.array(above, pa.int32()),
            "edge": pa.array(edge[order], pa.float64()),
            "vec_id": taken.column("vec_id"),
            "label": taken.column("label"),
            "v": taken.column("v"),
        }
    )


@dataclass
class Block:
    """Anchors in walking order. ``wanted`` has the (positive, its score) pairs of every anchor in the second pass."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    parent: np.ndarray
    edge: np.ndarray
    wanted: list[list[tuple[int, int]]] | None = None

    def last_use(self) -> np.ndarray:
        """The last child of every anchor, after which its bounds are no longer needed."""
        last = np.full(len(self.ids), -1)
        for step, p in enumerate(self.parent):
            if p >= 0:
                last[p] = step
        return last


def _read_block(trees: DataFrame, number: int, width: int) -> Block:
    rows = trees.where(F.col("block") == number).orderBy("step").toArrow()
    names = ("vec_id", "label", "parent", "edge")
    ids, labels, parent, edge = (rows.column(n).to_numpy() for n in names)
    return Block(ids, labels, matrix(rows.column("v"), width), parent, edge)


# --- rows against a block ------------------------------------------------------------------------------------------


class Chunk:
    """Rows that are scored together."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, most: int) -> None:
        self.ids, self.labels = ids, labels
        self.exact = most * most * v.shape[1] < EXACT
        self.v = v.astype(float) if self.exact else v.astype(object)
        self.norms = np.sqrt((v.astype(float) ** 2).sum(axis=1))

    def scores(self, anchor: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
        """Exact inner products with the rows ``at``."""
        if self.exact:
            return self.v[at] @ anchor.astype(float)
        return (self.v[at] * anchor.astype(object)).sum(axis=1)


def sweep(chunk: Chunk, block: Block, last: np.ndarray, needed: Callable, found: Callable) -> int:
    """Walk the tree over a chunk. ``needed(step, low, high)`` says which rows still matter, given their bounds;
    ``found(step, at, scores)`` takes the exact scores of these. Returns the number of products computed."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    everything, products = np.arange(len(chunk.ids)), 0
    for step, parent in enumerate(block.parent):
        anchor = block.v[step]
        if parent < 0 or not chunk.exact:
            at = everything
            low = high = scores = chunk.scores(anchor, slice(None))
            mask = needed(step, low, high)
            found(step, at[mask], scores[mask])
        else:
            low, high = held[parent]
            if last[parent] == step:
                del held[parent]
            # Rounding is allowed for; the anchor's own norm bounds a score as well.
            reach = block.edge[step] * chunk.norms * (1 + 1e-9) + 1e-3
            whole = np.sqrt((anchor.astype(float) ** 2).sum()) * chunk.norms * (1 + 1e-9) + 1e-3
            low, high = np.maximum(low - reach, -whole), np.minimum(high + reach, whole)
            at = np.flatnonzero(needed(step, low, high))
            if 2 * len(at) > len(everything):
                scores = chunk.scores(anchor, slice(None))[at]
            else:
                scores = chunk.scores(anchor, at)
            low[at] = high[at] = scores
            found(step, at, scores)
        products += len(at)
        if last[step] >= 0:
            held[step] = (low, high)
    return products


def chunks(source: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[Chunk]:
    """Rows (vec_id, label, v) in chunks of bounded size."""
    limit = max(1, min(CHUNK_ROWS, CHUNK_BYTES // (8 * width)))
    parts: list[tuple] = []
    count = 0
    for batch in source:
        for start in range(0, batch.num_rows, limit):
            piece = batch.slice(start, limit)
            if count and count + piece.num_rows > limit:
                yield Chunk(*map(np.concatenate, zip(*parts, strict=True)), most)
                parts, count = [], 0
            if piece.num_rows:
                values = piece.column("v"), piece.column("vec_id"), piece.column("label")
                parts.append((np.asarray(values[1]), np.asarray(values[2]), matrix(values[0], width)))
                count += piece.num_rows
    if count:
        yield Chunk(*map(np.concatenate, zip(*parts, strict=True)), most)


class Best:
    """The first ``n`` (score, id) pairs: higher scores first, then smaller ids."""

    def __init__(self, n: int) -> None:
        self.n, self.rows = n, []

    def least(self) -> float:
        """Scores below this no longer enter."""
        return self.rows[-1][0] if len(self.rows) == self.n else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """New pairs, first ones first."""
        fresh = list(zip(scores[: self.n].tolist(), ids[: self.n].tolist(), strict=True))
        if fresh:
            self.rows = sorted(self.rows + fresh, key=lambda r: (-r[0], r[1]))[: self.n]


def _first(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda k: (-scores[k], ids[k])), int)
    return np.lexsort((ids, -scores))


def _positives(shared, n: int, width: int, most: int):
    """Task of the first pass: the best rows with the anchor's label."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        last, best = block.last_use(), [Best(n) for _ in block.ids]
        for chunk in chunks(source, width, most):

            def needed(step, low, high, chunk=chunk):
                mine = (chunk.labels == block.labels[step]) & (chunk.ids != block.ids[step])
                return mine & (high >= best[step].least())

            def found(step, at, scores, chunk=chunk):
                order = _first(scores, chunk.ids[at])
                best[step].add(scores[order], chunk.ids[at][order])

            sweep(chunk, block, last, needed, found)
        rows = [(k, int(score), row) for k, b in enumerate(best) for score, row in b.rows]
        yield from _as_batches(rows, {"step": pa.int32(), "score": pa.int64(), "id": pa.int64()})

    return run


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and largest score s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def _negatives(shared, number: int, n: int, low_percent: int, high_percent: int, width: int, most: int):
    """Task of the second pass over block ``number``: the best rows of other labels in the window of each positive."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        last = block.last_use()
        windows = [[window(score, low_percent, high_percent) for _, score in pairs] for pairs in block.wanted]
        best = [[Best(n) for _ in pairs] for pairs in block.wanted]
        for chunk in chunks(source, width, most):

            def needed(step, low, high, chunk=chunk):
                least = min((max(a, b.least()) for (a, z), b in zip(windows[step], best[step], strict=True) if a <= z), default=np.inf)
                largest = max((z for a, z in windows[step] if a <= z), default=-np.inf)
                return (chunk.labels != block.labels[step]) & (high >= least) & (low <= largest)

            def found(step, at, scores, chunk=chunk):
                order = _first(scores, chunk.ids[at])
                scores, ids = scores[order], chunk.ids[at][order]
                for (a, z), b in zip(windows[step], best[step], strict=True):
                    lo, hi = np.searchsorted(-scores, -z), np.searchsorted(-scores, -a, side="right")
                    b.add(scores[lo:hi], ids[lo:hi])

            sweep(chunk, block, last, needed, found)
        rows = [
            (number * BLOCK_ROWS + k, place, int(block.ids[k]), int(block.labels[k]), positive, positive_score, int(score), row)
            for k, pairs in enumerate(block.wanted)
            for place, ((positive, positive_score), b) in enumerate(zip(pairs, best[k], strict=True))
            for score, row in b.rows
        ]
        yield from _as_batches(rows, dict.fromkeys(_NEGATIVE, pa.int64()))

    return run


def _as_batches(rows: list[tuple], fields: dict[str, pa.DataType], limit: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for start in range(0, max(1, len(rows)), limit):
        part = rows[start : start + limit]
        columns = [pa.array([r[k] for r in part], kind) for k, kind in enumerate(fields.values())]
        yield pa.RecordBatch.from_arrays(columns, names=list(fields))


def mine_negatives(
    rows: DataFrame,
    anchors: Column,
    *,
    row_id: str = "vec_id",
    vector: str = "embedding",
    label: Column | str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
) -> DataFrame:
    """anchor_id, anchor_label, positive_id, rank, negative_id, positive_score, negative_score (integer products of
    the quantised vectors).

    An anchor (a row where ``anchors`` holds) has its first ``positives`` other rows of its label as positives; each of
    them gets its first ``negatives`` rows of other labels whose score lies between ``low`` and ``high`` percent of the
    positive's. Higher scores come first, then smaller ids; fewer are returned where there are fewer.

    Rows without id, label or vector, or with a component that is null or not finite, take no part. Equal rows count
    once; an id may have several different rows, which then are not each other's positives. A vector shorter than
    others counts as filled up with zeros. Scores and ``scale`` times components must fit 64 bits. An empty table gives
    no rows.
    Only the three columns and ``anchors`` are read, so names of other columns do not matter.
    """
    spark = rows.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    vectors = stage(
        rows.where(F.col(row_id).isNotNull() & label.isNotNull() & usable(F.col(vector)))
        .select(
            F.col(row_id).cast("long").alias("vec_id"),
            label.cast("long").alias("label"),
            quantised(F.col(vector), scale).alias("v"),
            anchors.alias("anchor"),
        )
        .distinct(),
        "vectors",
    )
    most = F.greatest(F.array_max("v"), -F.array_min("v"))
    facts = vectors.agg(F.max(F.size("v")).alias("width"), F.max(most).alias("most")).first()
    width, most = max(1, facts["width"] or 1), facts["most"] or 0
    size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * width)))
    numbered = ordered_scan(
        vectors.where("anchor").select("vec_id", "label", "v"),
        [("vec_id", True), ("label", True)],
        row="_number",
        rows_total="_rows",
        repeatable=True,
    ).withColumn("block", F.floor((F.col("_number") - 1) / size).cast("int"))
    spanned = numbered.select("block", "vec_id", "label", "v").groupBy("block").applyInArrow(
        _span, f"block int, step int, parent int, edge double, {_ROW}"
    )
    trees = stage(spanned, "trees")
    blocks = trees.agg(F.coalesce(F.max("block"), F.lit(-1))).first()[0] + 1
    # One wave of tasks a pass: each returns its own best rows, so more tasks would only return more of them.
    candidates = vectors.select("vec_id", "label", "v").coalesce(spark.sparkContext.defaultParallelism)
    out = spark.createDataFrame([], _NEGATIVE_ROW)
    for number in range(blocks):
        block = _read_block(trees, number, width)
        shared = spark.sparkContext.broadcast(block)
        near = candidates.mapInArrow(_positives(shared, positives, width, most), "step int, score long, id long")
        first = Window.partitionBy("step").orderBy(F.desc("score"), "id")
        chosen = near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= positives).orderBy("step", "n")
        block.wanted = [[] for _ in block.ids]
        for step, score, row in zip(*(c.to_pylist() for c in chosen.select("step", "score", "id").toArrow().columns), strict=True):
            block.wanted[step].append((row, score))
        shared = spark.sparkContext.broadcast(block)
        task = _negatives(shared, number, negatives, low, high, width, most)
        out = out.unionByName(stage(candidates.mapInArrow(task, _NEGATIVE_ROW), "negatives"))
    first = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = out.withColumn("rank", F.row_number().over(first))
    return ranked.where(F.col("rank") <= negatives).select(
        "anchor_id", "anchor_label", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )

