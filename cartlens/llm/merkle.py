"""Merkle manifest of a dataset as a postorder append log.

A row is a leaf, the digest of its column values. The leaves of a group, in the order of their id, form a tree in
which runs of eight nodes become one, and the group's roots form one more tree in the same way. A log lists the
nodes of a tree in the order in which they are completed: a node stands behind everything below it, so its place
follows from the sizes of the complete subtrees before it and needs no index.

Builders are aligned to blocks of 8**4 nodes: each appends the nodes of its block to a segment of the log,
independently of all others, and only the root of a segment goes on to the next round (4,096 times fewer rows each).
Proofs run the other way: a segment's root gets its siblings from the segment above it, and a row finds its own in its
segment by closed-form place. Numbers inside a group come from a distributed ranking, so a group may hold any share
of the rows, and no task holds more than a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.operators.ordered import ordered_scan
from cartlens.staging import stage

FANOUT = 8
LEVELS = 4
BLOCK = FANOUT**LEVELS

_SEGMENT = "tree string, block long, nodes long, leaves long, log array<string>, places array<long>"
_PATH = "array<struct<before: string, after: string>>"


# --- one tree ----------------------------------------------------------------------------------------------------


def leaf_place(index: int) -> int:
    """Place in the log of leaf ``index``: every base-8 digit counts complete subtrees of its level's size."""
    place, size = 0, 1
    while index:
        index, digit = divmod(index, FANOUT)
        place += digit * size
        size = size * FANOUT + 1
    return place


def node_place(level: int, index: int, leaves: int) -> int:
    """Place of node ``index`` of ``level``: it is completed right after the lower nodes above its last leaf."""
    return leaf_place(min((index + 1) * FANOUT**level, leaves) - 1) + level


def levels_of(nodes: int) -> int:
    """Levels above ``nodes`` nodes until one is left."""
    level = 0
    while FANOUT**level < nodes:
        level += 1
    return level


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def append_nodes(nodes: Sequence[str], levels: int) -> list[str]:
    """The log of a tree over ``nodes``: nodes in the order of completion, up to ``levels``."""
    log: list[str] = []
    runs: list[list[str]] = [[] for _ in range(levels + 1)]
    for number, node in enumerate(nodes, 1):
        log.append(node)
        runs[0].append(node)
        for level in range(levels):
            if len(runs[level]) < FANOUT and number < len(nodes):
                break
            node = digest("".join(runs[level]))
            runs[level].clear()
            runs[level + 1].append(node)
            log.append(node)
    return log


def path_in(log: Sequence[str], index: int, leaves: int, levels: int) -> list[dict[str, str]]:
    """Digests before and after leaf ``index`` in its run, and so on for the node of each level above."""
    path = []
    for level in range(levels):
        count = -(-leaves // FANOUT**level)
        first = index - index % FANOUT
        run = [log[node_place(level, k, leaves)] for k in range(first, min(first + FANOUT, count))]
        path.append({"before": "".join(run[: index - first]), "after": "".join(run[index - first + 1 :])})
        index //= FANOUT
    return path


def _segment_levels(nodes: int) -> int:
    return min(LEVELS, levels_of(nodes))


# --- the log of many trees ---------------------------------------------------------------------------------------


def _build(level: int):
    """Builder of the segments whose lowest nodes are of ``level``."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("index").to_numpy())))
        tree, block = table.column("tree")[0].as_py(), table.column("block")[0].as_py()
        nodes, leaves = table.column("nodes")[0].as_py(), table.column("leaves")[0].as_py()
        levels = _segment_levels(nodes)
        log = append_nodes(table.column("digest").to_pylist(), levels)
        held = table.num_rows
        places: list[int | None] = [None] * len(log)
        for up in range(levels + 1):
            first = (block * BLOCK) // FANOUT**up
            for k in range(-(-held // FANOUT**up)):
                # The lowest nodes of a later round stand in the log already.
                places[node_place(up, k, held)] = None if level and not up else node_place(level + up, first + k, leaves)
        row = {"tree": tree, "block": block, "nodes": nodes, "leaves": leaves, "log": log, "places": places}
        return pa.table({name: [value] for name, value in row.items()}, schema=SEGMENT_SCHEMA)

    return run


SEGMENT_SCHEMA = pa.schema(
    [
        ("tree", pa.string()),
        ("block", pa.int64()),
        ("nodes", pa.int64()),
        ("leaves", pa.int64()),
        ("log", pa.list_(pa.string())),
        ("places", pa.list_(pa.int64())),
    ]
)


def build_log(leaves: DataFrame) -> list[DataFrame]:
    """Segments of the log, one table a round, of the trees in ``leaves`` (tree, index from 0, nodes: leaves of the
    tree, digest). ``places`` are the places of a segment's nodes in the log of the whole tree."""
    most = leaves.agg(F.max("nodes")).first()[0] or 0
    nodes, rounds = leaves.select("tree", "index", "nodes", F.col("nodes").alias("leaves"), "digest"), []
    while True:
        blocks = nodes.withColumn("block", F.floor(F.col("index") / BLOCK))
        segments = blocks.groupBy("tree", "block").applyInArrow(_build(LEVELS * len(rounds)), _SEGMENT)
        rounds.append(stage(segments, "segments"))
        if most <= BLOCK:
            return rounds
        most = -(-most // BLOCK)
        nodes = _segment_roots(rounds[-1])


def _segment_roots(segments: DataFrame) -> DataFrame:
    """Roots of the segments as the nodes of the next round."""
    return segments.where(F.col("nodes") > BLOCK).select(
        "tree",
        F.col("block").alias("index"),
        F.ceil(F.col("nodes") / BLOCK).alias("nodes"),
        "leaves",
        F.element_at("log", -1).alias("digest"),
    )


def tree_roots(rounds: Sequence[DataFrame]) -> DataFrame:
    """tree and its root."""
    found = None
    for segments in rounds:
        last = segments.where(F.col("nodes") <= BLOCK).select("tree", F.element_at("log", -1).alias("root"))
        found = last if found is None else found.unionByName(last)
    return found


def whole_log(rounds: Sequence[DataFrame]) -> DataFrame:
    """tree, place and digest of every node: the append log itself."""
    found = None
    for segments in rounds:
        rows = segments.select("tree", F.inline(F.arrays_zip(F.col("places").alias("place"), F.col("log").alias("digest"))))
        rows = rows.where(F.col("place").isNotNull())
        found = rows if found is None else found.unionByName(rows)
    return found


def _prove(names: Sequence[str], schema: pa.Schema):
    def run(rows: pa.Table, segment: pa.Table) -> pa.Table:
        log, above = segment.column("log")[0].as_py(), segment.column("above")[0].as_py()
        block, nodes = segment.column("block")[0].as_py(), segment.column("nodes")[0].as_py()
        held, levels = min(BLOCK, nodes - block * BLOCK), _segment_levels(nodes)
        paths = [path_in(log, i - block * BLOCK, held, levels) + above for i in rows.column("index").to_pylist()]
        roots = [segment.column("tree_root")[0].as_py()] * len(paths)
        columns = [*[rows.column(n) for n in names], pa.array(roots, pa.string()), pa.array(paths, schema.field("path").type)]
        return pa.Table.from_arrays(columns, schema=schema)

    return run


def _paths(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """``rows`` (tree, index and more) with ``tree_root`` and ``path``; ``segments`` have ``above``, the path of their
    root, and ``tree_root``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    nothing = F.lit(None)
    schema = rows.select("*", nothing.cast("string").alias("tree_root"), nothing.cast(_PATH).alias("path")).schema
    left = rows.withColumn("block", F.floor(F.col("index") / BLOCK))
    right = segments.select("tree", "block", "nodes", "log", "above", "tree_root")
    both = left.groupBy("tree", "block").cogroup(right.groupBy("tree", "block"))
    return both.applyInArrow(_prove(rows.columns, to_arrow_schema(schema)), schema)


def paths_to_root(rows: DataFrame, rounds: Sequence[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """``rows`` (tree, index and more) with ``tree_root`` and ``path``: digests before and after the node in its run,
    level by level up to the root of its tree. ``above`` (tree, above) is what follows there. An index may come once,
    as a task holds all rows of a block."""
    nothing = F.array().cast(_PATH)
    ends = tree_roots(rounds).withColumnRenamed("root", "tree_root")
    ends = ends.withColumn("above", nothing) if above is None else ends.join(above, "tree")
    upper: DataFrame | None = None
    for number in range(len(rounds) - 1, 0, -1):
        below = rounds[number - 1].where(F.col("nodes") > BLOCK).select("tree", F.col("block").alias("index"))
        upper = stage(_paths(below, _with_above(rounds[number], ends, upper)), "paths")
    return _paths(rows, _with_above(rounds[0], ends, upper))


def _with_above(segments: DataFrame, ends: DataFrame, upper: DataFrame | None) -> DataFrame:
    """Segments with the path of their root: the tree's own, or what the round above has found."""
    last = segments.where(F.col("nodes") <= BLOCK).join(ends, "tree")
    if upper is None:
        return last
    found = upper.select("tree", F.col("index").alias("block"), "tree_root", F.col("path").alias("above"))
    return last.unionByName(segments.where(F.col("nodes") > BLOCK).join(found, ["tree", "block"]))


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof(path: Column) -> Column:
    """All siblings of a path, level by level, from left to right."""
    return F.concat_ws("", F.transform(path, lambda step: F.concat(step["before"], step["after"])))


# --- a dataset ---------------------------------------------------------------------------------------------------


def leaf_digest(columns: Sequence[Column]) -> Column:
    """sha256 of the values: ``-`` for null, else UTF-8 bytes, a colon and the value as text."""
    parts = []
    for column in columns:
        value = column.cast("string")
        counted = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        parts.append(F.coalesce(counted, F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


@dataclass
class Manifest:
    """``leaves``: tree, index, nodes, digest, kept columns. ``rounds``: segments of the groups' trees; ``top``: of the
    tree over their roots. ``subroots``: tree, index, nodes (groups), digest."""

    leaves: DataFrame
    rounds: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]

    def root(self) -> DataFrame:
        """The root of all as one row; none for an empty table."""
        return tree_roots(self.top).select("root")

    def log(self) -> DataFrame:
        """tree (``=`` and the group, empty for the null group), place, digest of every node below the groups' roots."""
        return whole_log(self.rounds)

    def proofs(self) -> DataFrame:
        """``leaves`` with ``subroot``, ``root`` and ``path`` (from the leaf to the root) of every row."""
        groups = self.subroots.select(F.col("tree").alias("group"), F.lit("").alias("tree"), "index")
        upper = paths_to_root(groups, self.top).select(F.col("group").alias("tree"), F.col("path").alias("above"))
        rows = paths_to_root(self.leaves, self.rounds, stage(upper, "above")).withColumnRenamed("tree_root", "subroot")
        return rows.join(F.broadcast(self.root()), F.lit(True))  # one row


def build_manifest(
    docs: DataFrame,
    *,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group: str = "lang",
    order: str = "doc_id",
    keep: Mapping[str, Column] | None = None,
) -> Manifest:
    """The manifest of ``docs``: one tree a value of ``group`` over the rows by ``order``, and one over the groups by name.

    The null group comes first, null ids come last in their group, and rows with equal ids follow by their digest.
    Repeated rows are leaves of their own. A group of one row has the leaf as its root, an empty table has no root.
    Texts of any length are hashed whole. Only ``columns``, ``group``, ``order`` and the expressions of ``keep`` are
    read, so names of other columns do not matter; ``keep`` must not name tree, index, nodes or digest.
    """
    keep = dict(keep or {})
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"),
        F.col(order).alias("_order"),
        leaf_digest([F.col(f"`{c}`") for c in columns]).alias("digest"),
        F.monotonically_increasing_id().alias("_row"),  # cuts even a row that repeats without end
        *[column.alias(name) for name, column in keep.items()],
    )
    numbered = ordered_scan(
        rows,
        [("_order", True), ("digest", True), ("_row", True)],
        within=["tree"],
        row="_number",
        rows_total="nodes",
        repeatable=False,
    )
    leaves = stage(
        numbered.select("tree", (F.col("_number") - 1).alias("index"), "nodes", "digest", *keep), "leaves"
    )
    rounds = build_log(leaves)
    roots = tree_roots(rounds)
    ranked = ordered_scan(roots, [("tree", True)], row="_number", repeatable=True)
    count = roots.agg(F.count(F.lit(1)).alias("nodes"))
    subroots = stage(
        ranked.join(F.broadcast(count), F.lit(True)).select(  # one row
            "tree", (F.col("_number") - 1).alias("index"), "nodes", F.col("root").alias("digest")
        ),
        "subroots",
    )
    return Manifest(leaves, rounds, subroots, build_log(subroots.withColumn("tree", F.lit(""))))
