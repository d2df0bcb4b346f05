"""Hard negatives against all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartlens.llm import hard_negatives
from cartlens.llm.hard_negatives import mine_negatives, spanning_tree, walk


def brute(rows, anchor, scale=256, n_pos=5, n_neg=10, low=30, high=90):
    """(anchor, positive, rank, negative, scores) over all pairs, with whole numbers of any size."""
    kept = []
    for i, v, y in {(i, None if v is None else tuple(v), y) for i, v, y in rows}:
        if i is None or y is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((i, [int(np.floor(scale * x)) for x in v], y))
    out = []
    for i, v, y in kept:
        if not anchor(i):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in kept))
        for s, j, z in [r for r in scored if r[2] == y and r[1] != i][:n_pos]:
            window = [r for r in scored if r[2] != y and low * -s <= 100 * -r[0] <= high * -s][:n_neg]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k, _) in enumerate(window, 1)]
    return sorted(out)


def mined(spark, rows, anchor, **options):
    table = spark.createDataFrame(
        [(i, v, y, 1, 2.0) for i, v, y in rows],
        "vec_id long, embedding array<double>, label int, score int, v double",
    ).repartition(5)
    found = mine_negatives(table, anchor, **options)
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[n] for n in names) for r in found.collect())


def clustered(n, seed, labels=4, width=6):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(labels + 2, width))
    return [
        (int(k), (centres[k % len(centres)] + 0.2 * draw.normal(size=width)).tolist(), int(draw.integers(labels)))
        for k in range(n)
    ]


@pytest.mark.parametrize(("block", "chunk"), [(4096, 4096), (7, 16)])
def test_against_all_pairs(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "CHUNK_ROWS", chunk)
    rows = clustered(300, 1)
    got = mined(spark, rows, F.col("vec_id") % 10 == 0)
    assert got == brute(rows, lambda i: i % 10 == 0) and len(got) > 100


def test_ties_repeats_nulls_and_short_vectors(spark):
    nan = float("nan")
    rows = [(i, [1.0, 0.5], i % 2) for i in range(12)] + [(i, [0.25], i % 3) for i in range(12, 24)]
    rows += [(i, [0.5, 0.25, 0.0], 1) for i in range(24, 30)] + rows[:4]
    rows += [(30, None, 1), (31, [1.0, None], 1), (32, [nan, 1.0], 1), (33, [1.0, float("inf")], 0), (34, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (35, [], 1), (36, [-1.0, -0.5], 0)]
    got = mined(spark, rows, F.col("vec_id") % 5 == 0)
    assert got == brute(rows, lambda i: i % 5 == 0) and got


def test_scores_beyond_doubles_and_empty_table(spark):
    rows = [(i, [float(3**19 + 7 * i), float(i)], i % 2) for i in range(20)]
    got = mined(spark, rows, F.col("vec_id") % 4 == 0, scale=1, high=100)
    assert got == brute(rows, lambda i: i % 4 == 0, scale=1, high=100) and got
    assert mined(spark, [], F.col("vec_id") % 4 == 0) == []
    assert mined(spark, rows, F.lit(False)) == []


def test_tree_and_walk():
    v = np.array([[0, 0], [0, 3], [10, 0], [10, 1], [0, 0]])
    parent, edge = spanning_tree(v)
    assert edge.sum() == pytest.approx(0 + 3 + 10 + 1) and (parent < 0).sum() == 1
    order = walk(parent)
    assert sorted(order) == [0, 1, 2, 3, 4] and all(parent[k] < 0 or order.index(parent[k]) < order.index(k) for k in order)
    # At most log2(n) + 1 parents are open at once.
    n = 200
    parent, _ = spanning_tree(np.random.default_rng(2).integers(0, 50, (n, 3)))
    order = walk(parent)
    last = {int(parent[k]): place for place, k in enumerate(order) if parent[k] >= 0}
    place = {k: p for p, k in enumerate(order)}
    assert max(sum(place[k] < p <= end for k, end in last.items()) for p in range(n)) <= 1 + np.log2(n)


def test_bounds_save_products():
    """In close clusters most rows are settled by bounds alone."""
    draw = np.random.default_rng(3)
    centres = draw.integers(-1000, 1000, (8, 16))
    v = centres[np.arange(2000) % 8] + draw.integers(-3, 4, (2000, 16))
    labels = np.arange(2000) % 8
    anchors = np.arange(0, 2000, 20)
    parent, edge = spanning_tree(v[anchors])
    order = walk(parent)
    step = {k: s for s, k in enumerate(order)}
    block = hard_negatives.Block(
        anchors[order], labels[anchors[order]], v[anchors[order]], np.array([step[parent[k]] if parent[k] >= 0 else -1 for k in order]), edge[order]
    )
    chunk = hard_negatives.Chunk(np.arange(2000), labels, v, 1100)
    seen = {}

    def needed(k, low, high):
        exact = v @ block.v[k]
        assert (low <= exact).all() and (exact <= high).all()
        return high >= 0.95 * exact.max()

    def found(k, at, scores):
        seen[k] = dict(zip(at.tolist(), scores.tolist(), strict=True))
        assert (scores == v[at] @ block.v[k]).all()

    products = hard_negatives.sweep(chunk, block, block.last_use(), needed, found)
    assert products < 0.5 * len(anchors) * 2000
    for k in range(len(anchors)):
        exact = v @ block.v[k]
        assert {int(j) for j in np.flatnonzero(exact >= 0.95 * exact.max())} <= set(seen[k])


def test_matrix_fills_short_rows():
    assert hard_negatives.matrix(pa.array([[1, 2], [], [3]], pa.list_(pa.int64())), 2).tolist() == [[1, 2], [0, 0], [3, 0]]
