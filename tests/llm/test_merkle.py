"""The manifest against a plain recursive tree."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from cartlens.llm import merkle, queries

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf(values):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values]
    return digest("".join(parts))


def levels(nodes):
    """All levels of a tree, leaves first."""
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([digest("".join(found[-1][i : i + 8])) for i in range(0, len(found[-1]), 8)])
    return found


def siblings(tree, index):
    out = []
    for row in tree[:-1]:
        first = index - index % 8
        out.append((index - first, [d for k, d in enumerate(row[first : first + 8]) if k != index - first]))
        index //= 8
    return out


def fold(node, steps):
    for place, others in steps:
        node = digest("".join([*others[:place], node, *others[place:]]))
    return node


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of every row."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is None, row[0], leaf(row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: (x[0], x[1] or 0, x[2]))]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for number, g in enumerate(names):
        for index, (_, doc_id, own, row) in enumerate(sorted(groups[g], key=lambda x: (x[0], x[1] or 0, x[2]))):
            steps = siblings(trees[g], index) + siblings(top, number)
            seen = own
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and row[4] is not None:
                seen = leaf((*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])))
            root = top[-1][0]
            folded = fold(seen, steps)
            out.append((doc_id, own, trees[g][-1][0], root, digest("".join(d for _, others in steps for d in others)), folded, folded == root))
    return sorted(out, key=str)


def proven(spark, rows):
    """The query's result over other rows."""
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars int, text string, tree string, index int")
    tampered = merkle.leaf_digest([F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if c == "text" else F.col(c) for c in COLUMNS])
    keep = {"doc_id": F.col("doc_id"), "seen": F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, tampered)}
    manifest = merkle.build_manifest(table.repartition(3), keep=keep)
    folded = merkle.fold(F.coalesce("seen", "digest"), F.col("path"))
    found = manifest.proofs().select("doc_id", "digest", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256), folded, folded == F.col("root"))
    return manifest, sorted((tuple(r) for r in found.collect()), key=str)


def documents(n, names=("de", "en", None, "Ü")):
    return [(k, f"s{k % 3}", names[k * k % len(names)], k, f"Text {k} Of IT") for k in range(n)]


MIXED = [
    *documents(40),
    *documents(3),  # repeated rows
    (100, None, "xx", None, None),
    (None, "s", "en", 1, "no id"),
    (101, "", "en", 0, ""),
    (102, "s", "", 5, "ÄÖ Ü"),
    (103, "s", "en", 5, "W" * 300_000),
]


@pytest.mark.parametrize("levels_of_block", [4, 1])
def test_against_plain_trees(spark, monkeypatch, levels_of_block):
    monkeypatch.setattr(merkle, "LEVELS", levels_of_block)
    monkeypatch.setattr(merkle, "BLOCK", 8**levels_of_block)
    _, got = proven(spark, MIXED)
    assert got == brute(MIXED)


def test_one_large_group_in_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = documents(530, ("en",)) + documents(9, ("de",))[1:]
    manifest, got = proven(spark, rows)
    assert got == brute(rows) and len(manifest.rounds) == 4
    assert all(r[-1] or r[1] for r in got)
    # The log holds every node once, in the order of completion.
    tree = levels([x[1] for x in sorted((r[0], leaf(r)) for r in rows if r[2] == "en")])
    want = {}
    for level, row in enumerate(tree):
        for index, node in enumerate(row):
            want[merkle.node_place(level, index, len(tree[0]))] = node
    got_log = {r["place"]: r["digest"] for r in manifest.log().where("tree = '=en'").collect()}
    assert got_log == want and sorted(want) == list(range(sum(map(len, tree))))
    assert manifest.log().where("tree = '=en'").count() == len(want)


def test_places_follow_the_order_of_completion():
    for n in (1, 2, 8, 9, 64, 65, 200):
        tree = levels([str(k) for k in range(n)])
        log = merkle.append_nodes(tree[0], merkle.levels_of(n))
        for level, row in enumerate(tree):
            for index, node in enumerate(row):
                assert log[merkle.node_place(level, index, n)] == node
        assert len(log) == sum(map(len, tree))


def test_empty_table(spark):
    manifest, got = proven(spark, [])
    assert got == [] and manifest.root().count() == 0 and manifest.log().count() == 0


def test_query_against_plain_trees(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS).collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op13_merkle_manifest"](spark, sf_dir).collect()), key=str)
    assert got == brute(rows)
