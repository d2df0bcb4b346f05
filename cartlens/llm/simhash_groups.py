"""Near-duplicate texts by similarity, exactly: shingle prefixes, an inverted index and count filtering.

Two sets of n and m shingles have a similarity of 0.8 or more where they share at least 4/9 (n + m). In any order of
all shingles, such sets share one of their first fifth, and of the first one they share the places tell how many can
follow. So the index maps the first fifth of a text's five-word shingles to texts, and a pair of a list is dropped
only if too few shingles lie behind the shared one: the guaranteed minimum, which loses no pair. The order is from
rare to frequent, so that common passages come last and seldom count; the frequent ones are found in a sample of
texts, which moves the cost and never the result.

A candidate pair is first held against bitmaps: a text's bitmap has the parity of its shingles in each of some two
places a shingle, so two bitmaps differ in at most as many places as the sets differ in shingles. That drops nearly all
pairs that are not similar, at a few bits a shingle, and none that are. What is left is verified over all distinct
shingles.

Lists of up to ``DENSE`` texts form all pairs. The texts of a longer list are first paired with one hub, the text that
shares the most entries; lists of more than ``BLOCK`` texts that are not one component by then get some more hubs. This
only saves work: all lists that still hold several components form all pairs of texts of different components, in
blocks. Components are found once from the first links; later links join components, not texts.

Groups that another operator has found (SimHash components) can be given: their links count like those found here, and
texts they link already are not compared again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.common import batches, prepare
from cartlens.llm.components import connected_components
from cartlens.llm.simhash import shingle_hashes
from cartlens.staging import stage

WIDTH = 5
DENSE = 16
#: Turns with hubs before all pairs of what is left, hubs of a list in a turn, texts of a block.
TURNS, HUBS, BLOCK = 2, 4, 512
#: 64-bit words of the bitmap that goes with index entries.
NARROW = 16
#: One text of so many is looked through for frequent shingles, of which so many are told apart.
SAMPLED, FREQUENT = 16, 200_000
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _mixed(text: str | None, width: int) -> np.ndarray:
    """Distinct shingle hashes, mixed and sorted."""
    parts = [np.unique(h) for h in shingle_hashes(text, width)]
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return np.sort(h ^ (h >> np.uint64(29)))


def prefix(h: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles, from rare to frequent: one of them is shared with every set of similarity 0.8 or more."""
    if len(frequent) and len(h):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        h = h[np.argsort(np.where(frequent[at] == h, counts[at], 0), kind="stable")]
    return h[: len(h) - (4 * len(h) + 4) // 5 + 1]


def _frequent_shingles(docs: DataFrame, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of three or more sampled texts, sorted, and of how many."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            for t in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_mixed(t, width).view(np.int64))], names=["shingle"])

    sampled = docs.select(F.col(text).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    counted = sampled.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    table = counted.orderBy(F.desc("n")).limit(FREQUENT).toArrow()
    shingles = table.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], table.column("n").to_numpy()[order]


def parities(h: np.ndarray) -> np.ndarray:
    """Bitmap of the parity of the shingles in each place, in words of 64 bits: a power of two of places, at least two a
    shingle. Half as many places are what both halves give when combined by exclusive or."""
    places = 64
    while places < 2 * len(h):
        places *= 2
    odd = np.bincount((h & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


_SKETCH = "row long, a long, b long, n int, keys array<long>, bits array<long>, narrow array<long>"


def _sketches(docs: DataFrame, text: str, width: int) -> DataFrame:
    """``doc`` (all columns as a struct), the number of shingles, the prefix and bitmaps; equal (a, b) means equal words."""
    schema = T.StructType([T.StructField("doc", docs.schema), *T._parse_datatype_string(_SKETCH).fields])
    shared = docs.sparkSession.sparkContext.broadcast(_frequent_shingles(docs, text, width))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = shared.value
        for batch in batches(source):
            words_a, words_b, sizes, keys, bits = [], [], [], [], []
            for t in batch.column("_text").to_pylist():
                words = b" ".join(t.encode().lower().split()) if t else b""
                words_a.append(xxhash.xxh64_intdigest(words, 1))
                words_b.append(xxhash.xxh64_intdigest(words, 2))
                h = _mixed(t, width)
                sizes.append(len(h))
                keys.append(prefix(h, frequent, counts).view(np.int64) if len(h) else [])
                bits.append(parities(h))
            columns = [
                batch.column("doc"),
                batch.column("row"),
                pa.array(np.array(words_a, np.uint64).view(np.int64)),
                pa.array(np.array(words_b, np.uint64).view(np.int64)),
                pa.array(sizes, pa.int32()),
                *[pa.array(v, pa.list_(pa.int64())) for v in (keys, bits, [folded(x, NARROW) for x in bits])],
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "row", "a", "b", "n", "keys", "bits", "narrow"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(text).alias("_text"))
    return packed.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, schema)


def _other(entries: DataFrame, *more: str) -> DataFrame:
    """``entries`` as the second side of a pair."""
    return entries.select("key", *[F.col(c).alias(f"{c}_b") for c in ("row", "n", "i", *more)])


def _possible() -> Column:
    """Whether two texts (n, n_b shingles) can be similar if the first shingle they share is at i and i_b."""
    least = F.expr("(4 * (n + n_b) + 8) div 9")
    return (F.col("i") + least <= F.col("n")) & (F.col("i_b") + least <= F.col("n_b"))


def _alike(bits: str) -> Column:
    """Whether the bitmaps ``bits`` of two texts (n, n_b shingles) differ in no more places than similar sets may.

    Sets that can be similar differ in size by a quarter at most, so that one bitmap is at most twice the other.
    """
    one, two = F.col(bits), F.col(f"{bits}_b")
    words = F.least(F.size(one), F.size(two))

    def half(x: Column) -> Column:
        both = F.zip_with(F.slice(x, F.lit(1), words), F.slice(x, words + 1, words), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > words, both).otherwise(x)

    apart = F.aggregate(
        F.zip_with(half(one), half(two), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, x: total + x
    )
    return apart <= F.expr("n + n_b - 2 * ((4 * (n + n_b) + 8) div 9)")


def _ordered() -> list[Column]:
    return [F.least("row", "row_b").alias("a"), F.greatest("row", "row_b").alias("b")]


def _lists(nodes: DataFrame) -> DataFrame:
    """Index lists (key, row, n, i: place of the key in the text's order, m: texts of the list) of several texts.

    Of lists that hold the very same texts, as all shingles of a shared passage give, the first in the order of the
    shingles stays: the first shingle that two texts share is never in a later list of the same texts. Lists are the
    same if their length and 128 bits of their rows' hashes are.
    """
    postings = nodes.select("row", "n", F.posexplode("keys").alias("i", "key"))
    sizes = postings.groupBy("key").agg(
        F.count(F.lit(1)).alias("m"),
        F.bit_xor(F.xxhash64("row")).alias("one"),
        F.bit_xor(F.xxhash64("row", F.lit(1))).alias("two"),
        F.sum("i").alias("place"),
    )
    first = sizes.where(F.col("m") > 1).groupBy("m", "one", "two").agg(F.min_by("key", "place").alias("key"))
    return stage(postings.join(first.select("key", "m"), "key"), "lists")


def _first_pairs(lists: DataFrame) -> DataFrame:
    """All possible pairs of short lists; of long ones those with the text that shares the most entries."""
    short, long = lists.where(F.col("m") <= DENSE), lists.where(F.col("m") > DENSE)
    pairs = short.join(_other(short), "key").where((F.col("row") < F.col("row_b")) & _possible())
    weighed = long.join(lists.groupBy("row").agg(F.sum("m").alias("weight")), "row")
    hubs = weighed.groupBy("key").agg(F.max(F.struct("weight", "row", "n", "i")).alias("hub")).select("key", "hub.*")
    stars = long.join(_other(hubs), "key").where((F.col("row") != F.col("row_b")) & _possible())
    return pairs.select(*_ordered()).unionByName(stars.select(*_ordered())).distinct()


def _unsettled(long: DataFrame, roots: DataFrame, narrow: DataFrame) -> DataFrame:
    """Entries with ``root`` and ``narrow`` of the lists that hold several components; m: texts of the list."""
    named = long.join(roots.withColumnRenamed("id", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    mixed = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    entries = named.join(mixed.select("key"), "key", "left_semi")
    return stage(entries.join(narrow, "row"), "unsettled")


def _matching() -> Column:
    return _possible() & _alike("narrow")


def _some_pairs(entries: DataFrame, turn: int) -> DataFrame:
    """Pairs of texts with hubs of their list in other components; lists of the same texts have the same hubs."""
    hubs = [
        F.min(F.struct(F.xxhash64("row", F.lit(turn * HUBS + k)).alias("order"), "row", "n", "i", "root", "narrow"))
        for k in range(HUBS)
    ]
    chosen = entries.groupBy("key").agg(F.array_distinct(F.array(*hubs)).alias("hubs")).select("key", F.inline("hubs"))
    found = entries.join(_other(chosen, "root", "narrow"), "key").where((F.col("root") != F.col("root_b")) & _matching())
    return found.select(*_ordered()).distinct()


def _all_pairs(entries: DataFrame) -> DataFrame:
    """All possible pairs of different components. A list is cut into blocks, each of which meets the whole list."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    here = entries.withColumn("block", F.pmod(F.xxhash64("row"), blocks).cast("int"))
    there = entries.select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    other = there.select("block", "key", *[F.col(c).alias(f"{c}_b") for c in ("row", "n", "i", "root", "narrow")])
    found = here.join(other, ["key", "block"]).where((F.col("root") < F.col("root_b")) & _matching())
    return found.select(*_ordered()).distinct()


def _both(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the columns of ``table`` (row and more) for a, and for b with names that end in ``_b``."""
    names = [c for c in table.columns if c != "row"]
    one = table.withColumnRenamed("row", "a")
    two = table.select(F.col("row").alias("b"), *[F.col(c).alias(f"{c}_b") for c in names])
    return pairs.join(one, "a").join(two, "b")


def _verified(pairs: DataFrame, bitmaps: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) of ``texts`` (row, text) with a similarity of 0.8 or more over all distinct shingles."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def shingles(row: int, text: pa.Scalar) -> np.ndarray:
            if row not in held:
                if len(held) >= 64:
                    held.clear()
                held[row] = _mixed(text.as_py(), width)
            return held[row]

        for batch in batches(source):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            similar = []
            for k in range(batch.num_rows):
                x, y = shingles(a[k], batch.column("text")[k]), shingles(b[k], batch.column("text_b")[k])
                inside = len(np.intersect1d(x, y, assume_unique=True))
                similar.append(9 * inside >= 4 * (len(x) + len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(similar))

    alike = stage(_both(pairs, bitmaps).where(_alike("bits")).select("a", "b"), "alike")
    rows = alike.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    needed = texts.join(rows, "row", "left_semi")
    return _both(alike, needed).select("a", "b", "text", "text_b").mapInArrow(run, "a long, b long")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (id, root) after ``links`` (a, b) between texts: only the components of both ends are joined."""
    ends = links
    for end in "ab":
        named = roots.select(F.col("id").alias(end), "root")
        ends = ends.join(named, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    merged = stage(connected_components(ends), "merged")
    to = merged.select(F.col("id").alias("root"), F.col("root").alias("to"))
    moved = roots.join(to, "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    return moved.unionByName(merged.join(roots, "id", "left_anti").select("id", "root"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose ends are not linked by ``roots`` (id, root)."""
    one, two = (roots.select(F.col("id").alias(end), F.col("root").alias(f"root_{end}")) for end in "ab")
    named = pairs.join(one, "a", "left").join(two, "b", "left")
    return named.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def similar_groups(
    nodes: DataFrame, texts: DataFrame, width: int = WIDTH, linked: DataFrame | None = None
) -> DataFrame:
    """id and root (smallest id) of the ``nodes`` (row, n, keys, bits, narrow) that are linked to others.

    ``linked`` (id, root: smallest id) are groups of nodes that are linked beforehand.
    """
    lists, bitmaps = _lists(nodes), nodes.select("row", "n", "bits")
    pairs = _first_pairs(lists)
    if linked is None:
        roots = stage(connected_components(_verified(pairs, bitmaps, texts, width)), "roots")
    else:
        roots = stage(_joined(linked, _verified(_apart(pairs, linked), bitmaps, texts, width)), "roots")
    long, narrow = lists.where(F.col("m") > DENSE), nodes.select("row", "narrow")
    for turn in range(TURNS + 1):
        open_ = _unsettled(long, roots, narrow)
        most = open_.agg(F.max("m")).first()[0] or 0
        if not most:
            break
        with_hubs = turn < TURNS and most > BLOCK
        pairs = _some_pairs(open_.where(F.col("m") > BLOCK), turn) if with_hubs else _all_pairs(open_)
        roots = stage(_joined(roots, _verified(pairs, bitmaps, texts, width)), "roots")
        if not with_hubs:
            break
    return roots


def _linked_nodes(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """id and root (smallest id) of the ``nodes`` (row) that share a component of ``found`` (row, component_id)."""
    named = found.join(nodes.select("row"), "row").select("row", "component_id")
    first = named.groupBy("component_id").agg(F.min("row").alias("root"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return stage(named.join(first, "component_id").select(F.col("row").alias("id"), "root"), "linked")


def one_of_each_group(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    width: int = WIDTH,
    also: Callable[..., DataFrame] | None = None,
) -> DataFrame:
    """``docs`` without the documents that repeat another: of each group the smallest doc_id stays.

    A group holds texts with the same words (A-Z lower-cased, blanks aside) and texts whose five-word shingle sets
    have a similarity of 0.8 or more, over any chain of such texts. Null and empty texts are one group; repeated
    rows are copies; null ids come last in the order; all columns are kept, whatever their names.

    ``also`` is an operator whose groups count as well: called with the texts and ``text`` and ``doc_id`` (here the
    name of a unique row number), it returns that number and a component_id of every row. A chain may have links of
    both kinds.
    """
    prepare(docs.sparkSession)
    rows = stage(_sketches(docs, text, width), "sketches")
    place = F.struct(F.col(f"doc.{doc_id}").isNull().alias("late"), F.col(f"doc.{doc_id}").alias("id"), "row")
    classes = stage(rows.groupBy("a", "b").agg(F.min(place).alias("first")), "classes").select(
        F.col("first.row").alias("row"), "first"
    )
    nodes = rows.select("row", "n", "keys", "bits", "narrow").join(classes.select("row"), "row")
    texts = rows.select("row", F.col(f"doc.{text}").alias("text"))
    linked = _linked_nodes(also(texts, text="text", doc_id="row"), classes) if also else None
    roots = similar_groups(nodes, texts, width, linked).withColumnRenamed("id", "row")
    kept = (
        classes.join(roots, "row", "left")
        .groupBy(F.coalesce("root", "row").alias("root"))
        .agg(F.min("first").alias("first"))
        .select(F.col("first.row").alias("row"))
    )
    return rows.select("row", "doc").join(kept, "row", "left_semi").select("doc.*")
