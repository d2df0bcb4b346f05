"""SimHash near-duplicates over a byte-position inverted index with count filtering.

A fingerprint has 64 bits, eight positional bytes. Two fingerprints that differ in at most two bits differ in at
most two bytes, so six of the eight positional bytes are equal: the guaranteed minimum of the count filter. Cut
into four two-byte blocks, such a pair keeps two whole blocks, so the index has one posting list for every pair
of blocks and its four bytes (six lists a fingerprint). Lists of one fingerprint are dropped; in the others pairs
are formed, their equal positional bytes tallied, pairs below six dropped and the rest verified bit by bit.

A list of more than ``DENSE`` fingerprints (many near copies) forms no pairs. Its fingerprints meet in centres
instead: each is entered under itself and its 64 one-bit neighbours. Two fingerprints within two bits share a
centre, and all fingerprints of a centre (65 at most) are within two bits of each other, so linking each to the
smallest one of the centre keeps every component whole. This way is exact too and linear in the fingerprints.

Texts with equal fingerprints are one node, so exact copies cost no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.common import batches, prepare
from cartlens.llm.components import connected_components
from cartlens.staging import stage

SEED = 42
MAX_BITS = 2
MIN_BYTES = 8 - MAX_BITS
DENSE = 32
# Shingles hashed at once: a bound on memory, texts may be of any length.
_CHUNK = 1 << 16


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles (repeats included), in chunks; one hash of all words if there are fewer.

    Lower-casing and splitting work on bytes: only A-Z change, and only U+0020 and U+0009-U+000D separate.
    """
    words = text.encode().lower().split() if text else []
    n = max(1, len(words) - width + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, _CHUNK):
        part = words[start : start + _CHUNK + width - 1]
        grams = (b" ".join(part[i : i + width]) for i in range(min(_CHUNK, n - start)))
        yield np.fromiter((digest(g, SEED) for g in grams), np.uint64, min(_CHUNK, n - start))


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash; 0 for a text without words. A bit is set if it is set in over half of the hashes."""
    n, ones = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(text, width):
        n += len(hashes)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64) if len(bits) > 255 else bits.sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n).view(np.uint64)[0]) if n else 0


def add_fingerprints(
    docs: DataFrame, *, text: str = "text", keep: Sequence[str] = ("doc_id",), width: int = 3
) -> DataFrame:
    """``keep`` columns and ``fp`` (bigint, the fingerprint's bits) of every row."""
    prepare(docs.sparkSession)
    schema = T.StructType([*[docs.select(k).schema[0] for k in keep], T.StructField("fp", T.LongType())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            prints = np.array([fingerprint(t, width) for t in batch.column(text).to_pylist()], np.uint64)
            columns = [*[batch.column(k) for k in keep], pa.array(prints.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "fp"])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def _byte(column, position: int):
    return F.shiftrightunsigned(column, 8 * position).bitwiseAND(F.lit(255))


def link_fingerprints(prints: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of ``prints`` (fp) that differ in at most two bits.

    All links of sparse lists; of dense lists as many as keep their components whole.
    """
    blocks = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = [
        F.shiftleft(F.lit(number).cast("long"), 32) + F.shiftleft(blocks[i], 16) + blocks[j]
        for number, (i, j) in enumerate(combinations(range(4), 2))
    ]
    postings = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    live = stage(postings.join(sizes, "key"), "postings")

    sparse = live.where(F.col("n") <= DENSE)
    other = sparse.select("key", F.col("fp").alias("b"))
    a, b = F.col("fp"), F.col("b")
    tally = sum((_byte(a, p) == _byte(b, p)).cast("int") for p in range(8))
    pairs = (
        sparse.join(other, "key")
        .where((a < b) & (tally >= MIN_BYTES))
        .where(F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS)
        .select(a.alias("a"), "b")
    )

    dense = live.where(F.col("n") > DENSE).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), i) for i in range(64)])
    centres = dense.select("fp", F.explode(flips).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre")
    )
    least = centres.groupBy("centre").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    stars = centres.join(least, "centre").where(F.col("fp") != F.col("a")).select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", width: int = 3) -> DataFrame:
    """doc_id, fp (bigint) and component_id (smallest doc_id reachable over links) of every row.

    Null and empty texts have fingerprint 0 and are linked like any other; repeated ids keep their rows; a null id
    never names a component unless all its documents lack an id; other columns are not read.
    """
    rows = stage(add_fingerprints(docs, text=text, keep=(doc_id,), width=width), "fingerprints")
    prints = rows.groupBy("fp").agg(F.min(doc_id).alias("first"))
    roots = connected_components(link_fingerprints(rows.select("fp").distinct()))
    grouped = prints.join(roots.withColumnRenamed("id", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first"
    )
    names = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(grouped.join(names, "root").select("fp", "component_id"), "fp").select(
        doc_id, "fp", "component_id"
    )


def hex_fingerprint(column: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
