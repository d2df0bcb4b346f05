"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the 13-word windows of the benchmark items (an item of fewer words is one pattern). They are
grouped by length. For a group of length m, a table says for every block of two words how far the search may
jump: a block that ends no pattern prefix allows a jump of up to m - 1 words. Where the jump is zero, the block
is the suffix of some patterns; the bucket of that suffix, cut down by the first two words, names the strings to
compare, and a direct comparison of all words confirms the occurrence.

The tables of one part of the benchmark are broadcast to the tasks. A part holds at most ``part_words`` words,
a bound on the broadcast that does not depend on the input; a larger benchmark is searched part after part, each
over all documents, and the occurrences are merged by document.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.common import batches, prepare

WINDOW = 13
#: Words of benchmark text whose tables are broadcast at once (about 300 bytes a word in a task).
PART_WORDS = 500_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased (A-Z) words: runs of a-z, 0-9 and everything beyond ASCII."""
    if not text:
        return []
    return _WORD.findall(text.encode().lower().decode())  # bytes.lower() changes A-Z only


class WuManber:
    """Tables for patterns of one length; a pattern is a tuple of words."""

    def __init__(self, patterns: Iterable[tuple[str, ...]], length: int) -> None:
        self.length = length
        self.block = block = min(2, length)
        self.shift: dict = {}
        self.jump = length - block + 1
        self.buckets: dict[tuple, dict[tuple, set]] = {}
        for pattern in patterns:
            for end in range(block, length + 1):
                part = pattern[end - block : end]
                self.shift[part] = min(self.shift.get(part, self.jump), length - end)
            self.buckets.setdefault(pattern[-block:], {}).setdefault(pattern[:block], set()).add(pattern)

    def find(self, words: list[str]) -> Iterator[tuple[int, tuple[str, ...]]]:
        """(start, pattern) of every occurrence, by start."""
        m, block, jump, shift, buckets = self.length, self.block, self.jump, self.shift, self.buckets
        end, n = m, len(words)
        while end <= n:
            suffix = tuple(words[end - block : end])
            step = shift.get(suffix, jump)
            if step:
                end += step
                continue
            start = end - m
            tests = buckets.get(suffix, {}).get(tuple(words[start : start + block]))
            if tests:
                found = tuple(words[start:end])
                if found in tests:
                    yield start, found
            end += 1


def _patterns(words: list[str]) -> Iterator[tuple[str, ...]]:
    if 0 < len(words) < WINDOW:
        yield tuple(words)
    for i in range(len(words) - WINDOW + 1):
        yield tuple(words[i : i + WINDOW])


class Searcher:
    """Occurrences of one part of the benchmark in a text."""

    def __init__(self, items: Iterable[tuple[str | None, str]]) -> None:
        self.owners: dict[tuple[str, ...], set[str]] = {}
        for item, text in items:
            for pattern in _patterns(words_of(text)):
                owners = self.owners.setdefault(pattern, set())
                if item is not None:
                    owners.add(item)
        by_length: dict[int, list] = {}
        for pattern in self.owners:
            by_length.setdefault(len(pattern), []).append(pattern)
        self.tables = [WuManber(patterns, m) for m, patterns in sorted(by_length.items())]

    def search(self, words: list[str]) -> tuple[list[tuple[int, int]], list[str]]:
        """Merged word ranges [start, end) inside occurrences, and the items that occur."""
        found, items = [], set()
        for table in self.tables:
            for start, pattern in table.find(words):
                found.append((start, start + table.length))
                items |= self.owners[pattern]
        return merge_ranges(found), sorted(items)


def merge_ranges(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for start, end in sorted(ranges):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [(a, b) for a, b in merged]


def _search_task(shared, text: str, keep: Sequence[str], out: pa.Schema):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(shared.value)
        for batch in batches(source):
            n_words, starts, ends, items = [], [], [], []
            for value in batch.column(text):
                words = words_of(value.as_py())
                ranges, found = searcher.search(words)
                n_words.append(len(words))
                starts.append([a for a, _ in ranges])
                ends.append([b for _, b in ranges])
                items.append(found)
            columns = [batch.column(k) for k in keep]
            values = [pa.array(v, out.field(i + len(keep)).type) for i, v in enumerate((n_words, starts, ends, items))]
            yield pa.RecordBatch.from_arrays([*columns, *values], schema=out)

    return run


def _parts(benchmark: DataFrame, item: str, text: str, part_words: int) -> Iterator[list[tuple[str | None, str]]]:
    """The benchmark in parts of bounded size, read item by item."""
    part: list[tuple[str | None, str]] = []
    size = 0
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where(
        F.col("text").isNotNull()
    )
    for row in rows.toLocalIterator():
        n = len(words_of(row["text"]))
        if part and size + n > part_words:
            yield part
            part, size = [], 0
        part.append((row["item"], row["text"]))
        size += n
    yield part


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    item: str = "item_id",
    item_text: str = "text",
    part_words: int = PART_WORDS,
) -> DataFrame:
    """``keep`` columns, n_words, hit ranges (``starts``, ``ends``: words [start, end)) and items, for every row.

    A null or empty text has no words, ranges or items. An item without words never occurs; the words of an item
    without an id are hit like any others, but it is not among the items; repeated items count once; other columns of both tables are not read. With one part (a benchmark of up to
    ``part_words`` words) nothing is shuffled. With more, a row number made from the partition ties the parts'
    results together, so repeated rows stay apart.
    """
    spark = prepare(docs.sparkSession)
    fields = [docs.select(k).schema[0] for k in keep]
    own = T.StructType(
        [
            *fields,
            T.StructField("n_words", T.LongType()),
            T.StructField("starts", T.ArrayType(T.LongType())),
            T.StructField("ends", T.ArrayType(T.LongType())),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    out: DataFrame | None = None
    keyed, schema, names = docs.select(*dict.fromkeys([*keep, text])), own, list(keep)
    parts = list(_parts(benchmark, item, item_text, part_words))
    if len(parts) > 1:
        keyed = keyed.withColumn("_row", F.monotonically_increasing_id())
        schema = T.StructType([*fields, T.StructField("_row", T.LongType()), *own[len(fields) :]])
        names = [*names, "_row"]
    for part in parts:
        task = _search_task(spark.sparkContext.broadcast(part), text, names, to_arrow_schema(schema))
        found = keyed.mapInArrow(task, schema)
        out = found if out is None else out.unionByName(found)
    if len(parts) == 1:
        return out
    merged = out.groupBy("_row").agg(
        *[F.first(k).alias(k) for k in keep],
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).alias("_ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    ranges = F.array_sort("_ranges")
    return merged.select(*keep, "n_words", ranges["starts"].alias("starts"), ranges["ends"].alias("ends"), "items")


def hit_words(starts: str = "starts", ends: str = "ends"):
    """Number of words inside the ranges, which may overlap."""
    zipped = F.arrays_zip(F.col(starts).alias("a"), F.col(ends).alias("b"))
    last = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(
        zipped,
        last,
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["to"]))).alias("n"),
            F.greatest(s["to"], x["b"]).alias("to"),
        ),
        lambda s: s["n"],
    )


def contamination(found: DataFrame) -> DataFrame:
    """``find_benchmark`` rows with n_hit, n_items and contaminated (5 % of the words or more are hit)."""
    return (
        found.withColumn("n_hit", hit_words())
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )
