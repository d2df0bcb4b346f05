"""Connected components by alternating large-star and small-star steps.

Every step is an aggregation (partial sums before the shuffle) and a join that adaptive execution can split, so
neither a hub with millions of links nor a long chain is gathered in one task. The edge table is written after
every step to the shared folder; the loop ends when a step changes nothing, after about log n rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.staging import stage


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """id, root (smallest id reachable) of every node of ``edges`` (a, b: bigint); nodes without links are not in it."""
    edges = stage(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    before, now = None, _digest(edges)
    while now != before and now[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.join(nearest, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).distinct()
        nearest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(nearest, "a")
            .select(F.explode(F.array(F.struct(F.col("a"), F.col("m")), F.struct(F.col("b").alias("a"), F.col("m")))).alias("e"))
            .select("e.a", F.col("e.m").alias("b"))
            .where(F.col("a") != F.col("b"))
            .distinct()
        )
        edges = stage(small, "edges")
        before, now = now, _digest(edges)
    # Stars: every node points to the smallest id of its component.
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    )
