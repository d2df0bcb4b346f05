"""Weighted composite score over min-max normalised metrics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.operators.ordered import global_rank
from cartlens.staging import stage


def compute_composite_score(
    df: DataFrame, index_col: str, metric_cols: Sequence[str], weights: Sequence[float]
) -> DataFrame:
    """Complete rows with each metric, its ``_norm``, the ``composite_score`` and the ordinal ``rank``.

    A metric that is the same everywhere scores 0. The input is used twice (range of the metrics, then the
    scores), so it is written once.
    """
    if len(metric_cols) != len(weights):
        raise ValueError("one weight per metric is needed")
    if abs(sum(weights) - 1.0) >= 1e-6:
        raise ValueError("the weights must add up to 1")
    rows = stage(df.select(index_col, *metric_cols).dropna(), "metrics")
    ranges = F.broadcast(
        rows.agg(
            *[F.min(c).cast("double").alias(f"_min_{c}") for c in metric_cols],
            *[F.max(c).cast("double").alias(f"_max_{c}") for c in metric_cols],
        )
    )

    def norm(c: str):
        low, high = F.col(f"_min_{c}"), F.col(f"_max_{c}")
        return F.when(high == low, F.lit(0.0)).otherwise(
            F.try_divide(F.col(c).cast("double") - low, high - low)
        )

    scored = (
        rows.crossJoin(ranges)
        .withColumns({f"{c}_norm": norm(c) for c in metric_cols})
        .withColumn(
            "composite_score",
            reduce(add, [F.col(f"{c}_norm") * F.lit(float(w)) for c, w in zip(metric_cols, weights)]),
        )
        .select(index_col, *metric_cols, *[f"{c}_norm" for c in metric_cols], "composite_score")
    )
    # Scores are row-wise arithmetic on a written table, hence the same on every run.
    return global_rank(scored, [("composite_score", False), (index_col, True)], repeatable=True)
