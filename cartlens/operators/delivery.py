"""Delivery times, lateness and freight ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.functions.aggregates import drop_null_keys, exact_total
from cartlens.functions.scalars import as_list, ratio, ratio_or_zero, strict_timestamp, whole_days
from cartlens.operators.ordered import global_rank, sort_columns


def delivered_orders(
    df: DataFrame, purchase_col: str, delivery_col: str, estimated_col: str | None = None
) -> DataFrame:
    """Add ``delivery_days`` (and ``delay_days``, ``is_late``) and keep delivered, non-negative rows."""
    delivered = strict_timestamp(df, delivery_col)
    work = df.withColumn("delivery_days", whole_days(delivered, strict_timestamp(df, purchase_col)))
    if estimated_col:
        work = work.withColumn("delay_days", whole_days(delivered, strict_timestamp(df, estimated_col)))
        # A missing estimate cannot be missed.
        work = work.withColumn("is_late", F.coalesce(F.col("delay_days") > 0, F.lit(False)))
    return work.filter(F.col("delivery_days") >= 0)


def compute_delivery_metrics(
    df: DataFrame,
    purchase_col: str,
    delivery_col: str,
    estimated_col: str | None = None,
    group_col: str | Sequence[str] | None = None,
) -> DataFrame:
    """Delivery statistics as one row, or per group with the slowest group ranked first.

    Orders are first counted per group and number of days, which is a plain hash aggregation. The median is
    then taken over day counts: few values per group, however many orders it has.
    """
    keys = as_list(group_col)
    work = drop_null_keys(delivered_orders(df, purchase_col, delivery_col, estimated_col), keys)
    counts = [F.count(F.lit(1)).alias("_orders")]
    if estimated_col:
        counts += [
            F.sum(F.col("is_late").cast("long")).alias("_late"),
            F.sum("delay_days").alias("_delay"),
            F.count("delay_days").alias("_estimated"),
        ]
    per_day = work.groupBy(*keys, "delivery_days").agg(*counts)

    orders = F.sum("_orders")
    figures = {
        "avg_delivery_days": ratio(F.sum(F.col("delivery_days") * F.col("_orders")), orders),
        "median_delivery_days": F.percentile("delivery_days", F.lit(0.5), F.col("_orders")),
    }
    if keys:
        figures["order_count"] = orders
    if estimated_col:
        figures["late_rate_pct"] = ratio(F.sum("_late"), orders) * 100
        if not keys:
            figures["early_rate_pct"] = ratio(orders - F.sum("_late"), orders) * 100
        figures["avg_delay_days"] = ratio(F.sum("_delay"), F.sum("_estimated"))
    result = per_day.groupBy(*keys).agg(*[column.alias(name) for name, column in figures.items()])
    if not keys:
        return result
    order = [("avg_delivery_days", False), *[(k, True) for k in keys]]
    # The averages are quotients of whole numbers and come out the same on every run.
    return global_rank(result, order, repeatable=True)


def compute_freight_ratio(
    df: DataFrame, freight_col: str, revenue_col: str, group_col: str | Sequence[str] | None = None
) -> DataFrame:
    """Freight in percent of revenue: one row (0 without revenue) or per group (null without revenue)."""
    sums = [
        exact_total(df, freight_col).cast("double").alias("total_freight"),
        exact_total(df, revenue_col).cast("double").alias("total_revenue"),
    ]
    freight, revenue = F.col("total_freight"), F.col("total_revenue")
    if group_col is None:
        return df.agg(*sums).withColumn("freight_ratio_pct", ratio_or_zero(freight, revenue) * 100)
    keys = as_list(group_col)
    order = [("freight_ratio_pct", False), *[(k, True) for k in keys]]
    return (
        drop_null_keys(df, keys)
        .groupBy(*keys)
        .agg(*sums)
        .withColumn("freight_ratio_pct", ratio(freight, revenue) * 100)
        .orderBy(*sort_columns(order))
    )
