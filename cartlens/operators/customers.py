"""Correlations, baskets, ratings, payments, geography and market opportunity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlens.functions.aggregates import (
    drop_null_keys,
    exact_total,
    mean,
    pearson,
    sums_and_distincts,
    total,
)
from cartlens.functions.scalars import as_list, month, ratio
from cartlens.operators.ordered import exact_quantiles, sort_columns
from cartlens.operators.revenue import group_aggregate
from cartlens.staging import stage


def correlation_points(
    df: DataFrame, col_x: str, col_y: str, group_col: str | Sequence[str] | None = None, agg: str = "mean"
) -> DataFrame:
    """The points behind a correlation: complete rows, or both columns aggregated per entity."""
    if group_col:
        return group_aggregate(df, as_list(group_col), {col_x: (col_x, agg), col_y: (col_y, agg)})
    return df.select(col_x, col_y).dropna()


def compute_correlation(
    df: DataFrame, col_x: str, col_y: str, group_col: str | Sequence[str] | None = None, agg: str = "mean"
) -> dict[str, DataFrame]:
    """``correlation`` (one row) and ``scatter_df`` (the points)."""
    points = correlation_points(df, col_x, col_y, group_col, agg)
    corr = points.agg(pearson(F.col(col_x), F.col(col_y)).alias("correlation"))
    return {"correlation": corr, "scatter_df": points}


def compute_basket_size(
    df: DataFrame, order_col: str, item_col: str | None = None, revenue_col: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Items per order, and one row of statistics over the orders.

    Size and revenue of an order come from the same groupBy, so no join is needed. The median is over small
    whole numbers.
    """
    rows = drop_null_keys(df, [order_col])
    aggs = [F.count(item_col if item_col else F.lit(1)).alias("basket_size")]
    if revenue_col:
        aggs.append(total(rows, revenue_col).alias("_revenue"))
        aggs.append(exact_total(rows, revenue_col).alias("_exact"))
    orders = rows.groupBy(order_col).agg(*aggs)
    stats = [
        mean(orders, "basket_size").alias("mean_basket"),
        F.percentile("basket_size", F.lit(0.5)).alias("median_basket"),
        F.stddev_samp("basket_size").alias("std_basket"),
        F.max("basket_size").alias("max_basket"),
    ]
    if revenue_col:
        stats.append(mean(orders, "_exact").alias("avg_order_revenue"))
        stats.append(pearson(F.col("basket_size"), F.col("_revenue")).alias("basket_revenue_corr"))
    return orders.select(order_col, "basket_size"), orders.agg(*stats)


def compute_rating_summary(
    df: DataFrame,
    rating_col: str,
    group_col: str | Sequence[str] | None = None,
    date_col: str | None = None,
    min_reviews: int = 5,
) -> DataFrame | dict[str, DataFrame]:
    """Ratings per month (``date_col``), per entity (``group_col``), or overall.

    Overall returns ``overall`` (mean and median) and ``distribution`` (count per rating).
    """
    work = df.filter(F.col(rating_col).isNotNull())
    summary = [
        mean(work, rating_col).alias("mean_rating"),
        F.count(rating_col).alias("review_count"),
    ]
    if date_col:
        monthly = drop_null_keys(work.withColumn("period", month(work, date_col)), ["period"])
        return monthly.groupBy("period").agg(*summary).orderBy("period")
    if group_col:
        keys = as_list(group_col)
        order = [("mean_rating", False), *[(k, True) for k in keys]]
        rated = drop_null_keys(work, keys).groupBy(*keys).agg(*summary).filter(F.col("review_count") >= min_reviews)
        # Sorting reads its input twice, for the ranges and for the rows.
        return stage(rated, "ratings").orderBy(*sort_columns(order))
    medians = F.broadcast(exact_quantiles(work, {"median": (rating_col, 0.5)}))
    return {
        "overall": work.agg(mean(work, rating_col).alias("mean")).crossJoin(medians),
        "distribution": work.groupBy(rating_col).agg(F.count(F.lit(1)).alias("count")).orderBy(rating_col),
    }


def compute_payment_summary(
    df: DataFrame, payment_type_col: str, value_col: str, installment_col: str | None = None
) -> dict[str, DataFrame]:
    """``by_type`` and, with ``installment_col``, ``installments``. ``order_count`` counts payment rows."""
    exact = exact_total(df, value_col).alias("_exact")
    figures = [exact, mean(df, value_col).alias("avg_payment"), F.count(value_col).alias("order_count")]
    types = drop_null_keys(df, [payment_type_col]).groupBy(payment_type_col).agg(*figures)
    # One row per payment type is left here, so the window over all of them is short.
    all_types = F.sum("_exact").over(Window.partitionBy())
    revenue = F.col("_exact").cast("double")
    by_type = (
        types.select(
            payment_type_col,
            revenue.alias("total_revenue"),
            "avg_payment",
            "order_count",
            (ratio(revenue, all_types) * 100).alias("revenue_share_pct"),
        )
        .orderBy(*sort_columns([("total_revenue", False), (payment_type_col, True)]))
    )
    result = {"by_type": by_type}
    if installment_col:
        result["installments"] = (
            drop_null_keys(df, [installment_col])
            .groupBy(installment_col)
            .agg(*figures)
            .select(installment_col, "avg_payment", "order_count", revenue.alias("total_revenue"))
            .orderBy(installment_col)
        )
    return result


def compute_geographic_summary(
    df: DataFrame,
    revenue_col: str,
    order_col: str,
    state_col: str | None = None,
    city_col: str | None = None,
    customer_col: str | None = None,
    seller_col: str | None = None,
) -> dict[str, DataFrame]:
    """``by_state`` and/or ``by_city``: revenue, distinct orders, customers, sellers and revenue per each.

    A city is its name alone; cities of the same name in different states are one row.
    """

    def summary(geo_col: str) -> DataFrame:
        distinct = {"orders": order_col}
        if customer_col:
            distinct["customers"] = customer_col
        if seller_col:
            distinct["sellers"] = seller_col
        revenue = exact_total(df, revenue_col).cast("double").alias("revenue")
        grouped = sums_and_distincts(drop_null_keys(df, [geo_col]), [geo_col], [revenue], distinct)
        per = {
            "orders": "avg_revenue_per_order",
            "customers": "avg_revenue_per_customer",
            "sellers": "revenue_per_seller",
        }
        return grouped.select(
            geo_col,
            "revenue",
            *distinct,
            *[ratio(F.col("revenue"), F.col(name)).alias(per[name]) for name in distinct],
        ).orderBy(*sort_columns([("revenue", False), (geo_col, True)]))

    wanted = {"by_state": state_col, "by_city": city_col}
    return {key: summary(col) for key, col in wanted.items() if col}


def compute_market_opportunity(
    df: DataFrame, region_col: str, revenue_col: str, customer_col: str, order_col: str
) -> DataFrame:
    """Regions with revenue per customer at or above the median and fewer customers than the median.

    The regions are written once, because the medians and the flags both read them.
    """
    regions = (
        sums_and_distincts(
            drop_null_keys(df, [region_col]),
            [region_col],
            [exact_total(df, revenue_col).cast("double").alias("revenue")],
            {"customers": customer_col, "orders": order_col},
        )
        .withColumn("revenue_per_customer", ratio(F.col("revenue"), F.col("customers")))
        .withColumn("orders_per_customer", ratio(F.col("orders"), F.col("customers")))
    )
    regions = stage(regions, "regions")
    wanted = {"_median_spend": ("revenue_per_customer", 0.5), "_median_customers": ("customers", 0.5)}
    medians = F.broadcast(exact_quantiles(regions, wanted, repeatable=True))
    flag = (F.col("revenue_per_customer") >= F.col("_median_spend")) & (
        F.col("customers") < F.col("_median_customers")
    )
    return (
        regions.crossJoin(medians)
        .withColumn("opportunity_flag", F.coalesce(flag, F.lit(False)))
        .drop("_median_spend", "_median_customers")
        .orderBy(*sort_columns([("revenue_per_customer", False), (region_col, True)]))
    )
