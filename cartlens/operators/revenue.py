"""Headline figures, grouped aggregates, revenue shares, concentration and product performance."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.functions.aggregates import (
    AggSpec,
    agg_column,
    drop_null_keys,
    exact_total,
    is_repeatable,
    mean,
    sums_and_distincts,
)
from cartlens.functions.scalars import as_list, nan_to_null, ratio, ratio_or_zero
from cartlens.operators.ordered import (
    exact_quantiles,
    ordered_scan,
    top_rows,
)
from cartlens.staging import stage


def compute_kpis(
    df: DataFrame,
    revenue_col: str,
    order_col: str,
    customer_col: str | None = None,
    seller_col: str | None = None,
    freight_col: str | None = None,
) -> DataFrame:
    """One row: total revenue, distinct orders, average order value and the optional figures."""
    sums = [exact_total(df, revenue_col).cast("double").alias("total_revenue")]
    distincts = {"total_orders": order_col}
    if customer_col:
        distincts["total_customers"] = customer_col
    if seller_col:
        distincts["total_sellers"] = seller_col
    if freight_col:
        sums.append(exact_total(df, freight_col).cast("double").alias("total_freight"))
    out = sums_and_distincts(df, [], sums, distincts)
    columns = [
        "total_revenue",
        "total_orders",
        ratio_or_zero(F.col("total_revenue"), F.col("total_orders")).alias("aov"),
    ]
    if customer_col:
        columns.append("total_customers")
    if seller_col:
        columns.append("total_sellers")
    if freight_col:
        columns.append("total_freight")
        columns.append(ratio_or_zero(F.col("total_freight"), F.col("total_revenue")).alias("freight_ratio"))
    return out.select(*columns)


def group_aggregate(df: DataFrame, keys: Sequence[str], agg_map: Mapping[str, AggSpec]) -> DataFrame:
    """Named aggregates per key. Medians come from the distributed quantile, the rest from grouping."""
    keys = list(keys)
    rows = drop_null_keys(df, keys)
    medians = {name: (spec[0], 0.5) for name, spec in agg_map.items() if spec[1] == "median"}
    distincts = {name: spec[0] for name, spec in agg_map.items() if spec[1] == "nunique"}
    plain = [
        agg_column(rows, spec).alias(name)
        for name, spec in agg_map.items()
        if name not in medians and name not in distincts
    ]
    if plain or distincts:
        grouped = sums_and_distincts(rows, keys, plain, distincts)
    else:
        grouped = rows.select(*keys).distinct()
    if medians:
        grouped = grouped.join(exact_quantiles(rows, medians, by=keys), keys, "left")
    return grouped.select(*keys, *agg_map)


def aggregate_by(
    df: DataFrame,
    group_col: str | Sequence[str],
    agg_map: Mapping[str, AggSpec],
    rank_col: str | None = None,
    top_n: int | None = None,
    ascending: bool = False,
) -> DataFrame:
    """Group by one or more columns; optionally dense-rank on ``rank_col`` and keep ``top_n`` rows.

    ``top_n`` without ``rank_col`` has no effect. A missing value in ``rank_col`` is an error.
    """
    keys = as_list(group_col)
    result = group_aggregate(df, keys, agg_map)
    if not rank_col:
        return result
    repeatable = rank_col in agg_map and is_repeatable(df, agg_map[rank_col]) or None
    result = result.withColumn(
        rank_col,
        F.coalesce(
            F.col(rank_col), F.raise_error(F.lit(f"cannot rank: {rank_col} is missing"))
        ).cast(result.schema[rank_col].dataType),
    )
    order = [(rank_col, ascending), *[(k, True) for k in keys if k != rank_col]]
    if top_n is not None:
        result = top_rows(result, order, top_n)
    return ordered_scan(result, order, dense="rank", repeatable=repeatable)


def _entity_revenue(df: DataFrame, keys: Sequence[str], revenue_col: str) -> DataFrame:
    return drop_null_keys(df, keys).groupBy(*keys).agg(exact_total(df, revenue_col).alias("revenue"))


def _revenue_order(keys: Sequence[str]) -> list[tuple[str, bool]]:
    return [("revenue", False), *[(k, True) for k in keys]]


def compute_revenue_share(
    df: DataFrame, group_col: str | Sequence[str], revenue_col: str, top_n: int | None = None
) -> DataFrame:
    """Revenue, share of all revenue in percent and ordinal rank per entity. ``top_n`` 0 keeps all."""
    keys = as_list(group_col)
    entities = _entity_revenue(df, keys, revenue_col)
    share = (F.try_divide(F.col("revenue").cast("double"), F.col("_total").cast("double")) * 100).alias(
        "revenue_share_pct"
    )
    columns = [*keys, F.col("revenue").cast("double").alias("revenue"), share, "rank"]
    ranked = ordered_scan(entities, _revenue_order(keys), row="rank", totals={"revenue": "_total"})
    if top_n:
        ranked = ranked.filter(F.col("rank") <= top_n)
    return ranked.select(*columns)


def compute_pareto(df: DataFrame, group_col: str | Sequence[str], revenue_col: str) -> DataFrame:
    """``compute_revenue_share`` with the cumulative share in rank order."""
    keys = as_list(group_col)
    ranked = ordered_scan(
        _entity_revenue(df, keys, revenue_col),
        _revenue_order(keys),
        row="rank",
        running={"revenue": "_running"},
        totals={"revenue": "_total"},
    )
    total_revenue = F.col("_total").cast("double")
    return ranked.select(
        *keys,
        F.col("revenue").cast("double").alias("revenue"),
        (F.try_divide(F.col("revenue").cast("double"), total_revenue) * 100).alias("revenue_share_pct"),
        (F.try_divide(F.col("_running").cast("double"), total_revenue) * 100).alias("cumulative_share_pct"),
        "rank",
    )


def concentration_labels(percentiles: Sequence[float]) -> list[str]:
    """``top_{whole percent}pct`` per fraction; the percent is cut, not rounded."""
    labels = [f"top_{math.trunc(p * 100)}pct" for p in percentiles]
    if len(set(labels)) < len(labels):
        raise ValueError(f"fractions {tuple(percentiles)} share a label: {labels}")
    return labels


def compute_concentration_stats(
    df: DataFrame,
    group_col: str | Sequence[str],
    revenue_col: str,
    percentiles: Sequence[float] = (0.01, 0.05, 0.10),
) -> DataFrame:
    """One row: share of revenue of the top fractions, and the fraction of entities behind 80 %."""
    labels = concentration_labels(percentiles)
    keys = as_list(group_col)
    ranked = ordered_scan(
        _entity_revenue(df, keys, revenue_col),
        _revenue_order(keys),
        row="_rank",
        running={"revenue": "_running"},
        totals={"revenue": "_total"},
        rows_total="_n",
    )
    cut = [
        F.sum(F.when(F.col("_rank") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(float(p)))), F.col("revenue")))
        for p in percentiles
    ]
    below = ratio(F.col("_running"), F.col("_total")) < 0.80
    sums = ranked.agg(
        *[c.alias(label) for c, label in zip(cut, labels)],
        F.max("_total").alias("_total"),
        F.max("_n").alias("_n"),
        F.coalesce(F.sum(F.when(below, 1).otherwise(0)), F.lit(0)).alias("_below"),
    )
    return sums.select(
        *[(ratio(F.col(label), F.col("_total")) * 100).alias(label) for label in labels],
        ratio(F.col("_below") + 1, F.col("_n")).alias("pareto_ratio"),
    )


def entity_values(df: DataFrame, group_col: str | Sequence[str], value_col: str, agg: str = "sum") -> DataFrame:
    """One aggregated value per entity."""
    return group_aggregate(nan_to_null(df), as_list(group_col), {value_col: (value_col, agg)})


def compute_distribution_stats(
    df: DataFrame, group_col: str | Sequence[str], value_col: str, agg: str = "sum"
) -> tuple[DataFrame, DataFrame]:
    """Per-entity values, and one row of mean, median, std, min, max, p25, p75 over them."""
    values = stage(entity_values(df, group_col, value_col, agg), "entities")
    moments = values.agg(
        mean(values, value_col).alias("mean"),
        F.stddev_samp(F.col(value_col).cast("double")).alias("std"),
        F.min(value_col).cast("double").alias("min"),
        F.max(value_col).cast("double").alias("max"),
    )
    quantiles = exact_quantiles(
        values,
        {"median": (value_col, 0.5), "p25": (value_col, 0.25), "p75": (value_col, 0.75)},
        repeatable=True,  # read back from the written table
    )
    stats = moments.crossJoin(F.broadcast(quantiles)).select(
        "mean", "median", "std", "min", "max", "p25", "p75"
    )
    return values, stats


def product_figures(
    df: DataFrame, product_col: str, revenue_col: str, order_col: str, price_col: str | None = None
) -> DataFrame:
    """Revenue (exact), units sold and mean price per product, without an order among them."""
    rows = drop_null_keys(df, [product_col])
    return rows.groupBy(product_col).agg(
        exact_total(rows, revenue_col).alias("revenue"),
        F.count(order_col).alias("units_sold"),
        mean(rows, price_col or revenue_col).alias("avg_price"),
    )


def compute_product_performance(
    df: DataFrame,
    product_col: str,
    revenue_col: str,
    order_col: str,
    price_col: str | None = None,
) -> DataFrame:
    """Revenue, units sold, mean price, revenue share and revenue rank per product."""
    products = product_figures(df, product_col, revenue_col, order_col, price_col)
    ranked = ordered_scan(
        products, _revenue_order([product_col]), row="revenue_rank", totals={"revenue": "_total"}
    )
    return ranked.select(
        product_col,
        F.col("revenue").cast("double").alias("revenue"),
        "units_sold",
        "avg_price",
        (ratio(F.col("revenue"), F.col("_total")) * 100).alias("revenue_share_pct"),
        "revenue_rank",
    )
