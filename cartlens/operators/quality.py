"""Table profiles and key, reference and sanity checks, each as a report table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _stack(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _count_true(condition: Column) -> Column:
    """How often a condition holds; a missing operand counts as not."""
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, columns and missing values per table."""
    reports = []
    for name, df in tables.items():
        missing = [F.count(F.lit(1)) - F.count(F.col(c)) for c in df.columns]
        reports.append(
            df.agg(
                F.count(F.lit(1)).alias("row_count"),
                reduce(lambda a, b: a + b, missing).alias("null_count"),
            ).select(
                F.lit(name).alias("table"),
                "row_count",
                F.lit(len(df.columns)).cast("long").alias("column_count"),
                "null_count",
            )
        )
    return _stack(reports)


def primary_key_check(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Duplicate and missing keys per table; a missing key counts as one value among the duplicates."""
    reports = []
    for name, (df, key) in tables.items():
        per_key = df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        reports.append(
            per_key.agg(
                F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_pk"),
                F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n")).otherwise(0)), F.lit(0)).alias(
                    "null_pk"
                ),
            ).select(F.lit(name).alias("table"), F.lit(key).alias("key"), "duplicate_pk", "null_pk")
        )
    return _stack(reports)


def foreign_key_check(checks: Mapping[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Child rows without a parent per relation; a missing child key is a miss unless a parent key is missing.

    Both sides are reduced to their distinct keys and met in one grouping, where null equals null. A key that
    very many rows share leaves each task as one row.
    """
    reports = []
    for name, (child, child_key, parent, parent_key) in checks.items():
        both = child.select(F.col(child_key).alias("k"), F.lit(1).alias("n"), F.lit(0).alias("p")).unionByName(
            parent.select(F.col(parent_key).alias("k"), F.lit(0).alias("n"), F.lit(1).alias("p"))
        )
        per_key = both.groupBy("k").agg(F.sum("n").alias("n"), F.max("p").alias("p"))
        reports.append(
            per_key.filter(F.col("p") == 0)
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("missing"))
            .select(F.lit(name).alias("check"), "missing")
        )
    return _stack(reports)


def orphan_rows(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """The child rows themselves whose key has no parent (null-safe anti join)."""
    keys = parent.select(F.col(parent_key).alias("_parent_key"))
    return child.join(keys, F.col(child_key).eqNullSafe(F.col("_parent_key")), "left_anti")


def sanity_checks(
    items: DataFrame,
    payments: DataFrame,
    orders: DataFrame,
    price_col: str = "price",
    payment_col: str = "payment_value",
    delivery_col: str = "order_delivered_customer_date",
    purchase_col: str = "order_purchase_timestamp",
) -> DataFrame:
    """Negative prices, negative payments and deliveries before the purchase."""
    rules = {
        "negative_prices": (items, F.col(price_col) < 0),
        "negative_payments": (payments, F.col(payment_col) < 0),
        "invalid_delivery_dates": (orders, F.col(delivery_col) < F.col(purchase_col)),
    }
    return _stack(
        [
            df.agg(_count_true(rule).alias("violations")).select(F.lit(name).alias("check"), "violations")
            for name, (df, rule) in rules.items()
        ]
    )
