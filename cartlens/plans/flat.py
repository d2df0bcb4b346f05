"""Flat analysis frames over the nine-table model.

A frame joins only the tables whose columns are asked for. With ``how="left"`` (the default) no fact row is
lost and a dimension that is not asked for changes nothing; ``how="inner"`` drops rows with a dangling key and
therefore joins every dimension. Keys of orders and dimensions are taken to be unique, as the cleaning leaves
them. Customers are joined to orders before the items are, so that the large item
table is shuffled once on the order key. Small dimensions are broadcast by their size, as Spark decides.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tables = Mapping[str, DataFrame]


def _attach(left: DataFrame, dimension: DataFrame, key: str, columns: Sequence[str], how: str) -> DataFrame:
    """Join the named columns of a dimension."""
    return left.join(dimension.select(key, *columns), key, how)


def _split(wanted: Sequence[str], df: DataFrame) -> tuple[list[str], list[str]]:
    """Wanted columns that a table has, and the others."""
    own = [c for c in wanted if c in df.columns]
    return own, [c for c in wanted if c not in own]


def order_frame(tables: Tables, columns: Sequence[str], how: str = "left") -> DataFrame:
    """Orders with the wanted order and customer columns (and the order key)."""
    orders = tables["orders"]
    own, rest = _split([c for c in columns if c != "order_id"], orders)
    joined = bool(rest) or how == "inner"
    keep = ["order_id", *own]
    if joined and "customer_id" not in own:
        keep.append("customer_id")
    frame = orders.select(*keep)
    if joined:
        frame = _attach(frame, tables["customers"], "customer_id", rest, how)
    return frame.select("order_id", *own, *rest)


def flat_order_items(
    tables: Tables, columns: Sequence[str], how: str = "left", additive: Sequence[str] = ()
) -> DataFrame:
    """One row per order item with the wanted columns of items, orders, customers, sellers, products.

    ``additive`` names measures of which the caller only wants sums. They are summed per join key before the
    joins when that pays: by order, where the sums need the same shuffle as the join, or by seller and/or
    product, which are far fewer than the items. A key that very many items share then leaves each task as one
    row. Order together with another key is nearly the item itself, so nothing is summed there.
    """
    items = tables["order_items"]
    own, rest = _split(columns, items)
    dimensions: dict[str, list[str]] = {}
    for name, key in (("sellers", "seller_id"), ("products", "product_id")):
        found: list[str] = []
        if rest:
            found, rest = _split(rest, tables[name])
        if found or how == "inner":
            dimensions[key] = found
    join_keys = [*dimensions, *(["order_id"] if rest or how == "inner" else [])]
    frame = items.select(*own, *[k for k in join_keys if k not in own])

    sums = [c for c in own if c in additive]
    keys = [c for c in frame.columns if c not in sums]
    fewer_rows = keys == ["order_id"] or set(keys) <= {"seller_id", "product_id"}
    if sums and join_keys and fewer_rows:
        frame = frame.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    if "order_id" in join_keys:
        frame = frame.join(order_frame(tables, rest, how), "order_id", how)
    for name, key in (("sellers", "seller_id"), ("products", "product_id")):
        if key in dimensions:
            frame = _attach(frame, tables[name], key, dimensions[key], how)
    return frame.select(*columns)


def flat_reviews(tables: Tables, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Reviews at the item grain: every item of a reviewed order with the review's columns."""
    wanted = set(columns)
    reviews = tables["reviews"]
    review_columns = [c for c in reviews.columns if c in wanted and c != "order_id"]
    rest = [c for c in columns if c not in review_columns]
    items = flat_order_items(tables, list(dict.fromkeys(["order_id", *rest])))
    return items.join(reviews.select("order_id", *review_columns), "order_id", how).select(*columns)


def flat_payments(tables: Tables, columns: Sequence[str], how: str = "left") -> DataFrame:
    """Payments with the wanted order and customer columns."""
    payments = tables["payments"]
    own, rest = _split(columns, payments)
    if not rest and how == "left":
        return payments.select(*columns)
    key = [] if "order_id" in own else ["order_id"]
    return payments.select(*own, *key).join(order_frame(tables, rest, how), "order_id", how).select(*columns)


def translate_categories(
    df: DataFrame,
    translation: DataFrame,
    column: str = "product_category_name",
    english: str = "product_category_name_english",
) -> DataFrame:
    """Add the English category name; a category without translation keeps its own name."""
    names = translation.select(F.col(column), F.col(english).alias("_english"))
    joined = df.join(names, column, "left")
    return joined.select(*df.columns, F.coalesce("_english", column).alias(english))
