"""The cleaning pipeline in its fixed order: coerce, fill, exact duplicates, key duplicates, surrogate keys,
geolocation, latest review, then the checks. Filling comes before duplicate removal because rows can become
equal through it, and review keys are given before the latest review is chosen, so they have gaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial

from pyspark.sql import DataFrame

from cartlens import schemas
from cartlens.operators import cleaning, quality
from cartlens.staging import run_together, stage


def clean_orders(orders: DataFrame, seq_col: str = "seq") -> DataFrame:
    """Timestamps parsed, exact copies removed."""
    orders = cleaning.coerce_timestamps(orders, schemas.ORDER_DATE_COLUMNS)
    return cleaning.drop_exact_duplicates(orders, seq_col)


def clean_products(products: DataFrame, seq_col: str = "seq") -> DataFrame:
    """Category and numbers filled, exact copies removed. The medians are taken before that removal."""
    products = cleaning.fill_constants(products, {"product_category_name": "unknown"})
    products = cleaning.coerce_numbers(products, schemas.PRODUCT_NUMERIC_COLUMNS)
    products = cleaning.fill_medians(products, schemas.PRODUCT_NUMERIC_COLUMNS, repeatable=True)
    return cleaning.drop_exact_duplicates(products, seq_col)


def first_per_key(name: str, df: DataFrame, seq_col: str = "seq") -> DataFrame:
    """First row per primary key of a dimension."""
    return cleaning.keep_first(df, schemas.PRIMARY_KEYS[name], seq_col)


def keyed_facts(name: str, df: DataFrame, order: Sequence[str], seq_col: str = "seq") -> DataFrame:
    """A fact table without exact copies and with its surrogate key."""
    facts = cleaning.drop_exact_duplicates(df, seq_col)
    return cleaning.surrogate_key(facts, order, schemas.PRIMARY_KEYS[name])


def clean_reviews(reviews: DataFrame, order: Sequence[str], seq_col: str = "seq") -> DataFrame:
    """Times parsed, texts filled, keys given, then the latest review per order."""
    reviews = cleaning.coerce_timestamps(reviews, schemas.REVIEW_DATE_COLUMNS)
    reviews = cleaning.fill_constants(reviews, {c: "" for c in schemas.REVIEW_TEXT_COLUMNS})
    reviews = keyed_facts("reviews", reviews, order, seq_col)
    return cleaning.keep_latest(reviews, "order_id", "review_answer_timestamp", "review_key")


def clean_tables(
    tables: Mapping[str, DataFrame],
    seq_col: str = "seq",
    key_order: Mapping[str, Sequence[str]] | None = None,
    names: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Clean the raw tables (all nine, or the named ones) and write each once.

    Every table carries its input order in ``seq_col``. ``key_order`` names the columns that order the
    surrogate keys; by default it is ``seq_col``. The tables do not depend on each other.
    """
    order = {name: [seq_col] for name in ("order_items", "payments", "reviews")} | dict(key_order or {})

    def dimension(name: str) -> DataFrame:
        unique = cleaning.drop_exact_duplicates(tables[name], seq_col)
        return first_per_key(name, unique, seq_col)

    def facts(name: str) -> DataFrame:
        return keyed_facts(name, tables[name], order[name], seq_col)

    def geolocation() -> DataFrame:
        points = cleaning.drop_exact_duplicates(tables["geolocation"], seq_col)
        return cleaning.normalize_geolocation(points, seq_col=seq_col)

    steps = {
        "order_items": partial(facts, "order_items"),
        "payments": partial(facts, "payments"),
        "reviews": lambda: clean_reviews(tables["reviews"], order["reviews"], seq_col),
        "orders": lambda: clean_orders(tables["orders"], seq_col),
        "products": lambda: first_per_key("products", clean_products(tables["products"], seq_col), seq_col),
        "customers": partial(dimension, "customers"),
        "sellers": partial(dimension, "sellers"),
        "category_translation": partial(dimension, "category_translation"),
        "geolocation": geolocation,
    }
    wanted = names or list(steps)
    spark = tables[wanted[0]].sparkSession
    for name in wanted:
        tables[name]  # planned here, so that only jobs run side by side

    def written(name: str) -> DataFrame:
        return stage(steps[name]().drop(seq_col), name)

    return run_together(spark, {name: partial(written, name) for name in steps if name in wanted})


def key_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Primary key check of the nine cleaned tables."""
    return quality.primary_key_check(
        {name: (tables[name], key) for name, key in schemas.PRIMARY_KEYS.items()}
    )


def reference_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Foreign key check of the six relations."""
    return quality.foreign_key_check(
        {
            name: (tables[child], key, tables[parent], key)
            for name, (child, parent, key) in schemas.FOREIGN_KEYS.items()
        }
    )


def sanity_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Negative prices and payments, deliveries before the purchase."""
    return quality.sanity_checks(tables["order_items"], tables["payments"], tables["orders"])
