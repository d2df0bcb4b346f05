"""The nine-table model and its frames as views on the TPC-H-like parquet tables, and dirtied variants.

The dirt is chosen by column values (a status, a flag, a segment), never by a sample of row ids.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens import schemas

# Declared, so that planning reads no file footers.
PARQUET_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table."""
    return spark.read.schema(PARQUET_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _places(spark: SparkSession, sf_dir: str, city: str, state: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", F.col("n_name").alias(city), F.col("r_name").alias(state)
    )


class Views(Mapping):
    """Tables by name, each built when it is first asked for."""

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]):
        self._builders, self._built = dict(builders), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    place = _places(spark, sf_dir, "customer_city", "customer_state")
    return customer.join(place, customer.c_nationkey == place.n_nationkey).select(
        F.col("c_custkey").alias("customer_id"), "customer_city", "customer_state"
    )


def _sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    place = _places(spark, sf_dir, "seller_city", "seller_state")
    return supplier.join(place, supplier.s_nationkey == place.n_nationkey).select(
        F.col("s_suppkey").alias("seller_id"), "seller_city", "seller_state"
    )


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_type").alias("product_category_name")
    )


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
    )


def _order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice").cast(MONEY)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        price.alias("price"),
        # Exact: 18 digits hold the product and keep it in one machine word.
        (price * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(18,4)").alias("freight_value"),
    )


def _priority() -> Column:
    return F.substring("o_orderpriority", 1, 1).cast("int")


def _payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderstatus").alias("payment_type"),
        _priority().alias("payment_installments"),
        F.col("o_totalprice").cast(MONEY).alias("payment_value"),
    )


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.when(F.col("o_orderstatus") != "P", 6 - _priority()).alias("review_score"),
        F.col("o_orderdate").alias("review_answer_timestamp"),
    )


def marketplace(spark: SparkSession, sf_dir: str) -> Mapping[str, DataFrame]:
    """Lazy views under the model's table and column names."""
    views = {
        "customers": _customers,
        "sellers": _sellers,
        "products": _products,
        "orders": _orders,
        "order_items": _order_items,
        "payments": _payments,
        "reviews": _reviews,
    }
    return Views({name: partial(build, spark, sf_dir) for name, build in views.items()})


def category_translation(spark: SparkSession) -> DataFrame:
    """Translation of all categories but one."""
    return spark.sql(
        """SELECT * FROM VALUES ('ECONOMY', 'economy class'), ('LARGE', 'large size'), ('MEDIUM', 'medium size'),
           ('PROMO', 'promotion'), ('SMALL', 'small size')
           AS t(product_category_name, product_category_name_english)"""
    )


def order_delivery(spark: SparkSession, sf_dir: str, place: bool = False) -> DataFrame:
    """Orders with items: purchase, delivery (missing while pending), estimate (missing for low priority)."""
    orders = table(spark, sf_dir, "orders")
    shipped = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("order_id"))
        .agg(F.max("l_shipdate").alias("shipped"), F.min("l_suppkey").alias("seller_id"))
    )
    out = (
        orders.join(shipped, orders.o_orderkey == shipped.order_id)
        .select(
            "order_id",
            F.col("o_custkey").alias("customer_id"),
            "seller_id",
            F.col("o_orderdate").alias("order_purchase_timestamp"),
            F.when(F.col("o_orderstatus") != "P", F.col("shipped") + F.expr("INTERVAL 13 HOURS")).alias(
                "order_delivered_customer_date"
            ),
            F.when(
                F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate") + F.expr("INTERVAL 400 DAYS")
            ).alias("order_estimated_delivery_date"),
        )
    )
    if place:
        customers = marketplace(spark, sf_dir)["customers"]
        out = out.join(customers.select("customer_id", "customer_state"), "customer_id", "left")
    return out


# Dirtied variants ----------------------------------------------------------------------------------------


def items_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items, and every returned item once more."""
    items = table(spark, sf_dir, "lineitem")
    return items.unionByName(items.filter(F.col("l_returnflag") == "R"))


def parts_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part twice, the later row with another size."""
    part = table(spark, sf_dir, "part")
    later = part.withColumn("p_size", F.col("p_size") + 100).withColumn("seq", F.lit(2))
    return later.unionByName(part.withColumn("seq", F.lit(1)))


def parts_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one brand without type, of another without size and price."""
    brand = F.col("p_brand")
    return table(spark, sf_dir, "part").withColumns(
        {
            "p_type": F.when(brand != "Brand#1", F.col("p_type")),
            "p_size": F.when(brand != "Brand#2", F.col("p_size")),
            "p_retailprice": F.when(brand != "Brand#2", F.col("p_retailprice")),
        }
    )


def parts_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes as text, unreadable for one brand."""
    size = F.when(F.col("p_brand") == "Brand#3", "n/a").otherwise(F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", size.alias("p_size"))


def orders_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as text, unreadable for pending orders."""
    text = F.when(F.col("o_orderstatus") == "P", "garbage").otherwise(F.col("o_orderdate").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("o_orderdate"))


def events_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose error rows have no time."""
    return table(spark, sf_dir, "events").withColumn("ts", F.when(F.col("event_type") != "error", F.col("ts")))


def orders_nullkey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose urgent rows have no customer: one key with a fifth of all rows."""
    return table(spark, sf_dir, "orders").withColumn(
        "o_custkey", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_custkey"))
    )


def customers_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without one market segment."""
    return table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") != "BUILDING")


def items_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item prices, negative for one return flag."""
    price = F.col("l_extendedprice").cast(MONEY)
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "A", -price).otherwise(price).alias("price")
    )


def geo_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as points; the nation is the zip prefix and one segment has no city."""
    return table(spark, sf_dir, "customer").select(
        F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("geolocation_zip_code_prefix"),
        F.col("c_acctbal").alias("geolocation_lat"),
        (-F.col("c_acctbal")).alias("geolocation_lng"),
        F.when(F.col("c_mktsegment") != "AUTOMOBILE", F.col("c_mktsegment")).alias("geolocation_city"),
        F.col("c_name").alias("geolocation_state"),
        F.col("c_custkey").alias("seq"),
    )


def dirty_marketplace(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The nine raw tables with dirt: text dates and numbers, missing values, copies, repeated keys.

    ``seq`` is the input order.
    """
    clean = marketplace(spark, sf_dir)
    part, orders = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    pending = F.col("o_orderstatus") == "P"
    date_text = F.col("o_orderdate").cast("string")

    def numbered(df: DataFrame, n: int) -> DataFrame:
        return df.withColumn("seq", F.lit(n).cast("long"))

    def twice(df: DataFrame) -> DataFrame:
        return numbered(df, 1).unionByName(numbered(df, 2))

    weight = F.when(F.col("p_brand") == "Brand#3", "n/a").otherwise(F.col("p_size").cast("string"))
    products = part.select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_brand") != "Brand#1", F.col("p_type")).alias("product_category_name"),
        *[weight.alias(c) for c in schemas.PRODUCT_NUMERIC_COLUMNS],
    )
    other_products = products.withColumn("product_category_name", F.lit("later copy"))

    def review(days: int, n: int) -> DataFrame:
        answered = F.col("o_orderdate") + F.expr(f"INTERVAL {days} DAYS")
        no_text = F.lit(None).cast("string")
        return numbered(
            orders.select(
                F.col("o_orderkey").alias("order_id"),
                (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("review_score"),
                no_text.alias("review_comment_title"),
                no_text.alias("review_comment_message"),
                date_text.alias("review_creation_date"),
                F.when(pending & F.lit(n == 2), "never").otherwise(answered.cast("string")).alias(
                    "review_answer_timestamp"
                ),
            ),
            n,
        )

    return {
        "customers": twice(clean["customers"]),
        "sellers": twice(clean["sellers"]),
        "products": numbered(products, 1).unionByName(numbered(other_products, 2)),
        "orders": twice(
            orders.select(
                F.col("o_orderkey").alias("order_id"),
                F.col("o_custkey").alias("customer_id"),
                date_text.alias("order_purchase_timestamp"),
                F.lit("?").alias("order_approved_at"),
                F.lit(None).cast("string").alias("order_delivered_carrier_date"),
                F.when(pending, "soon").otherwise(date_text).alias("order_delivered_customer_date"),
                (F.col("o_orderdate") + F.expr("INTERVAL 400 DAYS"))
                .cast("string")
                .alias("order_estimated_delivery_date"),
            )
        ),
        "order_items": twice(clean["order_items"]),
        "payments": twice(clean["payments"]),
        "reviews": review(1, 1).unionByName(review(2, 2)),
        "geolocation": geo_points(spark, sf_dir),
        "category_translation": twice(category_translation(spark)),
    }
