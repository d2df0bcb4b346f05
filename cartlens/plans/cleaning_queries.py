"""Queries of the cleaning and quality operators on dirtied variants of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartlens.operators import cleaning, quality
from cartlens.plans import cleaning_pipeline
from cartlens.plans import driver_tables as driver
from cartlens.plans.registry import query, rounded

LINE_COLUMNS = (
    "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,"
    " l_returnflag, l_linestatus, l_shipdate"
)
ITEMS_DUP = "items_dup AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_returnflag = 'R')"
PARTS_NULL = """parts_null AS (SELECT p_partkey, p_name, p_brand,
 CASE WHEN p_brand <> 'Brand#1' THEN p_type END AS p_type,
 CASE WHEN p_brand <> 'Brand#2' THEN p_size END AS p_size,
 CASE WHEN p_brand <> 'Brand#2' THEN p_retailprice END AS p_retailprice FROM part)"""
EVENTS_LATE = """ev AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN ts END AS ts, user_id, event_type,
 value, props FROM events)"""
ORDERS_NULLKEY = """orders_nullkey AS (SELECT o_orderkey,
 CASE WHEN o_orderpriority <> '1-URGENT' THEN o_custkey END AS o_custkey, o_orderdate FROM orders)"""


@query("dedup_exact", f"WITH {ITEMS_DUP} SELECT DISTINCT {LINE_COLUMNS} FROM items_dup")
def dedup_exact(spark, sf_dir):
    return cleaning.drop_exact_duplicates(driver.items_dup(spark, sf_dir))


@query(
    "dedup_exact_report",
    f"""WITH {ITEMS_DUP}, n(t, b, a) AS (
 SELECT 'items', (SELECT count(*) FROM items_dup), (SELECT count(*) FROM (SELECT DISTINCT * FROM items_dup))
 UNION ALL
 SELECT 'customers', (SELECT count(*) FROM customer), (SELECT count(*) FROM (SELECT DISTINCT * FROM customer)))
SELECT t AS "table", b AS rows_before, a AS rows_after, b - a AS removed FROM n""",
)
def dedup_exact_report(spark, sf_dir):
    return cleaning.exact_duplicate_report(
        {"items": driver.items_dup(spark, sf_dir), "customers": driver.table(spark, sf_dir, "customer")}
    )


@query("dedup_keep_first", "SELECT *, CAST(1 AS INTEGER) AS seq FROM part")
def dedup_keep_first(spark, sf_dir):
    return cleaning.keep_first(driver.parts_dup(spark, sf_dir), "p_partkey", "seq")


def latest_sql(nulls: str) -> str:
    return f"""WITH {EVENTS_LATE} SELECT * FROM ev
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS {nulls}, event_id DESC) = 1"""


@query("dedup_keep_latest", latest_sql("FIRST"))
def dedup_keep_latest(spark, sf_dir):
    return cleaning.keep_latest(driver.events_late(spark, sf_dir), "user_id", "ts", "event_id")


@query("dedup_keep_latest_known", latest_sql("LAST"))
def dedup_keep_latest_known(spark, sf_dir):
    return cleaning.keep_latest(driver.events_late(spark, sf_dir), "user_id", "ts", "event_id", nulls="lose")


KEY_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


@query(
    "key_surrogate",
    f"SELECT row_number() OVER (ORDER BY {', '.join(KEY_ORDER)}) AS order_item_key, {LINE_COLUMNS} FROM lineitem",
)
def key_surrogate(spark, sf_dir):
    return cleaning.surrogate_key(driver.table(spark, sf_dir, "lineitem"), KEY_ORDER, "order_item_key")


@query(
    "geo_normalize",
    """WITH g AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS z, c_acctbal AS lat, -c_acctbal AS lng,
 CASE WHEN c_mktsegment <> 'AUTOMOBILE' THEN c_mktsegment END AS city, c_name AS state, c_custkey AS seq FROM customer)
SELECT z AS geolocation_zip_code_prefix, round(avg(lat), 6) AS geolocation_lat, round(avg(lng), 6) AS geolocation_lng,
 arg_min(city, seq) FILTER (WHERE city IS NOT NULL) AS geolocation_city, arg_min(state, seq) AS geolocation_state
FROM g GROUP BY z""",
)
def geo_normalize(spark, sf_dir):
    out = cleaning.normalize_geolocation(driver.geo_points(spark, sf_dir))
    return rounded(out, ["geolocation_lat", "geolocation_lng"])


@query("clean_dropna", f"WITH {PARTS_NULL} SELECT * FROM parts_null WHERE p_type IS NOT NULL AND p_size IS NOT NULL")
def clean_dropna(spark, sf_dir):
    return cleaning.drop_incomplete(driver.parts_null(spark, sf_dir), ["p_type", "p_size"])


@query(
    "clean_coerce_ts",
    """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'garbage'
 ELSE CAST(o_orderdate AS VARCHAR) END AS o_orderdate FROM orders)
SELECT o_orderkey, TRY_CAST(o_orderdate AS TIMESTAMP) AS o_orderdate FROM t""",
)
def clean_coerce_ts(spark, sf_dir):
    return cleaning.coerce_timestamps(driver.orders_text(spark, sf_dir), ["o_orderdate"])


PARTS_TEXT = """parts_text AS (SELECT p_partkey, p_brand,
 CASE WHEN p_brand = 'Brand#3' THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS p_size FROM part)"""


@query(
    "clean_coerce_num",
    f"WITH {PARTS_TEXT} SELECT p_partkey, p_brand, TRY_CAST(p_size AS DOUBLE) AS p_size FROM parts_text",
)
def clean_coerce_num(spark, sf_dir):
    return cleaning.coerce_numbers(driver.parts_text(spark, sf_dir), ["p_size"])


@query(
    "clean_fill_const",
    f"""WITH {PARTS_NULL} SELECT p_partkey, p_name, p_brand, coalesce(p_type, 'unknown') AS p_type, p_size,
 p_retailprice FROM parts_null""",
)
def clean_fill_const(spark, sf_dir):
    return cleaning.fill_constants(driver.parts_null(spark, sf_dir), {"p_type": "unknown"})


@query(
    "clean_fill_median",
    f"""WITH {PARTS_NULL}, m AS (SELECT quantile_cont(CAST(p_size AS DOUBLE), 0.5) AS ms,
 quantile_cont(p_retailprice, 0.5) AS mp FROM parts_null)
SELECT p_partkey, p_name, p_brand, p_type, coalesce(CAST(p_size AS DOUBLE), ms) AS p_size,
 round(coalesce(p_retailprice, mp), 6) AS p_retailprice FROM parts_null, m""",
)
def clean_fill_median(spark, sf_dir):
    filled = cleaning.fill_medians(driver.parts_null(spark, sf_dir), ["p_size", "p_retailprice"])
    return rounded(filled, ["p_retailprice"])


@query(
    "dq_profile",
    f"""WITH {PARTS_NULL}
SELECT 'parts' AS "table", count(*) AS row_count, CAST(6 AS BIGINT) AS column_count,
 count(*) - count(p_type) + count(*) - count(p_size) + count(*) - count(p_retailprice) AS null_count
FROM parts_null
UNION ALL SELECT 'customers', count(*), 5, 0 FROM customer
UNION ALL SELECT 'items', count(*), 11, 0 FROM lineitem""",
)
def dq_profile(spark, sf_dir):
    return quality.profile(
        {
            "parts": driver.parts_null(spark, sf_dir),
            "customers": driver.table(spark, sf_dir, "customer"),
            "items": driver.table(spark, sf_dir, "lineitem"),
        }
    )


@query(
    "dq_primary_key",
    f"""WITH {ORDERS_NULLKEY}
SELECT 'customers' AS "table", 'c_custkey' AS key, CAST(count(*) - count(DISTINCT c_custkey) AS BIGINT) AS duplicate_pk,
 CAST(0 AS BIGINT) AS null_pk FROM customer
UNION ALL SELECT 'orders', 'o_custkey',
 count(*) - count(DISTINCT o_custkey) - (count(*) > count(o_custkey))::BIGINT, count(*) - count(o_custkey) FROM orders_nullkey
UNION ALL SELECT 'parts', 'p_partkey', 2 * count(*) - count(DISTINCT p_partkey), 0 FROM part""",
)
def dq_primary_key(spark, sf_dir):
    return quality.primary_key_check(
        {
            "customers": (driver.table(spark, sf_dir, "customer"), "c_custkey"),
            "orders": (driver.orders_nullkey(spark, sf_dir), "o_custkey"),
            "parts": (driver.parts_dup(spark, sf_dir), "p_partkey"),
        }
    )


@query(
    "dq_foreign_key",
    f"""WITH {ORDERS_NULLKEY}, cut AS (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT 'orders -> customers' AS "check", count(*) AS missing FROM orders o
 WHERE NOT EXISTS (SELECT 1 FROM cut c WHERE c.c_custkey = o.o_custkey)
UNION ALL SELECT 'orders with missing keys -> customers', count(*) FROM orders_nullkey o
 WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)
UNION ALL SELECT 'orders -> keys with a missing one', count(*) FROM orders_nullkey o
 WHERE NOT EXISTS (SELECT 1 FROM orders_nullkey c WHERE c.o_custkey IS NOT DISTINCT FROM o.o_custkey)
UNION ALL SELECT 'items -> orders', count(*) FROM lineitem
 WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)""",
)
def dq_foreign_key(spark, sf_dir):
    orders, customer = driver.table(spark, sf_dir, "orders"), driver.table(spark, sf_dir, "customer")
    nullkey = driver.orders_nullkey(spark, sf_dir)
    return quality.foreign_key_check(
        {
            "orders -> customers": (orders, "o_custkey", driver.customers_cut(spark, sf_dir), "c_custkey"),
            "orders with missing keys -> customers": (nullkey, "o_custkey", customer, "c_custkey"),
            "orders -> keys with a missing one": (nullkey, "o_custkey", nullkey, "o_custkey"),
            "items -> orders": (driver.table(spark, sf_dir, "lineitem"), "l_orderkey", orders, "o_orderkey"),
        }
    )


@query(
    "dq_orphan_rows",
    f"""WITH {ORDERS_NULLKEY}
SELECT o_orderkey, o_custkey FROM orders_nullkey o
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c_mktsegment <> 'BUILDING')""",
)
def dq_orphan_rows(spark, sf_dir):
    orders = driver.orders_nullkey(spark, sf_dir).select("o_orderkey", "o_custkey")
    return quality.orphan_rows(orders, "o_custkey", driver.customers_cut(spark, sf_dir), "c_custkey")


@query(
    "dq_sanity",
    """SELECT 'negative_prices' AS "check", count(*) AS violations FROM lineitem
 WHERE l_returnflag = 'A' AND CAST(l_extendedprice AS DECIMAL(18,2)) > 0
UNION ALL SELECT 'negative_payments', count(*) FROM orders WHERE o_totalprice < 0
UNION ALL SELECT 'invalid_delivery_dates', count(*) FROM (
 SELECT o_orderdate, o_orderstatus, max(l_shipdate) AS shipped FROM orders JOIN lineitem ON l_orderkey = o_orderkey
 GROUP BY o_orderkey, o_orderdate, o_orderstatus)
 WHERE o_orderstatus <> 'P' AND shipped + INTERVAL 13 HOUR < o_orderdate""",
)
def dq_sanity(spark, sf_dir):
    payments = driver.marketplace(spark, sf_dir)["payments"]
    return quality.sanity_checks(
        driver.items_negative(spark, sf_dir), payments, driver.order_delivery(spark, sf_dir)
    )


# The whole pipeline on a dirty nine-table set ------------------------------------------------------------


def cleaned(spark, sf_dir, names=None):
    """The dirty tables through the pipeline, each written once."""
    return cleaning_pipeline.clean_tables(
        driver.dirty_marketplace(spark, sf_dir),
        key_order={
            "order_items": ["order_id", "order_item_id", "product_id", "seller_id", "price"],
            "payments": ["order_id"],
            "reviews": ["order_id", "seq"],
        },
        names=names,
    )


PIPELINE = """
raw_parts AS (SELECT p_partkey, CASE WHEN p_brand <> 'Brand#1' THEN p_type END AS cat,
 CASE WHEN p_brand <> 'Brand#3' THEN CAST(p_size AS DOUBLE) END AS size FROM part),
med AS (SELECT quantile_cont(size, 0.5) AS m FROM raw_parts),
n AS (SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM supplier) AS sellers,
 (SELECT count(*) FROM part) AS products, (SELECT count(*) FROM orders) AS orders,
 (SELECT count(*) FROM lineitem) AS items, (SELECT count(DISTINCT c_nationkey) FROM customer) AS zips,
 (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS pending)"""


@query(
    "clean_pipeline_profile",
    f"""WITH {PIPELINE}
SELECT 'customers' AS "table", customers AS row_count, CAST(3 AS BIGINT) AS column_count, CAST(0 AS BIGINT) AS null_count FROM n
UNION ALL SELECT 'sellers', sellers, 3, 0 FROM n
UNION ALL SELECT 'products', products, 9, 0 FROM n
UNION ALL SELECT 'orders', orders, 7, pending + orders * 2 FROM n
UNION ALL SELECT 'order_items', items, 7, 0 FROM n
UNION ALL SELECT 'payments', orders, 5, 0 FROM n
UNION ALL SELECT 'reviews', orders, 7, pending FROM n
UNION ALL SELECT 'geolocation', zips, 5, 0 FROM n
UNION ALL SELECT 'category_translation', 5, 2, 0 FROM n""",
)
def clean_pipeline_profile(spark, sf_dir):
    return quality.profile(cleaned(spark, sf_dir))


@query(
    "clean_pipeline_products",
    f"""WITH {PIPELINE} SELECT p_partkey AS product_id, coalesce(cat, 'unknown') AS product_category_name,
 coalesce(size, m) AS product_weight_g FROM raw_parts, med""",
)
def clean_pipeline_products(spark, sf_dir):
    tables = driver.dirty_marketplace(spark, sf_dir)
    products = cleaning_pipeline.clean_products(tables["products"])
    products = cleaning_pipeline.first_per_key("products", products)
    return products.select("product_id", "product_category_name", "product_weight_g")


@query(
    "clean_pipeline_reviews",
    """SELECT row_number() OVER (ORDER BY o_orderkey) * 2 AS review_key, o_orderkey AS order_id,
 CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 2 DAY END AS review_answer_timestamp,
 '' AS review_comment_title FROM orders""",
)
def clean_pipeline_reviews(spark, sf_dir):
    # Two reviews per order: the later answer wins, and so does a missing one. The keys have gaps.
    tables = driver.dirty_marketplace(spark, sf_dir)
    reviews = cleaning_pipeline.clean_reviews(tables["reviews"], ["order_id", "seq"])
    return reviews.select("review_key", "order_id", "review_answer_timestamp", "review_comment_title")


@query(
    "clean_pipeline_keys",
    """SELECT k.t AS "table", k.c AS key, CAST(0 AS BIGINT) AS duplicate_pk, CAST(0 AS BIGINT) AS null_pk
FROM (VALUES ('customers', 'customer_id'), ('sellers', 'seller_id'), ('products', 'product_id'),
 ('orders', 'order_id'), ('order_items', 'order_item_key'), ('payments', 'payment_id'), ('reviews', 'review_key'),
 ('geolocation', 'geolocation_zip_code_prefix'), ('category_translation', 'product_category_name')) k(t, c)""",
)
def clean_pipeline_keys(spark, sf_dir):
    return cleaning_pipeline.key_report(cleaned(spark, sf_dir))


@query(
    "clean_pipeline_references",
    """SELECT 'orders -> customers' AS "check", count(*) AS missing FROM orders
 WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
UNION ALL SELECT 'items -> products', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)
UNION ALL SELECT 'items -> sellers', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey)
UNION ALL SELECT 'items -> orders', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
UNION ALL SELECT 'reviews -> orders', 0
UNION ALL SELECT 'payments -> orders', 0""",
)
def clean_pipeline_references(spark, sf_dir):
    return cleaning_pipeline.reference_report(cleaned(spark, sf_dir))


@query(
    "clean_pipeline_sanity",
    """SELECT 'negative_prices' AS "check", count(*) FILTER (WHERE l_extendedprice < 0) AS violations FROM lineitem
UNION ALL SELECT 'negative_payments', count(*) FROM orders WHERE o_totalprice < 0
UNION ALL SELECT 'invalid_delivery_dates', CAST(0 AS BIGINT)""",
)
def clean_pipeline_sanity(spark, sf_dir):
    return cleaning_pipeline.sanity_report(cleaned(spark, sf_dir, ["order_items", "payments", "orders"]))
