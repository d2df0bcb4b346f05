"""Registered queries: a Spark function per key and, next to it, the SQL that defines its result."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a query under a key, with its SQL when SQL can say it."""

    def register(function):
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = function
        if sql is not None:
            ORACLES[key] = sql
        return function

    return register


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Round statistics whose last bits depend on the order of additions."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Views of the oracle side, as common table expressions ---------------------------------------------------

FLAT = """
flat AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
         l_suppkey AS seller_id, p_type AS product_category_name, o_custkey AS customer_id,
         cn.n_name AS customer_city, cr.r_name AS customer_state,
         sn.n_name AS seller_city, sr.r_name AS seller_state,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
         CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS freight_value,
         o_orderdate AS order_purchase_timestamp,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS period
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey
  JOIN region cr ON cn.n_regionkey = cr.r_regionkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey
  JOIN region sr ON sn.n_regionkey = sr.r_regionkey
  JOIN part ON l_partkey = p_partkey
)"""

PAYMENTS = """
payments AS (
  SELECT o_orderkey AS order_id, o_orderstatus AS payment_type,
         CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS payment_installments,
         CAST(o_totalprice AS DECIMAL(18,2)) AS payment_value
  FROM orders
)"""

REVIEWS = """
reviews AS (
  SELECT o_orderkey AS order_id,
         CASE WHEN o_orderstatus <> 'P' THEN 6 - CAST(substring(o_orderpriority, 1, 1) AS INTEGER) END
           AS review_score,
         o_orderdate AS review_answer_timestamp
  FROM orders
)"""

DELIVERY = """
delivery AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, min(l_suppkey) AS seller_id,
         r_name AS customer_state, o_orderdate AS purchased,
         CASE WHEN o_orderstatus <> 'P' THEN max(l_shipdate) + INTERVAL 13 HOUR END AS delivered,
         CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate + INTERVAL 400 DAY END AS estimated
  FROM orders
  JOIN lineitem ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  GROUP BY o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate, r_name
),
days AS (
  SELECT *,
         CAST(floor((epoch_us(delivered) - epoch_us(purchased)) / 86400000000.0) AS BIGINT) AS delivery_days,
         CAST(floor((epoch_us(delivered) - epoch_us(estimated)) / 86400000000.0) AS BIGINT) AS delay_days
  FROM delivery
),
done AS (
  SELECT *, coalesce(delay_days > 0, false) AS is_late FROM days WHERE delivery_days >= 0
)"""


def dbl(expression: str) -> str:
    """SQL cast to double."""
    return f"CAST({expression} AS DOUBLE)"


def sql_mean(column: str) -> str:
    """SQL mean as exact sum over count."""
    return f"CAST(sum({column}) AS DOUBLE) / CAST(count({column}) AS DOUBLE)"


def ranked_cte(key: str, source: str = "flat", value: str = "price") -> str:
    """SQL: entities ``e`` ranked by revenue with running sum, total and count."""
    keys = key.split(",")
    order = ", ".join(["r DESC", *keys])
    return f"""
ent AS (SELECT {key}, sum({value}) AS r FROM {source} GROUP BY {key}),
e AS (
  SELECT *, row_number() OVER (ORDER BY {order}) AS rk,
         sum(r) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS run,
         sum(r) OVER () AS total, count(*) OVER () AS n
  FROM ent
)"""


SHARE = f"{dbl('r')} / {dbl('total')} * 100"
CUMULATIVE = f"{dbl('run')} / {dbl('total')} * 100"


def share_sql(key: str, where: str = "", extra: str = "") -> str:
    """SQL of a revenue share table."""
    return f"""WITH {FLAT}, {ranked_cte(key)}
SELECT {key}, {dbl('r')} AS revenue, {SHARE} AS revenue_share_pct, rk AS rank{extra} FROM e {where}"""


def stats_sql(source: str, value: str) -> str:
    """SQL of the distribution statistics of a relation's column (rounded)."""
    v = dbl(value)
    return f"""
SELECT round({sql_mean(value)}, 6) AS mean, round(quantile_cont({v}, 0.5), 6) AS median,
       round(stddev_samp({v}), 6) AS std, min({v}) AS min, max({v}) AS max,
       round(quantile_cont({v}, 0.25), 6) AS p25, round(quantile_cont({v}, 0.75), 6) AS p75
FROM {source}"""


def geo_sql(geo: str, customers: bool = True, sellers: bool = True, where: str = "") -> str:
    """SQL of a geographic summary."""
    parts = [f"{geo}, {dbl('sum(price)')} AS revenue, count(DISTINCT order_id) AS orders"]
    outs = ["revenue / nullif(orders, 0) AS avg_revenue_per_order"]
    if customers:
        parts.append("count(DISTINCT customer_id) AS customers")
        outs.append("revenue / nullif(customers, 0) AS avg_revenue_per_customer")
    if sellers:
        parts.append("count(DISTINCT seller_id) AS sellers")
        outs.append("revenue / nullif(sellers, 0) AS revenue_per_seller")
    return f"""WITH {FLAT}, g AS (SELECT {', '.join(parts)} FROM flat GROUP BY {geo})
SELECT *, {', '.join(outs)} FROM g {where}"""
