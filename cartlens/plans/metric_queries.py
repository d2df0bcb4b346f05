"""Queries of the metric operators on the flat frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartlens.operators import charts, customers, delivery, revenue, scoring, series
from cartlens.plans import driver_tables as driver
from cartlens.plans.flat import flat_order_items, flat_payments, flat_reviews, translate_categories
from cartlens.plans.registry import (
    CUMULATIVE,
    DELIVERY,
    FLAT,
    PAYMENTS,
    REVIEWS,
    SHARE,
    dbl,
    geo_sql,
    query,
    ranked_cte,
    rounded,
    share_sql,
    sql_mean,
    stats_sql,
)

ALL_COLUMNS = [
    "order_id",
    "order_item_id",
    "product_id",
    "seller_id",
    "product_category_name",
    "customer_id",
    "customer_city",
    "customer_state",
    "seller_city",
    "seller_state",
    "price",
    "freight_value",
    "order_purchase_timestamp",
]
DATE = "order_purchase_timestamp"


def items(spark, sf_dir, *columns):
    """The item frame with just these columns."""
    return flat_order_items(driver.marketplace(spark, sf_dir), columns)


def sums(spark, sf_dir, *columns):
    """The item frame for operators that only add up price and freight."""
    return flat_order_items(
        driver.marketplace(spark, sf_dir), columns, additive=["price", "freight_value"]
    )


# Flat frames ---------------------------------------------------------------------------------------------


@query(
    "flat_order_items",
    f"""WITH {FLAT}
SELECT order_id, order_item_id, product_id, seller_id, product_category_name, customer_id, customer_city,
       customer_state, seller_city, seller_state, {dbl('price')} AS price,
       {dbl('freight_value')} AS freight_value, order_purchase_timestamp
FROM flat""",
)
def flat_items(spark, sf_dir):
    frame = flat_order_items(driver.marketplace(spark, sf_dir), ALL_COLUMNS, how="inner")
    return frame.withColumns({c: F.col(c).cast("double") for c in ("price", "freight_value")})


@query(
    "flat_category_translation",
    f"""WITH {FLAT}, tr(product_category_name, english) AS (VALUES ('ECONOMY', 'economy class'),
 ('LARGE', 'large size'), ('MEDIUM', 'medium size'), ('PROMO', 'promotion'), ('SMALL', 'small size'))
SELECT coalesce(english, product_category_name) AS product_category_name_english,
       {dbl('sum(price)')} AS revenue, count(*) AS items
FROM flat LEFT JOIN tr USING (product_category_name) GROUP BY 1""",
)
def flat_translation(spark, sf_dir):
    frame = items(spark, sf_dir, "product_category_name", "price")
    frame = translate_categories(frame, driver.category_translation(spark))
    return revenue.aggregate_by(
        frame,
        "product_category_name_english",
        {"revenue": ("price", "sum"), "items": ("price", "size")},
    )


# Headline figures and grouped aggregates -----------------------------------------------------------------

KPI_SQL = f"""
kpi AS (
  SELECT {dbl('sum(price)')} AS total_revenue, count(DISTINCT order_id) AS total_orders,
         count(DISTINCT customer_id) AS total_customers, count(DISTINCT seller_id) AS total_sellers,
         {dbl('sum(freight_value)')} AS total_freight
  FROM flat
),
kpis AS (
  SELECT total_revenue, total_orders, total_revenue / total_orders AS aov, total_customers, total_sellers,
         total_freight, total_freight / total_revenue AS freight_ratio
  FROM kpi
)"""


@query("kpis", f"WITH {FLAT}, {KPI_SQL} SELECT * FROM kpis")
def kpis(spark, sf_dir):
    frame = items(spark, sf_dir, "price", "order_id", "customer_id", "seller_id", "freight_value")
    return revenue.compute_kpis(frame, "price", "order_id", "customer_id", "seller_id", "freight_value")


# The operator's column names.
LABELS = ["total_revenue", "total_orders", "aov", "total_customers", "total_sellers", "total_freight", "freight_ratio"]


@query(
    "kpi_long",
    f"WITH {FLAT}, {KPI_SQL} "
    + " UNION ALL ".join(f"SELECT '{x}' AS label, {dbl(x)} AS value FROM kpis" for x in LABELS),
)
def kpi_long(spark, sf_dir):
    return charts.to_long(kpis(spark, sf_dir))


AGG_MAP = {"revenue": ("price", "sum"), "orders": ("order_id", "nunique"), "avg_price": ("price", "mean")}
AGG_SQL = f"{dbl('sum(price)')} AS revenue, count(DISTINCT order_id) AS orders, {sql_mean('price')} AS avg_price"


@query("aggregate_by", f"WITH {FLAT} SELECT product_category_name, {AGG_SQL} FROM flat GROUP BY 1")
def aggregate_by(spark, sf_dir):
    frame = items(spark, sf_dir, "product_category_name", "price", "order_id")
    return revenue.aggregate_by(frame, "product_category_name", AGG_MAP)


@query(
    "aggregate_by_multi",
    f"""WITH {FLAT}, g AS (SELECT customer_state, product_category_name, {AGG_SQL} FROM flat GROUP BY 1, 2)
SELECT *, dense_rank() OVER (ORDER BY revenue DESC) AS rank FROM g""",
)
def aggregate_by_multi(spark, sf_dir):
    frame = items(spark, sf_dir, "customer_state", "product_category_name", "price", "order_id")
    return revenue.aggregate_by(frame, ["customer_state", "product_category_name"], AGG_MAP, rank_col="revenue")


@query(
    "aggregate_by_ranked",
    f"""WITH {FLAT}, g AS (SELECT product_id, count(DISTINCT order_id) AS orders FROM flat GROUP BY 1)
SELECT *, dense_rank() OVER (ORDER BY orders DESC) AS rank FROM g""",
)
def aggregate_by_ranked(spark, sf_dir):
    # Many products share an order count: the dense rank has ties across range partitions.
    frame = items(spark, sf_dir, "product_id", "order_id")
    return revenue.aggregate_by(frame, "product_id", {"orders": ("order_id", "nunique")}, rank_col="orders")


@query(
    "aggregate_by_topn",
    f"""WITH {FLAT}, g AS (SELECT seller_id, {AGG_SQL} FROM flat GROUP BY 1)
SELECT *, dense_rank() OVER (ORDER BY orders DESC) AS rank FROM g ORDER BY orders DESC, seller_id LIMIT 15""",
)
def aggregate_by_topn(spark, sf_dir):
    frame = items(spark, sf_dir, "seller_id", "price", "order_id")
    return revenue.aggregate_by(frame, "seller_id", AGG_MAP, rank_col="orders", top_n=15)


@query(
    "aggregate_by_bottomn",
    f"""WITH {FLAT}, g AS (SELECT seller_id, {AGG_SQL} FROM flat GROUP BY 1)
SELECT *, dense_rank() OVER (ORDER BY orders) AS rank FROM g ORDER BY orders, seller_id LIMIT 15""",
)
def aggregate_by_bottomn(spark, sf_dir):
    frame = items(spark, sf_dir, "seller_id", "price", "order_id")
    return revenue.aggregate_by(frame, "seller_id", AGG_MAP, rank_col="orders", top_n=15, ascending=True)


@query(
    "aggregate_by_stats",
    f"""WITH {FLAT} SELECT seller_id, round(quantile_cont({dbl('price')}, 0.5), 6) AS median_price,
 {dbl('min(price)')} AS min_price, {dbl('max(price)')} AS max_price,
 round(stddev_samp({dbl('price')}), 6) AS std_price, count(*) AS n FROM flat GROUP BY 1""",
)
def aggregate_by_stats(spark, sf_dir):
    frame = items(spark, sf_dir, "seller_id", "price")
    out = revenue.aggregate_by(
        frame,
        "seller_id",
        {
            "median_price": ("price", "median"),
            "min_price": ("price", lambda c: F.min(c).cast("double")),
            "max_price": ("price", lambda c: F.max(c).cast("double")),
            "std_price": ("price", "std"),
            "n": ("price", "size"),
        },
    )
    return rounded(out, ["median_price", "std_price"])


# Series --------------------------------------------------------------------------------------------------


def monthly(spark, sf_dir, agg="sum", column="price", extra=()):
    frame = (sums if agg == "sum" else items)(spark, sf_dir, DATE, column, *extra)
    return series.compute_monthly_series(frame, DATE, column, agg, list(extra))


MONTHLY = f"monthly AS (SELECT period, {dbl('sum(price)')} AS price FROM flat GROUP BY 1)"


@query("monthly_series", f"WITH {FLAT}, {MONTHLY} SELECT * FROM monthly")
def monthly_series(spark, sf_dir):
    return monthly(spark, sf_dir)


@query(
    "monthly_series_multi",
    f"""WITH {FLAT} SELECT period, {dbl('sum(price)')} AS price, {dbl('sum(freight_value)')} AS freight_value
FROM flat GROUP BY 1""",
)
def monthly_series_multi(spark, sf_dir):
    return monthly(spark, sf_dir, extra=("freight_value",))


@query(
    "monthly_series_nunique",
    f"WITH {FLAT} SELECT period, count(DISTINCT customer_id) AS customer_id FROM flat GROUP BY 1",
)
def monthly_series_nunique(spark, sf_dir):
    return monthly(spark, sf_dir, "nunique", "customer_id")


@query("monthly_series_mean", f"WITH {FLAT} SELECT period, {sql_mean('price')} AS price FROM flat GROUP BY 1")
def monthly_series_mean(spark, sf_dir):
    return monthly(spark, sf_dir, "mean")


@query("monthly_series_count", f"WITH {FLAT} SELECT period, count(price) AS price FROM flat GROUP BY 1")
def monthly_series_count(spark, sf_dir):
    return monthly(spark, sf_dir, "count")


def growth_sql(k: int) -> str:
    return f"""WITH {FLAT}, {MONTHLY}
SELECT *, (price / nullif(lag(price, {k}) OVER (ORDER BY period), 0) - 1) * 100 AS growth_rate FROM monthly"""


@query("growth_rate", growth_sql(1))
def growth_rate(spark, sf_dir):
    return series.compute_growth_rate(monthly(spark, sf_dir), "price", "period", calendar=True)


@query("growth_rate_yoy", growth_sql(12))
def growth_rate_yoy(spark, sf_dir):
    return series.compute_growth_rate(monthly(spark, sf_dir), "price", "period", periods=12, calendar=True)


@query(
    "growth_rate_rows",
    """SELECT event_id, value,
 (value / nullif(lag(value, 3) OVER (ORDER BY event_id), 0) - 1) * 100 AS growth_rate FROM events""",
)
def growth_rate_rows(spark, sf_dir):
    events = driver.table(spark, sf_dir, "events").select("event_id", "value")
    return series.compute_growth_rate(events, "value", "event_id", periods=3)


@query(
    "growth_rate_pad",
    """WITH v AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value FROM events),
f AS (SELECT *, last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS filled FROM v)
SELECT event_id, value,
 (filled / nullif(lag(filled) OVER (ORDER BY event_id), 0) - 1) * 100 AS growth_rate FROM f""",
)
def growth_rate_pad(spark, sf_dir):
    present = F.when(F.col("event_type") != "error", F.col("value")).alias("value")
    events = driver.table(spark, sf_dir, "events").select("event_id", present)
    return series.compute_growth_rate(events, "value", "event_id", fill="pad")


@query(
    "rolling_avg",
    f"""WITH {FLAT}, {MONTHLY} SELECT *, round(avg(price) OVER (ORDER BY period
 ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS rolling_avg FROM monthly""",
)
def rolling_avg(spark, sf_dir):
    out = series.compute_rolling_avg(monthly(spark, sf_dir), "price", "period", calendar=True)
    return rounded(out, ["rolling_avg"], 4)


@query(
    "rolling_avg_minp",
    f"""WITH {FLAT}, {MONTHLY}
SELECT *, CASE WHEN count(price) OVER w >= 6 THEN round(avg(price) OVER w, 4) END AS rolling_avg
FROM monthly WINDOW w AS (ORDER BY period ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""",
)
def rolling_avg_minp(spark, sf_dir):
    out = series.compute_rolling_avg(
        monthly(spark, sf_dir), "price", "period", window=6, min_periods=6, calendar=True
    )
    return rounded(out, ["rolling_avg"], 4)


@query(
    "rolling_avg_rows",
    """WITH v AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)
SELECT event_id, value, CASE WHEN count(value) OVER w >= 4 THEN round(avg(value) OVER w, 6) END AS rolling_avg
FROM v WINDOW w AS (ORDER BY event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def rolling_avg_rows(spark, sf_dir):
    present = F.when(F.col("event_type") != "error", F.col("value")).alias("value")
    events = driver.table(spark, sf_dir, "events").select("event_id", present)
    out = series.compute_rolling_avg(events, "value", "event_id", window=7, min_periods=4)
    return rounded(out, ["rolling_avg"])


@query(
    "growth_by_group",
    f"""WITH {FLAT}, m AS (SELECT customer_state, period, {dbl('sum(price)')} AS price FROM flat GROUP BY 1, 2)
SELECT *, (price / nullif(lag(price) OVER (PARTITION BY customer_state ORDER BY period), 0) - 1) * 100
 AS growth_rate FROM m""",
)
def growth_by_group(spark, sf_dir):
    frame = sums(spark, sf_dir, DATE, "customer_state", "price")
    months = series.compute_monthly_series(frame, DATE, "price", within="customer_state")
    return series.compute_growth_rate(months, "price", "period", within="customer_state", calendar=True)


@query(
    "growth_rows_by_group",
    """SELECT event_type, event_id, value, (value / nullif(lag(value, 2) OVER (PARTITION BY event_type
 ORDER BY event_id), 0) - 1) * 100 AS growth_rate FROM events WHERE event_type IS NOT NULL""",
)
def growth_rows_by_group(spark, sf_dir):
    events = driver.table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return series.compute_growth_rate(events, "value", "event_id", periods=2, within="event_type")


def wide_sql(over: str, width: int) -> str:
    return f"""WITH e AS (SELECT event_type, event_id, CAST(value AS DECIMAL(18, 4)) AS value FROM events
 WHERE event_type IS NOT NULL)
SELECT event_type, event_id, value, {dbl('sum(value) OVER w')} / count(value) OVER w AS rolling_avg FROM e
WINDOW w AS ({over} ORDER BY event_id ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"""


def exact_events(spark, sf_dir):
    """Events of a known type with exact values, so that means are the same in any order of additions."""
    events = driver.table(spark, sf_dir, "events").filter(F.col("event_type").isNotNull())
    return events.select("event_type", "event_id", F.col("value").cast("decimal(18,4)").alias("value"))


@query("rolling_avg_wide", wide_sql("", 5000))
def rolling_avg_wide(spark, sf_dir):
    return series.compute_rolling_avg(exact_events(spark, sf_dir), "value", "event_id", window=5000)


@query("rolling_avg_by_group", wide_sql("PARTITION BY event_type", 500))
def rolling_avg_by_group(spark, sf_dir):
    events = exact_events(spark, sf_dir)
    return series.compute_rolling_avg(events, "value", "event_id", window=500, within="event_type")


MONTHLY_RANK = f"""WITH {FLAT}, {MONTHLY}
SELECT period, price, price / (SELECT {dbl('sum(price)')} FROM flat) * 100 AS revenue_contribution_pct,
       row_number() OVER (ORDER BY price DESC, period) AS rank FROM monthly"""


@query("monthly_revenue_rank", f"SELECT period, price, round(revenue_contribution_pct, 9) AS revenue_contribution_pct, rank FROM ({MONTHLY_RANK})")
def monthly_revenue_rank(spark, sf_dir):
    out = series.compute_monthly_revenue_rank(monthly(spark, sf_dir), "period", "price")
    return rounded(out, ["revenue_contribution_pct"], 9)


# Shares and concentration --------------------------------------------------------------------------------


@query("revenue_share", share_sql("seller_id"))
def revenue_share(spark, sf_dir):
    return revenue.compute_revenue_share(items(spark, sf_dir, "seller_id", "price"), "seller_id", "price")


@query("revenue_share_topn", share_sql("customer_id", "WHERE rk <= 20"))
def revenue_share_topn(spark, sf_dir):
    frame = sums(spark, sf_dir, "customer_id", "price")
    return revenue.compute_revenue_share(frame, "customer_id", "price", top_n=20)


@query("revenue_share_multi", share_sql("customer_state,product_category_name"))
def revenue_share_multi(spark, sf_dir):
    keys = ["customer_state", "product_category_name"]
    return revenue.compute_revenue_share(sums(spark, sf_dir, *keys, "price"), keys, "price")


PARETO_EXTRA = f", {CUMULATIVE} AS cumulative_share_pct"


@query("pareto", share_sql("customer_id", extra=PARETO_EXTRA))
def pareto(spark, sf_dir):
    return revenue.compute_pareto(sums(spark, sf_dir, "customer_id", "price"), "customer_id", "price")


@query("pareto_flagged", share_sql("product_id", extra=f"{PARETO_EXTRA}, {CUMULATIVE} <= 80 AS within_80"))
def pareto_flagged(spark, sf_dir):
    table = revenue.compute_pareto(items(spark, sf_dir, "product_id", "price"), "product_id", "price")
    return charts.pareto_flagged(table)


CONCENTRATION = f"""WITH {FLAT}, {ranked_cte('customer_id')}
SELECT """ + ", ".join(
    f"{dbl(f'sum(r) FILTER (WHERE rk <= greatest(1, ceil(n * {p})))')} / {dbl('max(total)')} * 100 AS {label}"
    for p, label in ((0.01, "top_1pct"), (0.05, "top_5pct"), (0.1, "top_10pct"))
) + f""",
 CAST(count(*) FILTER (WHERE {dbl('run')} / {dbl('total')} < 0.8) + 1 AS DOUBLE) / max(n) AS pareto_ratio FROM e"""


@query("concentration_stats", CONCENTRATION)
def concentration_stats(spark, sf_dir):
    frame = sums(spark, sf_dir, "customer_id", "price")
    return revenue.compute_concentration_stats(frame, "customer_id", "price")


@query(
    "concentration_long",
    f"WITH c AS ({CONCENTRATION}) "
    + " UNION ALL ".join(f"SELECT '{x}' AS label, {x} AS value FROM c" for x in ("top_1pct", "top_5pct", "top_10pct")),
)
def concentration_long(spark, sf_dir):
    return charts.concentration_long(concentration_stats(spark, sf_dir))


@query("entity_values", f"WITH {FLAT} SELECT order_id, {dbl('sum(price)')} AS price FROM flat GROUP BY 1")
def entity_values(spark, sf_dir):
    return revenue.entity_values(items(spark, sf_dir, "order_id", "price"), "order_id", "price")


@query(
    "distribution_stats",
    f"WITH {FLAT}, v AS (SELECT customer_id, sum(price) AS price FROM flat GROUP BY 1)" + stats_sql("v", "price"),
)
def distribution_stats(spark, sf_dir):
    frame = sums(spark, sf_dir, "customer_id", "price")
    _, stats = revenue.compute_distribution_stats(frame, "customer_id", "price")
    return rounded(stats, ["mean", "median", "std", "p25", "p75"])


@query(
    "distribution_stats_mean",
    f"""WITH {FLAT}, v AS (SELECT order_id, {sql_mean('price')} AS price FROM flat GROUP BY 1)"""
    + stats_sql("v", "price"),
)
def distribution_stats_mean(spark, sf_dir):
    frame = items(spark, sf_dir, "order_id", "price")
    _, stats = revenue.compute_distribution_stats(frame, "order_id", "price", agg="mean")
    return rounded(stats, ["mean", "median", "std", "p25", "p75"])


def product_sql(price: str) -> str:
    return f"""WITH {FLAT}, {ranked_cte('product_id')},
p AS (SELECT product_id, count(order_id) AS units_sold, {sql_mean(price)} AS avg_price FROM flat GROUP BY 1)
SELECT product_id, {dbl('r')} AS revenue, units_sold, avg_price, {SHARE} AS revenue_share_pct, rk AS revenue_rank
FROM e JOIN p USING (product_id)"""


@query("product_performance", product_sql("price"))
def product_performance(spark, sf_dir):
    frame = items(spark, sf_dir, "product_id", "price", "order_id")
    return revenue.compute_product_performance(frame, "product_id", "price", "order_id")


@query("product_performance_price", product_sql("freight_value"))
def product_performance_price(spark, sf_dir):
    frame = items(spark, sf_dir, "product_id", "price", "order_id", "freight_value")
    return revenue.compute_product_performance(frame, "product_id", "price", "order_id", "freight_value")


# Delivery and freight ------------------------------------------------------------------------------------

PURCHASED, DELIVERED, ESTIMATED = (
    "order_purchase_timestamp",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
)
DAYS_SQL = f"{sql_mean('delivery_days')} AS avg_delivery_days, quantile_cont({dbl('delivery_days')}, 0.5) AS median_delivery_days"
LATE = "sum(CAST(is_late AS INTEGER))"
LATE_SQL = f"{dbl(LATE)} / {dbl('count(*)')} * 100 AS late_rate_pct, {sql_mean('delay_days')} AS avg_delay_days"


@query(
    "delivery_overall",
    f"""WITH {DELIVERY} SELECT {DAYS_SQL}, {LATE_SQL},
 {dbl(f'count(*) - {LATE}')} / {dbl('count(*)')} * 100 AS early_rate_pct FROM done""",
)
def delivery_overall(spark, sf_dir):
    frame = driver.order_delivery(spark, sf_dir)
    return delivery.compute_delivery_metrics(frame, PURCHASED, DELIVERED, ESTIMATED)


@query("delivery_overall_noest", f"WITH {DELIVERY} SELECT {DAYS_SQL} FROM done")
def delivery_overall_noest(spark, sf_dir):
    return delivery.compute_delivery_metrics(driver.order_delivery(spark, sf_dir), PURCHASED, DELIVERED)


def delivery_group_sql(key: str, late: bool = True) -> str:
    extra = f", {LATE_SQL}" if late else ""
    return f"""WITH {DELIVERY}, g AS (
 SELECT {key}, {DAYS_SQL}, count(delivery_days) AS order_count{extra} FROM done GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY avg_delivery_days DESC, {key}) AS rank FROM g"""


@query("delivery_by_group", delivery_group_sql("seller_id"))
def delivery_by_group(spark, sf_dir):
    frame = driver.order_delivery(spark, sf_dir)
    return delivery.compute_delivery_metrics(frame, PURCHASED, DELIVERED, ESTIMATED, "seller_id")


@query("delivery_by_group_noest", delivery_group_sql("customer_state", late=False))
def delivery_by_group_noest(spark, sf_dir):
    frame = driver.order_delivery(spark, sf_dir, place=True)
    return delivery.compute_delivery_metrics(frame, PURCHASED, DELIVERED, group_col="customer_state")


FREIGHT_SQL = f"{dbl('sum(freight_value)')} AS total_freight, {dbl('sum(price)')} AS total_revenue"
RATIO_SQL = "total_freight / nullif(total_revenue, 0) * 100 AS freight_ratio_pct"


@query("freight_ratio_overall", f"WITH {FLAT}, g AS (SELECT {FREIGHT_SQL} FROM flat) SELECT *, {RATIO_SQL} FROM g")
def freight_ratio_overall(spark, sf_dir):
    return delivery.compute_freight_ratio(items(spark, sf_dir, "freight_value", "price"), "freight_value", "price")


def freight_group_sql(key: str) -> str:
    return f"WITH {FLAT}, g AS (SELECT {key}, {FREIGHT_SQL} FROM flat GROUP BY 1) SELECT *, {RATIO_SQL} FROM g"


@query("freight_ratio_by_group", freight_group_sql("seller_state"))
def freight_ratio_by_group(spark, sf_dir):
    frame = sums(spark, sf_dir, "seller_state", "freight_value", "price")
    return delivery.compute_freight_ratio(frame, "freight_value", "price", "seller_state")


# Correlation, baskets, ratings, payments, geography ------------------------------------------------------


@query("correlation", f"WITH {FLAT} SELECT round(corr({dbl('price')}, {dbl('freight_value')}), 6) AS correlation FROM flat")
def correlation(spark, sf_dir):
    frame = items(spark, sf_dir, "price", "freight_value")
    return rounded(customers.compute_correlation(frame, "price", "freight_value")["correlation"], ["correlation"])


POINTS = f"pts AS (SELECT seller_id, {sql_mean('price')} AS price, {sql_mean('freight_value')} AS freight_value FROM flat GROUP BY 1)"


@query("correlation_grouped", f"WITH {FLAT}, {POINTS} SELECT round(corr(price, freight_value), 6) AS correlation FROM pts")
def correlation_grouped(spark, sf_dir):
    frame = items(spark, sf_dir, "seller_id", "price", "freight_value")
    out = customers.compute_correlation(frame, "price", "freight_value", "seller_id")
    return rounded(out["correlation"], ["correlation"])


@query("correlation_points", f"WITH {FLAT}, {POINTS} SELECT * FROM pts")
def correlation_points(spark, sf_dir):
    frame = items(spark, sf_dir, "seller_id", "price", "freight_value")
    return customers.compute_correlation(frame, "price", "freight_value", "seller_id")["scatter_df"]


BASKET = "b AS (SELECT order_id, count(*) AS basket_size, sum(price) AS r FROM flat GROUP BY 1)"
BASKET_STATS = f"""round({sql_mean('basket_size')}, 6) AS mean_basket,
 quantile_cont({dbl('basket_size')}, 0.5) AS median_basket,
 round(stddev_samp(basket_size), 6) AS std_basket, max(basket_size) AS max_basket"""
BASKET_REVENUE = f"""round({sql_mean('r')}, 6) AS avg_order_revenue,
 round(corr({dbl('basket_size')}, {dbl('r')}), 6) AS basket_revenue_corr"""


@query("basket_sizes", f"WITH {FLAT}, {BASKET} SELECT order_id, basket_size FROM b")
def basket_sizes(spark, sf_dir):
    return customers.compute_basket_size(items(spark, sf_dir, "order_id"), "order_id")[0]


@query("basket_stats", f"WITH {FLAT}, {BASKET} SELECT {BASKET_STATS} FROM b")
def basket_stats(spark, sf_dir):
    frame = items(spark, sf_dir, "order_id", "order_item_id")
    _, stats = customers.compute_basket_size(frame, "order_id", "order_item_id")
    return rounded(stats, ["mean_basket", "std_basket"])


@query("basket_stats_revenue", f"WITH {FLAT}, {BASKET} SELECT {BASKET_STATS}, {BASKET_REVENUE} FROM b")
def basket_stats_revenue(spark, sf_dir):
    frame = items(spark, sf_dir, "order_id", "price")
    _, stats = customers.compute_basket_size(frame, "order_id", revenue_col="price")
    return rounded(stats, ["mean_basket", "std_basket", "avg_order_revenue", "basket_revenue_corr"])


RATING_SQL = f"{sql_mean('review_score')} AS mean_rating, count(review_score) AS review_count"


@query(
    "rating_monthly",
    f"""WITH {REVIEWS} SELECT CAST(date_trunc('month', review_answer_timestamp) AS DATE) AS period, {RATING_SQL}
FROM reviews WHERE review_score IS NOT NULL GROUP BY 1""",
)
def rating_monthly(spark, sf_dir):
    reviews = driver.marketplace(spark, sf_dir)["reviews"]
    return customers.compute_rating_summary(reviews, "review_score", date_col="review_answer_timestamp")


def rating_group_sql(key: str, least: int) -> str:
    return f"""WITH {FLAT}, {REVIEWS} SELECT {key}, {RATING_SQL}
FROM flat JOIN reviews USING (order_id) WHERE review_score IS NOT NULL GROUP BY 1
HAVING count(review_score) >= {least}"""


@query("rating_by_group", rating_group_sql("product_id", 20))
def rating_by_group(spark, sf_dir):
    frame = flat_reviews(driver.marketplace(spark, sf_dir), ["product_id", "review_score"])
    return customers.compute_rating_summary(frame, "review_score", "product_id", min_reviews=20)


@query(
    "rating_overall",
    f"""WITH {REVIEWS} SELECT {sql_mean('review_score')} AS mean,
 quantile_cont({dbl('review_score')}, 0.5) AS median FROM reviews WHERE review_score IS NOT NULL""",
)
def rating_overall(spark, sf_dir):
    reviews = driver.marketplace(spark, sf_dir)["reviews"]
    return customers.compute_rating_summary(reviews, "review_score")["overall"]


@query(
    "rating_distribution",
    f"WITH {REVIEWS} SELECT review_score, count(*) AS count FROM reviews WHERE review_score IS NOT NULL GROUP BY 1",
)
def rating_distribution(spark, sf_dir):
    reviews = driver.marketplace(spark, sf_dir)["reviews"]
    return customers.compute_rating_summary(reviews, "review_score")["distribution"]


PAID = f"{dbl('sum(payment_value)')} AS total_revenue, {sql_mean('payment_value')} AS avg_payment, count(payment_value) AS order_count"
BY_TYPE = f"""WITH {PAYMENTS}, g AS (SELECT payment_type, {PAID} FROM payments GROUP BY 1)
SELECT *, total_revenue / (SELECT {dbl('sum(payment_value)')} FROM payments) * 100 AS revenue_share_pct FROM g"""
INSTALLMENTS = f"WITH {PAYMENTS} SELECT payment_installments, {PAID} FROM payments GROUP BY 1"


def payment_summary(spark, sf_dir):
    payments = flat_payments(
        driver.marketplace(spark, sf_dir), ["payment_type", "payment_value", "payment_installments"]
    )
    return customers.compute_payment_summary(payments, "payment_type", "payment_value", "payment_installments")


@query("payment_by_type", BY_TYPE)
def payment_by_type(spark, sf_dir):
    return payment_summary(spark, sf_dir)["by_type"]


@query("payment_installments", INSTALLMENTS)
def payment_installments(spark, sf_dir):
    return payment_summary(spark, sf_dir)["installments"]


@query("geo_by_state", geo_sql("customer_state"))
def geo_by_state(spark, sf_dir):
    frame = items(spark, sf_dir, "price", "order_id", "customer_state", "customer_id", "seller_id")
    return customers.compute_geographic_summary(
        frame, "price", "order_id", state_col="customer_state", customer_col="customer_id", seller_col="seller_id"
    )["by_state"]


@query("geo_by_city", geo_sql("customer_city", sellers=False))
def geo_by_city(spark, sf_dir):
    frame = sums(spark, sf_dir, "price", "order_id", "customer_city", "customer_id")
    return customers.compute_geographic_summary(
        frame, "price", "order_id", city_col="customer_city", customer_col="customer_id"
    )["by_city"]


OPPORTUNITY = f"""WITH {FLAT},
g AS (SELECT customer_city, {dbl('sum(price)')} AS revenue, count(DISTINCT customer_id) AS customers,
      count(DISTINCT order_id) AS orders FROM flat GROUP BY 1),
h AS (SELECT *, revenue / customers AS revenue_per_customer,
      {dbl('orders')} / customers AS orders_per_customer FROM g),
m AS (SELECT quantile_cont(revenue_per_customer, 0.5) AS mr, quantile_cont({dbl('customers')}, 0.5) AS mc FROM h)
SELECT h.*, revenue_per_customer >= mr AND customers < mc AS opportunity_flag FROM h, m"""


@query("market_opportunity", OPPORTUNITY)
def market_opportunity(spark, sf_dir):
    frame = sums(spark, sf_dir, "customer_city", "price", "customer_id", "order_id")
    return customers.compute_market_opportunity(frame, "customer_city", "price", "customer_id", "order_id")


# Composite score -----------------------------------------------------------------------------------------


def norm_sql(c: str) -> str:
    return (
        f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.0 "
        f"ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END AS {c}_norm"
    )


def score_sql(index: str, source: str, weights: dict[str, float]) -> str:
    """SQL: normalise, weigh and rank the metrics of relation ``m``."""
    cols = list(weights)
    score = " + ".join(f"{c}_norm * {w}::DOUBLE" for c, w in weights.items())
    return f"""WITH {source},
d AS (SELECT {index}, {', '.join(f'{dbl(c)} AS {c}' for c in cols)} FROM m),
nrm AS (SELECT *, {', '.join(norm_sql(c) for c in cols)} FROM d),
sc AS (SELECT *, {score} AS composite_score FROM nrm)
SELECT *, row_number() OVER (ORDER BY composite_score DESC, {index}) AS rank FROM sc"""


SELLER_WEIGHTS = {"revenue": 0.5, "orders": 0.3, "constant_metric": 0.2}


@query(
    "composite_score",
    score_sql(
        "seller_id",
        f"""{FLAT}, m AS (SELECT seller_id, sum(price) AS revenue, count(DISTINCT order_id) AS orders,
 1 AS constant_metric FROM flat GROUP BY 1)""",
        SELLER_WEIGHTS,
    ),
)
def composite_score(spark, sf_dir):
    frame = items(spark, sf_dir, "seller_id", "price", "order_id")
    metrics = revenue.aggregate_by(
        frame, "seller_id", {"revenue": ("price", "sum"), "orders": ("order_id", "nunique")}
    ).select("seller_id", "revenue", F.col("orders").cast("double"), F.lit(1.0).alias("constant_metric"))
    return scoring.compute_composite_score(metrics, "seller_id", list(SELLER_WEIGHTS), list(SELLER_WEIGHTS.values()))
