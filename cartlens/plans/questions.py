"""The business questions, composed from the metric operators and the chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartlens.operators import charts, customers, delivery, revenue, scoring, series
from cartlens.operators.ordered import global_rank
from cartlens.plans import driver_tables as driver
from cartlens.plans import metric_queries as m
from cartlens.plans.flat import flat_reviews, translate_categories
from cartlens.plans.metric_queries import items, sums
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

TRANSLATION = """tr(product_category_name, english) AS (VALUES ('ECONOMY', 'economy class'), ('LARGE', 'large size'),
 ('MEDIUM', 'medium size'), ('PROMO', 'promotion'), ('SMALL', 'small size'))"""


# 1-3: executive revenue ----------------------------------------------------------------------------------


@query(
    "q01_headline_kpis",
    f"WITH {FLAT}, {m.KPI_SQL} "
    + " UNION ALL ".join(f"SELECT '{x}' AS label, {dbl(x)} AS value FROM kpis" for x in m.LABELS),
)
def q01(spark, sf_dir):
    return charts.to_long(m.kpis(spark, sf_dir))


@query(
    "q02_revenue_trend",
    f"""WITH {FLAT}, {m.MONTHLY}
SELECT period, price, (price / nullif(lag(price) OVER (ORDER BY period), 0) - 1) * 100 AS growth_rate,
 round(avg(price) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS rolling_avg FROM monthly""",
)
def q02(spark, sf_dir):
    monthly = m.monthly(spark, sf_dir)
    grown = series.compute_growth_rate(monthly, "price", "period", calendar=True)
    rolled = series.compute_rolling_avg(grown, "price", "period", calendar=True)
    return rounded(rolled, ["rolling_avg"], 4)


@query(
    "q03_month_ranking",
    f"SELECT period, price, round(revenue_contribution_pct, 9) AS revenue_contribution_pct, rank FROM ({m.MONTHLY_RANK})",
)
def q03(spark, sf_dir):
    ranked = series.compute_monthly_revenue_rank(m.monthly(spark, sf_dir), "period", "price")
    return rounded(ranked, ["revenue_contribution_pct"], 9)


# 4-6: concentration --------------------------------------------------------------------------------------


@query(
    "q04_customer_concentration",
    f"WITH c AS ({m.CONCENTRATION}) "
    + " UNION ALL ".join(f"SELECT '{x}' AS label, {x} AS value FROM c" for x in ("top_1pct", "top_5pct", "top_10pct")),
)
def q04(spark, sf_dir):
    return charts.concentration_long(m.concentration_stats(spark, sf_dir))


@query("q05_seller_share", share_sql("seller_id"))
def q05(spark, sf_dir):
    return revenue.compute_revenue_share(items(spark, sf_dir, "seller_id", "price"), "seller_id", "price")


@query("q06_category_pareto", share_sql("product_category_name", extra=f", {CUMULATIVE} AS cumulative_share_pct, {CUMULATIVE} <= 80 AS within_80"))
def q06(spark, sf_dir):
    frame = sums(spark, sf_dir, "product_category_name", "price")
    return charts.pareto_flagged(revenue.compute_pareto(frame, "product_category_name", "price"))


# 7-9: customers ------------------------------------------------------------------------------------------


@query(
    "q07_customer_lifetime_value",
    f"WITH {FLAT}, v AS (SELECT customer_id, sum(price) AS price FROM flat GROUP BY 1)" + stats_sql("v", "price"),
)
def q07(spark, sf_dir):
    frame = sums(spark, sf_dir, "customer_id", "price")
    _, stats = revenue.compute_distribution_stats(frame, "customer_id", "price")
    return rounded(stats, ["mean", "median", "std", "p25", "p75"])


@query("q07_top_customers", share_sql("customer_id", "WHERE rk <= 50"))
def q07_top(spark, sf_dir):
    frame = sums(spark, sf_dir, "customer_id", "price")
    return revenue.compute_revenue_share(frame, "customer_id", "price", top_n=50)


@query(
    "q08_order_value_distribution",
    f"WITH {FLAT}, v AS (SELECT order_id, sum(price) AS price FROM flat GROUP BY 1)" + stats_sql("v", "price"),
)
def q08(spark, sf_dir):
    _, stats = revenue.compute_distribution_stats(items(spark, sf_dir, "order_id", "price"), "order_id", "price")
    return rounded(stats, ["mean", "median", "std", "p25", "p75"])


@query("q09_customer_value_by_city", geo_sql("customer_city", sellers=False))
def q09(spark, sf_dir):
    frame = sums(spark, sf_dir, "price", "order_id", "customer_city", "customer_id")
    return customers.compute_geographic_summary(
        frame, "price", "order_id", city_col="customer_city", customer_col="customer_id"
    )["by_city"]


@query("q09_customer_value_by_state", geo_sql("customer_state", sellers=False))
def q09_states(spark, sf_dir):
    frame = sums(spark, sf_dir, "price", "order_id", "customer_state", "customer_id")
    return customers.compute_geographic_summary(
        frame, "price", "order_id", state_col="customer_state", customer_col="customer_id"
    )["by_state"]


# 10-13: products -----------------------------------------------------------------------------------------


@query("q10_top_products", m.product_sql("price"))
def q10(spark, sf_dir):
    frame = items(spark, sf_dir, "product_id", "price", "order_id")
    return revenue.compute_product_performance(frame, "product_id", "price", "order_id")


@query(
    "q11_category_share",
    f"""WITH {FLAT}, {TRANSLATION},
named AS (SELECT coalesce(english, product_category_name) AS product_category_name_english, price
 FROM flat LEFT JOIN tr USING (product_category_name)), {ranked_cte('product_category_name_english', 'named')}
SELECT product_category_name_english, {dbl('r')} AS revenue, {SHARE} AS revenue_share_pct, rk AS rank FROM e""",
)
def q11(spark, sf_dir):
    frame = sums(spark, sf_dir, "product_category_name", "price")
    frame = translate_categories(frame, driver.category_translation(spark))
    return revenue.compute_revenue_share(frame, "product_category_name_english", "price")


def product_quadrant_sql(x: str, y: str, label: str) -> str:
    return f"""WITH {FLAT}, p AS (SELECT product_id, {dbl('sum(price)')} AS revenue, count(order_id) AS units_sold,
 {sql_mean('price')} AS avg_price FROM flat GROUP BY 1),
md AS (SELECT quantile_cont({dbl(x)}, 0.5) AS mx, quantile_cont({dbl(y)}, 0.5) AS my FROM p)
SELECT product_id, revenue, units_sold, avg_price FROM p, md
WHERE CASE WHEN {x} >= mx THEN 'high' ELSE 'low' END || '_' || CASE WHEN {y} >= my THEN 'high' ELSE 'low' END = '{label}'"""


def product_quadrant(spark, sf_dir, x, y, label):
    frame = items(spark, sf_dir, "product_id", "price", "order_id")
    products = revenue.product_figures(frame, "product_id", "price", "order_id")
    placed = charts.quadrants(products.withColumn("revenue", F.col("revenue").cast("double")), x, y)
    return placed.filter(F.col("quadrant") == label).select("product_id", "revenue", "units_sold", "avg_price")


@query("q12_high_volume_low_revenue", product_quadrant_sql("units_sold", "revenue", "high_low"))
def q12(spark, sf_dir):
    return product_quadrant(spark, sf_dir, "units_sold", "revenue", "high_low")


@query("q13_high_price_low_volume", product_quadrant_sql("avg_price", "units_sold", "high_low"))
def q13(spark, sf_dir):
    return product_quadrant(spark, sf_dir, "avg_price", "units_sold", "high_low")


# 14-16: sellers ------------------------------------------------------------------------------------------


@query("q14_top_sellers", share_sql("seller_id", "WHERE rk <= 20"))
def q14(spark, sf_dir):
    frame = items(spark, sf_dir, "seller_id", "price")
    return revenue.compute_revenue_share(frame, "seller_id", "price", top_n=20)


@query(
    "q15_seller_volume_value",
    f"""WITH {FLAT}, g AS (SELECT seller_id, {m.AGG_SQL} FROM flat GROUP BY 1)
SELECT *, dense_rank() OVER (ORDER BY revenue DESC) AS rank FROM g""",
)
def q15(spark, sf_dir):
    frame = items(spark, sf_dir, "seller_id", "price", "order_id")
    return revenue.aggregate_by(frame, "seller_id", m.AGG_MAP, rank_col="revenue")


@query("q16_sellers_by_region", geo_sql("seller_state", customers=False))
def q16(spark, sf_dir):
    frame = items(spark, sf_dir, "price", "order_id", "seller_state", "seller_id")
    return customers.compute_geographic_summary(
        frame, "price", "order_id", state_col="seller_state", seller_col="seller_id"
    )["by_state"]


# 17-19: geography ----------------------------------------------------------------------------------------


@query("q17_states_by_revenue", geo_sql("customer_state"))
def q17(spark, sf_dir):
    frame = items(spark, sf_dir, "price", "order_id", "customer_state", "customer_id", "seller_id")
    return customers.compute_geographic_summary(
        frame, "price", "order_id", state_col="customer_state", customer_col="customer_id", seller_col="seller_id"
    )["by_state"]


@query(
    "q18_city_spend_per_customer",
    "SELECT *, row_number() OVER (ORDER BY avg_revenue_per_customer DESC, customer_city) AS rank FROM ("
    + geo_sql("customer_city", sellers=False)
    + ")",
)
def q18(spark, sf_dir):
    return global_rank(q09(spark, sf_dir), [("avg_revenue_per_customer", False), ("customer_city", True)])


@query("q19_freight_by_region", m.freight_group_sql("customer_state"))
def q19(spark, sf_dir):
    frame = sums(spark, sf_dir, "customer_state", "freight_value", "price")
    return delivery.compute_freight_ratio(frame, "freight_value", "price", "customer_state")


# 20-23: delivery -----------------------------------------------------------------------------------------


@query(
    "q20_delivery_by_month",
    f"""WITH {DELIVERY} SELECT CAST(date_trunc('month', purchased) AS DATE) AS period,
 {sql_mean('delivery_days')} AS delivery_days FROM done GROUP BY 1""",
)
def q20(spark, sf_dir):
    done = delivery.delivered_orders(driver.order_delivery(spark, sf_dir), m.PURCHASED, m.DELIVERED)
    return series.compute_monthly_series(done, m.PURCHASED, "delivery_days", "mean")


@query("q21_delivery_by_seller", m.delivery_group_sql("seller_id"))
def q21(spark, sf_dir):
    frame = driver.order_delivery(spark, sf_dir)
    return delivery.compute_delivery_metrics(frame, m.PURCHASED, m.DELIVERED, m.ESTIMATED, "seller_id")


@query("q22_delivery_by_state", m.delivery_group_sql("customer_state"))
def q22(spark, sf_dir):
    frame = driver.order_delivery(spark, sf_dir, place=True)
    return delivery.compute_delivery_metrics(frame, m.PURCHASED, m.DELIVERED, m.ESTIMATED, "customer_state")


DELIVERY_LABELS = ["avg_delivery_days", "median_delivery_days", "late_rate_pct", "early_rate_pct", "avg_delay_days"]


@query(
    "q23_on_time_share",
    f"""WITH {DELIVERY}, o AS (SELECT {m.DAYS_SQL}, {m.LATE_SQL},
 {dbl(f'count(*) - {m.LATE}')} / {dbl('count(*)')} * 100 AS early_rate_pct FROM done) """
    + " UNION ALL ".join(f"SELECT '{x}' AS label, {x} AS value FROM o" for x in DELIVERY_LABELS),
)
def q23(spark, sf_dir):
    return charts.to_long(m.delivery_overall(spark, sf_dir))


# 24-27: satisfaction -------------------------------------------------------------------------------------


def seller_experience(spark, sf_dir):
    """One row per delivered, reviewed order: seller, delivery days and rating."""
    done = delivery.delivered_orders(driver.order_delivery(spark, sf_dir), m.PURCHASED, m.DELIVERED)
    reviews = driver.marketplace(spark, sf_dir)["reviews"].select("order_id", "review_score")
    return done.join(reviews, "order_id").select("seller_id", "delivery_days", "review_score")


@query(
    "q24_delivery_time_vs_rating",
    f"""WITH {DELIVERY}, {REVIEWS}, s AS (SELECT seller_id, {sql_mean('delivery_days')} AS d,
 {sql_mean('review_score')} AS r FROM done JOIN reviews USING (order_id) GROUP BY 1)
SELECT round(corr(d, r), 6) AS correlation FROM s""",
)
def q24(spark, sf_dir):
    out = customers.compute_correlation(seller_experience(spark, sf_dir), "delivery_days", "review_score", "seller_id")
    return rounded(out["correlation"], ["correlation"])


@query("q25_rating_by_seller", m.rating_group_sql("seller_id", 5))
def q25(spark, sf_dir):
    frame = flat_reviews(driver.marketplace(spark, sf_dir), ["seller_id", "review_score"])
    return customers.compute_rating_summary(frame, "review_score", "seller_id")


@query("q26_rating_by_category", m.rating_group_sql("product_category_name", 5))
def q26(spark, sf_dir):
    frame = flat_reviews(driver.marketplace(spark, sf_dir), ["product_category_name", "review_score"])
    return customers.compute_rating_summary(frame, "review_score", "product_category_name")


@query(
    "q27_rating_by_month",
    f"""WITH {REVIEWS} SELECT CAST(date_trunc('month', review_answer_timestamp) AS DATE) AS period, {m.RATING_SQL}
FROM reviews WHERE review_score IS NOT NULL GROUP BY 1""",
)
def q27(spark, sf_dir):
    reviews = driver.marketplace(spark, sf_dir)["reviews"]
    monthly = customers.compute_rating_summary(reviews, "review_score", date_col="review_answer_timestamp")
    return charts.combo_data(monthly, "period", "review_count", "mean_rating")


# 28-30: payments -----------------------------------------------------------------------------------------


@query("q28_revenue_by_payment_type", m.BY_TYPE)
def q28(spark, sf_dir):
    return m.payment_summary(spark, sf_dir)["by_type"]


@query("q29_installments_and_spend", m.INSTALLMENTS)
def q29(spark, sf_dir):
    return m.payment_summary(spark, sf_dir)["installments"]


@query(
    "q30_installments_vs_payment",
    f"""WITH {PAYMENTS}, g AS (SELECT payment_installments, {sql_mean('payment_value')} AS avg_payment,
 count(*) AS order_count FROM payments GROUP BY 1)
SELECT payment_installments, order_count, avg_payment FROM g""",
)
def q30(spark, sf_dir):
    combo = charts.combo_data(q29(spark, sf_dir), "payment_installments", "order_count", "avg_payment")
    return charts.bar_data(combo, "payment_installments", "avg_payment")


# 31-33: operations ---------------------------------------------------------------------------------------


@query("q31_basket_and_revenue", f"WITH {FLAT}, {m.BASKET} SELECT {m.BASKET_STATS}, {m.BASKET_REVENUE} FROM b")
def q31(spark, sf_dir):
    frame = items(spark, sf_dir, "order_id", "order_item_id", "price")
    _, stats = customers.compute_basket_size(frame, "order_id", "order_item_id", "price")
    return rounded(stats, ["mean_basket", "std_basket", "avg_order_revenue", "basket_revenue_corr"])


@query("q32_freight_by_order", m.freight_group_sql("order_id"))
def q32(spark, sf_dir):
    frame = items(spark, sf_dir, "order_id", "freight_value", "price")
    return delivery.compute_freight_ratio(frame, "freight_value", "price", "order_id")


FREIGHT_LABELS = ["total_freight", "total_revenue", "freight_ratio_pct"]


@query(
    "q33_freight_overall",
    f"WITH {FLAT}, g AS (SELECT {m.FREIGHT_SQL} FROM flat), f AS (SELECT *, {m.RATIO_SQL} FROM g) "
    + " UNION ALL ".join(f"SELECT '{x}' AS label, {x} AS value FROM f" for x in FREIGHT_LABELS),
)
def q33(spark, sf_dir):
    frame = items(spark, sf_dir, "freight_value", "price")
    return charts.to_long(delivery.compute_freight_ratio(frame, "freight_value", "price"))


# 34-36: investment ---------------------------------------------------------------------------------------

# Own weights; scores take any.
INVESTMENT = {"units_sold": 0.45, "mean_rating": 0.35, "avg_price": 0.2}
PARTNER = {"revenue": 0.5, "orders": 0.2, "mean_rating": 0.3}


@query(
    "q34_category_investment",
    m.score_sql(
        "product_category_name",
        f"""{FLAT}, {REVIEWS},
a AS (SELECT product_category_name, {dbl('sum(price)')} AS revenue, {dbl('count(*)')} AS units_sold,
 {sql_mean('price')} AS avg_price FROM flat GROUP BY 1),
b AS (SELECT product_category_name, {sql_mean('review_score')} AS mean_rating
 FROM flat JOIN reviews USING (order_id) WHERE review_score IS NOT NULL GROUP BY 1),
m AS (SELECT * FROM a JOIN b USING (product_category_name))""",
        INVESTMENT,
    ),
)
def q34(spark, sf_dir):
    # Items and ratings meet once at the item grain; one groupBy yields every metric of a category.
    frame = flat_reviews(
        driver.marketplace(spark, sf_dir), ["product_category_name", "price", "review_score"], how="left"
    )
    metrics = revenue.aggregate_by(
        frame,
        "product_category_name",
        {
            "revenue": ("price", "sum"),
            "units_sold": ("price", lambda c: F.count(c).cast("double")),
            "mean_rating": ("review_score", "mean"),
            "avg_price": ("price", "mean"),
        },
    )
    return scoring.compute_composite_score(
        metrics, "product_category_name", list(INVESTMENT), list(INVESTMENT.values())
    )


@query(
    "q35_seller_partnership",
    m.score_sql(
        "seller_id",
        f"""{FLAT}, {REVIEWS},
a AS (SELECT seller_id, {dbl('sum(price)')} AS revenue, {dbl('count(DISTINCT order_id)')} AS orders FROM flat GROUP BY 1),
b AS (SELECT seller_id, {sql_mean('review_score')} AS mean_rating FROM flat JOIN reviews USING (order_id)
 WHERE review_score IS NOT NULL GROUP BY 1),
m AS (SELECT * FROM a JOIN b USING (seller_id))""",
        PARTNER,
    ),
)
def q35(spark, sf_dir):
    frame = flat_reviews(
        driver.marketplace(spark, sf_dir), ["seller_id", "order_id", "price", "review_score"], how="left"
    )
    metrics = revenue.aggregate_by(
        frame,
        "seller_id",
        {
            "revenue": ("price", "sum"),
            "orders": ("order_id", lambda c: F.countDistinct(c).cast("double")),
            "mean_rating": ("review_score", "mean"),
        },
    )
    return scoring.compute_composite_score(metrics, "seller_id", list(PARTNER), list(PARTNER.values()))


@query("q36_market_opportunity", m.OPPORTUNITY)
def q36(spark, sf_dir):
    frame = sums(spark, sf_dir, "customer_city", "price", "customer_id", "order_id")
    return customers.compute_market_opportunity(frame, "customer_city", "price", "customer_id", "order_id")


