"""Queries of the chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartlens.operators import charts, revenue, series
from cartlens.plans.metric_queries import DATE, items, sums
from cartlens.plans.registry import FLAT, dbl, query, rounded, sql_mean

PRODUCT_SALES = "p AS (SELECT product_id, sum(price) AS r, count(*) AS units FROM flat GROUP BY 1)"


def product_sales(spark, sf_dir):
    frame = items(spark, sf_dir, "product_id", "price")
    return revenue.aggregate_by(frame, "product_id", {"revenue": ("price", "sum"), "units": ("price", "size")})


def top_sql(direction: str) -> str:
    return f"""WITH {FLAT}, {PRODUCT_SALES} SELECT product_id, {dbl('r')} AS revenue, units FROM p
ORDER BY r {direction}, product_id LIMIT 20"""


@query("top_n_by", top_sql("DESC"))
def top_n_by(spark, sf_dir):
    return charts.bar_data(product_sales(spark, sf_dir), "product_id", "revenue", top_n=20, horizontal=True)


@query("bottom_n_by", top_sql("ASC"))
def bottom_n_by(spark, sf_dir):
    return charts.top_n_by(product_sales(spark, sf_dir), "revenue", 20, ascending=True, ties=["product_id"])


@query(
    "series_long",
    f"""WITH {FLAT}, m AS (SELECT strftime(period, '%Y-%m') AS x, {dbl('sum(price)')} AS a,
 {dbl('sum(freight_value)')} AS b FROM flat GROUP BY 1)
SELECT x, 'Revenue' AS series, a AS y FROM m UNION ALL SELECT x, 'Freight', b FROM m""",
)
def series_long(spark, sf_dir):
    frame = sums(spark, sf_dir, DATE, "price", "freight_value")
    monthly = series.compute_monthly_series(frame, DATE, "price", "sum", ["freight_value"])
    return charts.series_long(monthly, "period", ["price", "freight_value"], ["Revenue", "Freight"])


def ols_sql(keys: str, group: str) -> str:
    return f"""WITH {FLAT}
SELECT {keys} round(regr_slope({dbl('freight_value')}, {dbl('price')}), 6) AS slope,
 round(regr_intercept({dbl('freight_value')}, {dbl('price')}), 4) AS intercept,
 round(regr_r2({dbl('freight_value')}, {dbl('price')}), 6) AS r2, count(*) AS n FROM flat {group}"""


def rounded_trend(df):
    return rounded(rounded(df, ["slope", "r2"]), ["intercept"], 4)


@query("ols_trend", ols_sql("", ""))
def ols_trend(spark, sf_dir):
    return rounded_trend(charts.ols_trend(items(spark, sf_dir, "price", "freight_value"), "price", "freight_value"))


@query("ols_trend_grouped", ols_sql("product_category_name,", "GROUP BY product_category_name"))
def ols_trend_grouped(spark, sf_dir):
    frame = items(spark, sf_dir, "price", "freight_value", "product_category_name")
    return rounded_trend(charts.ols_trend(frame, "price", "freight_value", "product_category_name"))


@query(
    "histogram",
    f"""WITH {FLAT}, v AS (SELECT {dbl('sum(price)')} AS v FROM flat GROUP BY order_id),
s AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
b AS (SELECT lo, hi, CAST(least(floor((v - lo) * 40 / (hi - lo)) + 1, 40) AS BIGINT) AS bin FROM v, s)
SELECT bin, lo + (bin - 1) * ((hi - lo) / 40) AS bin_start, lo + bin * ((hi - lo) / 40) AS bin_end,
 count(*) AS count FROM b GROUP BY bin, lo, hi""",
)
def histogram(spark, sf_dir):
    values = revenue.entity_values(items(spark, sf_dir, "order_id", "price"), "order_id", "price")
    return charts.histogram(values, "price")


@query(
    "box_summary",
    f"""WITH {FLAT}, v AS (SELECT {dbl('sum(price)')} AS v FROM flat GROUP BY order_id),
q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM v),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q),
c AS (SELECT min(v) FILTER (WHERE v BETWEEN lower_fence AND upper_fence) AS whisker_low,
      max(v) FILTER (WHERE v BETWEEN lower_fence AND upper_fence) AS whisker_high,
      count(*) FILTER (WHERE v NOT BETWEEN lower_fence AND upper_fence) AS outliers, count(*) AS n FROM v, f)
SELECT round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
 round(lower_fence, 6) AS lower_fence, round(upper_fence, 6) AS upper_fence,
 whisker_low, whisker_high, outliers, n FROM f, c""",
)
def box_summary(spark, sf_dir):
    values = revenue.entity_values(items(spark, sf_dir, "order_id", "price"), "order_id", "price")
    return rounded(charts.box_summary(values, "price"), ["q1", "median", "q3", "lower_fence", "upper_fence"])


@query(
    "treemap_rollup",
    f"""WITH {FLAT}, r AS (
 SELECT CAST(2 - grouping(customer_state) - grouping(customer_city) AS BIGINT) AS level, customer_state, customer_city,
  {dbl('sum(price)')} AS value,
  sum({dbl('freight_value')} * {dbl('price')}) / {dbl('sum(price)')} AS color
 FROM flat GROUP BY ROLLUP (customer_state, customer_city))
SELECT level, customer_state, customer_city, value, value / (SELECT {dbl('sum(price)')} FROM flat) AS share,
 round(color, 4) AS color FROM r""",
)
def treemap_rollup(spark, sf_dir):
    frame = items(spark, sf_dir, "customer_state", "customer_city", "price", "freight_value")
    tree = charts.treemap_rollup(frame, ["customer_state", "customer_city"], "price", "freight_value")
    return rounded(tree, ["color"], 4)


STATES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query(
    "heatmap_pivot",
    f"WITH {FLAT} SELECT product_category_name, "
    + ", ".join(
        f"CAST(sum(price) FILTER (WHERE customer_state = '{s}') AS DOUBLE) / "
        f"count(price) FILTER (WHERE customer_state = '{s}') AS \"{s}\""
        for s in STATES
    )
    + " FROM flat GROUP BY 1",
)
def heatmap_pivot(spark, sf_dir):
    frame = items(spark, sf_dir, "customer_state", "product_category_name", "price")
    return charts.heatmap_pivot(frame, "customer_state", "product_category_name", "price", STATES)


@query(
    "quadrants",
    f"""WITH {FLAT}, {PRODUCT_SALES},
m AS (SELECT quantile_cont({dbl('units')}, 0.5) AS mx, quantile_cont({dbl('r')}, 0.5) AS my FROM p)
SELECT product_id, {dbl('r')} AS revenue, units, mx AS median_x, round(my, 6) AS median_y,
 (CASE WHEN units >= mx THEN 'high' ELSE 'low' END) || '_' ||
 (CASE WHEN {dbl('r')} >= my THEN 'high' ELSE 'low' END) AS quadrant FROM p, m""",
)
def quadrants(spark, sf_dir):
    return rounded(charts.quadrants(product_sales(spark, sf_dir), "units", "revenue"), ["median_y"])


@query(
    "combo_data",
    f"""WITH {FLAT}, b AS (SELECT order_id, count(*) AS basket_size, sum(price) AS r FROM flat GROUP BY 1)
SELECT basket_size, count(*) AS orders, {sql_mean('r')} AS avg_revenue FROM b GROUP BY 1""",
)
def combo_data(spark, sf_dir):
    frame = items(spark, sf_dir, "order_id", "price")
    orders = frame.groupBy("order_id").agg(F.count("price").alias("basket_size"), F.sum("price").alias("revenue"))
    sizes = revenue.aggregate_by(
        orders, "basket_size", {"orders": ("order_id", "size"), "avg_revenue": ("revenue", "mean")}
    )
    return charts.combo_data(sizes, "basket_size", "orders", "avg_revenue")
