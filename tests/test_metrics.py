"""Hand-made rows for the rules that clean data does not show."""

from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cartlens.functions.scalars import nan_to_null, whole_days
from cartlens.operators import charts, customers, delivery, revenue, scoring, series


def values(df, column, order):
    return [r[column] for r in df.orderBy(order).collect()]


# Kpis and grouped aggregates


def test_kpis_of_nothing_are_zero(spark):
    df = spark.createDataFrame([], "price decimal(18,2), order_id long, freight double")
    row = revenue.compute_kpis(df, "price", "order_id", freight_col="freight").first()
    assert row.asDict() == {
        "total_revenue": 0.0,
        "total_orders": 0,
        "aov": 0.0,
        "total_freight": 0.0,
        "freight_ratio": 0.0,
    }


def test_aggregates_of_a_missing_group(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, 1.0)], "k string, v double")
    names = ["sum", "mean", "count", "nunique", "size", "min", "max", "std", "var", "median"]
    out = revenue.aggregate_by(df, "k", {n: ("v", n) for n in names}).collect()
    assert len(out) == 1  # the missing key drops out
    want = dict.fromkeys(names) | {"sum": 0.0, "count": 0, "nunique": 0, "size": 2}
    assert {n: out[0][n] for n in names} == want


def test_several_distinct_counts_beside_sums(spark):
    rows = [("a", 1, 1, 1.0), ("a", 1, 2, 2.0), ("b", 3, 3, None), ("b", None, 3, 4.0), (None, 9, 9, 9.0)]
    df = spark.createDataFrame(rows, "k string, x int, y int, v double")
    out = revenue.aggregate_by(
        df, "k", {"nx": ("x", "nunique"), "s": ("v", "sum"), "ny": ("y", "nunique"), "m": ("v", "median")}
    )
    assert out.columns == ["k", "nx", "s", "ny", "m"]
    assert [tuple(r) for r in out.orderBy("k").collect()] == [("a", 1, 3.0, 2, 1.5), ("b", 1, 4.0, 1, 4.0)]


def test_release_deletes_what_was_written(spark):
    from cartlens.staging import release, stage

    staged = stage(spark.range(5), "release")
    assert staged.count() == 5
    path = staged.inputFiles()[0].removeprefix("file:")
    import os

    assert os.path.exists(path.replace("///", "/"))
    release(spark)
    assert not os.path.exists(path.replace("///", "/"))


def test_first_and_last_need_an_order(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("a", 3, "y")], "k string, seq int, v string")
    row = revenue.aggregate_by(df, "k", {"f": ("v", "first", "seq"), "l": ("v", "last", "seq")}).first()
    assert (row["f"], row["l"]) == ("x", "y")
    with pytest.raises(ValueError):
        revenue.aggregate_by(df, "k", {"f": ("v", "first")})
    with pytest.raises(ValueError):
        revenue.aggregate_by(df, "k", {"f": ("v", "mode")})


def test_aggregate_by_cut_and_ranks(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", 3), ("d", 1)], "k string, v int")
    spec = {"s": ("v", "sum")}
    ranked = revenue.aggregate_by(df, "k", spec, rank_col="s")
    assert values(ranked, "rank", "k") == [1, 1, 2, 3]
    cut = revenue.aggregate_by(df, "k", spec, rank_col="s", top_n=3)
    assert values(cut, "k", "k") == ["a", "b", "c"]  # rows are cut, not ranks
    assert revenue.aggregate_by(df, "k", spec, rank_col="s", top_n=0).count() == 0
    assert revenue.aggregate_by(df, "k", spec, top_n=1).count() == 4
    assert values(revenue.aggregate_by(df, "k", spec, rank_col="s", top_n=2, ascending=True), "k", "k") == ["c", "d"]


def test_ranking_a_missing_value_is_an_error(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", None)], "k string, v double")
    for top in (None, 1):
        with pytest.raises(PySparkException):
            revenue.aggregate_by(df, "k", {"m": ("v", "mean")}, rank_col="m", top_n=top).collect()


# Series


def test_months_without_rows_are_absent(spark):
    rows = [("2020-01-31 23:00:00", 1.0), ("2020-03-01 00:00:00", 2.0), (None, 9.0)]
    df = spark.createDataFrame(rows, "t string, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    out = series.compute_monthly_series(df, "t", "v").collect()
    assert [(str(r["period"]), r["v"]) for r in out] == [("2020-01-01", 1.0), ("2020-03-01", 2.0)]


def test_bad_date_text_is_an_error(spark):
    df = spark.createDataFrame([("2020-13-77", 1.0)], "t string, v double")
    with pytest.raises(PySparkException):
        series.compute_monthly_series(df, "t", "v").collect()


GROWTH = [(1, 1.0), (2, None), (3, 3.0), (4, 0.0), (5, 5.0)]


@pytest.mark.parametrize("calendar", [True, False])
@pytest.mark.parametrize("block_rows", [1, 2, 100])
def test_growth_and_rolling(spark, calendar, block_rows):
    df = spark.createDataFrame(GROWTH, "i int, v double")
    kw = {"calendar": calendar, "block_rows": block_rows}
    plain = series.compute_growth_rate(df, "v", "i", **kw)
    assert values(plain, "growth_rate", "i") == [None, None, None, -100.0, None]
    padded = series.compute_growth_rate(df, "v", "i", fill="pad", **kw)
    assert values(padded, "growth_rate", "i") == [None, 0.0, 200.0, -100.0, None]
    assert padded.columns == ["i", "v", "growth_rate"]
    two = series.compute_growth_rate(df, "v", "i", periods=2, **kw)
    assert values(two, "growth_rate", "i") == [None, None, 200.0, None, pytest.approx(200 / 3)]
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, 4.0)], "i int, v double")
    rolled = series.compute_rolling_avg(df, "v", "i", window=3, min_periods=1, **kw)
    assert values(rolled, "rolling_avg", "i") == [1.0, 1.5, 1.5, 3.0]
    rolled = series.compute_rolling_avg(df, "v", "i", window=3, min_periods=2, **kw)
    assert values(rolled, "rolling_avg", "i") == [None, 1.5, 1.5, 3.0]


@pytest.mark.parametrize("block_rows, window", [(7, 3), (1, 40), (64, 1), (50, 50), (1000, 333)])
def test_sliding_means_per_group_against_pandas(spark, block_rows, window):
    rng = np.random.default_rng(window)
    pdf = pd.DataFrame({"i": rng.permutation(400), "g": np.where(rng.random(400) < 0.8, "hot", "cold")})
    pdf["v"] = np.where(rng.random(400) < 0.1, np.nan, rng.normal(size=400))
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    rolled = series.compute_rolling_avg(df, "v", "i", window=window, min_periods=2, block_rows=block_rows, within="g")
    want = pdf.sort_values(["g", "i"]).reset_index(drop=True)
    want["m"] = want.groupby("g")["v"].rolling(window, min_periods=min(2, window)).mean().to_numpy()
    got = rolled.toPandas().sort_values(["g", "i"])
    if window == 1:
        assert got["rolling_avg"].isna().all()
    else:
        assert got["rolling_avg"].to_numpy() == pytest.approx(want["m"].to_numpy(), nan_ok=True)
    grown = series.compute_growth_rate(df, "v", "i", periods=2, block_rows=block_rows, within=["g"])
    back = want.groupby("g")["v"].shift(2)
    growth = grown.toPandas().sort_values(["g", "i"])["growth_rate"].to_numpy()
    assert growth == pytest.approx(((want["v"] / back - 1) * 100).to_numpy(), nan_ok=True)


def test_sliding_mean_subtracts_nothing(spark):
    data = [1e20, 1.0, 2.0, float("inf"), 3.0, 5.0, 1e-20, 7.0]
    df = spark.createDataFrame(list(enumerate(data)), "i int, v double")
    rolled = series.compute_rolling_avg(df, "v", "i", window=2, block_rows=3)
    want = [data[0], *[(a + b) / 2 for a, b in zip(data, data[1:])]]
    assert values(rolled, "rolling_avg", "i") == want


def test_a_wide_sliding_mean_keeps_one_shuffle_by_block(spark):
    df = spark.range(300).select("id", F.sin("id").alias("v"))
    plan = series.compute_rolling_avg(df, "v", "id", window=100)._jdf.queryExecution().executedPlan().toString()
    # The blocks are dealt once, for the forward and the backward sums and the look back.
    assert plan.count("Exchange hashpartitioning(_block") == 1, plan
    assert "specifiedwindowframe(RowFrame, -" not in plan.replace(" ", "")


# Shares


def test_share_cut_and_ties(spark):
    rows = [("b", Decimal("5.00")), ("a", Decimal("5.00")), ("c", Decimal("10.00")), (None, Decimal("1.00"))]
    df = spark.createDataFrame(rows, "k string, v decimal(18,2)")
    full = revenue.compute_revenue_share(df, "k", "v").orderBy("rank").collect()
    assert [(r["k"], r["revenue_share_pct"]) for r in full] == [("c", 50.0), ("a", 25.0), ("b", 25.0)]
    top = revenue.compute_revenue_share(df, "k", "v", top_n=1).collect()
    assert [(r["k"], r["revenue_share_pct"], r["rank"]) for r in top] == [("c", 50.0, 1)]
    assert revenue.compute_revenue_share(df, "k", "v", top_n=0).count() == 3
    pareto = revenue.compute_pareto(df, "k", "v").orderBy("rank").collect()
    assert [r["cumulative_share_pct"] for r in pareto] == [50.0, 75.0, 100.0]


def test_concentration_labels():
    assert revenue.concentration_labels((0.29, 0.005)) == ["top_28pct", "top_0pct"]
    with pytest.raises(ValueError):
        revenue.concentration_labels((0.01, 0.011))


def test_concentration_stats(spark):
    df = spark.createDataFrame([("a", 8.0), ("b", 1.0), ("c", 1.0)], "k string, v double")
    row = revenue.compute_concentration_stats(df, "k", "v", (0.1, 0.5)).first()
    assert row["top_10pct"] == pytest.approx(80.0) and row["top_50pct"] == pytest.approx(90.0)
    assert row["pareto_ratio"] == pytest.approx(1 / 3)  # 0.8 is not below 0.8


def test_distribution_stats(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 10.0), ("d", 15.0), ("d", 5.0)], "k string, v double")
    entities, stats = revenue.compute_distribution_stats(df, "k", "v")
    row = stats.first()
    assert entities.count() == 4
    assert (row["median"], row["p25"], row["min"], row["max"], row["mean"]) == (6.0, 1.75, 1.0, 20.0, 8.25)


# Delivery and freight


def test_whole_days_round_down(spark):
    rows = [("2020-01-01 01:00:00", "2020-01-01 13:00:00"), ("2020-01-02 01:00:00", "2020-01-01 23:00:00")]
    df = spark.createDataFrame(rows, "b string, a string")
    out = df.select(whole_days(F.to_timestamp("b"), F.to_timestamp("a")).alias("d")).collect()
    assert [r["d"] for r in out] == [-1, 0]


def test_missing_estimate_is_not_late(spark):
    rows = [
        ("2020-01-01", "2020-01-03", "2020-01-02", "x"),
        ("2020-01-01", "2020-01-05", None, "x"),
        ("2020-01-01", None, "2020-01-02", "y"),
        ("2020-01-04", "2020-01-03", "2020-01-02", "y"),
    ]
    df = spark.createDataFrame(rows, "p string, d string, e string, g string")
    row = delivery.compute_delivery_metrics(df, "p", "d", "e").first()
    assert (row["late_rate_pct"], row["early_rate_pct"], row["avg_delay_days"]) == (50.0, 50.0, 1.0)
    assert (row["avg_delivery_days"], row["median_delivery_days"]) == (3.0, 3.0)
    grouped = delivery.compute_delivery_metrics(df, "p", "d", "e", "g").collect()
    assert [(r["g"], r["order_count"], r["rank"]) for r in grouped] == [("x", 2, 1)]


def test_freight_without_revenue(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0)], "k string, f double, r double")
    assert delivery.compute_freight_ratio(df, "f", "r").first()["freight_ratio_pct"] == 0.0
    assert delivery.compute_freight_ratio(df, "f", "r", "k").first()["freight_ratio_pct"] is None


# Correlation, baskets, ratings, payments, geography


def test_correlation_of_a_constant(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (None, 3.0)], "x double, y double")
    out = customers.compute_correlation(df, "x", "y")
    assert out["correlation"].first()["correlation"] is None
    assert out["scatter_df"].count() == 2


def test_basket_counts_rows_or_items(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "o int, i string")
    sizes, _ = customers.compute_basket_size(df, "o")
    assert values(sizes, "basket_size", "o") == [2, 1]
    sizes, stats = customers.compute_basket_size(df, "o", "i")
    assert values(sizes, "basket_size", "o") == [1, 1]
    assert stats.first()["max_basket"] == 1


def test_rating_modes(spark):
    rows = [("a", 5, "2020-01-01")] * 5 + [("b", 1, "2020-02-01")] * 4 + [("a", None, "2020-01-01")]
    df = spark.createDataFrame(rows, "k string, r int, d string")
    by_group = customers.compute_rating_summary(df, "r", "k").collect()
    assert [(r["k"], r["mean_rating"], r["review_count"]) for r in by_group] == [("a", 5.0, 5)]
    assert "period" in customers.compute_rating_summary(df, "r", "k", "d").columns  # the date wins
    both = customers.compute_rating_summary(df, "r")
    assert both["overall"].first()["median"] == 5.0
    assert [(r["r"], r["count"]) for r in both["distribution"].collect()] == [(1, 4), (5, 5)]


def test_payments_count_rows(spark):
    df = spark.createDataFrame([("card", 1.0, 1), ("card", None, 2), ("cash", 3.0, 1)], "t string, v double, i int")
    out = customers.compute_payment_summary(df, "t", "v", "i")
    rows = out["by_type"].collect()
    assert [(r["t"], r["order_count"], r["revenue_share_pct"]) for r in rows] == [("cash", 1, 75.0), ("card", 1, 25.0)]
    assert [r["i"] for r in out["installments"].collect()] == [1, 2]
    assert list(customers.compute_payment_summary(df, "t", "v")) == ["by_type"]


def test_cities_of_one_name_are_merged(spark):
    rows = [("S1", "X", 1, 10, 5.0), ("S2", "X", 2, 11, 7.0), ("S1", None, 3, 12, 1.0)]
    df = spark.createDataFrame(rows, "s string, c string, o int, cu int, v double")
    out = customers.compute_geographic_summary(df, "v", "o", "s", "c", "cu")
    assert [(r["c"], r["revenue"], r["orders"]) for r in out["by_city"].collect()] == [("X", 12.0, 2)]
    assert [r["s"] for r in out["by_state"].collect()] == ["S2", "S1"]
    assert "revenue_per_seller" not in out["by_state"].columns


def test_opportunity_flag(spark):
    rows = [("a", 1, 1, 100.0), ("b", 2, 2, 1.0), ("b", 3, 3, 1.0), ("c", 4, 4, 2.0), ("c", 5, 5, 2.0)]
    df = spark.createDataFrame(rows, "g string, c int, o int, v double")
    out = customers.compute_market_opportunity(df, "g", "v", "c", "o").collect()
    assert [(r["g"], r["opportunity_flag"]) for r in out] == [("a", True), ("c", False), ("b", False)]


# Score


def test_composite_score(spark):
    rows = [("a", 1.0, 7.0), ("b", 3.0, 7.0), ("c", None, 7.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    out = scoring.compute_composite_score(df, "k", ["x", "y"], [0.75, 0.25]).orderBy("rank").collect()
    assert [(r["k"], r["x"], r["x_norm"], r["y_norm"], r["composite_score"]) for r in out] == [
        ("b", 3.0, 1.0, 0.0, 0.75),
        ("a", 1.0, 0.0, 0.0, 0.0),
    ]
    with pytest.raises(ValueError):
        scoring.compute_composite_score(df, "k", ["x"], [0.5, 0.5])
    with pytest.raises(ValueError):
        scoring.compute_composite_score(df, "k", ["x", "y"], [0.5, 0.6])


# Chart tables


def test_top_fills_up_with_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 2.0)], "k string, v double")
    assert [r["k"] for r in charts.top_n_by(df, "v", 3, ties=["k"]).collect()] == ["c", "a", "b"]
    assert [r["k"] for r in charts.top_n_by(df, "v", 2, True, ties=["k"]).collect()] == ["a", "c"]
    assert charts.top_n_by(df, "v", None).count() == 3
    assert [r["k"] for r in charts.bar_data(df, "k", "v", 2, horizontal=True).collect()] == ["a", "c"]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "v double")
    rows = charts.histogram(df, "v", 5).collect()
    assert [r["count"] for r in rows] == [2, 2, 2, 2, 3]  # the largest value is in the last bin
    assert rows[-1]["bin_end"] == 10.0
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [tuple(r) for r in charts.histogram(same, "v").collect()] == [(1, 3.0, 3.0, 2)]


def test_box_summary(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "v double")
    row = charts.box_summary(df, "v").first()
    assert (row["q1"], row["median"], row["q3"]) == (2.0, 3.0, 4.0)
    assert (row["whisker_low"], row["whisker_high"], row["outliers"], row["n"]) == (1.0, 4.0, 1, 5)


def test_trend_of_a_constant_x(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "x double, y double")
    assert charts.ols_trend(df, "x", "y").first()["slope"] is None


def test_heatmap_cells_and_columns(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 5.0)], "r string, c string, z double")
    cells = {(r["r"], r["c"]): r["z"] for r in charts.heatmap_cells(df, "c", "r", "z").collect()}
    assert cells == {("a", "x"): 1.0, ("a", "y"): 3.0, ("b", "x"): 5.0}
    out = charts.heatmap_pivot(df, "c", "r", "z", ["x", "y"])
    assert out.columns == ["r", "x", "y"]
    assert [tuple(r) for r in out.collect()] == [("a", 1.0, 3.0), ("b", 5.0, None)]


def test_treemap_levels(spark):
    df = spark.createDataFrame([("a", "x", 1.0, 2.0), ("a", "y", 3.0, 4.0)], "s string, c string, v double, w double")
    rows = charts.treemap_rollup(df, ["s", "c"], "v", "w").orderBy("level", "c").collect()
    assert [(r["level"], r["value"], r["share"], r["color"]) for r in rows] == [
        (0, 4.0, 1.0, 3.5),
        (1, 4.0, 1.0, 3.5),
        (2, 1.0, 0.25, 2.0),
        (2, 3.0, 0.75, 4.0),
    ]


def test_quadrant_labels(spark):
    df = spark.createDataFrame([("a", 1, 9), ("b", 2, 8), ("c", 3, 1), ("d", None, 1)], "k string, x int, y int")
    assert values(charts.quadrants(df, "x", "y"), "quadrant", "k") == ["low_high", "high_high", "high_low", None]


def test_series_long(spark):
    df = spark.sql("SELECT DATE'2020-01-01' AS p, 1 AS a, 2.5D AS b")
    rows = sorted(tuple(r) for r in charts.series_long(df, "p", ["a", "b"]).collect())
    assert rows == [("2020-01", "a", 1.0), ("2020-01", "b", 2.5)]


def test_nan_becomes_null(spark):
    df = spark.sql("SELECT double('NaN') AS a, 1 AS b")
    assert tuple(nan_to_null(df).first()) == (None, 1)


def test_distinct_counts_read_the_input_once(spark, sf_dir):
    from cartlens.plans import catalog
    from cartlens.session import tune

    tune(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for key in ("kpis", "q09_customer_value_by_city", "q16_sellers_by_region", "q17_states_by_revenue"):
            plan = catalog.QUERIES[key](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
            assert len([line for line in plan.splitlines() if "Relation" in line and "l_extendedprice" in line]) == 1, key
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", float("nan"))], "k string, v double")
    bins = charts.histogram(df, "v", bins=4).collect()
    assert [(r["bin"], r["count"]) for r in bins] == [(1, 1), (4, 1)]
    _, stats = revenue.compute_distribution_stats(df, "k", "v", "mean")
    row = stats.first()
    assert (row["mean"], row["median"]) == (1.5, 1.5)
    assert charts.top_n_by(df, "v", 1).first()["k"] == "b"
    assert charts.box_summary(df, "v").count() == 1


def test_tasks_of_distinct_counts_are_bounded(spark):
    """A shuffle task reads few bytes and joins without sorting, whatever the session has; smaller tasks stay."""
    from cartlens.session import ADVISORY, HASHED, TASK_BYTES, tune

    keys = [ADVISORY, HASHED]
    before = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(ADVISORY, "64MB")
        spark.conf.set(HASHED, "0b")
        tune(spark)
        assert [spark.conf.get(k) for k in keys] == [str(TASK_BYTES)] * 2
        spark.conf.set(ADVISORY, "8m")
        assert tune(spark).conf.get(ADVISORY) == "8m"
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def test_few_partitions_are_raised_and_merged(spark):
    from cartlens.session import INITIAL, LEAST_PARTITIONS, PARTITIONS, tune

    few = spark.conf.get(PARTITIONS)
    fresh = spark.newSession()
    fresh.conf.set(PARTITIONS, "12")
    fresh.conf.unset(INITIAL)
    assert tune(fresh).conf.get(INITIAL) == str(LEAST_PARTITIONS)
    out = fresh.range(1000).groupBy((F.col("id") % 100).alias("k")).count()
    assert out.rdd.getNumPartitions() < LEAST_PARTITIONS and out.count() == 100
    assert f", {LEAST_PARTITIONS})" in out._jdf.queryExecution().executedPlan().toString()
    # More partitions than that hold, also when they are set later.
    fresh.conf.set(PARTITIONS, "500")
    assert tune(fresh).conf.get(INITIAL) == "500"
    assert spark.conf.get(PARTITIONS) == few


def test_ratings_are_grouped_once_and_then_sorted(spark):
    df = spark.createDataFrame([("a", 5), ("a", 3), ("b", 5), ("b", 5), (None, 1), ("c", None)], "k string, r int")
    out = customers.compute_rating_summary(df, "r", "k", min_reviews=2)
    assert [tuple(r) for r in out.collect()] == [("b", 5.0, 2), ("a", 4.0, 2)]
    # Sorting reads its input twice: it must not be the grouping.
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
