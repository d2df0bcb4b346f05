"""Ranks found by selection against sorting, on distributions made to mislead the sketch."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartlens.operators import ordered
from cartlens.operators.ordered import exact_quantiles, numbered_top, top_rows
from cartlens.operators.selection import count_values, order_statistics
from cartlens.staging import stage

RNG = np.random.default_rng(11)
SHAPES = {
    "continuous": RNG.normal(size=3000),
    "a third is one value": np.concatenate([np.full(1000, 0.25), RNG.normal(size=2000)]),
    "one value": np.full(500, -7.0),
    "two far ends": np.concatenate([np.full(700, -1e300), np.full(700, 1e300), [0.0]]),
    "powers": 2.0 ** RNG.integers(-900, 900, 2500),
    "infinite": np.concatenate([[-np.inf] * 50, RNG.normal(size=900), [np.inf] * 50]),
    "few": np.array([3.0, 1.0]),
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("gathered, accuracy", [(100_000, 10_000), (1, 100)])
def test_ranks_equal_the_sorted_values(spark, shape, gathered, accuracy):
    data = SHAPES[shape]
    values = stage(spark.createDataFrame(pd.DataFrame({"v": data})).repartition(4), "values")
    ranks = sorted({0, len(data) // 3, len(data) // 2, len(data) - 1})
    got = order_statistics(values, [("v", r) for r in ranks], count_values(values), gathered, accuracy)
    want = np.sort(data)
    assert [got["v", r] for r in ranks] == [want[r] for r in ranks]


def test_several_columns_with_nulls_and_nan(spark):
    rows = [(float(i), None if i % 3 else -float(i), float("nan") if i < 10 else 1.0) for i in range(900)]
    values = stage(spark.createDataFrame(rows, "a double, b double, c double"), "values")
    counts = count_values(values)
    assert counts == {"a": (900, 0), "b": (300, 0), "c": (890, 10)}
    got = order_statistics(values, [("a", 450), ("b", 0), ("b", 299), ("c", 889), ("c", 890)], counts, 16, 100)
    assert [got[k] for k in (("a", 450), ("b", 0), ("b", 299), ("c", 889))] == [450.0, -897.0, 0.0, 1.0]
    assert math.isnan(got["c", 890])
    with pytest.raises(ValueError):
        order_statistics(values, [("b", 300)], counts)


def test_a_table_that_changes_is_an_error(spark):
    values = stage(spark.range(100).select(F.col("id").cast("double").alias("v")), "values")
    with pytest.raises(RuntimeError):
        order_statistics(values.filter("v < 50"), [("v", 95)], {"v": (100, 0)}, 5, 10)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, width=32), min_size=1, max_size=60), st.floats(0, 1))
def test_any_list_at_any_probability(spark, data, p):
    values = stage(spark.createDataFrame([(float(x),) for x in data], "v double"), "values")
    rank = math.floor((len(data) - 1) * p)
    got = order_statistics(values, [("v", rank)], count_values(values), 8, 50)
    assert got["v", rank] == sorted(data)[rank]


def test_quantiles_equal_percentile(spark):
    df = spark.range(20_000).select((F.hash("id") % 1000 / F.lit(7.0)).alias("x"), F.sin("id").alias("y"))
    wanted = {f"{c}{i}": (c, p) for c in "xy" for i, p in enumerate((0.0, 0.1, 0.5, 0.9, 1.0))}
    got = exact_quantiles(df, wanted).first()
    want = df.agg(*[F.percentile(c, F.lit(p)).alias(name) for name, (c, p) in wanted.items()]).first()
    assert [got[n] for n in wanted] == pytest.approx([want[n] for n in wanted], abs=1e-12)


def test_selection_shuffles_only_figures(spark):
    values = stage(spark.range(50_000).select(F.sin("id").alias("v")), "values")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("selection", "selection")
    order_statistics(values, [("v", 25_000)], count_values(values), 500, 1000)
    jobs = tracker.getJobIdsForGroup("selection")
    spark.sparkContext.setJobGroup("other", "other")
    assert 4 <= len(jobs) <= 12


@pytest.mark.parametrize(
    "kind, ascending",
    [("long", True), ("double", False), ("decimal(12,2)", False), ("date", True), ("timestamp", False), ("string", True)],
)
def test_large_cuts(spark, monkeypatch, kind, ascending):
    monkeypatch.setattr(ordered, "MERGED_ROWS", 10)
    day = "date_add(date'2020-01-01', v)"
    value = {"date": day, "timestamp": f"cast({day} as timestamp)"}.get(kind, f"cast(v as {kind})")
    # A third of the rows has one value, some have none.
    base = spark.range(600).selectExpr("id", "case when id % 3 = 0 then 40 when id % 50 = 1 then null else cast(pmod(hash(id), 90) as int) end as v")
    df = base.selectExpr("id", f"{value} as v")
    order = [("v", ascending), ("id", True)]
    every = df.orderBy(*ordered.sort_columns(order)).collect()
    for n in (250, 595):
        got = numbered_top(df, order, n).orderBy("rank").collect()
        assert [(r.id, r.v, r["rank"]) for r in got] == [(r.id, r.v, i) for i, r in enumerate(every[:n], 1)]
    if kind == "long":
        assert [r.id for r in top_rows(df, order, 250).collect()] == [r.id for r in every[:250]]
        assert numbered_top(df, order, 10_000).count() == len(every)


def test_large_cuts_have_no_single_task(spark, monkeypatch):
    monkeypatch.setattr(ordered, "MERGED_ROWS", 10)
    kept = []
    monkeypatch.setattr(ordered, "global_rank", lambda df, *a, **k: kept.append(df) or df.withColumn("rank", F.lit(1)))
    df = spark.range(5000).select("id", F.pmod(F.hash("id"), F.lit(1000)).alias("v"))
    plan = numbered_top(df, [("v", True), ("id", True)], 2000)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Exchange" not in plan
    assert 2000 <= kept[0].count() < 2030


def test_nothing_to_cut(spark):
    df = spark.createDataFrame([], "id long, v double")
    order = [("v", True), ("id", True)]
    for n in (0, 5, 5000):
        assert numbered_top(df, order, n).count() == 0 and top_rows(df, order, n).count() == 0
