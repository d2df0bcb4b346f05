"""The ordered scan against pandas on random data with ties, hot values and missing values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cartlens.operators.ordered import (
    exact_quantiles,
    global_rank,
    numbered_top,
    ordered_scan,
    surrogate_key,
)


def hot_frame(n=4000, seed=7):
    """A third of the rows share one value."""
    rng = np.random.default_rng(seed)
    v = rng.integers(0, 300, n)
    v[: n // 3] = 150
    return pd.DataFrame({"k": rng.permutation(n), "v": v, "g": rng.integers(0, 5, n)})


@pytest.mark.parametrize("partitions", [1, 5, 16])
@pytest.mark.parametrize("ascending", [True, False])
def test_rank_dense_and_running_sum(spark, partitions, ascending):
    pdf = hot_frame()
    out = ordered_scan(
        spark.createDataFrame(pdf),
        [("v", ascending), ("k", True)],
        row="row",
        dense="dense",
        running={"v": "run"},
        totals={"v": "total"},
        rows_total="n",
        partitions=partitions,
    ).toPandas()
    want = pdf.sort_values(["v", "k"], ascending=[ascending, True]).reset_index(drop=True)
    got = out.sort_values("row").reset_index(drop=True)
    assert got["k"].tolist() == want["k"].tolist()
    assert got["row"].tolist() == list(range(1, len(pdf) + 1))
    assert got["dense"].tolist() == want["v"].rank(method="dense", ascending=ascending).astype(int).tolist()
    assert got["run"].tolist() == want["v"].cumsum().tolist()
    assert set(got["total"]) == {pdf["v"].sum()} and set(got["n"]) == {len(pdf)}


def test_a_hot_value_is_cut_apart(spark):
    pdf = hot_frame()
    out = ordered_scan(spark.createDataFrame(pdf), [("v", False), ("k", True)], row="row", partitions=16)
    ranges = spark.createDataFrame(pdf).repartitionByRange(16, F.desc("v"), F.asc("k"))
    sizes = ranges.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert sizes.max() < len(pdf) / 8
    assert out.count() == len(pdf)


@pytest.mark.parametrize("partitions", [1, 5, 16])
@pytest.mark.parametrize("within", [[], ["g"]])
def test_row_numbers_from_the_written_order(spark, partitions, within):
    pdf = hot_frame()
    out = ordered_scan(
        spark.createDataFrame(pdf),
        [("v", False), ("k", True)],
        within=within,
        row="row",
        totals={"v": "total"},
        rows_total="n",
        partitions=partitions,
    )
    assert out.columns == ["k", "v", "g", "total", "n", "row"]
    got = out.toPandas().sort_values([*within, "row"])
    want = pdf.sort_values([*within, "v", "k"], ascending=[True] * len(within) + [False, True])
    assert got["k"].tolist() == want["k"].tolist()
    groups = pdf.groupby("g")["v"].transform("size") if within else pdf["v"] * 0 + len(pdf)
    assert sorted(got["n"]) == sorted(groups)
    if not within:
        assert got["row"].tolist() == list(range(1, len(pdf) + 1))


@pytest.mark.parametrize("partitions", [1, 7])
def test_scan_within_groups(spark, partitions):
    pdf = hot_frame()
    out = ordered_scan(
        spark.createDataFrame(pdf),
        [("v", True), ("k", True)],
        within=["g"],
        row="row",
        running={"v": "run"},
        totals={"v": "total"},
        partitions=partitions,
    ).toPandas()
    want = pdf.sort_values(["g", "v", "k"]).reset_index(drop=True)
    got = out.sort_values(["g", "row"]).reset_index(drop=True)
    assert got["k"].tolist() == want["k"].tolist()
    assert got["run"].tolist() == want.groupby("g")["v"].cumsum().tolist()
    assert got["total"].tolist() == want.groupby("g")["v"].transform("sum").tolist()


def test_missing_values_keep_their_hole(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, 4.0)], "i int, v double")
    for partitions in (1, 3):
        out = ordered_scan(
            df, [("i", True)], running={"v": "run"}, carry={"v": "last"}, partitions=partitions
        )
        rows = out.orderBy("i").collect()
        assert [r["run"] for r in rows] == [1.0, 3.0, None, 7.0]
        assert [r["last"] for r in rows] == [1.0, 2.0, 2.0, 4.0]


def test_missing_values_rank_last(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("c", 2.0)], "k string, v double")
    for ascending, want in ((False, "cba"), (True, "bca")):
        rows = global_rank(df, [("v", ascending), ("k", True)]).orderBy("rank").collect()
        assert "".join(r["k"] for r in rows) == want


def test_floating_keys_are_written_before_they_are_ranged(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": range(500), "v": rng.normal(size=500)})
    df = spark.createDataFrame(pdf).repartition(7).groupBy("k").agg(F.sum("v").alias("v"))
    got = global_rank(df, [("v", False), ("k", True)]).toPandas().sort_values("rank")
    assert got["k"].tolist() == pdf.sort_values("v", ascending=False)["k"].tolist()


def test_quantiles_match_pandas(spark):
    pdf = hot_frame()
    pdf["w"] = np.where(pdf["k"] % 10 == 0, np.nan, pdf["k"] * 1.5)
    df = spark.createDataFrame(pdf).withColumn("w", F.nanvl("w", F.lit(None).cast("double")))
    wanted = {"v25": ("v", 0.25), "v50": ("v", 0.5), "w75": ("w", 0.75), "w10": ("w", 0.1)}
    row = exact_quantiles(df, wanted).first()
    for name, (column, p) in wanted.items():
        assert row[name] == pytest.approx(pdf[column].quantile(p))
    grouped = exact_quantiles(df, wanted, by=["g"]).toPandas().set_index("g")
    for name, (column, p) in wanted.items():
        want = pdf.groupby("g")[column].quantile(p)
        assert grouped[name].sort_index().tolist() == pytest.approx(want.tolist())


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "v double")
    assert exact_quantiles(df, {"m": ("v", 0.5)}).first()["m"] is None
    small = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (20.0,)], "v double")
    row = exact_quantiles(small, {"q": ("v", 0.25), "m": ("v", 0.5)}).first()
    assert (row["q"], row["m"]) == (1.75, 6.0)


def test_surrogate_key_is_dense(spark):
    pdf = hot_frame()
    got = surrogate_key(spark.createDataFrame(pdf), ["g", "k"], "id").toPandas().sort_values("id")
    assert got["id"].tolist() == list(range(1, len(pdf) + 1))
    assert got["k"].tolist() == pdf.sort_values(["g", "k"])["k"].tolist()


@pytest.mark.parametrize("n", [1, 50, 1_000_000])
def test_top_cut_of_any_size(spark, n):
    df = spark.createDataFrame(hot_frame())
    order = [("v", False), ("k", True)]
    got = numbered_top(df, order, n).toPandas().sort_values("rank")
    want = df.toPandas().sort_values(["v", "k"], ascending=[False, True]).head(n)
    assert got["k"].tolist() == want["k"].tolist()
    assert got["rank"].tolist() == list(range(1, len(want) + 1))


@pytest.mark.parametrize("partitions", [1, 5, 16])
@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("values", [[1, 2, 3, 4] + [None] * 36, [None] * 5, [7] * 20 + [None] * 2, list(range(30))])
def test_dense_rank_counts_missing_values_once(spark, partitions, ascending, values):
    df = spark.createDataFrame(list(enumerate(values)), "k long, v long")
    order = [("v", ascending), ("k", True)]
    rows = ordered_scan(df, order, dense="rank", partitions=partitions).collect()
    present = sorted({v for v in values if v is not None}, reverse=not ascending)
    want = {v: i for i, v in enumerate(present, 1)} | {None: len(present) + 1}
    assert all(r["rank"] == want[r["v"]] for r in rows) and len(rows) == len(values)


def test_no_single_partition_exchange_over_entities(spark):
    """The entity rows never meet in one task: only the per-range counts do."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = global_rank(spark.createDataFrame(hot_frame()), [("v", False), ("k", True)])
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # A rank is read off the written order: no shuffle and no sort of the entity rows after the write.
    assert "Window [row_number" not in plan and "Exchange hashpartitioning" not in plan.split("Broadcast")[0]
    lines = plan.splitlines()
    single = [i for i, line in enumerate(lines) if "SinglePartition" in line]
    assert len(single) == 1
    assert "HashAggregate(keys=[_range_part" in lines[single[0] + 1]
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
