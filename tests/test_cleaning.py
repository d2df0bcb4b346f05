"""Cleaning, keys and checks on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from cartlens.operators import cleaning, quality
from cartlens.plans.flat import flat_order_items, flat_payments, translate_categories


def test_exact_duplicates_treat_null_as_equal(spark):
    df = spark.createDataFrame([(1, None, 5), (1, None, 3), (2, "x", 4)], "a int, b string, seq int")
    rows = sorted(tuple(r) for r in cleaning.drop_exact_duplicates(df, "seq").collect())
    assert rows == [(1, None, 3), (2, "x", 4)]
    assert cleaning.drop_exact_duplicates(df.drop("seq")).count() == 2
    report = cleaning.exact_duplicate_report({"t": df.drop("seq")}).first()
    assert tuple(report) == ("t", 3, 2, 1)


def test_latest_and_missing_time(spark):
    df = spark.createDataFrame([(1, "2020-01-01", 1), (1, None, 2)], "k int, t string, id int")
    assert cleaning.keep_latest(df, "k", "t", "id").first()["id"] == 2
    assert cleaning.keep_latest(df, "k", "t", "id", nulls="lose").first()["id"] == 1
    with pytest.raises(ValueError):
        cleaning.keep_latest(df, "k", "t", "id", nulls="first")


def test_one_row_per_key_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.floor(F.col("id") / 1000) + 1).alias("k"), F.col("id").alias("seq"))
    first = cleaning.keep_first(df, "k", "seq")
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan
    assert [tuple(r) for r in first.collect()] == [(1, 0)]


def test_coercion(spark):
    df = spark.createDataFrame([("2020-01-02 03:04:05", "1.5"), ("nope", "n/a"), (None, "NaN")], "t string, n string")
    out = cleaning.coerce_numbers(cleaning.coerce_timestamps(df, ["t"]), ["n"])
    assert dict(out.dtypes) == {"t": "timestamp_ntz", "n": "double"}
    assert [r["n"] for r in out.collect()] == [1.5, None, None]
    assert [r["t"] is None for r in out.collect()] == [False, True, True]


def test_fills(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, None), (None, ""), (10.0, "b")], "n double, s string")
    out = cleaning.fill_medians(cleaning.fill_constants(df, {"s": "unknown"}), ["n"])
    assert sorted((r["n"], r["s"]) for r in out.collect()) == [(1.0, "a"), (3.0, ""), (3.0, "unknown"), (10.0, "b")]


def test_geolocation_takes_the_first_present_name(spark):
    rows = [("01", 1.0, 2.0, None, "s", 1), ("01", 3.0, 4.0, "c", "t", 2), (None, 0.0, 0.0, "z", "z", 3)]
    schema = (
        "geolocation_zip_code_prefix string, geolocation_lat double, geolocation_lng double,"
        " geolocation_city string, geolocation_state string, seq int"
    )
    out = cleaning.normalize_geolocation(spark.createDataFrame(rows, schema)).collect()
    assert [tuple(r) for r in out] == [("01", 2.0, 3.0, "c", "s")]


def test_primary_key_counts_null_as_a_value(spark):
    df = spark.createDataFrame([(None,), (None,), ("a",)], "k string")
    row = quality.primary_key_check({"t": (df, "k")}).first()
    assert (row["duplicate_pk"], row["null_pk"]) == (1, 2)


def test_foreign_key_and_missing_values(spark):
    child = spark.createDataFrame([("a",), (None,), ("z",), ("z",)], "k string")
    parent = spark.createDataFrame([("a",), ("a",)], "k string")
    holey = parent.union(spark.createDataFrame([(None,)], "k string"))
    out = quality.foreign_key_check({"no": (child, "k", parent, "k"), "yes": (child, "k", holey, "k")}).collect()
    assert {r["check"]: r["missing"] for r in out} == {"no": 3, "yes": 2}
    assert quality.orphan_rows(child, "k", parent, "k").count() == 3
    assert quality.orphan_rows(child, "k", holey, "k").count() == 2


def test_checks_of_empty_tables(spark):
    df = spark.createDataFrame([], "k string, price double, payment_value double")
    orders = spark.createDataFrame(
        [], "order_delivered_customer_date timestamp, order_purchase_timestamp timestamp"
    )
    assert tuple(quality.profile({"t": df}).first()) == ("t", 0, 3, 0)
    assert quality.primary_key_check({"t": (df, "k")}).first()["duplicate_pk"] == 0
    assert quality.foreign_key_check({"c": (df, "k", df, "k")}).first()["missing"] == 0
    assert {r["violations"] for r in quality.sanity_checks(df, df, orders).collect()} == {0}


def flat_tables(spark):
    return {
        "order_items": spark.createDataFrame(
            [(1, 10, 100, 5.0), (1, 11, 100, 6.0), (2, 99, 100, 7.0)],
            "order_id int, product_id int, seller_id int, price double",
        ),
        "orders": spark.createDataFrame([(1, 7), (2, 8)], "order_id int, customer_id int"),
        "customers": spark.createDataFrame([(7, "c7")], "customer_id int, customer_city string"),
        "sellers": spark.createDataFrame([(100, "s")], "seller_id int, seller_city string"),
        "products": spark.createDataFrame([(10, "p"), (11, "q")], "product_id int, product_category_name string"),
        "payments": spark.createDataFrame([(1, 3.0)], "order_id int, payment_value double"),
    }


def test_flat_frame_joins_what_is_asked_for(spark):
    tables = flat_tables(spark)
    left = flat_order_items(tables, ["price", "customer_city", "product_category_name"])
    assert sorted(map(tuple, left.fillna("?").collect())) == [(5.0, "c7", "p"), (6.0, "c7", "q"), (7.0, "?", "?")]
    assert flat_order_items(tables, ["price", "customer_city"], how="inner").count() == 2
    plan = flat_order_items(tables, ["price", "seller_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    pay = flat_payments(tables, ["payment_value", "customer_city"]).collect()
    assert [tuple(r) for r in pay] == [(3.0, "c7")]


def test_additive_frame_sums_before_the_join(spark):
    tables = flat_tables(spark)
    frame = flat_order_items(tables, ["customer_id", "price"], additive=["price"])
    assert sorted(map(tuple, frame.collect())) == [(7, 11.0), (8, 7.0)]
    places = flat_order_items(tables, ["seller_city", "price", "seller_id"], additive=["price"])
    assert [tuple(r) for r in places.collect()] == [("s", 18.0, 100)]
    # An order with a second key keeps the item grain.
    both = flat_order_items(tables, ["customer_id", "seller_id", "price"], additive=["price"])
    assert both.count() == 3


def test_translation_falls_back(spark):
    df = spark.createDataFrame([("x",), ("y",)], "product_category_name string")
    names = spark.createDataFrame([("x", "ex")], "product_category_name string, product_category_name_english string")
    out = translate_categories(df, names).collect()
    assert sorted(r["product_category_name_english"] for r in out) == ["ex", "y"]
