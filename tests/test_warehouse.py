"""The raw CSV files of a small marketplace, cleaned into a database."""

from cartlens import api
from cartlens.plans import warehouse

FILES = {
    "customers": "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n"
    "c1,u1,01000,a,X\nc1,u1,01000,a,X\nc1,u9,01000,late,X\nc2,u2,02000,b,Y\n",
    "sellers": "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,01000,a,X\n",
    "products": "product_id,product_category_name,product_name_lenght,product_description_lenght,"
    "product_photos_qty,product_weight_g,product_length_cm,product_height_cm,product_width_cm\n"
    "p1,toys,1,1,1,100,1,1,1\np2,,1,1,1,oops,1,1,1\np3,toys,1,1,1,300,1,1,1\n",
    "orders": "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
    "order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n"
    "o1,c1,delivered,2020-01-01 10:00:00,,,2020-01-04 09:00:00,2020-01-10\n"
    "o2,c9,shipped,2020-02-01 10:00:00,bad,,,2020-02-10\n",
    "order_items": "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
    "o1,1,p1,s1,2020-01-02,10.50,1.00\no1,1,p1,s1,2020-01-02,10.50,1.00\no1,2,p2,s1,2020-01-02,-4.00,1.00\n"
    "o2,1,p3,s1,2020-02-02,7.25,1.00\n",
    "payments": "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
    "o1,1,card,2,16.50\no2,1,cash,1,8.25\n",
    "reviews": "review_id,order_id,review_score,review_comment_title,review_comment_message,"
    'review_creation_date,review_answer_timestamp\nr1,o1,2,,"two\nlines",2020-01-05,2020-01-06\n'
    "r2,o1,5,,,2020-01-05,2020-01-08\nr3,o2,1,x,,2020-02-05,2020-02-06\n",
    "geolocation": "geolocation_zip_code_prefix,geolocation_lat,geolocation_lng,geolocation_city,geolocation_state\n"
    "01000,1.0,2.0,,X\n01000,3.0,4.0,a,X\n02000,5.0,6.0,b,Y\n",
    "category_translation": "product_category_name,product_category_name_english\ntoys,Toys\ntoys,Games\n",
}


def test_build(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / f"raw_{name}.csv").write_text(text)
    built = warehouse.build(
        spark,
        str(tmp_path),
        "warehouse_test",
        stems={name: f"raw_{name}" for name in FILES},
        buckets=4,
        csv_folder=str(tmp_path / "clean"),
    )
    tables = built.tables
    assert sorted(r["customer_city"] for r in tables["customers"].collect()) == ["a", "b"]  # first row per key
    products = {r["product_id"]: r for r in tables["products"].collect()}
    assert products["p2"]["product_weight_g"] == 200.0 and products["p2"]["product_category_name"] == "unknown"
    keys = [r["order_item_key"] for r in tables["order_items"].orderBy("order_item_key").collect()]
    assert keys == [1, 2, 3]  # the copy is gone, the key is dense
    reviews = {r["order_id"]: r for r in tables["reviews"].collect()}
    assert reviews["o1"]["review_id"] == "r2" and reviews["o1"]["review_comment_title"] == ""
    geo = {r["geolocation_zip_code_prefix"]: r for r in tables["geolocation"].collect()}
    assert geo["01000"]["geolocation_lat"] == 2.0 and geo["01000"]["geolocation_city"] == "a"
    assert {r["duplicate_pk"] for r in built.primary_keys.collect()} == {0}
    foreign = {r["check"]: r["missing"] for r in built.foreign_keys.collect()}
    assert foreign["orders -> customers"] == 1 and sum(foreign.values()) == 1
    sanity = {r["check"]: r["violations"] for r in built.sanity.collect()}
    assert sanity == {"negative_prices": 1, "negative_payments": 0, "invalid_delivery_dates": 0}
    assert {r["table"]: r["row_count"] for r in built.profile.collect()}["payments"] == 2

    frame = api.flat_order_items(tables, ["customer_city", "price", "product_category_name"])
    frame = api.translate_categories(frame, tables["category_translation"])
    share = api.compute_revenue_share(frame, "product_category_name_english", "price")
    assert {r["product_category_name_english"]: r["revenue"] for r in share.collect()} == {"Toys": 17.75, "unknown": -4.0}
    days = api.compute_delivery_metrics(
        tables["orders"], "order_purchase_timestamp", "order_delivered_customer_date"
    ).first()
    assert days["avg_delivery_days"] == 2.0
    assert set(api.read_all_csv(spark, str(tmp_path / "clean"))) == set(FILES)


def test_missing_files_are_named(spark, tmp_path):
    (tmp_path / "orders.csv").write_text(FILES["orders"])
    try:
        warehouse.read_raw(spark, str(tmp_path))
    except FileNotFoundError as error:
        assert "customers" in str(error) and "orders" not in str(error).split("below")[0].split(", ")
    else:
        raise AssertionError("missing files were accepted")


def test_order_tables_meet_without_a_shuffle(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / f"{name}.csv").write_text(text)
    tables = warehouse.build(spark, str(tmp_path), "warehouse_join_test", buckets=4).tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = api.flat_reviews(tables, ["price", "review_score", "order_purchase_timestamp"])
        plan = frame._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan
    assert frame.count() == 3
