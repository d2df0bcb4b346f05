"""CSV, catalog, JDBC and message sources and sinks."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens import schemas
from cartlens.sources import csv_files, jdbc, messages, tables
from cartlens.streaming import json_events


def test_table_names():
    assert csv_files.clean_table_name("/x/My-Big Table.csv") == "my_big_table"
    assert csv_files.stem_name("/x/Orders.csv") == "Orders"


def test_discovery_is_recursive(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "one.csv").write_text("k,v\n1,x\n")
    (tmp_path / "a" / "two.csv").write_text("k,v\n2,y\n")
    (tmp_path / "a" / "note.txt").write_text("no")
    assert set(csv_files.discover_csv(spark, str(tmp_path))) == {"one", "two"}
    assert set(csv_files.discover_csv(spark, str(tmp_path), recursive=False)) == {"one"}
    assert csv_files.discover_csv(spark, str(tmp_path / "missing")) == {}
    out = csv_files.read_all_csv(spark, str(tmp_path))
    assert [tuple(r) for r in out["two"].collect()] == [(2, "y")]


def test_round_trip_keeps_text(spark, tmp_path):
    df = spark.createDataFrame([("a,\"b\"\nc", "", None, "007")], "t string, e string, n string, z string")
    csv_files.write_csv_tables({"texts": df}, str(tmp_path / "out"))
    back = csv_files.read_all_csv(spark, str(tmp_path / "out"), {"texts": df.schema})["texts"]
    assert [tuple(r) for r in back.collect()] == [("a,\"b\"\nc", None, None, "007")]


def test_input_order(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k,v\n" + "\n".join(f"{i % 3},{i}" for i in range(30)) + "\n")
    df = csv_files.read_csv(spark, str(tmp_path / "t.csv"), T.StructType.fromDDL("k int, v int"), order_col="seq")
    from cartlens.operators.cleaning import keep_first

    assert sorted(r["v"] for r in keep_first(df, "k", "seq").collect()) == [0, 1, 2]


def test_load_reports_and_guard(spark, tmp_path):
    (tmp_path / "Good-One.csv").write_text("k,v\n1,x\n2,y\n")
    (tmp_path / "bad.csv").write_text("k,v\nx,1\n")
    bad = {"bad": T.StructType.fromDDL("k int, v int")}
    report = tables.load_all_csv(spark, str(tmp_path), "load_test", schemas=bad)
    rows = {r["table"]: (r["rows"], r["status"], r["error"] is None) for r in report.collect()}
    assert rows == {"good_one": (2, "loaded", True), "bad": (None, "failed", False)}
    assert spark.table("load_test.good_one").count() == 2
    failed = tables.load_all_csv(spark, str(tmp_path), "load_test", schemas=bad).collect()
    assert [(r["table"], r["status"]) for r in failed] == [("bad", "failed")] and "SparkException" in failed[0]["error"] or failed[0]["error"]
    assert tables.database_has_data(spark, "load_test")
    assert tables.database_has_data(spark, "load_test", ["good_one"])
    assert not tables.database_has_data(spark, "load_test", ["good_one", "other"])
    again = tables.load_all_csv(spark, str(tmp_path), "load_test", guard=False, schemas=bad)
    assert again.count() == 2 and spark.table("load_test.good_one").count() == 2


def test_load_can_stop_at_the_first_error(spark, tmp_path):
    (tmp_path / "A.csv").write_text("k,v\nx,1\n")
    (tmp_path / "b.csv").write_text("k,v\n1,1\n")
    report = tables.load_all_csv(
        spark,
        str(tmp_path),
        "stop_test",
        schemas={"a": T.StructType.fromDDL("k int, v int")},
        naming=lambda f: csv_files.stem_name(f).lower(),
        stop_on_error=True,
    )
    assert [(r["table"], r["status"]) for r in report.collect()] == [("a", "failed")]


def test_failed_replace_leaves_the_old_table(spark):
    import os

    spark.sql("CREATE DATABASE IF NOT EXISTS replace_test")
    name = "replace_test.`t`"
    folder = spark.catalog.getDatabase("replace_test").locationUri.removeprefix("file:")
    tables.save_table(spark.range(5), name, bucket_by=(2, ["id"]))
    with pytest.raises(Exception, match="broken"):
        tables.save_table(spark.range(9).filter(F.expr("if(id > 7, raise_error('broken'), true)")), name)
    assert spark.table(name).count() == 5 and os.listdir(folder) == ["t"]
    # Other columns and another layout; the table may be read for its own replacement.
    tables.save_table(spark.table(name).select((F.col("id") + 1).alias("k")), name)
    assert sorted(r["k"] for r in spark.table(name).collect()) == [1, 2, 3, 4, 5]
    assert tables.stored_tables(spark, "replace_test") == {"t"} and os.listdir(folder) == ["t"]


def test_interrupted_replace_is_put_back(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS swap_test")
    tables.save_table(spark.range(3), "swap_test.t")
    spark.sql("ALTER TABLE swap_test.t RENAME TO swap_test.t__replaced")  # as if lost between the renames
    assert tables.stored_tables(spark, "swap_test") == set()
    with pytest.raises(Exception, match="broken"):
        tables.save_table(spark.range(9).filter(F.expr("if(id > 7, raise_error('broken'), true)")), "swap_test.t")
    assert spark.table("swap_test.t").count() == 3 and tables.stored_tables(spark, "swap_test") == {"t"}


def test_load_of_nothing(spark, tmp_path):
    assert tables.load_all_csv(spark, str(tmp_path), "nothing_test").count() == 0


def test_guard_ignores_temporary_views(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS view_test")
    spark.range(1).createOrReplaceTempView("some_view")
    assert not tables.database_has_data(spark, "view_test")
    assert not tables.database_has_data(spark, "no_such_database")
    spark.catalog.dropTempView("some_view")


def test_bucketed_tables_join_without_a_shuffle(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS bucket_test")
    for name in ("left_t", "right_t"):
        df = spark.range(1000).select(F.col("id").alias("k"), F.col("id").alias(name))
        tables.save_table(df, f"bucket_test.{name}", bucket_by=(4, ["k"]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("bucket_test.left_t").join(spark.table("bucket_test.right_t"), "k")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_jdbc_options():
    env = {"MYSQL_HOST": "h", "MYSQL_USER": "u", "MYSQL_PASSWORD": "p", "MYSQL_DATABASE": "d"}
    options = jdbc.jdbc_options("customers", env)
    assert options["url"] == "jdbc:mysql://h:3306/d"
    assert options["batchsize"] == "5000" and options["dbtable"] == "customers"
    assert jdbc.partition_options("id", 1, 9, 4)["numPartitions"] == "4"


def test_kafka_options():
    assert messages.kafka_options("k:9092")["topic"] == "users-topic"
    source = json_events.kafka_source_options("k:9092")
    assert source["startingOffsets"] == "earliest" and source["subscribe"] == "users-topic"


def test_messages_keep_missing_fields_and_microseconds(spark):
    df = spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b, TIMESTAMP_NTZ'2020-01-01 00:00:00.123456' AS t")
    line = messages.to_messages(df).first()["value"]
    assert line == '{"a":1,"b":null,"t":"2020-01-01T00:00:00.123456"}'
    assert messages.parse_messages(messages.to_messages(df), df.schema).first() == df.first()


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / d) for d in ("in", "out", "cp"))
    schema = T.StructType.fromDDL("a int")
    spark.range(3).select(F.col("id").cast("int").alias("a")).select(
        F.to_json(F.struct("a")).alias("value")
    ).coalesce(1).write.text(source)
    json_events.write_available(json_events.stream_from_files(spark, source, schema), target, checkpoint)
    assert spark.read.parquet(target).count() == 3
    messages.to_messages(spark.createDataFrame([(7,)], schema)).coalesce(1).write.mode("append").text(source)
    json_events.write_available(json_events.stream_from_files(spark, source, schema), target, checkpoint)
    assert sorted(r["a"] for r in spark.read.parquet(target).collect()) == [0, 1, 2, 7]


def test_declared_model():
    assert set(schemas.PRIMARY_KEYS) == set(schemas.RAW_SCHEMAS)
    for child, parent, key in schemas.FOREIGN_KEYS.values():
        assert key in schemas.RAW_SCHEMAS[child].names and key in schemas.RAW_SCHEMAS[parent].names
    for name in schemas.PRODUCT_NUMERIC_COLUMNS:
        assert name in schemas.RAW_SCHEMAS["products"].names


def test_stage_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from cartlens import staging

    class Conf:
        def get(self, key, default=None):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        staging.stage_root(Session())
    assert staging.stage_root(spark)


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "x.csv").write_text('b,a\n9,8\n')
    (tmp_path / "y.csv").write_text('﻿a,"b",c\n1,2,3\n')
    paths = [str(tmp_path / "x.csv"), str(tmp_path / "y.csv")]
    schema = T.StructType.fromDDL("a int, b int")
    for multi_line in (True, False):
        rows = csv_files.read_csv(spark, paths, schema, multi_line=multi_line).collect()
        assert sorted(map(tuple, rows)) == [(1, 2), (8, 9)]
    with pytest.raises(ValueError, match="lacks"):
        csv_files.read_csv(spark, paths, T.StructType.fromDDL("a int, z int"))


def test_nan_is_missing(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k,v\n1,NaN\n2,0.5\n")
    rows = csv_files.read_csv(spark, str(tmp_path / "t.csv"), T.StructType.fromDDL("k int, v double")).collect()
    assert sorted(map(tuple, rows)) == [(1, None), (2, 0.5)]


def test_name_clashes_and_hidden_files(spark, tmp_path):
    for folder in ("x", "y", "x/_temporary/0", "x/.hidden"):
        (tmp_path / folder).mkdir(parents=True)
    (tmp_path / "x/t.csv").write_text("a\n1\n")
    (tmp_path / "x/_temporary/0/part-1.csv").write_text("a\n1\n")
    (tmp_path / "x/.hidden/u.csv").write_text("a\n1\n")
    assert set(csv_files.discover_csv(spark, str(tmp_path))) == {"t"}
    (tmp_path / "y/t.csv").write_text("b\n1\n")
    with pytest.raises(ValueError, match="two sources"):
        csv_files.discover_csv(spark, str(tmp_path))


def test_bad_messages_are_kept(spark):
    schema = T.StructType.fromDDL("a int")
    lines = spark.createDataFrame([('{"a":1}',), ("{broken",), ('{"a":null}',)], "value string")
    rows = messages.parse_messages(lines, schema, "bad").collect()
    assert sorted((r["a"] or 0, r["bad"] or "") for r in rows) == [(0, ""), (0, "{broken"), (1, "")]
