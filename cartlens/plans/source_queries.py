"""Queries that write the tables out and read them back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.functions.scalars import table_name
from cartlens.plans import driver_tables as driver
from cartlens.plans import users
from cartlens.plans.registry import query
from cartlens.sources import csv_files, messages, tables
from cartlens.staging import new_path, stage
from cartlens.streaming import json_events

CSV_TABLES = ["customer", "orders", "nation"]


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(driver.PARQUET_SCHEMAS[name])


def written_csv(spark, sf_dir, names=CSV_TABLES) -> str:
    """The named tables as CSV folders below a new path."""
    folder = new_path(spark, "csv")
    csv_files.write_csv_tables({n: driver.table(spark, sf_dir, n) for n in names}, folder)
    return folder


@query("src_csv_roundtrip", "SELECT * FROM orders")
def src_csv_roundtrip(spark, sf_dir):
    folder = written_csv(spark, sf_dir)
    return csv_files.read_all_csv(spark, folder, {n: schema_of(n) for n in CSV_TABLES})["orders"]


@query("src_csv_inferred", "SELECT c_mktsegment, count(*) AS n, max(c_custkey) AS last_key FROM customer GROUP BY 1")
def src_csv_inferred(spark, sf_dir):
    customers = csv_files.read_all_csv(spark, written_csv(spark, sf_dir, ["customer"]))["customer"]
    return customers.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("c_custkey").cast("long")).alias("last_key")
    )


@query("src_csv_reordered", "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders")
def src_csv_reordered(spark, sf_dir):
    # Two files of one table with their columns in different orders, and more columns than are asked for.
    orders, folder = driver.table(spark, sf_dir, "orders"), new_path(spark, "csv")
    first, second = orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 <> 0")
    csv_files.write_csv_tables({"orders": first.select(*sorted(first.columns, reverse=True))}, f"{folder}/a")
    csv_files.write_csv_tables({"orders": second.select("o_orderdate", "o_totalprice", "o_orderkey")}, f"{folder}/b")
    paths = [f"{folder}/a/orders", f"{folder}/b/orders"]
    wanted = schema_of("orders")
    schema = T.StructType([wanted[c] for c in ("o_orderkey", "o_totalprice", "o_orderdate")])
    return csv_files.read_csv(spark, paths, schema, multi_line=False)


def load(spark, folder, database, **options):
    """Load a folder into a database that lives in the shared folder."""
    return tables.load_all_csv(
        spark,
        folder,
        database,
        schemas=options.pop("schemas", {n: schema_of(n) for n in CSV_TABLES}),
        recursive=True,
        location=new_path(spark, "db"),
        **options,
    )


@contextmanager
def database(spark) -> Iterator[str]:
    """Name of a database that is dropped with its tables at the end of the block."""
    name = f"cartlens_{uuid.uuid4().hex}"
    try:
        yield name
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


@query(
    "sink_table_load",
    """SELECT o_custkey, c_name, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
)
def sink_table_load(spark, sf_dir):
    # Both tables are bucketed on the customer key, so joining them moves no rows.
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = {"orders": (count, ["o_custkey"]), "customer": (count, ["c_custkey"])}
    with database(spark) as name:
        load(spark, written_csv(spark, sf_dir), name, bucket_by=buckets)
        orders, customer = spark.table(f"{name}.orders"), spark.table(f"{name}.customer")
        joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
        spent = joined.groupBy("o_custkey", "c_name").agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spent"),
        )
        return stage(spent, "spent")


@query(
    "sink_load_guard",
    """SELECT 'first load' AS step, 'customer' AS "table", count(*) AS rows FROM customer
UNION ALL SELECT 'first load', 'orders', count(*) FROM orders
UNION ALL SELECT 'first load', 'nation', count(*) FROM nation""",
)
def sink_load_guard(spark, sf_dir):
    folder = written_csv(spark, sf_dir)
    driver.table(spark, sf_dir, "region").createOrReplaceTempView("cartlens_guard_view")
    with database(spark) as name:
        reports = [load(spark, folder, name).withColumn("step", F.lit(step)) for step in ("first load", "second load")]
    spark.catalog.dropTempView("cartlens_guard_view")
    return reports[0].unionByName(reports[1]).select("step", "table", "rows")


@query(
    "sink_load_report",
    """SELECT 'customer' AS "table", count(*) AS rows, 'loaded' AS status FROM customer
UNION ALL SELECT 'orders', NULL, 'failed' FROM orders HAVING count(*) > 0
UNION ALL SELECT 'nation', count(*), 'loaded' FROM nation""",
)
def sink_load_report(spark, sf_dir):
    # The order status is read as a number: that table fails, the others are loaded.
    schemas = {n: schema_of(n) for n in CSV_TABLES}
    schemas["orders"] = T.StructType.fromDDL(
        driver.PARQUET_SCHEMAS["orders"].replace("o_orderstatus string", "o_orderstatus int")
    )
    with database(spark) as name:
        report = load(spark, written_csv(spark, sf_dir), name, schemas=schemas)
    return report.select("table", "rows", "status")


@query(
    "sink_load_again",
    """SELECT 'first load' AS step, 'customer' AS "table", 'loaded' AS status, count(*) AS rows FROM customer
UNION ALL SELECT 'first load', 'orders', 'failed', NULL FROM orders HAVING count(*) > 0
UNION ALL SELECT 'mended', 'orders', 'loaded', count(*) FROM orders""",
)
def sink_load_again(spark, sf_dir):
    # A table that failed is loaded by the next call; the one that was loaded is left alone.
    folder = written_csv(spark, sf_dir, ["customer", "orders"])
    good = {n: schema_of(n) for n in CSV_TABLES}
    broken = T.StructType.fromDDL(driver.PARQUET_SCHEMAS["orders"].replace("o_orderstatus string", "o_orderstatus int"))
    with database(spark) as name:
        first = load(spark, folder, name, schemas={**good, "orders": broken}).withColumn("step", F.lit("first load"))
        mended = load(spark, folder, name, schemas=good).withColumn("step", F.lit("mended"))
    return first.unionByName(mended).select("step", "table", "status", "rows")


@query(
    "sink_replace_failed",
    """SELECT *, 'failed' AS second_load FROM orders""",
)
def sink_replace_failed(spark, sf_dir):
    # The second load cannot read the order status as a number: the rows of the first one stay.
    folder = written_csv(spark, sf_dir, ["orders"])
    broken = T.StructType.fromDDL(driver.PARQUET_SCHEMAS["orders"].replace("o_orderstatus string", "o_orderstatus int"))
    with database(spark) as name:
        load(spark, folder, name)
        report = load(spark, folder, name, schemas={"orders": broken}, guard=False)
        rows = spark.table(f"{name}.orders").crossJoin(F.broadcast(report.select(F.col("status").alias("second_load"))))
        return stage(rows, "replaced")


@query(
    "fn_table_name",
    """SELECT p_partkey, replace(replace(lower(p_name || '-' || p_brand), '-', '_'), ' ', '_') AS table_name FROM part""",
)
def fn_table_name(spark, sf_dir):
    path = F.concat(F.lit("/data/in/"), "p_name", F.lit("-"), "p_brand", F.lit(".csv"))
    return driver.table(spark, sf_dir, "part").select("p_partkey", table_name(path).alias("table_name"))


@query("scan_limit", "SELECT * FROM customer ORDER BY c_custkey LIMIT 100")
def scan_limit(spark, sf_dir):
    return tables.scan_limit(driver.table(spark, sf_dir, "customer"), 100, "c_custkey")


@query("sink_json_events", "SELECT * FROM customer")
def sink_json_events(spark, sf_dir):
    path = messages.write_json_lines(driver.table(spark, sf_dir, "customer"), new_path(spark, "json"))
    return messages.parse_messages(spark.read.text(path), schema_of("customer"))


@query("stream_json_events", "SELECT * FROM events")
def stream_json_events(spark, sf_dir):
    source = messages.write_json_lines(driver.table(spark, sf_dir, "events"), new_path(spark, "json"))
    target = new_path(spark, "stream")
    stream = json_events.stream_from_files(spark, source, schema_of("events"))
    json_events.write_available(stream, target, new_path(spark, "checkpoint"))
    return spark.read.schema(schema_of("events")).parquet(target)


@query(
    "stream_bad_messages",
    """SELECT CASE WHEN event_id % 10 = 3 THEN 'bad' ELSE 'good' END AS kind, count(*) AS n,
 sum(CASE WHEN event_id % 10 <> 3 THEN event_id END)::BIGINT AS ids FROM events GROUP BY 1""",
)
def stream_bad_messages(spark, sf_dir):
    # Every tenth message is cut off before its end.
    events = driver.table(spark, sf_dir, "events")
    lines = messages.to_messages(events.where("event_id % 10 <> 3")).unionByName(
        messages.to_messages(events.where("event_id % 10 = 3")).select(F.expr("substring(value, 1, 20)").alias("value"))
    )
    source, target = new_path(spark, "json"), new_path(spark, "stream")
    lines.write.text(source)
    stream = json_events.stream_from_files(spark, source, schema_of("events"), bad_col="bad")
    json_events.write_available(stream, target, new_path(spark, "checkpoint"))
    written = spark.read.parquet(target)
    return written.groupBy(F.when(F.col("bad").isNull(), "good").otherwise("bad").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("bad").isNull(), F.col("event_id"))).alias("ids")
    )


@query("users_feed", "SELECT * FROM customer ORDER BY c_custkey LIMIT 100")
def users_feed(spark, sf_dir):
    # Loaded on first use, listed, sent as JSON messages and received by the stream.
    source, target = new_path(spark, "json"), new_path(spark, "stream")
    with database(spark) as name:
        users.get_users(
            spark,
            written_csv(spark, sf_dir, ["customer"]),
            name,
            send=lambda rows: messages.write_json_lines(rows, source),
            order_by="c_custkey",
            table="customer",
            schemas={"customer": schema_of("customer")},
            recursive=True,
            location=new_path(spark, "db"),
        )
    stream = json_events.stream_from_files(spark, source, schema_of("customer"))
    json_events.write_available(stream, target, new_path(spark, "checkpoint"))
    return spark.read.schema(schema_of("customer")).parquet(target)
