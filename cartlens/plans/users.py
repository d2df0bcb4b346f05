"""The user listing: load the tables when they are not there, list customers, send each one as a message."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartlens.sources.tables import database_has_data, load_all_csv, scan_limit


def get_users(
    spark: SparkSession,
    folder: str,
    database: str,
    send: Callable[[DataFrame], object],
    order_by: str,
    limit: int = 100,
    table: str = "customers",
    **load_options,
) -> DataFrame:
    """The first ``limit`` customers, which are also handed to ``send`` (a message sink)."""
    if not database_has_data(spark, database, [table]):
        load_all_csv(spark, folder, database, guard=False, **load_options)
    users = scan_limit(spark.table(f"{database}.{table}"), limit, order_by)
    send(users)
    return users
