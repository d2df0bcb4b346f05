"""JDBC options from the environment. The driver jar is the user's to supply."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 5000


# Names of the connection variables and their defaults.
def jdbc_options(table: str, env: Mapping[str, str] | None = None) -> dict[str, str]:
    """Connection options for a MySQL table from ``MYSQL_*`` variables."""
    env = os.environ if env is None else env
    host, port = env.get("MYSQL_HOST", "mysql"), env.get("MYSQL_PORT", "3306")
    return {
        "url": f"jdbc:mysql://{host}:{port}/{env.get('MYSQL_DATABASE', '')}",
        "user": env.get("MYSQL_USER", ""),
        "password": env.get("MYSQL_PASSWORD", ""),
        "dbtable": table,
        "batchsize": str(BATCH_ROWS),
    }


def partition_options(column: str, lower: int, upper: int, partitions: int) -> dict[str, str]:
    """Options that make a JDBC read run as several range queries instead of one task."""
    return {
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
    }


def read_jdbc(spark: SparkSession, table: str, split: Mapping[str, str] | None = None, env=None) -> DataFrame:
    """Read a table; ``split`` takes ``partition_options``."""
    return spark.read.format("jdbc").options(**jdbc_options(table, env), **(split or {})).load()


def write_jdbc(df: DataFrame, table: str, env=None) -> None:
    """Replace a table, in batches of 5,000 rows."""
    df.write.format("jdbc").options(**jdbc_options(table, env)).mode("overwrite").save()
