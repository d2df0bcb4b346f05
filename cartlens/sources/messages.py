"""Rows as JSON messages, to a topic or to text files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the topic's name.
USERS_TOPIC = "users-topic"
# Microseconds survive the trip; the default format would cut them.
TIME_FORMAT = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def to_messages(df: DataFrame) -> DataFrame:
    """One JSON object per row in ``value``. Missing fields are written as null, not left out."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", **TIME_FORMAT}).alias("value"))


def kafka_options(servers: str, topic: str = USERS_TOPIC) -> dict[str, str]:
    """Options of the topic sink."""
    return {"kafka.bootstrap.servers": servers, "topic": topic}


def send_to_kafka(df: DataFrame, servers: str, topic: str = USERS_TOPIC) -> None:
    """Send each row as a message (needs the Kafka connector on the class path)."""
    to_messages(df).write.format("kafka").options(**kafka_options(servers, topic)).save()


def write_json_lines(df: DataFrame, path: str) -> str:
    """Write the messages as text files, one object per line."""
    to_messages(df).write.mode("overwrite").text(path)
    return path


def parse_messages(messages: DataFrame, schema: T.StructType, bad_col: str | None = None) -> DataFrame:
    """The objects of ``value`` as columns.

    A message that is no object of the schema becomes nulls; with ``bad_col`` that column then holds its text (and
    is null for good messages), so that bad messages can be counted and kept.
    """
    options = dict(TIME_FORMAT)
    if bad_col:
        schema = T.StructType([*schema.fields, T.StructField(bad_col, T.StringType())])
        options["columnNameOfCorruptRecord"] = bad_col
    value = F.col("value").cast("string")
    parsed = messages.select(F.from_json(value, schema, options).alias("m"))
    return parsed.select("m.*")
