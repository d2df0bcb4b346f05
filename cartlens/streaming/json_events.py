"""The unbounded JSON source, read from the earliest message on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cartlens.sources.messages import USERS_TOPIC, parse_messages


def kafka_source_options(servers: str, topic: str = USERS_TOPIC) -> dict[str, str]:
    """Options of the topic source: everything from the earliest offset."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
    }


def stream_from_kafka(
    spark: SparkSession, servers: str, schema, topic: str = USERS_TOPIC, bad_col: str | None = None
) -> DataFrame:
    """Parsed messages of a topic (needs the Kafka connector on the class path). ``bad_col``: see
    ``parse_messages``."""
    source = spark.readStream.format("kafka").options(**kafka_source_options(servers, topic)).load()
    return parse_messages(source, schema, bad_col)


def stream_from_files(
    spark: SparkSession, folder: str, schema, files_per_trigger: int = 1000, bad_col: str | None = None
) -> DataFrame:
    """Parsed messages of text files that arrive in a folder. ``bad_col``: see ``parse_messages``."""
    source = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return parse_messages(source, schema, bad_col)


def write_available(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append all messages present now to parquet files and stop; a restart goes on where it stopped."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
