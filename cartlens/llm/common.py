"""What several text operators share: reading tables, session settings, splits and ASCII rules."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Text handed to Python at once: a task holds this many texts, and cuts longer runs by bytes.
BATCH_ROWS = 256
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings of the text operators: small Arrow batches, as single texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def crc_bucket(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id is in bucket 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % modulus, F.lit(0))


def batches(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``BATCH_BYTES`` at most (one longer row stays whole)."""
    for batch in source:
        if not batch.num_rows:
            continue
        pieces = max(1, -(-batch.nbytes // BATCH_BYTES))
        step = max(1, -(-batch.num_rows // pieces))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def executor_slots(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
