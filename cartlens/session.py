"""Session settings the operators are written for."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

# Runtime settings only, so they can be applied to a session somebody else built.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot join key is split even when the split costs one more shuffle further up.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
#: Bytes a shuffle task reads at most, where there are partitions enough: a task that joins and counts distinct values
#: holds about ten times that in memory.
TASK_BYTES = 16 << 20
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: A join whose smaller side has no partition above this is hashed: neither side is sorted.
HASHED = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
#: Shuffle partitions that adaptive execution starts from at least and then merges, so that few partitions set for small
#: tables do not make tasks grow with the input.
LEAST_PARTITIONS = 200
PARTITIONS = "spark.sql.shuffle.partitions"
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def _bytes(size: str) -> int:
    """A size as Spark writes it (``64MB``, ``8m``, ``1024b``)."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgt]?)i?b?\s*", size.lower()).groups()
    return int(number) * _UNITS[unit]


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it. Smaller and more tasks than ours stay as they
    are set."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    if _bytes(spark.conf.get(ADVISORY)) > TASK_BYTES:
        spark.conf.set(ADVISORY, str(TASK_BYTES))
    if _bytes(spark.conf.get(HASHED)) < TASK_BYTES:
        spark.conf.set(HASHED, str(TASK_BYTES))
    partitions = int(spark.conf.get(PARTITIONS))
    if int(spark.conf.get(INITIAL, None) or partitions) < max(partitions, LEAST_PARTITIONS):
        spark.conf.set(INITIAL, str(max(partitions, LEAST_PARTITIONS)))
    return spark


def get_spark(
    app_name: str = "cartlens",
    master: str | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Build a session. ``master`` and partition counts are left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())
