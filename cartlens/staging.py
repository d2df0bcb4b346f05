"""Written intermediate tables.

An operator that needs several passes over an aggregated table writes it once as parquet, so that the
raw data is scanned once, later passes prune columns, and a lost executor costs a file read and not a
recomputation whose floating-point sums could come out differently. Files go to the shared folder named
by ``spark.checkpoint.dir`` and are removed when the application ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

PARALLEL_JOBS = 4
# Application folder -> its path and file system, for the clean-up at exit.
_written: dict[str, tuple] = {}


def stage_root(spark: SparkSession) -> str:
    """The folder for written intermediates: the session's checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="cartlens-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def _application_folder(spark: SparkSession) -> str:
    return f"{stage_root(spark).rstrip('/')}/cartlens-{spark.sparkContext.applicationId}"


def _hadoop(spark: SparkSession, path: str):
    """A path and its file system."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the application's stage folder, which is deleted when the application ends."""
    folder = _application_folder(spark)
    if folder not in _written:
        _written[folder] = _hadoop(spark, folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


@atexit.register
def _delete_written() -> None:
    for hadoop_path, fs in _written.values():
        try:
            fs.delete(hadoop_path, True)
        except Exception:  # the JVM may be gone already
            pass


def release(spark: SparkSession) -> None:
    """Delete everything this application has written so far. Results that are still to be read need it."""
    hadoop_path, fs = _hadoop(spark, _application_folder(spark))
    fs.delete(hadoop_path, True)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def run_together(spark: SparkSession, work: Mapping[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """Run independent Spark jobs side by side, so that small tables do not wait for large ones."""
    wrap = inheritable_thread_target(spark)
    with ThreadPoolExecutor(PARALLEL_JOBS) as pool:
        futures = {name: pool.submit(wrap(function)) for name, function in work.items()}
        return {name: future.result() for name, future in futures.items()}
