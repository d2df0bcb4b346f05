"""Loading CSV folders into catalog tables, with a guard and a report per file; the limited scan."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Collection, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cartlens.operators.ordered import sort_columns
from cartlens.sources.csv_files import clean_table_name, discover_csv, holds_breaks, read_csv

REPORT_SCHEMA = "table string, rows long, status string, error string"


def save_table(
    df: DataFrame,
    name: str,
    partition_by: Sequence[str] = (),
    bucket_by: tuple[int, Sequence[str]] | None = None,
) -> None:
    """Replace a parquet table. Tables bucketed alike on a join key are joined without a shuffle.

    The rows are written to a table aside, which takes the name when it is whole, so a job that fails leaves the old
    table as it was. The change of names is two renames, which move folders. A driver that is lost between them leaves
    the old table as ``name__replaced``: the next call puts it back before it writes. One lost while it writes leaves a
    folder ``name__incoming_...`` that no table refers to.
    """
    spark = df.sparkSession
    old, aside = _beside(name, "replaced"), _beside(name, f"incoming_{uuid.uuid4().hex}")
    if spark.catalog.tableExists(old):
        back = f"DROP TABLE {old}" if spark.catalog.tableExists(name) else f"ALTER TABLE {old} RENAME TO {name}"
        spark.sql(back)
    writer = df.write.format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        count, keys = bucket_by
        writer = writer.bucketBy(count, *keys).sortBy(*keys)
    try:
        writer.saveAsTable(aside)
    except Exception:
        _drop_half_written(spark, aside)
        raise
    replaces = spark.catalog.tableExists(name)
    if replaces:
        spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {aside} RENAME TO {name}")
    if replaces:
        spark.sql(f"DROP TABLE {old}")


def _beside(name: str, what: str) -> str:
    """Name of a helper table in the same database."""
    database, dot, table = name.rpartition(".")
    return f"{database}{dot}`{table.strip('`')}__{what}`"


def _drop_half_written(spark: SparkSession, name: str) -> None:
    """Drop a table whose job failed, and the folder that the job may have left."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    database, _, table = name.rpartition(".")
    location = spark.catalog.getDatabase(database.strip("`") or spark.catalog.currentDatabase()).locationUri
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{location.rstrip('/')}/{table.strip('`')}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored_tables(spark: SparkSession, database: str) -> set[str]:
    """Names of the stored tables of a database. Temporary views do not count."""
    if not spark.catalog.databaseExists(database):
        return set()
    names = {t.name for t in spark.catalog.listTables(database) if not t.isTemporary}
    return {n for n in names if not n.endswith("__replaced") and "__incoming_" not in n}


def database_has_data(spark: SparkSession, database: str, wanted: Iterable[str] | None = None) -> bool:
    """Whether the database holds any table, or all ``wanted`` ones when they are named."""
    present = stored_tables(spark, database)
    return bool(present) if wanted is None else set(wanted) <= present


def load_all_csv(
    spark: SparkSession,
    folder: str,
    database: str,
    schemas: Mapping[str, T.StructType] | None = None,
    naming: Callable[[str], str] = clean_table_name,
    stop_on_error: bool = False,
    bucket_by: Mapping[str, tuple[int, Sequence[str]]] | None = None,
    guard: bool = True,
    multi_line: bool | Collection[str] = True,
    recursive: bool = False,
    location: str | None = None,
) -> DataFrame:
    """Load every CSV directly in a folder (or below it) into its table; returns one report row per table.

    A file that fails is reported with its whole error and the others are loaded, unless ``stop_on_error``. With
    ``guard`` a table that the database already holds is left alone and not reported, so a table that failed is
    loaded by the next call. ``multi_line`` is a flag for all tables or the names of those whose fields hold line
    breaks; the others can be read by several tasks a file. No files means an empty report.
    """
    schemas, bucket_by = schemas or {}, bucket_by or {}
    report: list[tuple] = []
    present = stored_tables(spark, database) if guard else set()
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{at}")
    for name, paths in discover_csv(spark, folder, recursive=recursive, naming=naming).items():
        if name in present:
            continue
        table = f"{database}.`{name}`"
        try:
            df = read_csv(spark, paths, schemas.get(name), multi_line=holds_breaks(name, multi_line))
            save_table(df, table, bucket_by=bucket_by.get(name))
            rows = spark.table(table).count()  # from the parquet footers
            report.append((name, rows, "loaded", None))
        except Exception as error:
            report.append((name, None, "failed", repr(error)))
            if stop_on_error:
                break
    return spark.createDataFrame(report, REPORT_SCHEMA)


def scan_limit(df: DataFrame, n: int = 100, order_by: str | Sequence[str] | None = None) -> DataFrame:
    """``SELECT * ... LIMIT n``; an order key makes the result defined."""
    if order_by is None:
        return df.limit(n)
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*sort_columns([(k, True) for k in keys])).limit(n)
