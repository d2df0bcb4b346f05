"""From a folder of raw CSV files to the cleaned tables of a database, with the check reports."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from cartlens import schemas
from cartlens.operators import quality
from cartlens.plans import cleaning_pipeline
from cartlens.sources.csv_files import discover_csv, holds_breaks, read_csv, write_csv_tables
from cartlens.sources.tables import save_table

# Tables whose free text holds line breaks; the files of all others can be split.
WITH_BREAKS = ("reviews",)
# Tables that meet on the order key; bucketed alike they are joined without a shuffle.
BY_ORDER = ("orders", "order_items", "payments", "reviews")


class Warehouse(NamedTuple):
    """The cleaned tables and the reports on them."""

    tables: dict[str, DataFrame]
    profile: DataFrame
    primary_keys: DataFrame
    foreign_keys: DataFrame
    sanity: DataFrame


def read_raw(
    spark: SparkSession,
    folder: str,
    stems: Mapping[str, str] | None = None,
    seq_col: str = "seq",
    multi_line: bool | Collection[str] = WITH_BREAKS,
) -> dict[str, DataFrame]:
    """The nine raw tables with their input order. ``stems`` maps a table to its file stem when it differs."""
    files = discover_csv(spark, folder)
    stems = {name: name for name in schemas.RAW_SCHEMAS} | dict(stems or {})
    missing = sorted(name for name, stem in stems.items() if stem not in files)
    if missing:
        raise FileNotFoundError(f"no CSV file for {', '.join(missing)} below {folder}")
    return {
        name: read_csv(spark, files[stems[name]], schema, order_col=seq_col, multi_line=holds_breaks(name, multi_line))
        for name, schema in schemas.RAW_SCHEMAS.items()
    }


def build(
    spark: SparkSession,
    folder: str,
    database: str,
    stems: Mapping[str, str] | None = None,
    buckets: int | None = None,
    csv_folder: str | None = None,
    location: str | None = None,
    multi_line: bool | Collection[str] = WITH_BREAKS,
    key_order: Mapping[str, Sequence[str]] | None = None,
) -> Warehouse:
    """Clean the raw files and replace the database's tables.

    ``buckets`` is the bucket count of the order-grain tables (none: plain tables); ``csv_folder`` also
    writes the cleaned tables as CSV.
    """
    raw = read_raw(spark, folder, stems, multi_line=multi_line)
    cleaned = cleaning_pipeline.clean_tables(raw, key_order=key_order)
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{at}")
    for name, df in cleaned.items():
        bucket_by = (buckets, ["order_id"]) if buckets and name in BY_ORDER else None
        save_table(df, f"{database}.{name}", bucket_by=bucket_by)
    tables = {name: spark.table(f"{database}.{name}") for name in cleaned}
    if csv_folder:
        write_csv_tables(tables, csv_folder)
    return Warehouse(
        tables=tables,
        profile=quality.profile(tables),
        primary_keys=cleaning_pipeline.key_report(tables),
        foreign_keys=cleaning_pipeline.reference_report(tables),
        sanity=cleaning_pipeline.sanity_report(tables),
    )
