"""CSV discovery, reading and writing."""

from __future__ import annotations

import csv
import posixpath
from collections.abc import Collection, Mapping
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.functions.scalars import nan_to_null


def clean_table_name(filename: str) -> str:
    """Table name of a file: base name without ``.csv``, lower case, ``-`` and blank as ``_``."""
    name = posixpath.basename(filename).replace(".csv", "").lower()
    return name.replace("-", "_").replace(" ", "_")


def stem_name(filename: str) -> str:
    """Base name without its last suffix."""
    return posixpath.splitext(posixpath.basename(filename))[0]


def csv_paths(spark: SparkSession, folder: str, recursive: bool = True) -> list[str]:
    """Paths of all CSV files below (or directly in) a folder, in name order. Only names are read."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    base = fs.makeQualified(root).toString().rstrip("/") + "/"
    listing, found = fs.listFiles(root, recursive), []
    while listing.hasNext():
        path = listing.next().getPath().toString()
        hidden = any(part[:1] in ("_", ".") for part in path.removeprefix(base).split("/"))
        if path.endswith(".csv") and not hidden:
            found.append(path)
    return sorted(found)


def discover_csv(spark: SparkSession, folder: str, recursive: bool = True, naming=stem_name) -> dict[str, list[str]]:
    """Table name -> its files. ``part-...`` files of a written table belong to their folder's name.

    Two sources with one table name are an error. Names that begin with ``_`` or ``.`` are not read.
    """
    tables: dict[str, list[str]] = {}
    sources: dict[str, str] = {}
    for path in csv_paths(spark, folder, recursive):
        base = posixpath.basename(path)
        source = posixpath.dirname(path) if base.startswith("part-") else path
        name = naming(unquote(source))
        if sources.setdefault(name, source) != source:
            raise ValueError(f"two sources for table {name}: {sources[name]} and {source}")
        tables.setdefault(name, []).append(path)
    return tables


def holds_breaks(name: str, multi_line: bool | Collection[str]) -> bool:
    """Whether a table's fields hold line breaks: a flag for all tables, or the names of those."""
    return multi_line if isinstance(multi_line, bool) else name in multi_line


def header_of(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names in a file's first line, read by the driver."""
    java = spark.sparkContext._jvm.java.io
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(hadoop_path)
    reader = java.BufferedReader(java.InputStreamReader(stream, "UTF-8"))
    try:
        line = reader.readLine() or ""
    finally:
        reader.close()
    return tuple(next(csv.reader([line.removeprefix("\ufeff")]), []))


def read_csv(
    spark: SparkSession,
    paths: str | list[str],
    schema: T.StructType | None = None,
    order_col: str | None = None,
    multi_line: bool = True,
    mode: str = "FAILFAST",
) -> DataFrame:
    """Read CSV files with a header. Columns are found by name: files may order them differently and have more.

    A column of ``schema`` that a file lacks is an error. Without a schema the types are inferred, which is a
    second pass. NaN becomes null. Quoted line breaks are part of a field, so a file is read by one task;
    ``multi_line=False`` lets Spark split large files that are known to hold none. A row that does not fit the
    schema is an error; ``mode="PERMISSIVE"`` makes its unreadable fields null.

    ``order_col`` adds the input order (file, position of the split, row in it) for "keep first" rules.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        for file in csv_paths(spark, path) if not path.endswith(".csv") else [path]:
            by_header.setdefault(header_of(spark, file), []).append(file)
    by_header.pop((), None) if len(by_header) > 1 else None

    def read(header: tuple[str, ...], files: list[str]) -> DataFrame:
        reader = (
            spark.read.option("header", True)
            .option("quote", '"')
            .option("escape", '"')
            .option("multiLine", multi_line)
            .option("mode", mode)
        )
        if schema is None or not header:
            reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
            return reader.csv(files)
        absent = [name for name in schema.names if name not in header]
        if absent:
            raise ValueError(f"{files[0]} lacks the columns {', '.join(absent)}")
        known = {f.name: f for f in schema.fields}
        return reader.schema(T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in header])).csv(files)

    frames = []
    for header, files in by_header.items():
        df = read(header, files)
        columns = [F.col(f"`{c}`") for c in (schema.names if schema is not None else df.columns)]
        if order_col:
            position = F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("split"),
                F.monotonically_increasing_id().alias("row"),
            )
            columns.append(position.alias(order_col))
        frames.append(nan_to_null(df.select(*columns)))
    if not frames:
        raise FileNotFoundError(f"no CSV file in {', '.join(paths)}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=schema is None), frames)


def read_all_csv(
    spark: SparkSession,
    folder: str,
    schemas: Mapping[str, T.StructType] | None = None,
    multi_line: bool | Collection[str] = True,
) -> dict[str, DataFrame]:
    """Every CSV below a folder as a table under its file stem. ``multi_line``: see ``holds_breaks``."""
    schemas = schemas or {}
    return {
        name: read_csv(spark, paths, schemas.get(name), multi_line=holds_breaks(name, multi_line))
        for name, paths in discover_csv(spark, folder).items()
    }


def write_csv_tables(tables: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """Write each table as CSV with a header below ``folder/name``.

    Empty text is written in quotes and null as nothing; a CSV reader takes both for missing.
    """
    targets = {}
    for name, df in tables.items():
        targets[name] = f"{folder.rstrip('/')}/{name}"
        (
            df.write.mode("overwrite")
            .option("header", True)
            .option("escape", '"')
            .option("emptyValue", '""')
            .csv(targets[name])
        )
    return targets
