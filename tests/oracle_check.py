"""Run registered queries beside their SQL in DuckDB and compare types and values.

    python tests/oracle_check.py SF_DIR [key ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
TABLES += ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def frame(table) -> pd.DataFrame:
    """Arrow table as a frame with sorted columns and sorted rows."""
    df = table.to_pandas(types_mapper=None)
    df = df[sorted(df.columns)]
    key = df.astype(str)
    return df.loc[key.sort_values(list(key.columns)).index].reset_index(drop=True)


def compare(got, want) -> str | None:
    """None when equal, else what differs."""
    types = {f.name: str(f.type) for f in got.schema}
    expected = {f.name: str(f.type) for f in want.schema}
    plain = {"large_string": "string", "timestamp[ns]": "timestamp[us]"}
    types = {k: plain.get(v, v) for k, v in types.items()}
    expected = {k: plain.get(v, v) for k, v in expected.items()}
    if types != expected:
        return f"schema: {types} != {expected}"
    if got.num_rows != want.num_rows:
        return f"rows: {got.num_rows} != {want.num_rows}"
    a, b = frame(got), frame(want)
    for c in a.columns:
        x, y = a[c], b[c]
        differs = ~((x == y) | (x.isna() & y.isna()))
        if differs.any():
            at = differs.idxmax()
            return f"{c}: {int(differs.sum())} values differ, row {at}: {x[at]!r} != {y[at]!r}"
    return None


def main(sf_dir: str, keys: list[str]) -> int:
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = connect(sf_dir), entry.queries(), entry.oracle_sql()
    bad = 0
    for key in keys or list(queries):
        start = time.time()
        try:
            got = queries[key](spark, sf_dir).toArrow()
            took = time.time() - start
            if key not in oracles:
                print(f"rows  {key} {got.num_rows} rows {took:.2f}s", flush=True)
                continue
            problem = compare(got, con.sql(oracles[key]).to_arrow_table())
        except Exception as error:
            took, problem = time.time() - start, repr(error)[:1500]
        bad += problem is not None
        print(f"{'ok   ' if problem is None else 'FAIL '} {key} {took:.2f}s {problem or got.num_rows}", flush=True)
    print(f"{bad} of {len(keys or queries)} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
