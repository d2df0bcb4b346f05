"""Type coercion, imputation, duplicate removal and key assignment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlens.functions.aggregates import drop_null_keys, first_by, mean
from cartlens.functions.scalars import as_list
from cartlens.operators.ordered import exact_quantiles, surrogate_key

__all__ = [
    "coerce_numbers",
    "coerce_timestamps",
    "drop_exact_duplicates",
    "drop_incomplete",
    "exact_duplicate_report",
    "fill_constants",
    "fill_medians",
    "keep_first",
    "keep_latest",
    "normalize_geolocation",
    "surrogate_key",
]


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a missing value in the named columns."""
    return df.dropna(subset=list(columns))


def coerce_timestamps(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text to timestamp without zone; what cannot be parsed becomes null."""
    return df.withColumns({c: F.col(c).cast("string").try_cast("timestamp_ntz") for c in columns})


def coerce_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text to double; what is no number becomes null."""
    out = {}
    for c in columns:
        value = F.col(c).try_cast("double")
        out[c] = F.when(~F.isnan(value), value)
    return df.withColumns(out)


def fill_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Put a constant in place of missing values."""
    return df.fillna(dict(values))


def fill_medians(df: DataFrame, columns: Sequence[str], repeatable: bool | None = None) -> DataFrame:
    """Put the column's exact median in place of missing values; numeric columns come out as double.

    ``repeatable`` says that the values are read or parsed and not sums of floating-point numbers.
    """
    wanted = {f"_median_{c}": (c, 0.5) for c in columns}
    medians = F.broadcast(exact_quantiles(df, wanted, repeatable=repeatable))
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_median_{c}")) for c in columns}
    return df.crossJoin(medians).withColumns(filled).select(*df.columns)


def drop_exact_duplicates(df: DataFrame, seq_col: str | None = None) -> DataFrame:
    """One of each set of equal rows (null equals null). ``seq_col`` is not compared; its minimum stays."""
    if seq_col is None:
        return df.dropDuplicates()
    others = [c for c in df.columns if c != seq_col]
    return df.groupBy(*others).agg(F.min(seq_col).alias(seq_col)).select(*df.columns)


def exact_duplicate_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows before, rows after and rows removed per table, each from one grouped pass."""
    reports = []
    for name, df in tables.items():
        groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
        reports.append(
            groups.agg(
                F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows_before"),
                F.count(F.lit(1)).alias("rows_after"),
            ).select(
                F.lit(name).alias("table"),
                "rows_before",
                "rows_after",
                (F.col("rows_before") - F.col("rows_after")).alias("removed"),
            )
        )
    out = reports[0]
    for report in reports[1:]:
        out = out.unionByName(report)
    return out


def _pick_one(df: DataFrame, keys: Sequence[str], order: list) -> DataFrame:
    # The filter on rank 1 is applied per task before the shuffle (window group limit), so that a key with
    # very many rows sends one row per task.
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def keep_first(df: DataFrame, keys: str | Sequence[str], seq_col: str) -> DataFrame:
    """The first row per key in the order of ``seq_col``. Null is a key like any other."""
    return _pick_one(df, as_list(keys), [F.asc_nulls_last(seq_col)])


def keep_latest(
    df: DataFrame,
    keys: str | Sequence[str],
    time_col: str,
    tie_col: str,
    nulls: str = "win",
) -> DataFrame:
    """The latest row per key. By default a missing time counts as latest, as in a nulls-last sort."""
    if nulls not in ("win", "lose"):
        raise ValueError("nulls must be 'win' or 'lose'")
    latest = F.desc_nulls_first(time_col) if nulls == "win" else F.desc_nulls_last(time_col)
    return _pick_one(df, as_list(keys), [latest, F.desc(tie_col)])


def normalize_geolocation(
    df: DataFrame,
    zip_col: str = "geolocation_zip_code_prefix",
    lat_col: str = "geolocation_lat",
    lng_col: str = "geolocation_lng",
    city_col: str = "geolocation_city",
    state_col: str = "geolocation_state",
    seq_col: str = "seq",
) -> DataFrame:
    """One row per zip prefix: mean position and the first present city and state."""
    rows = drop_null_keys(df, [zip_col])
    return rows.groupBy(zip_col).agg(
        mean(rows, lat_col).alias(lat_col),
        mean(rows, lng_col).alias(lng_col),
        first_by(city_col, seq_col).alias(city_col),
        first_by(state_col, seq_col).alias(state_col),
    )

