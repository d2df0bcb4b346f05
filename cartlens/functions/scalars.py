"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS_PER_DAY = 86_400_000_000


def as_list(cols: str | list[str] | tuple[str, ...] | None) -> list[str]:
    """One name or several names, as a list."""
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


def strict_timestamp(df: DataFrame, name: str) -> Column:
    """A column as timestamp; text that is no timestamp is an error."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.to_timestamp(F.col(name))
    return F.col(name).cast("timestamp")


def month(df: DataFrame, name: str) -> Column:
    """First day of the month of a date or timestamp column, as DATE."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.trunc(F.to_timestamp(F.col(name)), "MM")
    return F.date_trunc("MONTH", F.col(name)).cast("date")


def whole_days(later: Column, earlier: Column) -> Column:
    """Elapsed whole days between two timestamps, rounded down (minus 12 hours is day -1)."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(float(MICROS_PER_DAY)))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Floating-point quotient, null when the denominator is 0 or missing."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """Like ``ratio`` with 0 in place of null."""
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN of floating-point columns into null, so that one missing value remains."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[
            F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) if c in floating else F.col(c)
            for c in df.columns
        ]
    )


def table_name(path: Column) -> Column:
    """Table name of a CSV path: base name, without the suffix, lower case, no ``-`` or blank."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(F.lower(F.replace(base, F.lit(".csv"), F.lit(""))), "[- ]", "_")
