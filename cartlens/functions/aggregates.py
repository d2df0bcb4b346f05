"""The named aggregates an ``agg_map`` may use, with the missing-value rules of a data frame library:
the sum of nothing is 0, the mean of nothing is missing, null group keys drop out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AggFunc = Union[str, Callable[[Column], Column]]
# (source column, function) or, for first/last, (source column, function, order column)
AggSpec = Sequence[AggFunc]


def _is_decimal(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.DecimalType)


def _number(df: DataFrame, name: str) -> Column:
    """A boolean counts as 0/1, everything else as it is."""
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return F.col(name).cast("int")
    return F.col(name)


def exact_total(df: DataFrame, name: str) -> Column:
    """Sum in the column's own type (exact for decimals), 0 when there is nothing to add."""
    return F.coalesce(F.sum(_number(df, name)), F.lit(0))


def total(df: DataFrame, name: str) -> Column:
    """Sum for output: decimals are added exactly and then turned into double."""
    out = exact_total(df, name)
    return out.cast("double") if _is_decimal(df, name) else out


def mean(df: DataFrame, name: str) -> Column:
    """Exact sum over non-null count; null for no values."""
    return F.try_divide(F.sum(_number(df, name)).cast("double"), F.count(name).cast("double"))


def is_repeatable(df: DataFrame, spec: AggSpec) -> bool:
    """Whether the aggregate comes out the same whatever the order of the rows: exact arithmetic."""
    if callable(spec[1]) or spec[1] in ("std", "var"):
        return False
    exact = not isinstance(df.schema[spec[0]].dataType, (T.DoubleType, T.FloatType))
    return exact or spec[1] in ("count", "size", "nunique", "min", "max", "median")


def _order_column(func: str, spec: AggSpec) -> str:
    if len(spec) < 3:
        raise ValueError(f"'{func}' needs an order column: (source, '{func}', order)")
    return spec[2]


def agg_column(df: DataFrame, spec: AggSpec) -> Column:
    """The aggregate expression of one ``agg_map`` entry (``median`` is handled by the caller)."""
    source, func = spec[0], spec[1]
    if callable(func):
        return func(F.col(source))
    if func == "sum":
        return total(df, source)
    if func == "mean":
        return mean(df, source)
    if func == "count":
        return F.count(source)
    if func == "size":
        return F.count(F.lit(1))
    if func == "nunique":
        return F.countDistinct(source)
    if func == "min":
        return F.min(source)
    if func == "max":
        return F.max(source)
    if func == "std":
        return F.stddev_samp(source)
    if func == "var":
        return F.var_samp(source)
    if func == "first":
        return first_by(source, _order_column(func, spec))
    if func == "last":
        return last_by(source, _order_column(func, spec))
    raise ValueError(f"unknown aggregate {func!r}")


def first_by(source: str, order: str) -> Column:
    """First non-null value in the given order."""
    return F.min_by(source, F.when(F.col(source).isNotNull(), F.col(order)))


def last_by(source: str, order: str) -> Column:
    """Last non-null value in the given order."""
    return F.max_by(source, F.when(F.col(source).isNotNull(), F.col(order)))


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose group keys are all present."""
    for key in keys:
        df = df.filter(F.col(key).isNotNull())
    return df


def sums_and_distincts(
    df: DataFrame, keys: Sequence[str], sums: Sequence[Column], distincts: Mapping[str, str]
) -> DataFrame:
    """Sums and several distinct counts per key (or over everything), in one pass over the input.

    Spark expands each row once for the sums and once for every distinct count, and combines within the task, so
    what is shuffled is one row for each key and value; the input with its joins is read once.
    """
    counts = [F.countDistinct(source).alias(name) for name, source in distincts.items()]
    return df.groupBy(*keys).agg(*sums, *counts)


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both sides are present; null for a constant side."""
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_samp(px, py), F.stddev_samp(px) * F.stddev_samp(py))
