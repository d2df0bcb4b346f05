"""Monthly series, growth rates, rolling means and the ranking of months."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.functions.aggregates import drop_null_keys
from cartlens.functions.scalars import as_list, month, ratio
from cartlens.operators.ordered import ordered_scan, sort_columns
from cartlens.operators.revenue import group_aggregate

BLOCK_ROWS = 65_536


def compute_monthly_series(
    df: DataFrame,
    date_col: str,
    value_col: str,
    agg: str = "sum",
    additional_cols: Sequence[str] | None = None,
    within: str | Sequence[str] = (),
) -> DataFrame:
    """One row per month that has rows: ``period`` (first of month) and the aggregated columns.

    ``within`` names columns whose groups are series of their own; they come first.
    """
    columns = [value_col, *(additional_cols or [])]
    monthly = df.withColumn("period", month(df, date_col))
    keys = [*as_list(within), "period"]
    return group_aggregate(monthly, keys, {c: (c, agg) for c in columns}).orderBy(*keys)


def _row_blocks(df: DataFrame, row: str, back: int, block_rows: int) -> DataFrame:
    """Cut numbered rows into blocks; each block also gets the ``back`` rows before it."""
    size = max(block_rows, back, 1)
    home = F.floor((F.col(row) - 1) / F.lit(size)).cast("long")
    last_rows = (F.col(row) - 1) % F.lit(size) >= size - back
    blocks = F.when(last_rows, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumn("_home", home).withColumn("_block", F.explode(blocks))


def _backward_window(
    df: DataFrame,
    order_col: str,
    within: Sequence[str],
    name: str,
    add,
    back: int,
    calendar: bool,
    carry: dict[str, str],
    block_rows: int,
) -> DataFrame:
    """Add a column that looks at most ``back`` rows back in the order of ``order_col``, per ``within`` group.

    A series of calendar periods is short and takes one window. Any other series is numbered by the
    distributed scan (``_row``) and cut into blocks that overlap by ``back`` rows, so a group that holds most rows is
    many blocks. ``add(rows, keys, sort)`` adds the column, one series for each of ``keys`` in the order ``sort``.
    ``carry`` columns are kept only where it needs them. Rows with a missing group key drop out.
    """
    within = list(within)
    order = [(order_col, True)]
    columns = df.columns
    if calendar:
        df = drop_null_keys(df, within)
        window = Window.partitionBy(*within).orderBy(*sort_columns(order))
        so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        for source, alias in carry.items():
            df = df.withColumn(alias, F.last(source, ignorenulls=True).over(so_far))
        return add(df, within, F.asc_nulls_last(order_col)).select(*columns, name)
    numbered = ordered_scan(df, order, within=within, row="_row", carry=carry)
    # One shuffle by block serves every window that follows.
    keys = [*within, "_block"]
    blocks = _row_blocks(numbered, "_row", back, block_rows).repartition(*keys)
    return add(blocks, keys, F.asc("_row")).filter(F.col("_block") == F.col("_home")).select(*columns, name)


def compute_growth_rate(
    df: DataFrame,
    value_col: str,
    order_col: str,
    periods: int = 1,
    fill: str = "none",
    name: str = "growth_rate",
    calendar: bool = False,
    block_rows: int = BLOCK_ROWS,
    within: str | Sequence[str] = (),
) -> DataFrame:
    """Percentage change against the row ``periods`` earlier; null for the first rows and on division by 0.

    ``fill="pad"`` puts the last present value in place of missing ones first. ``calendar=True`` promises one
    row per calendar period (a monthly series), which one window handles. ``within`` names columns whose groups
    are series of their own.
    """
    if fill not in ("none", "pad"):
        raise ValueError("fill must be 'none' or 'pad'")
    if periods < 1:
        raise ValueError("periods must be positive")
    source = "_filled" if fill == "pad" else value_col

    def change(rows: DataFrame, keys: Sequence[str], sort: Column) -> DataFrame:
        earlier = F.lag(source, periods).over(Window.partitionBy(*keys).orderBy(sort))
        return rows.withColumn(name, (ratio(F.col(source), earlier) - 1) * 100)

    carry = {value_col: "_filled"} if fill == "pad" else {}
    return _backward_window(df, order_col, as_list(within), name, change, periods, calendar, carry, block_rows)


def sliding_sums(df: DataFrame, keys: Sequence[str], row: str, window: int, sums: Mapping[str, Column]) -> DataFrame:
    """Sums over the last ``window`` of numbered rows (``row``), at a cost that does not depend on ``window``.

    Rows are cut into runs of ``window`` rows. The last ``window`` rows are the end of one run and the beginning of the
    next, so a sliding sum is one running sum backwards plus one forwards. Unlike a difference of running sums it
    subtracts nothing: small values behind large ones, infinities and NaN come out as in a direct sum.
    """
    df = df.withColumns({f"_in_{alias}": value for alias, value in sums.items()})
    df = df.withColumn("_run", F.floor((F.col(row) - 1) / F.lit(window)).cast("long"))
    here = Window.partitionBy(*keys, "_run")
    forward = here.orderBy(F.asc(row)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    backward = here.orderBy(F.desc(row)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(row)
    df = df.withColumns({f"_end_{a}": F.sum(f"_in_{a}").over(backward) for a in sums})
    df = df.withColumns({f"_start_{a}": F.sum(f"_in_{a}").over(forward) for a in sums})
    # The last row of a run sees that run alone.
    whole = F.col(row) % F.lit(window) == 0
    out = {}
    for alias in sums:
        earlier = F.when(~whole, F.lag(f"_end_{alias}", window - 1).over(before)) if window > 1 else F.lit(None)
        start = F.col(f"_start_{alias}")
        out[alias] = F.coalesce(earlier + start, start, earlier)
    return df.withColumns(out).drop("_run", *[f"_{part}_{a}" for part in ("in", "end", "start") for a in sums])


def compute_rolling_avg(
    df: DataFrame,
    value_col: str,
    order_col: str,
    window: int = 3,
    min_periods: int = 1,
    name: str = "rolling_avg",
    calendar: bool = False,
    block_rows: int = BLOCK_ROWS,
    within: str | Sequence[str] = (),
) -> DataFrame:
    """Mean of the present values among the last ``window`` rows; null for fewer than ``min_periods``.

    A wide window costs what a narrow one does. ``within`` names columns whose groups are series of their own.
    """
    if window < 1:
        raise ValueError("window must be positive")

    def rolled(rows: DataFrame, keys: Sequence[str], sort: Column) -> DataFrame:
        if calendar:
            frame = Window.partitionBy(*keys).orderBy(sort).rowsBetween(-(window - 1), Window.currentRow)
            figures = {"_sum": F.sum(value_col).over(frame), "_present": F.count(value_col).over(frame)}
            summed = rows.withColumns(figures)
        else:
            present = F.when(F.col(value_col).isNotNull(), 1).otherwise(0)
            summed = sliding_sums(rows, keys, "_row", window, {"_sum": F.col(value_col), "_present": present})
        mean_value = ratio(F.col("_sum"), F.col("_present"))
        return summed.withColumn(name, F.when(F.col("_present") >= F.lit(min_periods), mean_value))

    return _backward_window(df, order_col, as_list(within), name, rolled, window - 1, calendar, {}, block_rows)


def compute_monthly_revenue_rank(df: DataFrame, period_col: str, revenue_col: str) -> DataFrame:
    """Share of the total of all months given and ordinal rank; other columns are kept.

    The input has one row per month, so the window over it is short.
    """
    order = [(revenue_col, False), (period_col, True)]
    total_revenue = F.sum(revenue_col).over(Window.partitionBy())
    return df.select(
        *df.columns,
        (ratio(F.col(revenue_col), total_revenue) * 100).alias("revenue_contribution_pct"),
        F.row_number().over(Window.orderBy(*sort_columns(order))).cast("long").alias("rank"),
    )
