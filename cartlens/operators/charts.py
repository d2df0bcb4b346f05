"""The small tables that charts are drawn from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.functions.aggregates import drop_null_keys, mean
from cartlens.functions.scalars import as_list, nan_to_null, ratio
from cartlens.operators.ordered import exact_quantiles, sort_columns, top_rows
from cartlens.staging import stage


def top_n_by(
    df: DataFrame, value_col: str, n: int | None, ascending: bool = False, ties: Sequence[str] = ()
) -> DataFrame:
    """The ``n`` largest (or smallest) rows; missing values only fill up. ``ties`` break equal values."""
    if n is None:
        return df
    return top_rows(nan_to_null(df), [(value_col, ascending), *[(t, True) for t in ties]], n)


def bar_data(
    df: DataFrame, x: str, y: str, top_n: int | None = None, horizontal: bool = False
) -> DataFrame:
    """Rows of a bar chart: the top ``top_n`` by ``y``; a horizontal chart lists the largest last."""
    rows = top_n_by(df, y, top_n or None, ties=[x])
    return rows.orderBy(*sort_columns([(y, True), (x, True)])) if horizontal else rows


def to_long(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A one-row table of figures as ``(label, value)`` rows."""
    columns = list(columns or df.columns)
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "label", "value"
    )


def concentration_long(stats: DataFrame) -> DataFrame:
    """Concentration shares as ``(label, value)``, without the ratio that is no percentage."""
    return to_long(stats, [c for c in stats.columns if c != "pareto_ratio"])


def series_long(df: DataFrame, x: str, y_cols: str | Sequence[str], labels: Sequence[str] | None = None) -> DataFrame:
    """Several lines over one axis as ``(x, series, y)``; a month axis is written as ``yyyy-MM``."""
    y_cols = as_list(y_cols)
    labels = list(labels or y_cols)
    is_date = dict(df.dtypes)[x] == "date"
    axis = F.date_format(x, "yyyy-MM") if is_date else F.col(x).cast("string")
    wide = df.select(axis.alias("x"), *[F.col(y).cast("double").alias(name) for y, name in zip(y_cols, labels)])
    return wide.unpivot("x", labels, "series", "y")


def combo_data(df: DataFrame, x: str, bar_col: str, line_col: str) -> DataFrame:
    """One bar and one line column over a common axis."""
    return df.select(x, bar_col, line_col)


def pareto_flagged(pareto: DataFrame, limit: float = 80.0) -> DataFrame:
    """A Pareto table with ``within_80``: the cumulative share has not passed the reference line."""
    return pareto.withColumn("within_80", F.col("cumulative_share_pct") <= F.lit(limit))


def ols_trend(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Least-squares line of ``y`` on ``x``, one per colour group: slope, intercept, r2, points."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    rows = df.filter(both).withColumns({"_x": F.col(x).cast("double"), "_y": F.col(y).cast("double")})
    if color:
        rows = drop_null_keys(rows, [color])
    keys = [color] if color else []
    return rows.groupBy(*keys).agg(
        F.regr_slope("_y", "_x").alias("slope"),
        F.regr_intercept("_y", "_x").alias("intercept"),
        F.regr_r2("_y", "_x").alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )


def histogram(df: DataFrame, value_col: str, bins: int = 40) -> DataFrame:
    """Equal-width bins between the smallest and largest value: ``bin``, its bounds and ``count``."""
    rows = nan_to_null(df.select(F.col(value_col).cast("double").alias("v"))).filter(F.col("v").isNotNull())
    span = F.broadcast(rows.agg(F.min("v").alias("_lo"), F.max("v").alias("_hi")))
    lo, hi = F.col("_lo"), F.col("_hi")
    # The largest value would fall behind the last bin; one value for all has no width to cut.
    raw = F.when(lo == hi, F.lit(1)).otherwise(F.least(F.width_bucket("v", lo, hi, F.lit(bins)), F.lit(bins)))
    step = (hi - lo) / F.lit(float(bins))
    binned = rows.crossJoin(span).withColumn("bin", raw.cast("long"))
    return (
        binned.groupBy("bin", "_lo", "_hi")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            "bin",
            (lo + (F.col("bin") - 1) * step).alias("bin_start"),
            F.when(lo == hi, hi).otherwise(lo + F.col("bin") * step).alias("bin_end"),
            "count",
        )
        .orderBy("bin")
    )


def box_summary(df: DataFrame, value_col: str) -> DataFrame:
    """One row: quartiles, 1.5 IQR fences, the whisker ends inside them and the count of outliers."""
    rows = nan_to_null(df.select(F.col(value_col).cast("double").alias("v"))).filter(F.col("v").isNotNull())
    rows = stage(rows, "box")
    quartiles = F.broadcast(
        exact_quantiles(
            rows, {"q1": ("v", 0.25), "median": ("v", 0.5), "q3": ("v", 0.75)}, repeatable=True
        ).select(
            "q1",
            "median",
            "q3",
            (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lower_fence"),
            (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("upper_fence"),
        )
    )
    inside = (F.col("v") >= F.col("lower_fence")) & (F.col("v") <= F.col("upper_fence"))
    counted = rows.crossJoin(quartiles).agg(
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(inside, 0).otherwise(1)), F.lit(0)).alias("outliers"),
        F.count("v").alias("n"),
    )
    return quartiles.crossJoin(F.broadcast(counted))


def treemap_rollup(
    df: DataFrame, path_cols: Sequence[str], value_col: str, color_col: str | None = None
) -> DataFrame:
    """Totals of every level of a hierarchy: ``level`` 0 is the root, ``share`` is the part of the root.

    ``color`` is the mean of ``color_col`` weighted by the value.
    """
    path = list(path_cols)
    rows = drop_null_keys(df, path)
    # Leaves first: the rollup then multiplies one row per leaf and not one per input row.
    aggs = [F.sum(value_col).alias("value")]
    if color_col:
        value, color = F.col(value_col).cast("double"), F.col(color_col).cast("double")
        aggs += [
            F.sum(color * value).alias("_weighted"),
            F.sum(F.when(color.isNotNull(), value)).alias("_weights"),
        ]
    leaves = stage(rows.groupBy(*path).agg(*aggs), "leaves")
    sums = [F.sum(c).alias(c) for c in leaves.columns if c not in path]
    # grouping_id has one bit per rolled-up column, so depth = path length - number of set bits.
    depth = (F.lit(len(path)) - F.bit_count(F.grouping_id())).cast("long").alias("level")
    levels = leaves.rollup(*path).agg(depth, *sums)
    root = F.broadcast(leaves.agg(F.sum("value").alias("_root")))
    return levels.crossJoin(root).select(
        "level",
        *path,
        F.col("value").cast("double").alias("value"),
        ratio(F.col("value"), F.col("_root")).alias("share"),
        *([ratio(F.col("_weighted"), F.col("_weights")).alias("color")] if color_col else []),
    )


def heatmap_cells(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Mean of ``z`` per cell, one row for each (y, x): any number of values on both sides."""
    rows = drop_null_keys(df, [x, y])
    return rows.groupBy(y, x).agg(mean(rows, z).alias(z))


def heatmap_pivot(df: DataFrame, x: str, y: str, z: str, x_values: Sequence) -> DataFrame:
    """``heatmap_cells`` as ``y`` rows and one column for each of the given ``x`` values."""
    rows = drop_null_keys(df, [x, y])
    return rows.groupBy(y).pivot(x, list(x_values)).agg(mean(rows, z)).orderBy(y)


def quadrants(df: DataFrame, x: str, y: str) -> DataFrame:
    """Label every row by its side of the medians: ``high_high``, ``high_low``, ... (x first)."""
    rows = stage(df, "quadrants")
    medians = F.broadcast(
        exact_quantiles(rows, {"median_x": (x, 0.5), "median_y": (y, 0.5)}, repeatable=True)
    )

    def side(column: str, median: str):
        return F.when(F.col(column) >= F.col(median), "high").otherwise("low")

    label = F.when(
        F.col(x).isNotNull() & F.col(y).isNotNull(),
        F.concat_ws("_", side(x, "median_x"), side(y, "median_y")),
    )
    return rows.crossJoin(medians).withColumn("quadrant", label)
