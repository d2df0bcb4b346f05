"""Global ranks, running sums and exact quantiles without a one-task window.

A window without partition keys sorts the whole input in one task. Here the input is range-partitioned on
the full sort key (value first, then the tie-break, so that equal values can be cut apart), written once
together with its partition number, and every number that depends on earlier rows is split in two: what the
earlier partitions contribute (one small row per partition) and what the rows of the same partition
contribute. Row numbers inside a partition come from writing it sorted, so a rank needs no second shuffle;
running sums and dense ranks take a window keyed by the partition.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.functions.aggregates import drop_null_keys
from cartlens.functions.scalars import as_list
from cartlens.operators.selection import count_values, order_statistics
from cartlens.staging import stage

PART = "_range_part"
LOCAL = "_range_row"
# monotonically_increasing_id: partition number above, row number below this bit.
LOCAL_BITS = 33
# The largest cut that every task sends whole to one merging task.
MERGED_ROWS = 1_000

Order = Sequence[tuple[str, bool]]  # (column, ascending); missing values always last


def sort_columns(order: Order) -> list[Column]:
    """Sort expressions with missing values last in both directions."""
    return [F.asc_nulls_last(name) if asc else F.desc_nulls_last(name) for name, asc in order]


def _floating(df: DataFrame, names: Sequence[str]) -> bool:
    return any(isinstance(df.schema[n].dataType, (T.DoubleType, T.FloatType)) for n in names)


def ordered_scan(
    df: DataFrame,
    order: Order,
    *,
    within: Sequence[str] = (),
    row: str | None = None,
    dense: str | None = None,
    running: Mapping[str, str] | None = None,
    totals: Mapping[str, str] | None = None,
    rows_total: str | None = None,
    carry: Mapping[str, str] | None = None,
    few_groups: bool = False,
    repeatable: bool | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Number and accumulate rows in a global order (or in an order per ``within`` group).

    ``row`` names the ordinal 1..n, ``dense`` the dense rank on the first order column, ``running`` maps
    columns to running sums (missing values are skipped but keep their hole), ``totals`` maps columns to
    the sum over the group, ``rows_total`` names the group's row count, ``carry`` maps columns to their last
    present value. ``few_groups`` promises that the ``within`` groups are a handful fixed by the caller.
    ``repeatable`` says that recomputing ``df`` gives the very same sort keys; floating-point
    keys are taken not to be, and are then written once before they decide which partition a row belongs to.
    Rows with a missing group key drop out.
    """
    within = list(within)
    df = drop_null_keys(df, within)
    running, totals, carry = dict(running or {}), dict(totals or {}), dict(carry or {})
    if repeatable is None:
        repeatable = not _floating(df, [name for name, _ in order])
    if not repeatable:
        df = stage(df, "input")
    sort = sort_columns(order)
    columns = df.columns

    # Without a number AQE merges neighbouring ranges up to its advisory size: small inputs become a few
    # files, large ones keep spark.sql.shuffle.partitions ranges.
    keys = [*[F.asc(k) for k in within], *sort]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    by_window = bool(running or dense or carry)
    if row and not by_window:
        ranged = ranged.sortWithinPartitions(*keys).withColumn("_position", F.monotonically_increasing_id())
        part = F.shiftright("_position", LOCAL_BITS).cast("int")
        local_row = F.col("_position").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
        ranged = ranged.select(*columns, part.alias(PART), local_row.alias(LOCAL))
    else:
        ranged = ranged.withColumn(PART, F.spark_partition_id())
    ranged = stage(ranged, "ranged")

    # What each partition holds: at most one row per partition, or per group and partition.
    head, ascending = order[0]
    per_part = [F.count(F.lit(1)).alias("_rows")]
    if LOCAL in ranged.columns:
        per_part.append(F.min(LOCAL).alias("_first_row"))
    for name in {**running, **totals}:
        per_part.append(F.coalesce(F.sum(name), F.lit(0)).alias(f"_sum_{name}"))
    if dense:
        # A missing value is a value of its own, behind all others.
        lo, hi, missing = F.min(head), F.max(head), F.max(F.col(head).isNull())
        per_part += [
            (F.countDistinct(head) + missing.cast("long")).alias("_values"),
            (lo if ascending else hi).alias("_first"),
            F.when(~missing, hi if ascending else lo).alias("_last"),
        ]
    for name in carry:
        if not all(asc for _, asc in order):
            raise ValueError("carry needs an ascending order")
        key = F.when(F.col(name).isNotNull(), F.struct(*[F.col(c) for c, _ in order]))
        per_part.append(F.max_by(name, key).alias(f"_tail_{name}"))
    parts = ranged.groupBy(*within, PART).agg(*per_part)

    by_part = Window.partitionBy(*within).orderBy(PART)
    earlier = by_part.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*within)
    offsets = [F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before")]
    if LOCAL in ranged.columns:
        offsets.append(F.col("_first_row"))
    if rows_total:
        offsets.append(F.sum("_rows").over(everything).alias(rows_total))
    for name in running:
        offsets.append(F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_off_{name}"))
    for name, alias in totals.items():
        offsets.append(F.sum(f"_sum_{name}").over(everything).alias(alias))
    if dense:
        # A value cut by a partition boundary was counted on both sides.
        behind = F.lag(F.lit(True)).over(by_part).isNotNull()
        same = F.lag("_last").over(by_part).eqNullSafe(F.col("_first"))
        parts = parts.withColumn("_shared", (behind & same).cast("long"))
        upto = by_part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        offsets.append(
            (
                F.coalesce(F.sum("_values").over(earlier), F.lit(0)) - F.sum("_shared").over(upto)
            ).alias("_values_before")
        )
    for name in carry:
        offsets.append(F.last(f"_tail_{name}", ignorenulls=True).over(earlier).alias(f"_off_tail_{name}"))
    offsets_df = parts.select(*within, PART, *offsets)
    if few_groups or not within:
        offsets_df = F.broadcast(offsets_df)  # at most (range partitions + groups) rows

    local = Window.partitionBy(PART, *within).orderBy(*sort)
    so_far = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(offsets_df, [*within, PART])
    added: list[Column] = []
    if row:
        in_part = F.row_number().over(local) if by_window else F.col(LOCAL) - F.col("_first_row") + 1
        added.append((in_part + F.col("_rows_before")).cast("long").alias(row))
    if dense:
        by_value = Window.partitionBy(PART, *within).orderBy(sort[0])
        added.append((F.dense_rank().over(by_value) + F.col("_values_before")).cast("long").alias(dense))
    for name, alias in running.items():
        summed = F.coalesce(F.sum(name).over(so_far), F.lit(0)) + F.col(f"_off_{name}")
        added.append(F.when(F.col(name).isNotNull(), summed).alias(alias))
    for name, alias in carry.items():
        last = F.coalesce(F.last(name, ignorenulls=True).over(so_far), F.col(f"_off_tail_{name}"))
        added.append(last.alias(alias))
    kept = [*totals.values(), *([rows_total] if rows_total else [])]
    return out.select(*columns, *kept, *added)


def global_rank(
    df: DataFrame, order: Order, name: str = "rank", repeatable: bool | None = None
) -> DataFrame:
    """Add the ordinal rank 1..n in the given order."""
    return ordered_scan(df, order, row=name, repeatable=repeatable)


def _as_double(df: DataFrame, name: str) -> Column | None:
    """A double that never turns the order of a column round (it may make neighbours equal), or None."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name).cast("double")
    return None


def _up_to_cut(df: DataFrame, order: Order, n: int) -> DataFrame:
    """Without the rows that the first order column alone puts behind the first ``n``."""
    name, ascending = order[0]
    key = _as_double(df, name)
    if key is None:
        return df
    keys = df.select(key.alias("key"))
    counts = count_values(keys)
    present = sum(counts["key"])
    if n >= present:
        return df
    rank = n - 1 if ascending else present - n
    cut = F.lit(order_statistics(keys, [("key", rank)], counts)["key", rank])
    return df.filter(key <= cut if ascending else key >= cut)


def numbered_top(df: DataFrame, order: Order, n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows with their ordinal rank, for any ``n``.

    The value at rank ``n`` is found by selection, the rows behind it are dropped where they are read, and only what
    is left (the ``n`` rows and the ties of the last value) is ranged and numbered.
    """
    if n <= 0:
        return df.limit(0).withColumn(name, F.lit(0).cast("long"))
    if n <= MERGED_ROWS:
        return global_rank(_merged_top(df, order, n), order, name)
    kept = _up_to_cut(stage(df, "top"), order, n)
    return global_rank(kept, order, name, repeatable=True).filter(F.col(name) <= n)


def _merged_top(df: DataFrame, order: Order, n: int) -> DataFrame:
    return df.orderBy(*sort_columns(order)).limit(n)


def top_rows(df: DataFrame, order: Order, n: int) -> DataFrame:
    """The first ``n`` rows of an order.

    Up to ``MERGED_ROWS`` every task sends its first ``n`` rows to one merge. More than that would be too much for
    one task: the cut is then selected, and what it leaves is sorted in ranges.
    """
    if n <= MERGED_ROWS:
        return _merged_top(df, order, max(n, 0))
    return numbered_top(df, order, n, "_top").orderBy("_top").drop("_top")


def surrogate_key(df: DataFrame, order_cols: str | Sequence[str], name: str) -> DataFrame:
    """Dense key 1..n in the order of ``order_cols`` (list enough of them to make the order total)."""
    order = [(c, True) for c in as_list(order_cols)]
    keyed = ordered_scan(df, order, row=name, repeatable=True)
    return keyed.select(name, *df.columns)


def exact_quantiles(
    df: DataFrame,
    wanted: Mapping[str, tuple[str, float]],
    by: Sequence[str] = (),
    repeatable: bool | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, as one row (or one row per ``by`` group).

    ``wanted`` maps an output name to (column, probability). Over everything the ranks are found by selection:
    the values are neither sorted nor shuffled. Per group, equal values are counted before the sort, so a value or
    group that holds a large part of all rows is one entry; the running count is distributed. ``repeatable`` says
    that ``df`` reads the same every time; otherwise the columns alone are written once.
    """
    return _grouped_quantiles(df, wanted, list(by), repeatable) if by else _selected_quantiles(df, wanted, repeatable)


def _selected_quantiles(
    df: DataFrame, wanted: Mapping[str, tuple[str, float]], repeatable: bool | None
) -> DataFrame:
    columns = list(dict.fromkeys(col for col, _ in wanted.values()))
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    if not repeatable:
        values = stage(values, "values")
    counts = count_values(values)
    at = {name: (col, (sum(counts[col]) - 1) * float(p)) for name, (col, p) in wanted.items() if sum(counts[col])}
    ranks = [(col, side(place)) for col, place in at.values() for side in (math.floor, math.ceil)]
    found = order_statistics(values, ranks, counts)
    row = []
    for name in wanted:
        value = None
        if name in at:
            col, place = at[name]
            low, high = found[col, math.floor(place)], found[col, math.ceil(place)]
            value = low if low == high else low + (high - low) * (place - math.floor(place))
        row.append(F.lit(value).cast("double").alias(name))
    return df.sparkSession.range(0, 1, 1, 1).select(*row)


def _grouped_quantiles(
    df: DataFrame, wanted: Mapping[str, tuple[str, float]], by: list[str], repeatable: bool | None
) -> DataFrame:
    columns = list(dict.fromkeys(col for col, _ in wanted.values()))
    if repeatable is None:
        repeatable = not _floating(df, columns)
    pairs = F.array(
        *[F.struct(F.lit(i).alias("metric"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)]
    )
    counts = (
        df.select(*by, F.explode(pairs).alias("_p"))
        .select(*by, "_p.metric", "_p.value")
        .filter(F.col("value").isNotNull())
        .groupBy(*by, "metric", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    scan = ordered_scan(
        counts,
        [("value", True)],
        within=[*by, "metric"],
        running={"n": "upto"},
        totals={"n": "all_rows"},
        repeatable=repeatable,
    )
    picks: list[Column] = []
    finals: list[Column] = []
    for name, (column, p) in wanted.items():
        at = (F.col("all_rows") - 1) * F.lit(float(p))
        mine = F.col("metric") == columns.index(column)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = mine & (rank >= F.col("upto") - F.col("n")) & (rank < F.col("upto"))
            picks.append(F.max(F.when(here, F.col("value"))).alias(f"{name}_{side}"))
        picks.append(F.max(F.when(mine, at - F.floor(at))).alias(f"{name}_frac"))
        finals.append(
            (
                F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * F.col(f"{name}_frac")
            ).alias(name)
        )
    return scan.groupBy(*by).agg(*picks).select(*by, *finals)
