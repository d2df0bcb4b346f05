"""Order statistics by selection: the value at a rank without sorting or shuffling the values.

A sketch proposes two values that bracket the wanted rank, one exact count says where the rank really lies (below,
on, between or above them), and the search goes on with the values of that part alone. The sketch only steers: every
step is decided by counts, so the result is exact for any distribution. A value that holds most rows is met as one
of the two ends and never has to be cut. What a step sends is a sketch or a few counts a task; only when at most
``GATHERED`` values are left are they sorted together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.staging import stage

#: Values between the ends that are sorted in one task at the end (8 bytes each).
GATHERED = 100_000
#: A sketch of accuracy a is off by at most one in a of its rows, so a bracket keeps about four in a.
ACCURACY = 10_000

Rank = tuple[str, int]  # (column, rank from 0)


@dataclass
class _Search:
    """Where one rank is looked for: strictly between ``low`` and ``high``, ``below`` values before that part."""

    column: str
    rank: int
    size: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    value: float | None = None

    @property
    def found(self) -> bool:
        return self.value is not None

    def inside(self) -> Column:
        held = F.col(self.column).isNotNull() & ~F.isnan(self.column)
        if self.low is not None:
            held = held & (F.col(self.column) > F.lit(self.low))
        if self.high is not None:
            held = held & (F.col(self.column) < F.lit(self.high))
        return held

    def values(self) -> Column:
        return F.when(self.inside(), F.col(self.column))

    def bracket(self, accuracy: int) -> Column:
        at = (self.rank - self.below) / self.size
        ends = [max(0.0, at - 2 / accuracy), min(1.0, at + 2 / accuracy)]
        return F.percentile_approx(self.values(), ends, accuracy)

    def counts(self, ends: Sequence[float]) -> Column:
        value, (a, b) = self.values(), [F.lit(e) for e in ends]
        tests = [value < a, value == a, (value > a) & (value < b), (value == b) & (a < b), value > b]
        return F.array(*[F.count_if(test) for test in tests])

    def narrow(self, ends: Sequence[float], counts: Sequence[int]) -> None:
        parts = [(self.low, ends[0]), ends[0], (ends[0], ends[1]), ends[1], (ends[1], self.high)]
        for part, size in zip(parts, counts, strict=True):
            if self.rank < self.below + size:
                if isinstance(part, tuple):
                    self.low, self.high, self.size = *part, size
                else:
                    self.value = part
                return
            self.below += size
        raise RuntimeError("the input changed between two passes: pass a table that reads the same every time")


def _figures(df: DataFrame, columns: Sequence[Column]) -> list:
    return list(df.agg(*[c.alias(f"f{i}") for i, c in enumerate(columns)]).first())


def count_values(values: DataFrame) -> dict[str, tuple[int, int]]:
    """Column to (numbers, NaN), nulls not counted; the columns are doubles."""
    columns = [f for c in values.columns for f in (F.count(c), F.count_if(F.isnan(c)))]
    got = _figures(values, columns)
    return {c: (got[2 * i] - got[2 * i + 1], got[2 * i + 1]) for i, c in enumerate(values.columns)}


def order_statistics(
    values: DataFrame,
    ranks: Sequence[Rank],
    counts: Mapping[str, tuple[int, int]],
    gathered: int = GATHERED,
    accuracy: int = ACCURACY,
) -> dict[Rank, float]:
    """The value at each rank of a column in ascending order; nulls are left out, NaN stands behind all numbers.

    ``values`` holds double columns and must read the same on every pass (a written table); ``counts`` are those
    of ``count_values``. A rank outside the column is an error.
    """
    searches, result = [], {}
    for column, rank in dict.fromkeys(ranks):
        numbers, nans = counts[column]
        if not 0 <= rank < numbers + nans:
            raise ValueError(f"{column} has {numbers + nans} values, there is no rank {rank}")
        if rank >= numbers:
            result[column, rank] = float("nan")
        else:
            searches.append(_Search(column, rank, numbers))
    wide = [s for s in searches if s.size > gathered]
    while wide:
        ends = _figures(values, [s.bracket(accuracy) for s in wide])
        sizes = _figures(values, [s.counts(e) for s, e in zip(wide, ends, strict=True)])
        for search, end, size in zip(wide, ends, sizes, strict=True):
            search.narrow(end, size)
        still_open = [s for s in searches if not s.found]
        wide = [s for s in still_open if s.size > gathered]
        if still_open:
            # The next passes read only what is still between the ends of a search.
            held = still_open[0].inside()
            for search in still_open[1:]:
                held = held | search.inside()
            values = stage(values.filter(held), "narrowed")
    last = [s for s in searches if not s.found]
    if last:
        picks = [
            F.get(F.array_sort(F.collect_list(s.values())), F.lit(s.rank - s.below)) for s in last
        ]
        for search, value in zip(last, _figures(values, picks), strict=True):
            search.value = value
    return {**result, **{(s.column, s.rank): s.value for s in searches}}
