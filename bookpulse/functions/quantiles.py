"""Exact quantiles of any number of rows.

``percentile`` keeps every distinct value in one aggregation buffer, which does not
survive a billion clients. Here a sketch only proposes a narrow bracket around each
wanted rank; exact counts decide whether the rank lies below, on, inside or above it.
Rounds repeat until the rows inside a bracket fit a stated bound, and only those rows
are ever brought together. A value held by a third of all rows costs nothing: a rank on
a bracket end is answered by counting.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookpulse.session import stage

SMALL = 100_000      # rows inside a bracket that may be sorted in one buffer
ACCURACY = 10_000    # of the proposing sketch; wrong proposals cost a round, not the result
MARGIN = 2.0 / ACCURACY


Values = dict[tuple[str, int], float]


@dataclass
class _Bracket:
    """Open interval of one column that holds the rows of some wanted ranks (0-based)."""

    column: str
    ranks: list[int]
    rows: int
    below: int = 0
    low: float | None = None
    high: float | None = None

    def inside(self) -> Column:
        v = F.col(self.column)
        condition = v.isNotNull()
        if self.low is not None:
            condition &= v > F.lit(self.low)
        if self.high is not None:
            condition &= v < F.lit(self.high)
        return condition

    def proposals(self) -> list[float]:
        """Shares of the rows inside at which the sketch is asked for a value."""
        around = [(r - self.below) / max(self.rows - 1, 1) for r in self.ranks]
        ends = [a + side * MARGIN for a in around for side in (-1, 1)]
        return sorted({round(min(max(e, 0.0), 1.0), 5) for e in ends})

    def split(self, cuts: Sequence[float], counts: Sequence[tuple[int, int]], values: Values) -> list[_Bracket]:
        """Ranks on a cut are answered; the others go on in the intervals between cuts.

        ``counts`` holds the rows inside that lie below each cut, and below or on it.
        """
        parts: dict[int, _Bracket] = {}
        for rank in self.ranks:
            i = next((i for i, (_, through) in enumerate(counts) if rank - self.below < through), len(cuts))
            if i < len(cuts) and rank - self.below >= counts[i][0]:
                values[self.column, rank] = cuts[i]
                continue
            passed = counts[i - 1][1] if i else 0
            low, high = (cuts[i - 1] if i else self.low), (cuts[i] if i < len(cuts) else self.high)
            until = counts[i][0] if i < len(cuts) else self.rows
            part = _Bracket(self.column, [], until - passed, self.below + passed, low, high)
            parts.setdefault(i, part).ranks.append(rank)
        return list(parts.values())


def _any_inside(brackets: Sequence[_Bracket]) -> Column:
    return reduce(or_, (b.inside() for b in brackets))


def _row(df: DataFrame, measures: list[Column], brackets: Sequence[_Bracket]) -> list:
    """One aggregate over the rows inside any of the brackets."""
    named = [m.alias(f"m{i}") for i, m in enumerate(measures)]
    return list(df.where(_any_inside(brackets)).agg(*named).first())


def _narrow(df: DataFrame, brackets: Sequence[_Bracket], values: Values) -> list[_Bracket]:
    sketches = [
        F.percentile_approx(F.when(b.inside(), F.col(b.column)), b.proposals(), ACCURACY) for b in brackets
    ]
    all_cuts = [sorted(set(cuts)) for cuts in _row(df, sketches, brackets)]
    measures = [
        F.count_if(b.inside() & condition)
        for b, cuts in zip(brackets, all_cuts)
        for cut in cuts
        for condition in (F.col(b.column) < cut, F.col(b.column) <= cut)
    ]
    counted = iter(_row(df, measures, brackets))
    parts: list[_Bracket] = []
    for b, cuts in zip(brackets, all_cuts):
        parts += b.split(cuts, [(next(counted), next(counted)) for _ in cuts], values)
    return parts


def _pick(df: DataFrame, brackets: Sequence[_Bracket], values: Values) -> None:
    sorted_rows = [F.sort_array(F.collect_list(F.when(b.inside(), F.col(b.column)))) for b in brackets]
    wanted = [
        F.array(*[F.get(rows, F.lit(r - b.below)) for r in b.ranks]) for b, rows in zip(brackets, sorted_rows)
    ]
    for b, found in zip(brackets, _row(df, wanted, brackets)):
        values.update({(b.column, r): v for r, v in zip(b.ranks, found)})


def exact_quantiles(
    df: DataFrame, wanted: Mapping[str, Sequence[float]], small: int = SMALL
) -> dict[str, list[float] | None]:
    """Linear-interpolation quantiles per column; ``None`` for a column without values.

    Scans ``df`` a few times: pass a written table. Only scalars reach the driver.
    """
    df = df.select(*[F.col(c).cast("double").alias(c) for c in wanted])
    totals = df.agg(*[F.count(c).alias(c) for c in wanted]).first()
    values: Values = {}
    open_ = []
    for column, probabilities in wanted.items():
        n = totals[column]
        positions = [math.floor(p * (n - 1)) for p in probabilities]
        ranks = {min(position + step, n - 1) for position in positions for step in (0, 1)}
        if n:
            open_.append(_Bracket(column, sorted(ranks), n))

    rows = sum(totals)
    while wide := [b for b in open_ if b.rows > small]:
        open_ = [b for b in open_ if b.rows <= small] + _narrow(df, wide, values)
        # Once the brackets hold a small share of the rows, later rounds read only those.
        held = sum(b.rows for b in open_)
        if 0 < held < rows / 10:
            df, rows = stage(df.where(_any_inside(open_)), "brackets"), held
    if open_:
        _pick(df, open_, values)

    return {
        column: [_between(values, column, p * (totals[column] - 1), totals[column]) for p in probabilities]
        if totals[column] else None
        for column, probabilities in wanted.items()
    }


def _between(values: Values, column: str, position: float, n: int) -> float:
    first = math.floor(position)
    low, high = values[column, first], values[column, min(first + 1, n - 1)]
    share = position - first
    # Measured from the nearer end, which keeps the result exact at both.
    return low + (high - low) * share if share < 0.5 else high - (high - low) * (1 - share)


def bucket(value: Column, edges: Sequence[float] | None, buckets: int, ascending: bool = True) -> Column:
    """Right-closed quantile bucket 1..``buckets`` of ``value``.

    Repeated edges count once, the lowest value belongs to bucket 1, and a missing value
    or a column with one distinct value lands in bucket 2.
    """
    distinct = sorted(set(edges or ()))
    if len(distinct) < 2:
        number = F.lit(2)
    else:
        passed = sum((F.when(value > F.lit(e), 1).otherwise(0) for e in distinct[1:]), F.lit(0))
        passed = F.least(passed + F.lit(1), F.lit(len(distinct) - 1))
        number = F.when(value.isNull(), F.lit(2)).otherwise(passed)
    return number if ascending else F.lit(buckets + 1) - number
