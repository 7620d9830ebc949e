"""Running totals over groups of any size.

A window over one group runs in one task, so a broker with a third of all clients, or a
ranking of all clients at once, would not fit. Here the rows are range-sorted over the
whole cluster and written; each sorted piece adds up its own rows, and the totals of the
pieces before it (one row per group and piece) are added on top.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookpulse.session import stage

_POSITION, _PIECE = "_position", "_piece"


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], totals: Mapping[str, Column]
) -> DataFrame:
    """Add running sums (first row to current row) of ``totals`` per non-null ``keys``.

    ``order`` must be total within a group. Integer or decimal sums are exact.
    """
    keys, names = list(keys), list(totals)
    placed = stage(
        df.withColumns(dict(totals))
        .orderBy(*keys, *order)
        .withColumn(_POSITION, F.monotonically_increasing_id()),
        "sorted",
    ).withColumn(_PIECE, F.shiftright(_POSITION, 33))

    # At most one row per group and sorted piece: a group has no more rows here than the
    # sort had partitions.
    earlier = (
        Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ).orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*keys, _PIECE)
        .agg(*[F.sum(n).alias(n) for n in names])
        .select(*keys, _PIECE, *[F.sum(n).over(earlier).alias(f"_before_{n}") for n in names])
    )

    inside = (
        Window.partitionBy(*keys, _PIECE)
        .orderBy(_POSITION)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = placed.withColumns({n: F.sum(n).over(inside) for n in names})
    return (
        summed.join(offsets, [*keys, _PIECE])
        .withColumns({n: F.col(n) + F.coalesce(F.col(f"_before_{n}"), F.lit(0)) for n in names})
        .drop(_POSITION, _PIECE, *[f"_before_{n}" for n in names])
    )


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Number the rows of each group from 1 in ``order``."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("bigint")})
