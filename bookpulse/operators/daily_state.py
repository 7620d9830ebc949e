"""Client features at any number of midnights, from a state of one row per client and day.

The state holds sums, counts and a day's latest time, all of which add up: over days, over
tables, over late rows. ``features_at`` reads it once. Its days are first put together between
the days on which some window of some cutoff begins or ends; the few rows that are left per
client then go to the cutoffs after them. Transactions are not read again, neither for another
cutoff nor after another day.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookpulse import schemas
from bookpulse.fixed_values import RECENT_DAYS, TREND_WEEKS
from bookpulse.functions.numbers import finite, halves, joined, parts
from bookpulse.operators import client_features as cf

AMOUNTS = ("volume_usd", "spread_bps", "minimum_spread")
_LIMBS = [f"{name}_{k}" for name in AMOUNTS for k in range(5)]
_HOURS = [f"h{h}" for h in range(24)]
#: What is added up; ``last`` is the latest time in epoch microseconds.
SUMS = ["dated", "valid", "spreads", "minimums", *_LIMBS, *_HOURS]


def _totals(columns: Iterable[str] = SUMS) -> list[Column]:
    return [F.sum(c).alias(c) for c in columns]


def _dated(tx: DataFrame) -> DataFrame:
    return tx.where(F.col("balance_owner_uuid").isNotNull() & F.col("trigger_at_dt").isNotNull())


def daily_state(tx: DataFrame) -> DataFrame:
    """One row per client and day with a dated transaction: one hash aggregate of numbers."""
    valid = F.col("is_valid_completed")
    rows = _dated(tx).select(
        F.col("balance_owner_uuid").alias("client_id"), F.to_date("trigger_at_dt").alias("day"),
        F.unix_micros("trigger_at_dt").alias("at"), F.hour("trigger_at_dt").alias("hour"), valid.alias("valid"),
        *[F.when(valid, finite(F.col(c))).alias(c) for c in AMOUNTS],
    )
    split = {f"{c}_{k}": half for c in AMOUNTS for k, half in zip("wfb", halves(F.col(c)))}
    limbs = {f"{c}_{k}": part for c in AMOUNTS for k, part in enumerate(parts(*[F.col(f"{c}_{h}") for h in "wfb"]))}
    return rows.withColumns(split).withColumns(limbs).groupBy("client_id", "day").agg(
        F.max("at").alias("last"), F.count(F.lit(1)).alias("dated"), F.count_if("valid").alias("valid"),
        F.count("spread_bps").alias("spreads"), F.count("minimum_spread").alias("minimums"), *_totals(_LIMBS),
        *[F.count_if(F.col("hour") == h).alias(f"h{h}") for h in range(24)],
    )


def daily_names(tx: DataFrame) -> DataFrame:
    """Rows and first time per client, combination of names, and day."""
    return _dated(tx).groupBy(
        F.col("balance_owner_uuid").alias("client_id"), F.to_date("trigger_at_dt").alias("day"),
        *[F.col(f"{c}_clean").alias(c) for c in cf.NAMES],
    ).agg(F.count(F.lit(1)).alias("rows"), F.min(F.unix_micros("trigger_at_dt")).alias("first"))


def merged_state(*states: DataFrame) -> DataFrame:
    """The state of all transactions of several states, days in any order, late rows included."""
    return _union(states).groupBy("client_id", "day").agg(F.max("last").alias("last"), *_totals())


def merged_names(*states: DataFrame) -> DataFrame:
    return _union(states).groupBy("client_id", "day", *cf.NAMES).agg(
        F.sum("rows").alias("rows"), F.min("first").alias("first"))


def _union(states: Sequence[DataFrame]) -> DataFrame:
    whole = states[0]
    for more in states[1:]:
        whole = whole.unionByName(more)
    return whole


def _window_days(cutoff: date) -> list[date]:
    """The days on which a window of the cutoff begins, and the cutoff itself."""
    back = (*RECENT_DAYS, *(7 * w for w in range(TREND_WEEKS + 1)))
    return [cutoff - timedelta(days=d) for d in back]


def _segments(cutoffs: Sequence[date]) -> tuple[Column, Column, Column]:
    """Of a ``day``: the number of its segment, that segment's first day, and the cutoffs after it."""
    days = sorted({d for c in cutoffs for d in _window_days(c)})
    bounds = F.array(*[F.lit(d) for d in days])
    segment = F.size(F.filter(bounds, lambda b: b <= F.col("day")))
    begins = F.get(bounds, F.col("segment") - 1)  # null before the first window
    after = F.filter(
        F.array(*[F.struct(F.lit(c).alias("cutoff"), F.lit(days.index(c)).alias("at")) for c in sorted(set(cutoffs))]),
        lambda c: c["at"] >= F.col("segment"),
    )
    return segment, begins, after


def features_at(state: DataFrame, names: DataFrame, cutoffs: Sequence[date]) -> DataFrame:
    """Client features as of the midnights at which ``cutoffs`` begin, with a column ``cutoff``.

    Equal to ``build_features_before`` at each of them: a client has a row for every cutoff
    after its first dated transaction.
    """
    if not cutoffs:
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.FEATURES)
        return state.sparkSession.createDataFrame([], f"cutoff date, {schema}")
    segment, begins, after = _segments(cutoffs)
    weekdays = {f"d{d}": F.when(F.weekday("day") == d, F.col("dated")).otherwise(0) for d in range(7)}
    by_segment = (
        state.withColumns({"segment": segment, **weekdays}).groupBy("client_id", "segment")
        .agg(F.max("last").alias("last"), *_totals([*SUMS, *weekdays]))
    )
    spread_out = by_segment.select("*", begins.alias("begins"), F.explode(after).alias("c")).withColumn("cutoff", F.col("c.cutoff"))
    start = F.date_sub("cutoff", 7 * TREND_WEEKS)
    week = F.when((F.col("valid") > 0) & (F.col("begins") >= start), F.floor(F.date_diff("begins", start) / F.lit(7)))
    in_trend = [F.when(F.col("week").isNotNull(), F.col(f"volume_usd_{k}")) for k in range(5)]

    def recent(days: int) -> Column:
        return F.sum(F.when(F.col("begins") >= F.date_sub("cutoff", days), F.col("dated")).otherwise(0))

    def whole(name: str) -> Column:
        return joined([F.sum(f"{name}_{k}") for k in range(5)])

    month, quarter = RECENT_DAYS
    measures = spread_out.withColumn("week", week).groupBy("client_id", "cutoff").agg(
        F.max("last").alias("last"), recent(month).alias("recent_30"), recent(quarter).alias("recent_90"),
        whole("volume_usd").alias("volume"), whole("spread_bps").alias("spread"), whole("minimum_spread").alias("minimum"),
        *_totals(["dated", "valid", "spreads", "minimums", *_HOURS, *weekdays]),
        F.coalesce(F.bit_or(F.pow(F.lit(2), F.col("week")).cast("int")), F.lit(0)).alias("weeks"),
        *[F.sum(c).alias(f"trend_{k}") for k, c in enumerate(in_trend)],
        *[F.sum(F.col("week") * c).alias(f"tilt_{k}") for k, c in enumerate(in_trend)],
    )
    combinations = (
        names.withColumn("segment", segment).groupBy("client_id", "segment", *cf.NAMES)
        .agg(F.sum("rows").alias("rows"), F.min("first").alias("first"))
        .select("*", F.explode(after).alias("c")).withColumn("cutoff", F.col("c.cutoff"))
        .groupBy("client_id", "cutoff", *cf.NAMES).agg(F.sum("rows").alias("rows"), F.min("first").alias("first"))
    )
    per_client = measures.join(cf.main_names(combinations, "cutoff"), ["client_id", "cutoff"])
    return cf.feature_columns(per_client, F.col("cutoff").cast("timestamp"), "cutoff")
