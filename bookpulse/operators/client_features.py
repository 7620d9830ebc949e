"""One row of behaviour features per client."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookpulse import schemas
from bookpulse.fixed_values import DIRECT_BROKER, RECENT_DAYS, TREND_WEEKS
from bookpulse.functions.numbers import exact_sum, finite, halves, joined, parts, ratio
from bookpulse.operators.cleaning import reference_date

_HOURS, _DAYS = range(24), range(7)
_WEEKS = range(TREND_WEEKS + 1)          # a row at the reference date itself falls in the last
_DAY_MICROS = 86_400_000_000
#: Cleaned columns that name a client or its broker.
NAMES = ("broker_id", "broker_name", "client_name")
_UNDATED = 2**63 - 1                     # sorts after every time


def _days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def _week(now: Column) -> Column:
    """Week of the trend window that a valid row falls in, else NULL."""
    ts, start = F.col("trigger_at_dt"), now - _days(7 * TREND_WEEKS)
    return F.when(
        F.col("is_valid_completed") & (ts >= start),
        F.floor((F.unix_micros(ts) - F.unix_micros(start)) / F.lit(7 * _DAY_MICROS)),
    )


def _measures(tx: DataFrame, as_of: Column) -> DataFrame:
    """Counts, sums, hour and weekday counts and the sums of the weekly trend per client.

    One hash aggregate over fixed-width numbers, one shuffle: every task first adds up
    its own rows, so a client that holds a third of them moves one row per task. Hour and
    weekday have 24 and 7 values and get a column each, which saves a second shuffle per
    measure; the columns are mostly zero and compress away when moved. The trend needs
    three numbers: volume, volume times week, and the set of weeks as bits.
    """
    ts, valid, now = F.col("trigger_at_dt"), F.col("is_valid_completed"), F.col("_as_of")
    month, quarter = RECENT_DAYS
    rows = tx.where(F.col("balance_owner_uuid").isNotNull()).withColumn("_as_of", as_of)
    columns = {
        "client_id": F.col("balance_owner_uuid"),
        "at": F.unix_micros(ts),
        "hour": F.hour(ts),
        "day": F.weekday(ts),
        "recent_30": ts >= now - _days(month),
        "recent_90": ts >= now - _days(quarter),
        "valid": valid,
        "week": _week(now),
    }
    amounts = ("volume_usd", "spread_bps", "minimum_spread")
    columns |= {name: F.when(valid, finite(F.col(name))) for name in amounts}
    # One step after another, so that no expression is written out for each of its uses.
    split = {f"{name}_{k}": half for name in amounts for k, half in zip("wfb", halves(F.col(name)))}
    limbs = {
        f"{name}_{k}": part
        for name in amounts for k, part in enumerate(parts(*[F.col(f"{name}_{h}") for h in "wfb"]))
    }

    def of(name: str) -> list[Column]:
        return [F.col(f"{name}_{k}") for k in range(5)]

    week = F.col("week")
    in_trend = [F.when(week.isNotNull(), part) for part in of("volume_usd")]

    return (
        rows.select(*[c.alias(n) for n, c in columns.items()]).withColumns(split).withColumns(limbs)
        .groupBy("client_id")
        .agg(
            F.count("at").alias("dated"),
            F.max("at").alias("last"),
            *[F.count_if(c).alias(c) for c in ("recent_30", "recent_90", "valid")],
            joined([F.sum(c) for c in of("volume_usd")]).alias("volume"),
            joined([F.sum(c) for c in of("spread_bps")]).alias("spread"),
            F.count("spread_bps").alias("spreads"),
            joined([F.sum(c) for c in of("minimum_spread")]).alias("minimum"),
            F.count("minimum_spread").alias("minimums"),
            *[F.count_if(F.col("hour") == h).alias(f"h{h}") for h in _HOURS],
            *[F.count_if(F.col("day") == d).alias(f"d{d}") for d in _DAYS],
            F.coalesce(F.bit_or(F.pow(F.lit(2), week).cast("int")), F.lit(0)).alias("weeks"),
            *[F.sum(c).alias(f"trend_{k}") for k, c in enumerate(in_trend)],
            *[F.sum(week * c).alias(f"tilt_{k}") for k, c in enumerate(in_trend)],
        )
        .where(F.col("dated") > 0)
    )


def _first_in_time(name: str) -> Column:
    """Non-missing ``name`` with the earliest time; equal times go by name."""
    return F.min(F.when(F.col(name).isNotNull(), F.struct("first", name)))[name].alias(name)


def _names(tx: DataFrame) -> DataFrame:
    """Main broker with its name, and client name, per client, over dated and undated rows.

    Rows are first counted per distinct combination of names, a hash aggregate of numbers.
    The aggregates that carry strings then see a handful of rows per client, and each of
    them combines before it shuffles, whatever a client's number of names.
    """
    combinations = (
        tx.where(F.col("balance_owner_uuid").isNotNull())
        .groupBy(
            F.col("balance_owner_uuid").alias("client_id"),
            *[F.col(f"{c}_clean").alias(c) for c in NAMES],
        )
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.min(F.unix_micros("trigger_at_dt")), F.lit(_UNDATED)).alias("first"),
        )
    )
    return main_names(combinations)


def main_names(combinations: DataFrame, *keys: str) -> DataFrame:
    """Main broker with its name, and client name, per client (and keys), of counted combinations."""
    per_broker = combinations.groupBy("client_id", *keys, "broker_id").agg(
        F.sum("rows").alias("rows"),
        F.min(F.when(F.col("client_name").isNotNull(), F.col("first"))).alias("first"),
        _first_in_time("client_name"),
        _first_in_time("broker_name"),
    )
    most_rows = F.struct(
        (-F.col("rows")).alias("rows"), "broker_id",
        F.coalesce("broker_name", "broker_id").alias("broker_name"),
    )
    return per_broker.groupBy("client_id", *keys).agg(
        F.min(F.when(F.col("broker_id").isNotNull(), most_rows)).alias("main"),
        _first_in_time("client_name"),
    )


def _mode(prefix: str, values: range) -> Column:
    """Most frequent value; equal counts go to the smallest."""
    counts = F.array(*[F.col(f"{prefix}{v}") for v in values])
    return (F.array_position(counts, F.array_max(counts)) - 1).cast("int")


def _weekly_slope() -> Column:
    """Least-squares slope of weekly volume over the week index, 0 below two weeks.

    Absent weeks are left out. Sums are multiplied out limb by limb in DECIMAL, so equal
    weeks give exactly 0.
    """
    weeks = F.col("weeks")
    present = {w: F.getbit(weeks, F.lit(w)).cast("int") for w in _WEEKS}
    n = F.bit_count(weeks)
    x = sum((F.lit(w) * p for w, p in present.items()), F.lit(0))
    xx = sum((F.lit(w * w) * p for w, p in present.items()), F.lit(0))

    def rise(k: int) -> Column:
        kind = "double" if k == 4 else "decimal(25,0)"
        return n * F.col(f"tilt_{k}").cast(kind) - x * F.col(f"trend_{k}").cast(kind)

    return F.when(n < 2, F.lit(0.0)).otherwise(joined([rise(k) for k in range(5)]) / (n * xx - x * x))


def build_features(tx: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Clean transactions to one feature row per client that has a dated row.

    ``as_of`` is the reference time, by default the latest time in ``tx``.
    """
    as_of = reference_date(tx) if as_of is None else as_of
    per_client = _measures(tx, as_of).join(_names(tx), "client_id")
    return feature_columns(per_client, as_of)


def weekly_volume(tx: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Volume per client and week of the trend window; empty weeks have no row."""
    rows = tx.where(F.col("balance_owner_uuid").isNotNull()).withColumn(
        "_as_of", reference_date(tx) if as_of is None else as_of
    )
    return (
        rows.select(F.col("balance_owner_uuid").alias("client_id"), _week(F.col("_as_of")).alias("week"), "volume_usd")
        .where(F.col("week").isNotNull())
        .groupBy("client_id", F.col("week").cast("int").alias("week"))
        .agg(exact_sum(F.col("volume_usd")).alias("volume_usd"))
    )


def build_features_before(tx: DataFrame, cutoff: Column) -> DataFrame:
    """Features a model may know at ``cutoff``: only rows dated before it."""
    return build_features(tx.where(F.col("trigger_at_dt") < cutoff), cutoff)


def feature_columns(per_client: DataFrame, as_of: Column, *keys: str) -> DataFrame:
    """The feature table from measures and names per client; ``keys`` stay in front."""
    none_valid = F.col("valid") == 0
    spread = F.when(none_valid, 0.0).otherwise(ratio(F.col("spread"), F.col("spreads")))
    minimum = F.when(none_valid, 0.0).otherwise(ratio(F.col("minimum"), F.col("minimums")))
    total = F.coalesce(F.col("volume").cast("double"), F.lit(0.0))
    columns = {
        "client_id": F.col("client_id"),
        "client_name": F.coalesce("client_name", F.substring("client_id", 1, 8)),
        "days_since_last_tx": (F.unix_micros(as_of) - F.col("last")) / F.lit(_DAY_MICROS),
        "tx_count_total": F.col("dated"),
        "tx_count_30d": F.col("recent_30"),
        "tx_count_90d": F.col("recent_90"),
        "tx_count_completed": F.col("valid"),
        "success_rate": F.col("valid") / F.col("dated"),
        "avg_volume_usd": F.coalesce(ratio(F.col("volume"), F.col("valid")), F.lit(0.0)),
        "total_volume_usd": total,
        "volume_trend": _weekly_slope(),
        "avg_spread_bps": spread,
        "spread_vs_minimum": spread - minimum,
        "preferred_hour": _mode("h", _HOURS),
        "preferred_day": _mode("d", _DAYS),
        "broker_id": F.coalesce("main.broker_id", F.lit(DIRECT_BROKER)),
        "broker_name": F.coalesce("main.broker_name", F.lit(DIRECT_BROKER)),
    }
    return per_client.select(
        *keys, *[columns[f.name].cast(f.dataType).alias(f.name) for f in schemas.FEATURES]
    )


def feature_summary(features: DataFrame) -> DataFrame:
    """Clients with a broker of their own and clients without."""
    direct = F.col("broker_id") == DIRECT_BROKER
    return features.agg(
        F.count(F.lit(1)).alias("clients"),
        F.count_if(~direct).alias("with_broker"),
        F.count_if(direct).alias("without_broker"),
    )
