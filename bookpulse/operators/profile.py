"""Profile of the transaction table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookpulse.fixed_values import HISTOGRAM_BINS
from bookpulse.functions.numbers import exact_sum, halves, joined, parts
from bookpulse.functions.quantiles import exact_quantiles
from bookpulse.operators.cleaning import completed_with_broker
from bookpulse.session import stage

PROFILED = (
    "balance_owner_uuid", "balance_owner_name", "intermediary_uuid", "intermediary_name",
    "trigger_at", "status", "volume_usd", "spread_bps", "minimum_spread", "profit_spread_bps",
)
BROKER = ("intermediary_uuid", "intermediary_name")
CELL = ("status", *BROKER, "has_broker", "balance_owner_uuid")


def load_quality(tx: DataFrame) -> DataFrame:
    """Rows, dated, valid completed, with broker, distinct clients."""
    return tx.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("trigger_at_dt").alias("dated"),
        F.count_if("is_valid_completed").alias("valid_completed"),
        F.count_if("has_broker").alias("with_broker"),
        F.count_distinct("balance_owner_uuid").alias("clients"),
    )


def table_shape(raw: DataFrame) -> DataFrame:
    """Rows and columns of the raw table."""
    return raw.agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "column_count", F.lit(len(raw.columns))
    )


def _null_counts(tx: DataFrame) -> dict[str, Column]:
    known = [c for c in PROFILED if c in tx.columns]
    return {c: F.count_if(F.col(c).isNull()).alias(c) for c in known}


def _null_percent(column: str) -> Column:
    return F.when(F.col("n") > 0, F.col(column) / F.col("n") * 100)


def null_profile(tx: DataFrame) -> DataFrame:
    """Type and percent of missing values of the profiled columns, one row each."""
    types, counts = dict(tx.dtypes), _null_counts(tx)
    lines = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(types[c]).alias("data_type"),
            _null_percent(c).alias("null_percent"),
        )
        for c in counts
    ]
    missing = tx.agg(F.count(F.lit(1)).alias("n"), *counts.values())
    return missing.select(F.inline(F.array(*lines)))


def date_range(tx: DataFrame) -> DataFrame:
    """First and last valid time."""
    return tx.agg(
        F.min("trigger_at_dt").alias("first_time"), F.max("trigger_at_dt").alias("last_time")
    )


def universe(tx: DataFrame) -> DataFrame:
    """Distinct brokers and clients, and rows, among completed rows with a broker."""
    return completed_with_broker(tx).agg(
        F.count_distinct("intermediary_uuid").alias("brokers"),
        F.count_distinct("balance_owner_uuid").alias("clients"),
        F.count(F.lit(1)).alias("transactions"),
    )


def _positive_volume(tx: DataFrame) -> DataFrame:
    return completed_with_broker(tx).where(F.col("volume_usd") > 0)


def volume_percentiles(
    tx: DataFrame, percents: tuple[int, ...] = (25, 50, 75, 95, 99), approximate: bool = False
) -> DataFrame:
    """Volume percentiles, one row each. Exact by default; a sketch on request."""
    return _percentiles(_positive_volume(tx), percents, approximate)


def _percentiles(volumes: DataFrame, percents: tuple[int, ...] = (25, 50, 75, 95, 99), approximate: bool = False) -> DataFrame:
    points = [p / 100 for p in percents]
    if approximate:
        one_row = volumes.agg(F.percentile_approx("volume_usd", points, 10_000).alias("v"))
        values: list[Column] = [F.get("v", F.lit(i)) for i in range(len(points))]
    else:
        found = exact_quantiles(volumes, {"volume_usd": points})["volume_usd"]
        one_row = volumes.sparkSession.range(1)
        values = [F.lit(v) for v in found] if found else [F.lit(None).cast("double")] * len(points)
    lines = [
        F.struct(F.lit(p).alias("percent"), v.alias("volume_usd")) for p, v in zip(percents, values)
    ]
    return one_row.select(F.inline(F.array(*lines)))


def broker_volume(tx: DataFrame) -> DataFrame:
    """Volume and rows per broker id and name; rows without either are left out."""
    return (
        _positive_volume(tx).dropna(subset=list(BROKER)).groupBy(*BROKER)
        .agg(
            exact_sum(F.col("volume_usd")).cast("double").alias("total_volume_usd"),
            F.count("volume_usd").alias("tx_count"),
        )
    )


def broker_clients(tx: DataFrame) -> DataFrame:
    """Distinct clients per broker id and name."""
    return (
        completed_with_broker(tx).dropna(subset=list(BROKER)).groupBy(*BROKER)
        .agg(F.count_distinct("balance_owner_uuid").alias("n_clients"))
    )


def top_brokers(per_broker: DataFrame, measure: str, rows: int = 10) -> DataFrame:
    """Largest brokers by ``measure``; equal ones go by id and name."""
    return per_broker.orderBy(F.desc(measure), *BROKER).limit(rows)


def status_distribution(tx: DataFrame) -> DataFrame:
    """Rows per status and their percent of all rows."""
    everything = tx.agg(F.count(F.lit(1))).scalar()
    counted = tx.where(F.col("status").isNotNull()).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("percent", F.col("n") / everything * 100)


def volume_histogram(tx: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Rows per equal-width bin of log10(volume), volumes below 1 counted as 1.

    The last bin is closed; empty bins are listed with 0.
    """
    return _histogram(_positive_volume(tx), bins)


def _histogram(volumes: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    logs = volumes.select(F.log10(F.greatest("volume_usd", F.lit(1.0))).alias("x"))
    ends = logs.agg(F.struct(F.min("x").alias("low"), F.max("x").alias("high"))).scalar()
    low, high = ends["low"], ends["high"]
    # A single distinct value is given a bin range of one, centred on it.
    start = F.when(high > low, low).otherwise(low - 0.5)
    width = F.when(high > low, high - low).otherwise(F.lit(1.0))
    placed = F.least(F.floor((F.col("x") - start) / width * bins), F.lit(bins - 1)).cast("int")
    counted = logs.groupBy(placed.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    slots = counted.agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("held"))
    return slots.select("held", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).select(
        "bin",
        (start + F.col("bin") * width / bins).alias("low_edge"),
        F.coalesce(F.try_element_at("held", "bin"), F.lit(0)).alias("n"),
    )


def profile_cells(tx: DataFrame) -> DataFrame:
    """Counts and sums per status, broker and client: what all grouped profile lines add up from.

    One scan with map-side combining; a row per combination that occurs, nulls included.
    """
    volume = F.when(F.col("volume_usd") > 0, F.col("volume_usd"))
    counted = {c: n for c, n in _null_counts(tx).items() if c not in CELL}
    return tx.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n"), F.count(volume).alias("volumes"),
        F.min("trigger_at_dt").alias("first"), F.max("trigger_at_dt").alias("last"), *counted.values(),
        *[F.sum(part).alias(f"volume_{k}") for k, part in enumerate(parts(*halves(volume)))],
    )


def profile_report(tx: DataFrame) -> DataFrame:
    """The whole profile as ``(section, key, value)`` rows; times are epoch seconds.

    Scans ``tx`` twice: for the cells that everything grouped adds up from, and for the
    column of positive volumes, of which percentiles and histogram are taken.
    """

    def lines(section: str, df: DataFrame, key: Column, value: Column) -> DataFrame:
        return df.select(
            F.lit(section).alias("section"), key.alias("key"), value.cast("double").alias("value")
        )

    def spread_out(df: DataFrame, cells: list[tuple[str, str, Column]]) -> DataFrame:
        rows = [
            F.struct(F.lit(s).alias("section"), F.lit(k).alias("key"), v.cast("double").alias("value"))
            for s, k, v in cells
        ]
        return df.select(F.inline(F.array(*rows)))

    cells = stage(profile_cells(tx), "profile-cells")
    volumes = stage(_positive_volume(tx).select("volume_usd"), "profile-volumes")
    known = list(_null_counts(tx))
    n = F.sum("n")
    missing = {c: F.sum(F.when(F.col(c).isNull(), F.col("n")).otherwise(0)) if c in CELL else F.sum(c) for c in known}
    totals = cells.agg(
        F.coalesce(n, F.lit(0)).alias("n"), F.unix_micros(F.min("first")).alias("first"),
        F.unix_micros(F.max("last")).alias("last"), *[m.alias(c) for c, m in missing.items()],
    )
    everything = totals.select("n").scalar()
    with_broker = completed_with_broker(cells)
    named = with_broker.dropna(subset=list(BROKER)).groupBy(*BROKER)
    per_broker = named.agg(joined([F.sum(f"volume_{k}") for k in range(5)]).alias("total_volume_usd"), F.sum("volumes").alias("rows"))
    clients = named.agg(F.count_distinct("balance_owner_uuid").alias("n_clients"))
    universe_ = with_broker.agg(
        F.count_distinct("intermediary_uuid").alias("brokers"),
        F.count_distinct("balance_owner_uuid").alias("clients"),
        F.coalesce(n, F.lit(0)).alias("transactions"),
    )
    status = cells.where(F.col("status").isNotNull()).groupBy("status").agg(n.alias("n"))
    broker = F.concat_ws(" ", *BROKER)
    return reduce(DataFrame.unionByName, [
        spread_out(totals, [
            ("shape", "row_count", F.col("n")),
            ("dates", "first_time", F.col("first") / F.lit(1e6)),
            ("dates", "last_time", F.col("last") / F.lit(1e6)),
            *[("nulls", c, _null_percent(c)) for c in known],
        ]),
        spread_out(universe_, [("universe", c, F.col(c)) for c in ("brokers", "clients", "transactions")]),
        lines("volume", _percentiles(volumes), F.concat(F.lit("p"), F.col("percent")), F.col("volume_usd")),
        lines("top_volume", top_brokers(per_broker.where(F.col("rows") > 0), "total_volume_usd"), broker, F.col("total_volume_usd")),
        lines("top_clients", top_brokers(clients, "n_clients"), broker, F.col("n_clients")),
        lines("status", status, F.col("status"), F.col("n") / everything * 100),
        lines("histogram", _histogram(volumes), F.col("bin").cast("string"), F.col("n")),
    ])
