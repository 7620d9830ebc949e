"""Rule-based commercial opportunities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookpulse import schemas
from bookpulse.fixed_values import (
    ALL_TYPES,
    CONTEXT_NO_DAY,
    CONTEXT_TEXT,
    CONTEXT_TREND_WORDS,
    OPPORTUNITY_TYPES,
    PREVIEW_TYPES,
    UPSELL_MIN_RECENT_TX,
    UPSELL_SPREAD_GAP,
)
from bookpulse.functions.quantiles import exact_quantiles
from bookpulse.functions.running import row_numbers
from bookpulse.functions.text import day_name, fill, grouped, plain, signed_word
from bookpulse.session import stage


def volume_limits(features: DataFrame) -> tuple[float, float]:
    """Median and upper quartile of total volume over all clients. Pass a written table."""
    limits = exact_quantiles(features, {"total_volume_usd": [0.5, 0.75]})["total_volume_usd"]
    return tuple(limits) if limits else (0.0, 0.0)


def context(prefix: str = "") -> Column:
    """One-line summary of a client."""
    c = lambda name: F.col(prefix + name)
    return fill(
        CONTEXT_TEXT,
        {
            "segment": c("segment"),
            "days": plain(c("days_since_last_tx")),
            "total": grouped(c("total_volume_usd")),
            "average": grouped(c("avg_volume_usd")),
            "trend": signed_word(c("volume_trend"), CONTEXT_TREND_WORDS),
            "hour": c("preferred_hour"),
            "day": day_name(c("preferred_day"), CONTEXT_NO_DAY),
            "spread": plain(c("avg_spread_bps"), 2),
        },
    )


def _rules(p50: float, p75: float) -> dict[str, tuple[Column, Column]]:
    """Type -> (condition, priority), in rule order."""
    segment, volume = F.col("segment"), F.col("total_volume_usd")
    rising = F.col("volume_trend") > 0
    wide = F.coalesce(F.col("spread_vs_minimum") > UPSELL_SPREAD_GAP, F.lit(False))
    return {
        "CHURN_RISK": (segment == "en_riesgo", F.when(volume > p75, "high").otherwise("medium")),
        "REACTIVATION": ((segment == "reactivar") & (volume > p50), F.lit("medium")),
        "UPSELL": (
            (segment == "activo_sano") & (rising | (F.col("tx_count_90d") >= UPSELL_MIN_RECENT_TX)),
            F.when(rising & wide, "high").otherwise("medium"),
        ),
        "BEST_TIME": (segment.isin("activo_sano", "en_riesgo"), F.lit("low")),
    }


def broker_names(features: DataFrame) -> DataFrame:
    """Name of each broker: the one its first client (by client id) carries."""
    return features.groupBy("broker_id").agg(F.min_by("broker_name", "client_id").alias("broker_name"))


def detect(features: DataFrame, limits: tuple[float, float] | None = None) -> DataFrame:
    """All opportunities: one scan of the clients, each giving 0 to 2 rows.

    Only the broker's name needs a join, against one row per broker. That table is
    written first: Spark then knows its size when it chooses the join, and where it is too
    large to broadcast, AQE can split a broker with very many clients (it does not split
    a join whose other side is an aggregate).
    """
    p50, p75 = volume_limits(features) if limits is None else limits
    hits = [
        F.when(hit, F.struct(F.lit(kind).alias("opportunity_type"), priority.alias("priority")))
        for kind, (hit, priority) in _rules(p50, p75).items()
    ]
    found = features.withColumn(
        "hit", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull()))
    ).withColumn("context", context())
    return (
        found.drop("broker_name")
        .join(stage(broker_names(features), "broker-names"), "broker_id")
        .select("*", "hit.*")
        .select(schemas.OPPORTUNITIES.names)
    )


def rule_number(kind: Column) -> Column:
    """1 to 4, the order in which rules are listed."""
    return F.array_position(F.array(*[F.lit(t) for t in OPPORTUNITY_TYPES]), kind).cast("int")


def listing_order() -> list[Column]:
    """Broker, rule, then volume downwards; contact-time rows by client alone."""
    weight = F.when(F.col("opportunity_type") == "BEST_TIME", 0.0).otherwise(-F.col("total_volume_usd"))
    return [F.col("broker_id"), rule_number(F.col("opportunity_type")), weight, F.col("client_id")]


def ranked(opportunities: DataFrame) -> DataFrame:
    """Add ``rule_no`` and ``rank_in_rule``; brokers of any size are ranked in parallel."""
    numbered = opportunities.withColumn("rule_no", rule_number(F.col("opportunity_type")))
    return row_numbers(numbered, ["broker_id", "rule_no"], listing_order()[2:], "rank_in_rule")


def filter_opportunities(
    df: DataFrame, priorities: Sequence[str] = (), types: Sequence[str] = ()
) -> DataFrame:
    """Rows of the given priorities and types; an empty choice means all."""
    if priorities:
        df = df.where(F.col("priority").isin(list(priorities)))
    if types:
        df = df.where(F.col("opportunity_type").isin(list(types)))
    return df


def of_type(df: DataFrame, kind: str = ALL_TYPES) -> DataFrame:
    """Rows of one opportunity type, or all."""
    return df if kind == ALL_TYPES else df.where(F.col("opportunity_type") == kind)


def type_counts(opportunities: DataFrame, *keys: str) -> DataFrame:
    """Opportunities per type, optionally within other keys such as ``broker_id``."""
    return opportunities.groupBy(*keys, "opportunity_type").agg(F.count(F.lit(1)).alias("n"))


def preview(opportunities: DataFrame, rows: int = 2) -> DataFrame:
    """First ``rows`` opportunities of each broker in listing order, contact times left out."""
    broker, *order = listing_order()
    window = Window.partitionBy(broker).orderBy(*order)
    return (
        opportunities.where(F.col("opportunity_type").isin(list(PREVIEW_TYPES)))
        .withColumn("position", F.row_number().over(window))
        .where(F.col("position") <= rows)
    )
