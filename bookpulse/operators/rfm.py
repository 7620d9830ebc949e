"""Recency / frequency / money scores and segments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookpulse.fixed_values import (
    DORMANT_DAYS,
    HEALTHY_SCORE,
    LOST_DAYS,
    MIDDLE_SCORE,
    RFM_BUCKETS,
    RISK_DAYS,
)
from bookpulse.functions.quantiles import bucket, exact_quantiles

# score -> (feature, True when more is better)
SCORES = {
    "R": ("days_since_last_tx", False),
    "F": ("tx_count_90d", True),
    "M": ("total_volume_usd", True),
}
Edges = Mapping[str, Sequence[float] | None]


def quartile_edges(features: DataFrame) -> Edges:
    """Exact quartile edges of the three scored features. Pass a written table."""
    cuts = [i / RFM_BUCKETS for i in range(RFM_BUCKETS + 1)]
    return exact_quantiles(features, {feature: cuts for feature, _ in SCORES.values()})


def segment(score: Column, days: Column) -> Column:
    """Segment of a client by total score and days since the last transaction."""
    middle = F.when(days > RISK_DAYS, "en_riesgo").otherwise("activo_sano")
    low = (
        F.when(days > LOST_DAYS, "perdido").when(days > DORMANT_DAYS, "reactivar").otherwise("en_riesgo")
    )
    return F.when(score >= HEALTHY_SCORE, "activo_sano").when(score >= MIDDLE_SCORE, middle).otherwise(low)


def add_rfm(features: DataFrame, edges: Edges | None = None) -> DataFrame:
    """Add R, F, M, their sum and the segment: comparisons with constants, no join.

    Without ``edges`` they are computed from ``features``, which should then be a
    written table.
    """
    edges = quartile_edges(features) if edges is None else edges
    scored = features.withColumns(
        {
            score: bucket(F.col(feature), edges[feature], RFM_BUCKETS, ascending)
            for score, (feature, ascending) in SCORES.items()
        }
    ).withColumn("rfm_score", sum((F.col(s) for s in SCORES), F.lit(0)))
    return scored.withColumn("segment", segment(F.col("rfm_score"), F.col("days_since_last_tx")))


def segment_counts(features: DataFrame, *keys: str) -> DataFrame:
    """Clients per segment, optionally within other keys such as ``broker_id``."""
    return features.groupBy(*keys, "segment").agg(F.count(F.lit(1)).alias("clients"))
