"""Table schemas."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

_TYPES = {"string": StringType(), "double": DoubleType(), "bigint": LongType(), "int": IntegerType()}


def _columns(text: str) -> StructType:
    """Schema from ``name type, ...``; unlike a DDL string it needs no session."""
    pairs = (column.split() for column in text.split(","))
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])

RAW_TRANSACTIONS = _columns(
    "balance_owner_uuid string, balance_owner_name string, intermediary_uuid string, "
    "intermediary_name string, trigger_at string, status string, balance_paid string, "
    "er_paid_to_usd double, profit_spread_bps double, minimum_spread double"
)

FEATURES = _columns(
    "client_id string, client_name string, days_since_last_tx double, tx_count_total bigint, "
    "tx_count_30d bigint, tx_count_90d bigint, tx_count_completed bigint, success_rate double, "
    "avg_volume_usd double, total_volume_usd double, volume_trend double, avg_spread_bps double, "
    "spread_vs_minimum double, preferred_hour int, preferred_day int, broker_id string, "
    "broker_name string"
)

SCORED_FEATURES = StructType(
    FEATURES.fields
    + _columns("R int, F int, M int, rfm_score int, segment string").fields
)

OPPORTUNITIES = _columns(
    "broker_id string, broker_name string, client_id string, client_name string, "
    "opportunity_type string, priority string, days_since_last_tx double, "
    "total_volume_usd double, avg_volume_usd double, volume_trend double, segment string, "
    "preferred_hour int, preferred_day int, context string"
)

CHURN_LABELS = _columns("client_id string, churned int")

CHURN_SCORES = _columns(
    "client_id string, client_name string, broker_id string, broker_name string, "
    "segment string, churn_probability double, churn_score int, risk_label string"
)

SCORE_COLUMNS = ("client_id", "churn_probability", "churn_score", "risk_label")

MESSAGES = _columns(
    "broker_id string, broker_name string, client_id string, client_name string, "
    "opportunity_type string, priority string, message string, source string, context string"
)

OUTSIDE_TEXTS = _columns("client_id string, opportunity_type string, text string")
