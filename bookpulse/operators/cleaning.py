"""Row-wise cleaning of raw transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookpulse.fixed_values import COMPLETED, MONEY_SCALE
from bookpulse.functions.numbers import finite, read_number
from bookpulse.functions.times import read_time


def _blank_to_null(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def clean(raw: DataFrame, day_first: bool = False) -> DataFrame:
    """Add the derived columns; no row is dropped.

    ``day_first`` reads 04/07/2025 as the fourth of July, see ``reads_day_first``. Times without a zone are read in the session zone, which ``prepare`` sets to UTC.
    """
    paid = read_number(F.col("balance_paid"))
    return raw.withColumns(
        {
            "bp_num": paid,
            "volume_usd": finite(paid * F.col("er_paid_to_usd") / F.lit(MONEY_SCALE)),
            "spread_bps": finite(F.col("profit_spread_bps") / F.lit(MONEY_SCALE)),
            "trigger_at_dt": read_time(F.col("trigger_at"), day_first),
            "broker_id_clean": _blank_to_null("intermediary_uuid"),
            "broker_name_clean": _blank_to_null("intermediary_name"),
            "client_name_clean": _blank_to_null("balance_owner_name"),
        }
    ).withColumns(
        {
            "has_broker": F.col("broker_name_clean").isNotNull(),
            "is_valid_completed": F.coalesce(
                (F.col("status") == COMPLETED)
                & (F.col("volume_usd") > 0)
                & F.col("trigger_at_dt").isNotNull(),
                F.lit(False),
            ),
            "month": F.date_format("trigger_at_dt", "yyyy-MM"),
            "hour": F.hour("trigger_at_dt"),
            "weekday": F.weekday("trigger_at_dt"),
        }
    )


def reporting_subset(tx: DataFrame) -> DataFrame:
    """Completed transactions with a positive volume; undated ones count too."""
    return tx.where((F.col("status") == COMPLETED) & (F.col("volume_usd") > 0))


def completed_with_broker(tx: DataFrame) -> DataFrame:
    """Completed transactions that name a broker."""
    return tx.where(F.col("has_broker") & (F.col("status") == COMPLETED))


def reference_date(tx: DataFrame) -> Column:
    """Latest valid time of the whole table, as a scalar subquery (no join)."""
    return tx.agg(F.max("trigger_at_dt")).scalar()
