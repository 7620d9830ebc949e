"""Churn labels and what is derived from churn probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookpulse.fixed_values import CHURN_WINDOW_DAYS, MIN_PAST_TX, RISK_LABELS, RISK_LIMITS
from bookpulse.functions.numbers import ratio
from bookpulse.operators.cleaning import reference_date


def label_cutoff(
    tx: DataFrame, window_days: int = CHURN_WINDOW_DAYS, as_of: Column | None = None
) -> Column:
    """Start of the label window, which ends at ``as_of`` (by default the latest time)."""
    end = reference_date(tx) if as_of is None else as_of
    return end - F.make_dt_interval(F.lit(window_days))


def churn_labels(
    tx: DataFrame, window_days: int = CHURN_WINDOW_DAYS, min_past: int = MIN_PAST_TX,
    as_of: Column | None = None,
) -> DataFrame:
    """1 for a client with history but nothing in the window, 0 for one active in it.

    Clients with fewer than ``min_past`` dated rows before the window get no label.
    """
    dated = tx.where(F.col("balance_owner_uuid").isNotNull() & F.col("trigger_at_dt").isNotNull())
    past = F.col("trigger_at_dt") < label_cutoff(tx, window_days, as_of)
    return (
        dated.groupBy(F.col("balance_owner_uuid").alias("client_id"))
        .agg(F.count_if(past).alias("past"), F.count_if(~past).alias("recent"))
        .where(F.col("past") >= min_past)
        .select("client_id", (F.col("recent") == 0).cast("int").alias("churned"))
    )


def label_summary(labels: DataFrame) -> DataFrame:
    """Labelled, churned and active clients, and the churn rate in percent."""
    counted = labels.agg(
        F.count(F.lit(1)).alias("labelled"), F.count_if(F.col("churned") == 1).alias("churned")
    )
    return counted.select(
        "labelled", "churned",
        (F.col("labelled") - F.col("churned")).alias("active"),
        (ratio(F.col("churned"), F.col("labelled")) * 100).alias("churn_rate"),
    )


def risk_label(probability: Column) -> Column:
    """Risk class of a probability; limits belong to the lower class."""
    chain = F
    for name, limit in zip(RISK_LABELS, RISK_LIMITS):
        chain = chain.when(probability <= limit, name)
    return chain.when(probability <= 1.0, RISK_LABELS[-1])


def churn_score(probability: Column) -> Column:
    """Whole percent, half-even."""
    return F.bround(probability * 100, 0).cast("int")


def percent_text(probability: Column) -> Column:
    """Percent with one digit, half-even, as a number."""
    return F.bround(probability * 100, 1)


def risk_counts(scores: DataFrame) -> DataFrame:
    """Clients per risk label, all four labels listed, from one row of four counts."""
    counts = scores.agg(
        *[F.count_if(F.col("risk_label") == name).alias(name) for name in RISK_LABELS]
    )
    return counts.unpivot([], list(RISK_LABELS), "risk_label", "clients")
