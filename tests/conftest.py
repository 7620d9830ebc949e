import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("BOOK_ROUNDS", "8")  # a fit of all rounds takes over a minute


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from bookpulse.session import prepare

    yield prepare(session)
    session.stop()


RAW_DEFAULTS = {
    "balance_owner_uuid": "client-0001", "balance_owner_name": "Ana", "intermediary_uuid": "B1",
    "intermediary_name": "Broker 1", "trigger_at": "2025-06-30 12:00:00+00", "status": "COMPLETED",
    "balance_paid": "100", "er_paid_to_usd": 1e8, "profit_spread_bps": 30e8, "minimum_spread": 10.0,
}


@pytest.fixture
def raw(spark):
    """raw(dict, dict, ...) -> raw transactions; keys left out take the defaults."""
    from bookpulse.schemas import RAW_TRANSACTIONS

    def build(*rows):
        filled = [RAW_DEFAULTS | r for r in rows]
        return spark.createDataFrame(
            [tuple(r[f.name] for f in RAW_TRANSACTIONS) for r in filled], RAW_TRANSACTIONS
        )

    return build


@pytest.fixture
def tx(raw):
    from bookpulse.operators.cleaning import clean

    return lambda *rows: clean(raw(*rows))


FEATURE_DEFAULTS = {
    "client_id": "C1", "client_name": "Ana", "days_since_last_tx": 10.0, "tx_count_total": 10,
    "tx_count_30d": 2, "tx_count_90d": 6, "tx_count_completed": 8, "success_rate": 0.8,
    "avg_volume_usd": 100.0, "total_volume_usd": 1000.0, "volume_trend": 1.0, "avg_spread_bps": 35.0,
    "spread_vs_minimum": 25.0, "preferred_hour": 9, "preferred_day": 1, "broker_id": "B1",
    "broker_name": "Broker 1", "R": 3, "F": 3, "M": 3, "rfm_score": 9, "segment": "activo_sano",
}


@pytest.fixture
def features(spark):
    """features(dict, dict, ...) -> scored client features; keys left out take the defaults."""
    from bookpulse.schemas import SCORED_FEATURES

    def build(*rows):
        filled = [FEATURE_DEFAULTS | r for r in rows]
        return spark.createDataFrame(
            [tuple(r[f.name] for f in SCORED_FEATURES) for r in filled], SCORED_FEATURES
        )

    return build


def column(df, name):
    return [r[name] for r in df.collect()]


def by_key(df, key):
    return {r[key]: r.asDict() for r in df.collect()}
