import pytest
from conftest import by_key, column
from pyspark.sql import functions as F

from bookpulse.operators.client_features import (
    build_features,
    build_features_before,
    feature_summary,
    weekly_volume,
)
from bookpulse.operators.labels import label_cutoff
from bookpulse.operators.rfm import add_rfm, segment

REF = "2025-06-30 12:00:00+00"


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def feature(tx, *rows, client="client-0001"):
    return by_key(build_features(tx(*rows)), "client_id")[client]


def test_cleaning_of_odd_values(tx):
    rows = tx(
        {"trigger_at": "2001-06-05 13:00:05.123456+00", "balance_paid": "112946.26"},
        {"trigger_at": "2001-06-05 13:00:05+00:00", "balance_paid": "N/A"},
        {"trigger_at": "", "balance_paid": "NaN"},
        {"trigger_at": "nan", "balance_paid": "0"},
        {"trigger_at": "2001-06-05T13:00:05Z", "balance_paid": "-5"},
        {"trigger_at": None, "balance_paid": "5", "er_paid_to_usd": None},
        {"trigger_at": "2001-06-05 13:00:05+02", "status": "PENDING", "intermediary_name": "", "balance_owner_name": ""},
        {"status": None, "intermediary_uuid": "", "balance_paid": "1e300"},
    ).collect()
    assert [str(r["trigger_at_dt"]) for r in rows[:7]] == [
        "2001-06-05 13:00:05.123456", "2001-06-05 13:00:05", "None", "None", "2001-06-05 13:00:05", "None",
        "2001-06-05 11:00:05"]
    assert [r["volume_usd"] for r in rows] == [112946.26, None, None, 0.0, -5.0, None, 100.0, 1e300]
    assert [r["is_valid_completed"] for r in rows] == [True] + [False] * 7
    assert (rows[6]["has_broker"], rows[6]["broker_name_clean"], rows[6]["client_name_clean"]) == (False, None, None)
    assert (rows[7]["has_broker"], rows[7]["broker_id_clean"]) == (True, None)
    assert (rows[0]["hour"], rows[0]["weekday"], rows[0]["month"]) == (13, 1, "2001-06")


def test_windows_include_their_start(tx):
    f = feature(
        tx, {}, {"trigger_at": "2025-05-31 12:00:00+00"}, {"trigger_at": "2025-05-31 11:59:59+00"},
        {"trigger_at": "2025-04-01 12:00:00+00"}, {"trigger_at": "2025-04-01 11:59:59+00"})
    assert (f["tx_count_total"], f["tx_count_30d"], f["tx_count_90d"]) == (5, 2, 4)


def test_weekly_index_and_absent_weeks(tx):
    rows = [
        {"balance_paid": "10"},                                                # the reference itself: week 8
        {"trigger_at": "2025-05-05 12:00:00+00", "balance_paid": "20"},        # exactly 56 days before: week 0
        {"trigger_at": "2025-05-05 11:59:59+00", "balance_paid": "999"},       # before the window
        {"trigger_at": "2025-05-20 12:00:00+00", "balance_paid": "5"},         # week 2
        {"trigger_at": "2025-05-21 12:00:00+00", "balance_paid": "7", "status": "PENDING"},
    ]
    weeks = {r["week"]: r["volume_usd"] for r in weekly_volume(tx(*rows)).collect()}
    assert weeks == {0: 20.0, 2: 5.0, 8: 10.0}
    # slope through (0,20), (2,5), (8,10) only
    assert feature(tx, *rows)["volume_trend"] == pytest.approx(-80 / 104)


def test_trend_needs_two_weeks_and_is_zero_for_equal_weeks(tx):
    assert feature(tx, {}, {"trigger_at": "2025-06-30 11:00:00+00"})["volume_trend"] == 0.0
    equal = [{"trigger_at": f"2025-06-{d:02d} 12:00:00+00", "balance_paid": "0.1"} for d in (1, 8, 15, 22, 30)]
    assert feature(tx, *equal)["volume_trend"] == 0.0


def test_ties_go_to_the_smallest(tx):
    f = feature(
        tx,
        {"trigger_at": "2025-06-30 09:00:00+00", "intermediary_uuid": "B2"},   # Monday
        {"trigger_at": "2025-06-29 05:00:00+00", "intermediary_uuid": "B1"},   # Sunday
    )
    assert (f["preferred_hour"], f["preferred_day"], f["broker_id"]) == (5, 0, "B1")


def test_names_and_broker_use_undated_rows(tx):
    f = feature(
        tx, {"balance_owner_name": None, "intermediary_uuid": None},
        {"balance_owner_name": "Luz", "trigger_at": None, "intermediary_uuid": "B9", "intermediary_name": "Nueve"})
    assert (f["client_name"], f["broker_id"], f["broker_name"], f["tx_count_total"]) == ("Luz", "B9", "Nueve", 1)


def test_first_name_in_time_with_undated_last(tx):
    f = feature(
        tx, {"balance_owner_name": "Zoe", "trigger_at": ""},
        {"balance_owner_name": "Late", "intermediary_name": "Late broker"},
        {"balance_owner_name": "Early", "intermediary_name": "Early broker", "trigger_at": "2025-01-01 00:00:00+00"})
    assert (f["client_name"], f["broker_name"]) == ("Early", "Early broker")


def test_fallback_names(tx):
    f = feature(tx, {"balance_owner_name": "", "intermediary_name": ""})
    assert (f["client_name"], f["broker_id"], f["broker_name"]) == ("client-0", "B1", "B1")
    f = feature(tx, {"intermediary_uuid": "", "intermediary_name": "kept apart"})
    assert (f["broker_id"], f["broker_name"]) == ("DIRECTO", "DIRECTO")


def test_clients_without_date_or_key_are_dropped(tx):
    found = build_features(tx({}, {"balance_owner_uuid": "x", "trigger_at": "bad"}, {"balance_owner_uuid": None}))
    assert column(found, "client_id") == ["client-0001"]


def test_money_of_client_without_valid_rows_is_zero(tx):
    f = feature(tx, {"status": "PENDING"})
    assert [f[c] for c in ("tx_count_completed", "success_rate", "avg_volume_usd", "total_volume_usd",
                           "avg_spread_bps", "spread_vs_minimum")] == [0, 0, 0, 0, 0, 0]


def test_missing_spreads_stay_missing(tx):
    f = feature(tx, {"profit_spread_bps": None}, {"profit_spread_bps": None, "balance_paid": "50"})
    assert (f["avg_spread_bps"], f["spread_vs_minimum"], f["avg_volume_usd"]) == (None, None, 75.0)
    f = feature(tx, {"minimum_spread": None})
    assert (f["avg_spread_bps"], f["spread_vs_minimum"]) == (30.0, None)


def test_hot_client_equals_the_same_rows_in_small(tx, spark):
    base = tx({}, {"trigger_at": "2025-06-10 03:00:00+00", "balance_paid": "0.1", "intermediary_uuid": "B2"})
    many = base.crossJoin(spark.range(3000)).drop("id").repartition(8)
    f, once = one(build_features(many)), one(build_features(base))
    assert f["total_volume_usd"] == pytest.approx(3000 * once["total_volume_usd"], rel=1e-12)
    for name in ("preferred_hour", "preferred_day", "broker_id", "avg_volume_usd", "client_name", "success_rate"):
        assert f[name] == once[name]


def test_features_before_a_cutoff_ignore_later_rows(tx):
    rows = tx({"trigger_at": "2025-01-01 00:00:00+00"}, {"trigger_at": "2025-03-01 12:00:00+00"}, {})
    f = one(build_features_before(rows, label_cutoff(rows)))
    assert (f["tx_count_total"], f["days_since_last_tx"]) == (2, 31.0)


@pytest.mark.parametrize(
    ("score", "days", "expected"),
    [(9, 999.0, "activo_sano"), (8, 45.0, "activo_sano"), (8, 45.1, "en_riesgo"), (6, 30.0, "activo_sano"),
     (5, 30.0, "en_riesgo"), (5, 30.1, "reactivar"), (5, 180.0, "reactivar"), (5, 180.1, "perdido")],
)
def test_segments(spark, score, days, expected):
    assert spark.range(1).select(segment(F.lit(score), F.lit(days))).first()[0] == expected


def test_scores_of_a_small_book(features):
    df = features(*[
        {"client_id": f"C{i}", "days_since_last_tx": float(i), "tx_count_90d": 5, "total_volume_usd": i * 10.0}
        for i in range(1, 9)
    ]).drop("R", "F", "M", "rfm_score", "segment")
    got = by_key(add_rfm(df), "client_id")
    assert [got[f"C{i}"]["R"] for i in range(1, 9)] == [4, 4, 3, 3, 2, 2, 1, 1]
    assert {g["F"] for g in got.values()} == {2}
    assert [got[f"C{i}"]["M"] for i in range(1, 9)] == [1, 1, 2, 2, 3, 3, 4, 4]
    assert all(g["rfm_score"] == g["R"] + g["F"] + g["M"] for g in got.values())


def test_feature_summary(features):
    assert tuple(feature_summary(features({}, {"client_id": "C2", "broker_id": "DIRECTO"})).first()) == (2, 1, 1)


@pytest.mark.parametrize(
    ("text", "wanted"),
    [("2025-06-30 12:00:05.5+00", "2025-06-30 12:00:05"), ("2025-06-30", "2025-06-30 00:00:00"),
     ("2025/06/30 12:00:00", "2025-06-30 12:00:00"), ("30-Jun-2025 12:00", "2025-06-30 12:00:00"),
     ("06/30/2025 10:00", "2025-06-30 10:00:00"), ("Jun 30 2025", "2025-06-30 00:00:00"),
     ("20250630 120000", "2025-06-30 12:00:00"), ("12:30:00", None), ("2025", None), ("13/45/2025 10:00", None),
     ("Xyz 30 2025", None), ("", None), (None, None)],
)
def test_times_are_read_by_their_date(spark, text, wanted):
    from pyspark.sql import functions as F

    from bookpulse.operators.cleaning import read_time

    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.date_format(read_time(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("r")).first()["r"] == wanted
