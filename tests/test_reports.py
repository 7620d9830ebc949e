import math

import pytest
from conftest import by_key, column
from pyspark.sql import functions as F

from bookpulse import fixed_values as fv
from bookpulse.operators import broker_reports as rep
from bookpulse.operators import opportunities as opps
from bookpulse.operators import profile
from bookpulse.operators.rfm import segment_counts


@pytest.mark.parametrize(
    ("days", "index"), [(13.9, 0), (14.0, 1), (30.0, 1), (30.1, 2), (90.0, 2), (90.1, 3)])
def test_activity_light(spark, days, index):
    assert spark.range(1).select(rep.activity_light(F.lit(days))).first()[0] == fv.ACTIVITY_LABELS[index]


@pytest.mark.parametrize(
    ("trend", "key"),
    [(501.0, "strong_up"), (500.0, "up"), (0.1, "up"), (0.0, "flat"), (-0.1, "down"), (-500.0, "down"), (-501.0, "strong_down")])
def test_trend_label(spark, trend, key):
    assert spark.range(1).select(rep.trend_label(F.lit(trend))).first()[0] == fv.TREND_LABELS[key]


def test_small_texts(spark):
    row = spark.range(1).select(
        rep.best_contact(F.lit(8), F.lit(5)), rep.type_label(F.lit("NEW")), rep.type_label(F.lit("UPSELL")),
        rep.segment_label(F.lit("perdido")), rep.inactive_text(F.lit(1200.5)), rep.money_text(F.lit(1200.5)),
    ).first()
    assert tuple(row) == ("Martes a las 05:00", "NEW", "📈 Crecer Cuenta", "Sin Actividad Reciente", "1200d", "$1,200")


def test_broker_card_rounds_half_even(features):
    df = features(*[
        {"client_id": f"c{i}", "segment": "activo_sano" if i < 1 else "en_riesgo", "total_volume_usd": 0.1}
        for i in range(8)
    ], {"client_id": "z", "broker_id": "B2", "segment": "reactivar"})
    card = by_key(rep.broker_card(df, opps.detect(df, (1e9, 1e9))), "broker_id")
    assert card["B1"]["active_percent"] == 12       # 12.5
    assert (card["B1"]["at_risk"], card["B1"]["upsell"], card["B1"]["total_volume_usd"]) == (7, 1, 0.8)
    assert (card["B2"]["dormant"], card["B2"]["active_percent"], card["B2"]["at_risk_volume_usd"]) == (1, 0, 0.0)


def test_kpis_fall_back_to_features(tx, features):
    transactions = tx(
        {"balance_paid": "10"}, {"balance_paid": "30", "trigger_at": None}, {"balance_paid": "50", "status": "PENDING"},
        {"intermediary_uuid": "B2", "status": "CANCELED"}, {"intermediary_uuid": ""})
    df = features(
        {"client_id": "a"}, {"client_id": "b", "broker_id": "B2", "avg_volume_usd": 10.0},
        {"client_id": "c", "broker_id": "B2", "avg_volume_usd": 20.0}, {"client_id": "d", "broker_id": "DIRECTO"})
    kpis = by_key(rep.broker_kpis(transactions, df), "broker_id")
    assert [kpis["B1"][c] for c in ("basis", "total_volume_usd", "avg_volume_usd", "transactions", "clients")] == [
        "transactions", 40.0, 20.0, 2, 1]
    assert [kpis["B2"][c] for c in ("basis", "total_volume_usd", "avg_volume_usd", "transactions", "clients")] == [
        "features", 2000.0, 15.0, 16, 2]
    assert kpis["DIRECTO"]["basis"] == "features"
    texts = by_key(rep.kpi_texts(rep.broker_kpis(transactions, df)), "broker_id")
    assert texts["B2"]["volume"] == "$2,000" and texts["B2"]["mean_ticket"] == "$15"


def test_activity_grid(tx, features):
    transactions = tx(
        {"trigger_at": "2025-06-30 12:00:00+00"}, {"trigger_at": "2025-06-23 12:30:00+00"},
        {"intermediary_uuid": "B3", "trigger_at": None}, {"intermediary_uuid": "B4"})
    df = features(
        {"client_id": "a"}, {"client_id": "b", "broker_id": "DIRECTO", "preferred_day": 6, "preferred_hour": 23},
        {"client_id": "c", "broker_id": "B3"})
    grid = rep.activity_grid(transactions, df)
    assert {r[0]: r[1] for r in grid.groupBy("broker_id").count().collect()} == {"B1": 168, "DIRECTO": 168, "B3": 168}
    filled = {(r["broker_id"], r["weekday"], r["hour"]): r["n"] for r in grid.where("n > 0").collect()}
    assert filled == {("B1", 0, 12): 2, ("DIRECTO", 6, 23): 1}     # B3 has transactions, none of them dated
    matrix = rep.activity_matrix(grid)
    assert matrix.count() == 21 and matrix.where("broker_id = 'B1' AND weekday = 0").first()["h12"] == 2


def test_monthly_volume_leaves_out_undated_rows(tx):
    rows = rep.monthly_volume(tx({}, {"balance_paid": "5"}, {"trigger_at": ""}, {"intermediary_uuid": None})).collect()
    assert [tuple(r) for r in rows] == [("B1", "2025-06", 105.0)]


def test_top_clients_break_ties_by_client(features):
    df = features(*[{"client_id": f"c{i}", "total_volume_usd": 5.0} for i in (3, 1, 2)], {"client_id": "c9", "total_volume_usd": 9.0})
    assert column(rep.top_clients(df, 3).orderBy("position"), "client_id") == ["c9", "c1", "c2"]


def test_opportunity_and_status_tables(features, spark):
    df = features({"segment": "en_riesgo", "total_volume_usd": 5.0}, {"client_id": "C2", "client_name": "Bo"})
    scores = spark.createDataFrame([("C1", 0.1235)], "client_id string, churn_probability double")
    shown = rep.opportunity_table(opps.detect(df, (1.0, 1.0)), scores)
    assert {r["client"]: r["churn_percent"] for r in shown.collect()} == {"Ana": 12.4, "Bo": None}
    status = by_key(rep.client_status(df, scores), "client_id")
    assert status["C2"]["best_contact"] == "Martes a las 09:00" and status["C2"]["segment"] == "Cliente Activo"
    assert set(column(rep.client_status(df), "churn_percent")) == {None}
    assert rep.overview(df, opps.detect(df, (1.0, 1.0))).first().asDict() == {"brokers": 1, "clients": 2, "at_risk": 1}


def test_segments_cover_every_client_once(features):
    df = features(*[{"client_id": f"c{i}", "segment": fv.SEGMENTS[i % 4]} for i in range(10)])
    assert sum(column(segment_counts(df), "clients")) == 10


def test_profile_of_empty_and_constant_volume(tx):
    constant = tx({"balance_paid": "100"}, {"balance_paid": "100"}, {"balance_paid": "0.5", "status": "X"})
    bins = {r["bin"]: r["n"] for r in profile.volume_histogram(constant).collect()}
    assert len(bins) == 50 and sum(bins.values()) == 2 and bins[25] == 2
    nothing = tx({"status": "X"})
    assert column(profile.volume_percentiles(nothing), "volume_usd") == [None] * 5


def test_histogram_closes_its_last_bin(tx):
    rows = [{"balance_paid": str(10 ** (i / 10))} for i in range(21)]
    bins = {r["bin"]: r["n"] for r in profile.volume_histogram(tx(*rows)).collect()}
    assert sum(bins.values()) == 21 and bins[49] >= 1 and bins[0] >= 1


def test_percentiles_exact_and_by_sketch(tx):
    df = tx(*[{"balance_paid": str(v)} for v in range(1, 102)])
    assert column(profile.volume_percentiles(df), "volume_usd") == [26.0, 51.0, 76.0, 96.0, 100.0]
    sketch = column(profile.volume_percentiles(df, approximate=True), "volume_usd")
    assert all(math.isclose(a, b, abs_tol=1) for a, b in zip(sketch, [26, 51, 76, 96, 100]))


def test_broker_tables_keep_raw_keys(tx):
    df = tx({}, {"intermediary_uuid": None}, {"intermediary_uuid": "", "balance_owner_uuid": "x"},
            {"intermediary_name": ""}, {"status": None})
    assert {r["intermediary_uuid"]: r["tx_count"] for r in profile.broker_volume(df).collect()} == {"B1": 1, "": 1}
    assert tuple(profile.universe(df).first()) == (2, 2, 3)
    status = {r["status"]: r["percent"] for r in profile.status_distribution(df).collect()}
    assert status == {"COMPLETED": 80.0}
    assert column(profile.top_brokers(profile.broker_clients(df), "n_clients", 1), "intermediary_uuid") == [""]
