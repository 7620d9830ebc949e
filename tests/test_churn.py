import random

import pytest
from conftest import by_key, column
from pyspark.sql import functions as F

from bookpulse import fixed_values as fv
from bookpulse.operators import churn_model, labels, metrics
from bookpulse.session import stage
from bookpulse.sources import tables


def test_labels(tx):
    old, older, at_cutoff = "2025-01-02 00:00:00+00", "2025-01-01 00:00:00+00", "2025-04-01 12:00:00+00"
    rows = [
        {"balance_owner_uuid": "ref"},
        {"balance_owner_uuid": "one past", "trigger_at": old},
        *[{"balance_owner_uuid": "gone", "trigger_at": t, "status": "PENDING"} for t in (old, older)],
        *[{"balance_owner_uuid": "active", "trigger_at": t} for t in (old, older, at_cutoff)],
        *[{"balance_owner_uuid": "undated", "trigger_at": t} for t in (old, None, "bad")],
    ]
    found = labels.churn_labels(tx(*rows))
    assert {r["client_id"]: r["churned"] for r in found.collect()} == {"gone": 1, "active": 0}
    assert tuple(labels.label_summary(found).first()) == (2, 1, 1, 50.0)


@pytest.mark.parametrize(
    ("p", "label"),
    [(0.0, "Bajo"), (0.3, "Bajo"), (0.30001, "Medio"), (0.6, "Medio"), (0.8, "Alto"), (0.80001, "Crítico"), (1.0, "Crítico")],
)
def test_risk_labels(spark, p, label):
    assert spark.range(1).select(labels.risk_label(F.lit(p))).first()[0] == label


@pytest.mark.parametrize(("p", "score"), [(0.005, 0), (0.015, 2), (0.025, 2), (0.994, 99), (1.0, 100)])
def test_churn_score_is_half_even(spark, p, score):
    assert spark.range(1).select(labels.churn_score(F.lit(p))).first()[0] == score


def test_risk_counts_list_every_label(spark):
    df = spark.createDataFrame([("Bajo",), ("Bajo",), ("Alto",)], "risk_label string")
    assert {r[0]: r[1] for r in labels.risk_counts(df).collect()} == {"Bajo": 2, "Medio": 0, "Alto": 1, "Crítico": 0}


@pytest.fixture(scope="module")
def scored_rows():
    rng = random.Random(9)
    return [(f"c{i}", int(rng.random() < 0.4), round(rng.random(), 2)) for i in range(400)]


@pytest.fixture(scope="module")
def scored(spark, scored_rows):
    return spark.createDataFrame(scored_rows, "client_id string, churned int, churn_probability double").repartition(5)


def test_roc_auc_counts_ordered_pairs(scored, scored_rows):
    pos = [p for _, y, p in scored_rows if y]
    neg = [p for _, y, p in scored_rows if not y]
    pairs = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert metrics.roc_auc(scored).first()[0] == pytest.approx(pairs / (len(pos) * len(neg)), abs=1e-12)


def test_average_precision_is_step_wise(scored, scored_rows):
    positives, total, last = sum(y for _, y, _ in scored_rows), 0.0, 0.0
    for t in sorted({p for _, _, p in scored_rows}, reverse=True):
        called = [y for _, y, p in scored_rows if p >= t]
        recall = sum(called) / positives
        total += (recall - last) * sum(called) / len(called)
        last = recall
    assert metrics.average_precision(scored).first()[0] == pytest.approx(total, abs=1e-12)


def test_classification_report(scored, scored_rows):
    lines = by_key(metrics.classification_report(scored), "line")
    called = [(y, int(p > 0.5)) for _, y, p in scored_rows]
    tp = sum(a and b for a, b in called)
    precision, recall = tp / sum(b for _, b in called), tp / sum(a for a, _ in called)
    assert lines["Churned"]["precision"] == pytest.approx(precision)
    assert lines["Churned"]["recall"] == pytest.approx(recall)
    assert lines["Churned"]["f1"] == pytest.approx(2 * precision * recall / (precision + recall))
    assert lines["accuracy"]["f1"] == pytest.approx(sum(a == b for a, b in called) / 400)
    assert lines["Activo"]["support"] + lines["Churned"]["support"] == lines["macro avg"]["support"] == 400


def test_report_with_one_class_nobody_was_called(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.2)], "churned int, churn_probability double")
    lines = by_key(metrics.classification_report(df), "line")
    assert (lines["Churned"]["precision"], lines["Churned"]["f1"], lines["accuracy"]["precision"]) == (0.0, 0.0, 0.5)


def test_folds_split_each_class_evenly(scored):
    folded = metrics.stratified_folds(scored.drop("churn_probability"))
    assert folded.count() == folded.select("client_id").distinct().count() == 400
    counts = folded.groupBy("churned").pivot("fold").count().collect()
    for row in counts:
        sizes = list(row.asDict().values())[1:]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    again = metrics.stratified_folds(scored.drop("churn_probability").repartition(3))
    assert folded.exceptAll(again).count() == 0


@pytest.fixture(scope="module")
def training(spark):
    rng = random.Random(1)
    rows = []
    for i in range(160):
        gone = i % 3 == 0
        values = [rng.random() + (0.8 if gone else 0.0) for _ in fv.MODEL_FEATURES]
        rows.append((f"c{i:03d}", int(gone), "n", "B", "Bn", "s", *values))
    schema = "client_id string, churned int, client_name string, broker_id string, broker_name string, segment string, "
    df = spark.createDataFrame(rows, schema + ", ".join(f"{c} double" for c in fv.MODEL_FEATURES))
    return stage(df.coalesce(2), "training")


def test_model_learns_and_is_deterministic(training, spark, tmp_path):
    model = churn_model.fit(training, rounds=4)
    scores = churn_model.score_clients(model, training)
    again = churn_model.score_clients(churn_model.fit(training, rounds=4), training)
    assert scores.exceptAll(again).count() == 0
    rows = scores.join(training.select("client_id", "churned"), "client_id")
    assert rows.where("churn_probability < 0 OR churn_probability > 1").count() == 0
    assert metrics.roc_auc(rows).first()[0] > 0.95

    path = str(tmp_path / "model")
    tables.save_model(model, path)
    loaded, inputs = tables.load_model(path)
    assert inputs == list(fv.MODEL_FEATURES)
    assert scores.exceptAll(churn_model.score_clients(loaded, training)).count() == 0

    weights = column(churn_model.importances(model), "importance")
    assert sum(weights) == pytest.approx(1.0) and weights == sorted(weights, reverse=True)
    assert [r["churn_score"] for r in churn_model.top_risk(scores, 3).collect()] == sorted(
        column(scores, "churn_score"), reverse=True)[:3]


def test_every_client_is_scored_out_of_fold(training):
    out = churn_model.cross_validated(training, rounds=2)
    assert out.count() == out.select("client_id").distinct().count() == 160
    assert metrics.roc_auc(out).first()[0] > 0.8


def test_missing_inputs_become_zero(features):
    df = churn_model.fill_features(features({"avg_spread_bps": None, "spread_vs_minimum": None}))
    assert tuple(df.select("avg_spread_bps", "spread_vs_minimum").first()) == (0.0, 0.0)
