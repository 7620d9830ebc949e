"""The physical plans that decide whether a step survives large data."""

import io
from contextlib import redirect_stdout

import pytest

from bookpulse.operators import broker_reports as rep
from bookpulse.operators import opportunities as opps
from bookpulse.operators import profile
from bookpulse.operators.client_features import _measures, build_features
from bookpulse.operators.cleaning import reference_date
from bookpulse.operators.labels import churn_labels
from bookpulse.operators.rfm import add_rfm
from checks.book import book


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def b(spark):
    return book(spark, "/root/testdata/sf0.001")


def test_measures_are_one_hash_aggregate_and_one_shuffle(b):
    text = plan(_measures(b.transactions, reference_date(b.transactions)))
    main = text.split("===== Subqueries")[0]
    assert main.split("\n(1)")[0].count("Exchange") == 1
    assert "SortAggregate" not in main and "ObjectHashAggregate" not in main
    read = main.split("ReadSchema: ")[1].splitlines()[0]
    assert "status" not in read and "trigger_at_dt" in read


def test_no_nested_loops_or_cartesian_products(b):
    limits = opps.volume_limits(b.features)
    for df in (
        build_features(b.transactions), churn_labels(b.transactions), opps.detect(b.features, limits),
        rep.broker_kpis(b.transactions, b.features), rep.activity_grid(b.transactions, b.features),
        rep.overview(b.features, b.opportunities),
    ):
        text = plan(df)
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_scores_compare_with_constants_in_one_stage(b):
    text = plan(add_rfm(b.features.drop("R", "F", "M", "rfm_score", "segment")))
    assert "Exchange" not in text and "Join" not in text


def test_top_k_is_limited_before_the_shuffle(b):
    for df in (rep.top_clients(b.features), opps.preview(b.opportunities)):
        steps = plan(df).split("\n(1)")[0]
        assert steps.count("WindowGroupLimit") == 2
        assert steps.rindex("WindowGroupLimit") > steps.rindex("Exchange")


def test_filters_reach_the_scan(b):
    text = plan(rep.monthly_volume(b.transactions))
    assert "EqualTo(status,COMPLETED)" in text and "GreaterThan(volume_usd,0.0)" in text


def test_profile_scans_the_transactions_twice(b, monkeypatch):
    written = []
    keep = profile.stage
    monkeypatch.setattr(profile, "stage", lambda df, name: written.append(plan(df)) or keep(df, name))
    report = plan(profile.profile_report(b.transactions))
    assert len(written) == 2 and all(text.count("Location: ") == text.count("/transactions]") == 1 for text in written)
    assert "/transactions]" not in report
    assert "NestedLoop" not in report and "Cartesian" not in report


def test_totals_are_read_from_cells(b):
    """Two scans, of clients and of opportunities, serve all reports of totals."""
    found = b.reports()
    for name in ("broker_card", "distributions", "overview", "opportunity_totals", "broker_kpis"):
        text = plan(found[name])
        assert f"{b.folder}/features" not in text and f"{b.folder}/opportunities" not in text, name
        assert "client_cells" in text or "opportunity_cells" in text, name
    for cells, table in ((rep.client_cells(b.features), "features"), (rep.opportunity_cells(b.opportunities), "opportunities")):
        text = plan(cells)
        assert text.count("Scan parquet") == 2 and f"{b.folder}/{table}" in text  # the plan's tree, and its details
        assert "SortAggregate" not in text and "ObjectHashAggregate" not in text
    assert b.spark.read.parquet(f"{b.folder}/client_cells").count() <= 4 * b.features.select("broker_id").distinct().count()
