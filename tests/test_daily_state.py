"""Features at many midnights from the daily state, against features of the transactions."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from bookpulse.operators import daily_state
from bookpulse.operators.client_features import build_features_before
from bookpulse.session import stage


@pytest.fixture(scope="module")
def random_rows():
    r = random.Random(3)
    rows = []
    for i in range(900):
        c = r.randrange(12) if r.random() < 0.6 else 0  # a third of all rows and more belong to one client
        rows.append({
            "balance_owner_uuid": None if r.random() < 0.03 else f"client-{c:04d}",
            "balance_owner_name": r.choice(["Ana", "Ana B", "", None]),
            "intermediary_uuid": r.choice(["B1", "B2", "B2", "", None]), "intermediary_name": r.choice(["One", "Two", "", None]),
            "trigger_at": r.choice(["", None, "bad"]) if r.random() < 0.05 else
            f"2025-{r.randrange(1, 7):02d}-{r.randrange(1, 29):02d} {r.choice([0, 0, 9, 23]):02d}:{r.choice([0, 59]):02d}:00+00",
            "status": r.choice(["COMPLETED", "COMPLETED", "PENDING"]), "balance_paid": r.choice(["10.55", "1234567.891", "0", "-3", "N/A", "1e19"]),
            "er_paid_to_usd": r.choice([1e8, 3.3e7, None]), "profit_spread_bps": r.choice([30e8, 7.7e7, None]),
            "minimum_spread": r.choice([10.0, 0.25, None]),
        })
    return rows


CUTOFFS = [date(2025, 1, 1), date(2025, 2, 15), date(2025, 4, 1), date(2025, 4, 2), date(2025, 6, 20), date(2025, 12, 1)]


def expected(tx):
    parts = [
        build_features_before(tx, F.lit(datetime(c.year, c.month, c.day)).cast("timestamp")).select(F.lit(c).alias("cutoff"), "*")
        for c in CUTOFFS
    ]
    return sorted(map(str, [r for p in parts for r in p.collect()]))


def test_features_at_each_cutoff(tx, random_rows):
    cleaned = stage(tx(*random_rows), "tx")
    state, names = stage(daily_state.daily_state(cleaned), "state"), stage(daily_state.daily_names(cleaned), "names")
    found = daily_state.features_at(state, names, CUTOFFS)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2  # each state once, however many cutoffs
    want = expected(cleaned)
    assert sorted(map(str, found.collect())) == want and len(want) > 40
    assert daily_state.features_at(state, names, []).columns == found.columns
    assert daily_state.features_at(state, names, []).count() == 0


def test_late_rows_and_further_days_add_up(tx, random_rows):
    """Three tables whose days overlap, merged in any order, equal one."""
    shuffled = random_rows[:]
    random.Random(4).shuffle(shuffled)
    slices = [tx(*shuffled[i::3]) for i in range(3)]
    states = [daily_state.daily_state(s) for s in slices]
    names = [daily_state.daily_names(s) for s in slices]
    found = daily_state.features_at(
        daily_state.merged_state(states[2], daily_state.merged_state(states[0], states[1])),
        daily_state.merged_names(*names[::-1]), CUTOFFS)
    assert sorted(map(str, found.collect())) == expected(tx(*random_rows))


def test_state_of_nothing(tx):
    none = tx({}).where("false")
    state, names = daily_state.daily_state(none), daily_state.daily_names(none)
    assert state.count() == 0 and daily_state.features_at(state, names, CUTOFFS).count() == 0
    undated = tx({"trigger_at": None}, {"balance_owner_uuid": None})
    assert daily_state.features_at(daily_state.daily_state(undated), daily_state.daily_names(undated), CUTOFFS).count() == 0


def test_book_keeps_the_state(spark, raw, tmp_path):
    from bookpulse.plans.client_book import ClientBook

    rows = [{"balance_owner_uuid": f"client-{c:04d}", "trigger_at": f"2025-0{m}-03 10:00:00+00"} for c in range(4) for m in (1, 2, 5)]
    book = ClientBook(spark, str(tmp_path / "book"), raw(*rows))
    counts = {str(r.cutoff): r["count"] for r in book.features_at([date(2025, 2, 1), date(2025, 6, 1)]).groupBy("cutoff").count().collect()}
    assert counts == {"2025-02-01": 4, "2025-06-01": 4}
    assert book.features_at([date(2025, 6, 1)]).agg(F.sum("tx_count_90d")).first()[0] == 4
