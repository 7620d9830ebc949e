"""Client features of random messy books against plain Python over the same rows."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from bookpulse.operators.client_features import build_features
from bookpulse.operators.labels import churn_labels

START = datetime(2025, 1, 1)


def messy_rows(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        at = START + timedelta(seconds=rng.randint(0, 170 * 86400), microseconds=rng.choice([0, 0, 123456]))
        written = at.isoformat(sep=" ") + rng.choice(["+00", "+00:00"])
        rows.append({
            "balance_owner_uuid": rng.choice([None, *[f"customer-{c}" for c in range(9)], *["customer-hot"] * 6]),
            "balance_owner_name": rng.choice([None, "", "Ana", "Bo"]),
            "intermediary_uuid": rng.choice([None, "", "B1", "B2", "B3"]),
            "intermediary_name": rng.choice([None, "", "Uno", "Dos"]),
            "trigger_at": rng.choice([written] * 8 + [None, "", "nan", "not a date"]),
            "status": rng.choice(["COMPLETED"] * 4 + ["PENDING", None]),
            "balance_paid": rng.choice([f"{rng.uniform(0, 5000):.2f}"] * 6 + ["N/A", "", "NaN", "0", "-7", None]),
            "er_paid_to_usd": rng.choice([1e8, 2e8, 0.5e8, None]),
            "profit_spread_bps": rng.choice([None, 10e8, 35.5e8]),
            "minimum_spread": rng.choice([None, 4.0, 12.0]),
        })
    return rows


def moment(text):
    try:
        return datetime.fromisoformat(text.removesuffix("+00").removesuffix("+00:00"))
    except (AttributeError, ValueError):
        return None


def volume(row):
    try:
        paid = float(row["balance_paid"])
    except (TypeError, ValueError):
        return None
    if paid != paid or row["er_paid_to_usd"] is None:
        return None
    return paid * row["er_paid_to_usd"] / 1e8


def most_common(values):
    counts = Counter(values)
    return min(counts, key=lambda v: (-counts[v], v)) if counts else None


def earliest(pairs):
    """Name of the smallest (time, name); undated last; blank names skipped."""
    named = [(at or datetime.max, name) for at, name in pairs if name]
    return min(named)[1] if named else None


def mean(values):
    return sum(values) / len(values) if values else None


def slope(weekly):
    if len(weekly) < 2:
        return 0.0
    xm, ym = mean(list(weekly)), mean(list(weekly.values()))
    return sum((x - xm) * (y - ym) for x, y in weekly.items()) / sum((x - xm) ** 2 for x in weekly)


def expected(rows):
    ref = max(m for r in rows if (m := moment(r["trigger_at"])))
    groups = defaultdict(list)
    for r in rows:
        if r["balance_owner_uuid"]:
            groups[r["balance_owner_uuid"]].append(r)
    out = {}
    for client, mine in groups.items():
        at = [m for r in mine if (m := moment(r["trigger_at"]))]
        if not at:
            continue
        good = [r for r in mine if moment(r["trigger_at"]) and r["status"] == "COMPLETED" and (volume(r) or 0) > 0]
        weekly = defaultdict(float)
        for r in good:
            into = (moment(r["trigger_at"]) - (ref - timedelta(weeks=8))).total_seconds() / (7 * 86400)
            if into >= 0:
                weekly[int(into)] += volume(r)
        broker = most_common([r["intermediary_uuid"] for r in mine if r["intermediary_uuid"]])
        names = [(moment(r["trigger_at"]), r["intermediary_name"]) for r in mine if r["intermediary_uuid"] == broker]
        spread = mean([r["profit_spread_bps"] / 1e8 for r in good if r["profit_spread_bps"] is not None])
        minimum = mean([r["minimum_spread"] for r in good if r["minimum_spread"] is not None])
        gap = None if spread is None or minimum is None else spread - minimum
        out[client] = {
            "client_name": earliest([(moment(r["trigger_at"]), r["balance_owner_name"]) for r in mine]) or client[:8],
            "days_since_last_tx": (ref - max(at)).total_seconds() / 86400,
            "tx_count_total": len(at),
            "tx_count_30d": sum(a >= ref - timedelta(days=30) for a in at),
            "tx_count_90d": sum(a >= ref - timedelta(days=90) for a in at),
            "tx_count_completed": len(good),
            "success_rate": len(good) / len(at),
            "avg_volume_usd": mean([volume(r) for r in good]) or 0.0,
            "total_volume_usd": sum(volume(r) for r in good),
            "volume_trend": slope(weekly),
            "avg_spread_bps": spread if good else 0.0,
            "spread_vs_minimum": gap if good else 0.0,
            "preferred_hour": most_common([a.hour for a in at]),
            "preferred_day": most_common([a.weekday() for a in at]),
            "broker_id": broker or "DIRECTO",
            "broker_name": (earliest(names) or broker) if broker else "DIRECTO",
        }
    return ref, out


@pytest.mark.parametrize("seed", range(6))
def test_features(tx, seed):
    rows = messy_rows(seed)
    _, want = expected(rows)
    got = {r["client_id"]: r.asDict() for r in build_features(tx(*rows).repartition(5)).collect()}
    assert set(got) == set(want)
    for client, values in want.items():
        for name, value in values.items():
            if isinstance(value, float):
                assert got[client][name] == pytest.approx(value, rel=1e-9, abs=1e-6), (client, name)
            else:
                assert got[client][name] == value, (client, name)


@pytest.mark.parametrize("seed", range(3))
def test_labels(tx, seed):
    rows = messy_rows(seed, 120)
    ref, _ = expected(rows)
    cutoff, want = ref - timedelta(days=90), {}
    for client in {r["balance_owner_uuid"] for r in rows} - {None}:
        at = [m for r in rows if r["balance_owner_uuid"] == client and (m := moment(r["trigger_at"]))]
        if sum(a < cutoff for a in at) >= 2:
            want[client] = int(all(a < cutoff for a in at))
    assert {r["client_id"]: r["churned"] for r in churn_labels(tx(*rows)).collect()} == want
