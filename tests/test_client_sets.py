"""Distinct counts from bitmaps against counts of the transactions."""

import random

import pytest
from pyspark.sql import functions as F

from bookpulse.operators import client_sets, profile
from bookpulse.session import stage


@pytest.fixture(scope="module")
def rows():
    r = random.Random(21)
    return [
        {"balance_owner_uuid": None if r.random() < 0.05 else f"client-{r.randrange(90):04d}",
         "intermediary_uuid": r.choice(["B1", "B2", "B3", "", None]), "intermediary_name": r.choice(["One", "Two", "", None]),
         "status": r.choice(["COMPLETED", "PENDING", None]), "trigger_at": r.choice(["", f"2025-0{r.randrange(1, 7)}-10 10:00:00+00"]),
         "balance_paid": r.choice(["5", "0", "N/A"])}
        for _ in range(700)
    ]


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def test_counts_equal_those_of_the_rows(tx, rows):
    cleaned = stage(tx(*rows), "tx")
    sets = stage(client_sets.sets_of(cleaned), "sets")
    assert same(client_sets.load_quality(sets), profile.load_quality(cleaned))
    assert same(client_sets.universe(sets), profile.universe(cleaned))
    assert same(client_sets.broker_clients(sets), profile.broker_clients(cleaned))
    for keys in (("status",), ("month",), ("status", "month"), ("intermediary_uuid", "month")):
        want = cleaned.groupBy(*keys).agg(F.count_distinct("balance_owner_uuid").alias("clients"), F.count("*").alias("transactions"))
        assert same(client_sets.counts_by(sets, *keys).select(*keys, "clients", "transactions"), want)


def test_numbers_are_dense_and_brokers_are_neighbours(tx, rows):
    cells = stage(client_sets.client_cells(tx(*rows)), "cells")
    numbers = client_sets.client_numbers(cells).collect()
    assert sorted(r.number for r in numbers) == list(range(len(numbers))) and len({r.client for r in numbers}) == len(numbers)
    first = {r.client: r.b for r in cells.groupBy("client").agg(F.min("intermediary_uuid").alias("b")).collect()}
    order = [first[r.client] for r in sorted(numbers, key=lambda r: r.number)]
    assert sum(a != b for a, b in zip(order, order[1:])) == len(set(order)) - 1


def test_sets_of_several_tables_add_up(tx, rows):
    whole = stage(tx(*rows), "tx")
    parts = [stage(client_sets.client_cells(tx(*rows[i::3])), "cells") for i in range(3)]
    numbers = None
    for cells in parts:  # numbers grow as clients appear
        numbers = stage(client_sets.client_numbers(cells, numbers), "numbers")
    sets = client_sets.merged(*[client_sets.client_sets(c, numbers) for c in parts])
    assert same(client_sets.load_quality(sets), profile.load_quality(whole))
    assert same(client_sets.broker_clients(sets, "month").groupBy(*profile.BROKER).agg(F.max("n_clients").alias("n")).where("n > 0"),
                client_sets.broker_clients(client_sets.sets_of(whole), "month").groupBy(*profile.BROKER).agg(F.max("n_clients").alias("n")).where("n > 0"))


def test_plans_expand_nothing(tx, rows):
    sets = stage(client_sets.sets_of(tx(*rows)), "sets")
    for df in (client_sets.load_quality(sets), client_sets.universe(sets), client_sets.broker_clients(sets, "month")):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in text and "Join" not in text
    none = client_sets.sets_of(tx({}).where("false"))
    assert tuple(client_sets.load_quality(none).first()) == (0, 0, 0, 0, 0) and tuple(client_sets.universe(none).first()) == (0, 0, 0)
