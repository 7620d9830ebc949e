"""Distinct clients that add up: bitmaps of dense client numbers per broker, status and month.

A distinct count cannot be added to another one, a set can. Clients get dense numbers, those of
one broker next to each other, so that a broker's set is a few bitmaps of 32,768 bits. Counts
over any choice of brokers, statuses and months are the bits of the united bitmaps: exact, from
one small table, without another look at the transactions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookpulse.fixed_values import COMPLETED
from bookpulse.functions.running import row_numbers
from bookpulse.session import stage

BROKER = ("intermediary_uuid", "intermediary_name")
CELL = (*BROKER, "status", "month", "has_broker")
COUNTS = ("transactions", "dated", "valid")


def client_cells(tx: DataFrame) -> DataFrame:
    """Counts per cell and client: one scan, one hash aggregate."""
    return tx.groupBy(*CELL, F.col("balance_owner_uuid").alias("client")).agg(
        F.count(F.lit(1)).alias("transactions"), F.count("trigger_at_dt").alias("dated"),
        F.count_if("is_valid_completed").alias("valid"),
    )


def client_numbers(cells: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """client and number, dense from 0; clients of one broker are neighbours.

    With ``known`` numbers further clients get the numbers after them.
    """
    clients = cells.where(F.col("client").isNotNull()).groupBy("client").agg(F.min(BROKER[0]).alias("first_broker"))
    begin: Column = F.lit(0).cast("bigint")
    if known is not None:
        clients = clients.join(known, "client", "left_anti")
        begin = F.coalesce(known.agg(F.max("number") + 1).scalar(), F.lit(0))
    order = [F.col("first_broker").asc_nulls_last(), F.col("client")]
    found = row_numbers(clients, [], order, "number").select("client", (F.col("number") - 1 + begin).alias("number"))
    return found if known is None else known.unionByName(found)


def client_sets(cells: DataFrame, numbers: DataFrame) -> DataFrame:
    """Per cell and bucket of numbers: the counts, and the clients as a bitmap (none for rows without a client)."""
    number = F.col("number")
    return (
        cells.join(numbers, "client", "left")
        .groupBy(*CELL, F.bitmap_bucket_number(number).alias("bucket"))
        .agg(*[F.sum(c).alias(c) for c in COUNTS], F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("clients"))
    )


def sets_of(tx: DataFrame) -> DataFrame:
    """``client_sets`` of a transaction table, which is read once."""
    cells = stage(client_cells(tx), "client-cells")
    return client_sets(cells, client_numbers(cells))


def merged(*sets: DataFrame) -> DataFrame:
    """The sets of several tables, made with the same numbers."""
    whole = sets[0]
    for more in sets[1:]:
        whole = whole.unionByName(more)
    return _united(whole, CELL)


def _united(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sets.groupBy(*keys, "bucket").agg(
        *[F.sum(c).alias(c) for c in COUNTS], F.bitmap_or_agg("clients").alias("clients"))


def counts_by(sets: DataFrame, *keys: str) -> DataFrame:
    """Distinct clients and the counts per ``keys`` (none: over all), from the united bitmaps."""
    return _united(sets, keys).groupBy(*keys).agg(
        F.coalesce(F.sum(F.bitmap_count("clients")), F.lit(0)).alias("clients"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS],
    )


def _completed_with_broker(sets: DataFrame) -> DataFrame:
    return sets.where(F.col("has_broker") & (F.col("status") == COMPLETED))


def load_quality(sets: DataFrame) -> DataFrame:
    """Rows, dated, valid completed, with broker, distinct clients."""
    with_broker = sets.where("has_broker").agg(F.coalesce(F.sum("transactions"), F.lit(0))).scalar()
    return counts_by(sets).select(
        F.col("transactions").alias("row_count"), "dated", F.col("valid").alias("valid_completed"),
        with_broker.alias("with_broker"), "clients",
    )


def universe(sets: DataFrame) -> DataFrame:
    """Distinct brokers and clients, and rows, among completed rows with a broker."""
    own = _completed_with_broker(sets)
    brokers = own.agg(F.count_distinct("intermediary_uuid")).scalar()
    return counts_by(own).select(brokers.alias("brokers"), "clients", "transactions")


def broker_clients(sets: DataFrame, *more: str) -> DataFrame:
    """Distinct clients per broker id and name (and ``more``, as the month)."""
    own = _completed_with_broker(sets).dropna(subset=list(BROKER))
    return counts_by(own, *BROKER, *more).select(*BROKER, *more, F.col("clients").alias("n_clients"))
