"""The whole book, step by step, as tables in one folder."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookpulse import schemas
from bookpulse.operators import broker_reports, churn_model, client_sets, daily_state, labels, messages, opportunities, rfm
from bookpulse.operators.boosting import BoostedTrees
from bookpulse.operators.cleaning import clean
from bookpulse.operators.client_features import build_features
from bookpulse.session import prepare, stage
from bookpulse.sources import lineage, tables


# What later steps read; the other raw columns are not written again.
TRANSACTION_COLUMNS = (
    "balance_owner_uuid", "balance_owner_name", "intermediary_uuid", "intermediary_name", "trigger_at",
    "status", "profit_spread_bps", "minimum_spread", "bp_num", "volume_usd", "spread_bps",
    "trigger_at_dt", "broker_id_clean", "broker_name_clean", "client_name_clean", "has_broker",
    "is_valid_completed", "month", "hour", "weekday",
)


# What each table is built from; the messages of former runs are kept.
BUILT_FROM = {
    "transactions": ("raw",),
    "reference_date": ("transactions",),
    "features": ("transactions", "reference_date"),
    "opportunities": ("features",),
    "daily_state": ("transactions",),
    "daily_names": ("transactions",),
    "client_cells": ("features",),
    "opportunity_cells": ("opportunities",),
    "client_sets": ("transactions",),
    "churn_labels": ("transactions", "reference_date"),
    "churn_training": ("features", "churn_labels"),
    "churn_validated": ("churn_training",),
    "churn_model": ("churn_training",),
    "churn_scores": ("churn_model", "features"),
    "churn_report": (
        "features", "churn_labels", "churn_validated", "churn_model", "churn_scores", "reference_date",
    ),
}


def scored_features(tx: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Client features with segments.

    The features are written once before the quartile edges are taken, so edges and rows
    come from the same numbers and the transactions are scanned once.
    """
    return rfm.add_rfm(stage(build_features(tx, as_of), "features"))


@dataclass
class ClientBook:
    """Tables of one book under ``folder``; each is built when first asked for.

    A stored table is read if it was built from the same raw rows with the same settings,
    and built anew otherwise, with all that follows from it. Raw rows are compared by an
    order-free digest: one scan per ``ClientBook``, or none where the transactions are built
    in any case. Without ``raw`` the stored transactions stand for it. ``replace`` removes
    all derived tables first.
    """

    spark: SparkSession
    folder: str
    raw: DataFrame | None = None
    rounds: int = churn_model.ROUNDS
    company: str = messages.COMPANY
    extra_columns: tuple[str, ...] = ()
    day_first: bool = False
    replace: bool = False
    _recipes: dict[str, str] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        prepare(self.spark)
        if self.replace:
            self._raw()
            for name in BUILT_FROM:
                tables.remove(self.spark, f"{self.folder}/{name}")

    def _settings(self, name: str) -> dict[str, object]:
        """What shapes a table besides its inputs."""
        if name == "transactions":
            return {"columns": [*self.extra_columns, *TRANSACTION_COLUMNS], "day_first": self.day_first}
        if name in ("churn_validated", "churn_model"):
            return {"rounds": self.rounds}
        return {}

    def _recipe(self, name: str) -> str:
        if name == "transactions":
            _ = self.transactions  # compared with the raw rows, or built, at the first call
        elif name not in self._recipes:
            inputs = {x: lineage.short(self._recipe(x)) for x in BUILT_FROM[name]}
            self._recipes[name] = lineage.recipe(name, inputs, self._settings(name))
        return self._recipes[name]

    def _table(self, name: str, builder) -> DataFrame:
        return tables.get_or_build(self.spark, f"{self.folder}/{name}", builder, self._recipe(name))

    @property
    def transactions(self) -> DataFrame:
        """Cleaned transactions: the one table every later step reads."""
        path = f"{self.folder}/transactions"
        if "transactions" not in self._recipes:
            self._recipes["transactions"] = self._current_transactions(path)
        return self.spark.read.parquet(path)

    def _current_transactions(self, path: str) -> str:
        """The recipe of the stored transactions, after they have been built anew if need be."""
        stored = lineage.stored_recipe(self.spark, path) if tables.exists(self.spark, path) else None
        if self.raw is None:
            if not tables.exists(self.spark, path):
                self._raw()
            return stored or lineage.recipe("transactions", {"raw": "not known"})
        read = [*(f.name for f in schemas.RAW_TRANSACTIONS), *self.extra_columns]

        def recipe(digest: str) -> str:
            return lineage.recipe("transactions", {"raw": digest}, self._settings("transactions"))

        if stored is not None and stored == (now := recipe(lineage.table_digest(self.raw, read))):
            return now
        raw, digest = lineage.observed(self.raw.select(*read), read)
        tables.write_table(clean(raw, self.day_first).select(*self.extra_columns, *TRANSACTION_COLUMNS), path)
        lineage.store_recipe(self.spark, path, now := recipe(digest()))
        return now

    @property
    def reference_date(self) -> Column:
        """Latest valid time, kept as a one-row table so that steps need not scan for it."""
        kept = self._table(
            "reference_date", lambda: self.transactions.agg(F.max("trigger_at_dt").alias("at"))
        )
        return kept.scalar()

    def reference_date_value(self) -> date:
        """The day of the latest valid time."""
        _ = self.reference_date  # built if need be
        return self.spark.read.parquet(f"{self.folder}/reference_date").first()["at"].date()

    @property
    def features(self) -> DataFrame:
        return self._table("features", lambda: scored_features(self.transactions, self.reference_date))

    def features_at(self, cutoffs: Sequence[date]) -> DataFrame:
        """Features known at the beginning of each of these days, from the stored daily state."""
        state = self._table("daily_state", lambda: daily_state.daily_state(self.transactions))
        names = self._table("daily_names", lambda: daily_state.daily_names(self.transactions))
        return daily_state.features_at(state, names, cutoffs)

    @property
    def client_sets(self) -> DataFrame:
        """Clients per broker, status and month as bitmaps, for distinct counts over any of them."""
        return self._table("client_sets", lambda: client_sets.sets_of(self.transactions))

    @property
    def opportunities(self) -> DataFrame:
        """Opportunities in listing order (a range sort: large brokers span several files)."""
        return self._table(
            "opportunities",
            lambda: opportunities.detect(self.features).orderBy(*opportunities.listing_order()),
        )

    @property
    def churn_labels(self) -> DataFrame:
        return self._table("churn_labels", lambda: labels.churn_labels(self.transactions, as_of=self.reference_date))

    @property
    def training(self) -> DataFrame:
        return self._table(
            "churn_training", lambda: churn_model.training_set(self.features, self.churn_labels)
        )

    @property
    def validated(self) -> DataFrame:
        return self._table(
            "churn_validated", lambda: churn_model.cross_validated(self.training, self.rounds)
        )

    @property
    def model(self) -> BoostedTrees:
        path, recipe = f"{self.folder}/churn_model", self._recipe("churn_model")
        if not tables.is_current(self.spark, path, recipe, "/metadata"):
            tables.save_model(churn_model.fit(self.training, self.rounds), path)
            lineage.store_recipe(self.spark, path, recipe)
        return tables.load_model(path)[0]

    @property
    def churn_scores(self) -> DataFrame:
        """Scores of all clients, highest risk first."""
        return self._table(
            "churn_scores",
            lambda: churn_model.score_clients(self.model, self.features).orderBy(
                F.desc("churn_probability"), "client_id"
            ),
        )

    @property
    def churn_report(self) -> DataFrame:
        return self._table(
            "churn_report",
            lambda: churn_model.churn_report(
                self.features, self.churn_labels, self.validated, self.model, self.churn_scores, self.reference_date
            ).coalesce(1),
        )

    def write_messages(self, broker_id: str | None = None, outside_texts: DataFrame | None = None) -> DataFrame:
        """Render and store the messages of one broker, or of all; returns what is stored."""
        chosen = self.opportunities
        if broker_id is not None:
            chosen = chosen.where(F.col("broker_id") == broker_id)
        path = f"{self.folder}/messages"
        tables.upsert_messages(messages.messages(chosen, outside_texts, self.company), path)
        return tables.read_messages_or_empty(self.spark, path)

    def reports(self) -> dict[str, DataFrame]:
        """Every broker report, with churn columns where scores have been stored.

        Totals over clients and opportunities come from two written tables of cells.
        """
        scores = tables.read_scores_or_empty(self.spark, f"{self.folder}/churn_scores")
        tx, features, found = self.transactions, self.features, self.opportunities
        status = broker_reports.client_status(features, scores)
        clients = self._table("client_cells", lambda: broker_reports.client_cells(features))
        offers = self._table("opportunity_cells", lambda: broker_reports.opportunity_cells(found))
        kpis = broker_reports.kpis_of(tx, clients)
        return {
            "opportunity_table": broker_reports.opportunity_table(found, scores),
            "broker_card": broker_reports.card_of(clients, offers),
            "broker_kpis": kpis,
            "kpi_texts": broker_reports.kpi_texts(kpis),
            "distributions": broker_reports.distributions_of(clients, offers),
            "top_clients": broker_reports.top_clients(features),
            "monthly_volume": broker_reports.monthly_volume(tx),
            "activity_grid": broker_reports.activity_grid(tx, features),
            "client_status": broker_reports.by_recency(status),
            "overview": broker_reports.overview_of(clients, offers),
            "opportunity_totals": broker_reports.totals_of(offers),
        }

    def _raw(self) -> DataFrame:
        if self.raw is None:
            raise ValueError("no raw transactions given and none stored")
        return self.raw
