"""Time the steps of a full run and every report; prints one JSON line.

The book is built from the raw test tables into a new folder, step by step, so each
number is real work: later steps read the tables that earlier steps wrote.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession

from bookpulse.operators import churn_model, client_sets, metrics, profile
from bookpulse.plans.client_book import ClientBook
from bookpulse.session import prepare, work_folder
from bookpulse.sources.tables import type_raw
from checks.book import fixed_scores, raw_transactions

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ROUNDS = int(os.environ.get("BENCH_ROUNDS", churn_model.ROUNDS))


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = prepare(
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    book = ClientBook(
        spark, f"{work_folder(spark)}/bench-{uuid.uuid4().hex[:8]}",
        type_raw(raw_transactions(spark, SF_DIR)), rounds=ROUNDS,
    )
    spent: dict[str, float] = {}

    def timed(name: str, step) -> None:
        start = time.perf_counter()
        result = step()
        if isinstance(result, DataFrame):
            run(result)
        spent[name] = round(time.perf_counter() - start, 3)

    # First load: raw tables to features and opportunities.
    timed("build_transactions", lambda: book.transactions)
    timed("build_features", lambda: book.features)
    timed("build_opportunities", lambda: book.opportunities)
    timed("build_labels", lambda: book.churn_labels)
    timed("write_messages_all_brokers", book.write_messages)
    timed("write_messages_one_broker", lambda: book.write_messages("B001"))
    timed(f"fit_churn_model_{ROUNDS}_rounds", lambda: book.model and None)
    timed(f"cross_validate_{ROUNDS}_rounds", lambda: book.validated)
    timed("score_clients", lambda: book.churn_scores)
    timed("churn_report", lambda: book.churn_report)
    def reopened() -> DataFrame:
        """The same rows again: a digest, and no table is built."""
        return ClientBook(spark, book.folder, type_raw(raw_transactions(spark, SF_DIR)), rounds=ROUNDS).features

    def at_cutoffs() -> DataFrame:
        last = book.reference_date_value()
        return book.features_at([last - timedelta(days=d) for d in (0, 15, 45, 90, 150)])

    timed("reopen_unchanged", reopened)
    timed("features_at_5_cutoffs", at_cutoffs)
    timed("client_sets", lambda: book.client_sets)
    timed("clients_per_broker_and_month", lambda: client_sets.broker_clients(book.client_sets, "month"))
    timed("profile_report", lambda: profile.profile_report(book.transactions))
    scored = fixed_scores(book.features).join(book.churn_labels, "client_id")
    timed("ranking_metrics", lambda: metrics.ranking_metrics(scored))
    for name, report in book.reports().items():
        timed(name, lambda report=report: report)

    print(json.dumps({
        "metric": "full run: build, messages, model fit, folds, scores and all reports",
        "value": round(sum(spent.values()), 3),
        "unit": "sec",
        "queries": spent,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "first_load_sec": round(sum(v for k, v in spent.items() if k.startswith("build_") and k != "build_labels"), 3),
        "transactions": book.transactions.count(),
    }))


if __name__ == "__main__":
    main()
