"""Run one step of a book: ``spark-submit --py-files ... bookpulse`` or ``python -m bookpulse``.

    python -m bookpulse features --input raw.parquet --folder book
    python -m bookpulse messages --folder book --broker B001
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from bookpulse.operators import broker_reports, churn_model, messages, profile
from bookpulse.plans.client_book import ClientBook
from bookpulse.session import drop_stages, prepare
from bookpulse.sources import tables


def _profile(book: ClientBook, _: argparse.Namespace) -> DataFrame:
    return profile.profile_report(book.transactions)


def _churn(book: ClientBook, _: argparse.Namespace) -> DataFrame:
    book.churn_report.show(100, truncate=False)
    return churn_model.top_risk(book.churn_scores)


def _messages(book: ClientBook, args: argparse.Namespace) -> DataFrame:
    broker = args.broker or broker_reports.first_broker(book.opportunities).first()["broker_id"]
    stored = book.write_messages(None if args.all_brokers else broker)
    if args.json:
        tables.export_json(stored, args.json)
    return messages.source_counts(stored)


def _reports(book: ClientBook, _: argparse.Namespace) -> DataFrame:
    for name, report in book.reports().items():
        tables.write_table(report, f"{book.folder}/reports/{name}")
    return broker_reports.broker_list(book.opportunities)


STEPS = {
    "profile": _profile,
    "features": lambda book, _: book.features,
    "opportunities": lambda book, _: book.opportunities,
    "churn": _churn,
    "messages": _messages,
    "reports": _reports,
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="bookpulse", description=__doc__)
    parser.add_argument("step", choices=STEPS)
    parser.add_argument("--folder", required=True, help="where the tables of the book are kept")
    parser.add_argument("--input", help="raw transactions; what follows from changed ones is built anew")
    parser.add_argument("--format", default="parquet", help="format of the raw transactions")
    parser.add_argument("--company", default=messages.COMPANY, help="name used in messages")
    parser.add_argument("--rounds", type=int, default=churn_model.ROUNDS, help="boosting rounds")
    parser.add_argument("--broker", help="broker to write messages for; the first one by default")
    parser.add_argument("--all-brokers", action="store_true", help="write messages for all brokers")
    parser.add_argument("--json", help="also export the stored messages as JSON records")
    args = parser.parse_args(argv)

    spark = prepare(SparkSession.builder.appName("bookpulse").getOrCreate())
    raw = tables.read_transactions(spark, args.input, args.format) if args.input else None
    book = ClientBook(spark, args.folder, raw, rounds=args.rounds, company=args.company)
    STEPS[args.step](book, args).show(20, truncate=False)
    drop_stages(spark)


if __name__ == "__main__":
    main()
