"""A transaction book derived from the test tables ``orders``, ``lineitem``, ``customer``."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookpulse.operators import churn_model
from bookpulse.plans.client_book import ClientBook
from bookpulse.session import prepare, work_folder
from bookpulse.sources.tables import type_raw

LAG_DAYS = (0, 0, 0, 0, 20, 70, 120, 250)
#: Boosting rounds of the registered model queries; the unit tests set a smaller number.
ROUNDS = int(os.environ.get("BOOK_ROUNDS", churn_model.ROUNDS))

_BOOKS: dict[tuple[str, str], ClientBook] = {}
_FOLDERS: dict[int, str] = {}


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw transaction per order: about 50 per client, squeezed into ~200 days."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders = read("orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("day")
    )
    first_supplier = read("lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("sk"))
    names = read("customer").select("c_custkey", "c_name")
    key, client, sk = F.col("o_orderkey"), F.col("client"), F.col("sk")
    anchor = F.to_timestamp(F.lit("2001-08-01 00:00:00"))
    lag = F.get(F.array(*[F.lit(d) for d in LAG_DAYS]), (F.floor(F.col("o_custkey") / 5) % 8).cast("int"))
    minutes = (
        F.date_diff(F.lit("2001-08-01").cast("date"), "day") * -120 - lag * 1440 + (key % 24) * 60
    )
    at = F.timestamp_micros(F.unix_micros(anchor) + (minutes * 60 + key % 3600) * 1_000_000)
    return (
        orders.join(names, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(first_supplier, key == F.col("l_orderkey"), "left")
        .withColumn("client", F.col("o_custkey") - F.col("o_custkey") % 5)
        .select(
            key.alias("tx_id"),
            F.concat(F.lit("C"), F.lpad(client.cast("string"), 9, "0")).alias("balance_owner_uuid"),
            F.when(client % 35 == 0, "").otherwise(F.col("c_name")).alias("balance_owner_name"),
            F.when(client % 15 == 0, "").when(
                sk.isNotNull(), F.concat(F.lit("B"), F.lpad((sk % 20).cast("string"), 3, "0"))
            ).alias("intermediary_uuid"),
            F.when(sk % 20 == 7, "").when(
                sk.isNotNull(), F.concat(F.lit("Broker "), (sk % 20).cast("string"))
            ).alias("intermediary_name"),
            F.when(key % 101 == 0, "").otherwise(
                F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("+00"))
            ).alias("trigger_at"),
            F.when(F.col("o_orderstatus") == "F", "COMPLETED")
            .when(F.col("o_orderstatus") == "P", "CANCELED")
            .otherwise(F.when(key % 2 == 0, "COMPLETED").otherwise("PENDING")).alias("status"),
            F.when(key % 97 == 0, "N/A").otherwise(
                F.col("o_totalprice").cast("decimal(18,2)").cast("string")
            ).alias("balance_paid"),
            F.lit(1e8).alias("er_paid_to_usd"),
            ((key % 60) * F.lit(1e8)).alias("profit_spread_bps"),
            (key % 20).cast("double").alias("minimum_spread"),
        )
    )


def mixed_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same transactions with times in twelve forms, and rates that change or are missing."""
    key, at = F.col("tx_id"), F.to_timestamp("trigger_at", "yyyy-MM-dd HH:mm:ssX")
    form = key % 12
    written = F.when(form == 9, F.when(F.dayofmonth(at) > 12, F.date_format(at, "dd.MM.yyyy HH:mm")).otherwise(
        F.date_format(at, "yyyy-MM-dd HH:mm")))
    for k, pattern in MIXED_FORMS.items():
        shown = at + F.expr("INTERVAL 2 HOURS") if k == 10 else at
        written = written.when(form == k, F.date_format(shown, pattern))
    rate = F.when(key % 89 != 0, F.element_at(F.array(*[F.lit(r) for r in MIXED_RATES]), (key % 4 + 1).cast("int")) * F.lit(1e8))
    return raw_transactions(spark, sf_dir).withColumns({
        "trigger_at": F.when(F.col("trigger_at") == "", "soon").otherwise(written), "er_paid_to_usd": rate,
    })


#: Forms of the mixed book by ``tx_id % 12``; 9 is day-first where that is certain, 10 is two hours ahead of UTC.
MIXED_FORMS = {
    0: "yyyy-MM-dd HH:mm:ss'+00'", 1: "MM/dd/yyyy HH:mm:ss", 2: "yyyy/MM/dd HH:mm", 3: "dd-MMM-yyyy HH:mm:ss",
    4: "MMM dd yyyy HH:mm", 5: "M/d/yyyy", 6: "yyyyMMdd", 7: "MMMM d, yyyy h:mm a", 8: "yyyy/MM/dd HH:mm:ss.SSS '+00'",
    10: "yyyy-MM-dd'T'HH:mm:ss'+02:00'", 11: "yyyyMMdd HHmmss",
}
MIXED_RATES = (1.0, 2.0, 3.0, 7.0)


def book(spark: SparkSession, sf_dir: str, rows=raw_transactions) -> ClientBook:
    """The book of one test folder; its tables are written once per application."""
    prepare(spark)
    app, name = spark.sparkContext.applicationId, f"{rows.__name__} {sf_dir}"
    if (app, name) not in _BOOKS:
        folder = f"{work_folder(spark)}/books/{hashlib.sha1(name.encode()).hexdigest()[:12]}"
        raw = type_raw(rows(spark, sf_dir))
        _BOOKS[app, name] = ClientBook(spark, folder, raw, rounds=ROUNDS, extra_columns=("tx_id",))
        _FOLDERS[id(_BOOKS[app, name])] = sf_dir
    return _BOOKS[app, name]


def mixed_book(other: ClientBook) -> ClientBook:
    """The book of the mixed transactions beside another book of the same test folder."""
    return book(other.spark, _FOLDERS[id(other)], mixed_transactions)


def fixed_scores(features: DataFrame) -> DataFrame:
    """Score table with known probabilities (ties included) in place of a model's."""
    client = F.substring("client_id", 2, 9).cast("bigint")
    return churn_model.with_risk(
        features.withColumn("churn_probability", (client * 7919 % 1000) / F.lit(1000.0))
    )


def outside_texts(opportunities: DataFrame) -> DataFrame:
    """Texts as an outside model might return them: some blank, most absent."""
    client = F.substring("client_id", 2, 9).cast("bigint")
    return opportunities.where(client % 10 == 0).select(
        "client_id", "opportunity_type",
        F.when(client % 20 == 0, F.concat(F.lit(" Hola "), F.col("client_name"), F.lit("\n")))
        .otherwise(F.lit("  ")).alias("text"),
    )
