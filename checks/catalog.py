"""Every operation of the inventory as a query over the test book, with its SQL twin.

``QUERIES[key]`` takes the book of one test folder; ``ORACLES[key]`` is the select that
:func:`checks.oracle.sql` completes. Queries that fit a model have no SQL twin.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from functools import reduce

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookpulse import fixed_values as fv
from bookpulse.functions.text import day_name, signed_word
from bookpulse.operators import broker_reports as rep
from bookpulse.operators import boosting, churn_model, cleaning, client_sets, metrics, profile, rfm
from bookpulse.operators import client_features as cf
from bookpulse.operators import labels as churn
from bookpulse.operators import messages as msg
from bookpulse.operators import opportunities as opps
from bookpulse.plans.client_book import ClientBook
from bookpulse.session import stage
from bookpulse.sources import tables
from checks import oracle as o
from checks.book import ROUNDS, fixed_scores, mixed_book, outside_texts

Query = Callable[[ClientBook], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(key: str, query: Query, select: str | None = None) -> None:
    QUERIES[key] = query
    if select is not None:
        ORACLES[key] = select


def time_text(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss")


def scores_of(b: ClientBook) -> DataFrame:
    return fixed_scores(b.features)


def scored_of(b: ClientBook) -> DataFrame:
    return b.churn_labels.join(scores_of(b), "client_id").select("client_id", "churned", "churn_probability")


TIME = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
RAW = (
    "tx_id, balance_owner_uuid, balance_owner_name, intermediary_uuid, intermediary_name, trigger_at, "
    "status, balance_paid, er_paid_to_usd, profit_spread_bps, minimum_spread"
)
MESSAGE_ROW = (
    "broker_id, broker_name, client_id, client_name, opportunity_type, priority, message, source, context"
)
SCORE_ROW = (
    "client_id, client_name, broker_id, broker_name, segment, churn_probability, churn_score, risk_label"
)


def names(columns: str) -> list[str]:
    return columns.split(", ")


# --- A. sources and sinks --------------------------------------------------------------
def landed(b: ClientBook, fmt: str) -> DataFrame:
    """The raw book written as ``fmt`` and read through the transaction reader."""
    path = f"{b.folder}/landed/{fmt}"
    if not tables.exists(b.spark, path):
        writer = b.raw.write.mode("overwrite").format(fmt)
        (writer.options(header=True, escape='"') if fmt == "csv" else writer).save(path)
    return tables.read_transactions(b.spark, path, fmt)


def read_csv(b: ClientBook) -> DataFrame:
    return cleaning.clean(landed(b, "csv")).select(
        F.col("tx_id").cast("bigint").alias("tx_id"), "balance_owner_uuid", "broker_id_clean",
        "client_name_clean", "volume_usd", "spread_bps", time_text("trigger_at_dt").alias("happened"),
    )


def read_named(b: ClientBook, name: str) -> DataFrame:
    getattr(b, name)        # built when missing
    return tables.read_table(b.spark, name, b.folder)


def round_trip(b: ClientBook, name: str, df: DataFrame) -> DataFrame:
    folder = f"{b.folder}/written"
    tables.write_table(df, f"{folder}/{name}")
    return tables.read_table(b.spark, name, folder)


def read_scores(b: ClientBook) -> DataFrame:
    path = f"{b.folder}/written/fixed_scores"
    tables.write_table(scores_of(b), path)
    return tables.read_scores_or_empty(b.spark, path)


def built_features(b: ClientBook) -> DataFrame:
    path = f"{b.folder}/written/built_features"
    return tables.get_or_build(b.spark, path, lambda: b.features).select(names(o.SCORED_COLUMNS))


def rebuilt(b: ClientBook) -> DataFrame:
    """Features of half the raw rows, of all, and of all again, asked for in one folder."""
    found = []
    for step, raw in (("half", b.raw.where("tx_id % 2 = 0")), ("all", b.raw), ("again", b.raw.repartition(3))):
        own = ClientBook(b.spark, f"{b.folder}/written/rebuilt", raw, extra_columns=("tx_id",))
        found.append(stage(own.features.agg(
            F.lit(step).alias("step"), F.count("*").alias("clients"), F.sum("tx_count_total").alias("dated")), step))
    return reduce(DataFrame.unionByName, found)


def upserted(b: ClientBook) -> DataFrame:
    """All brokers, then one broker again with another signature, then an empty run."""
    path = f"{b.folder}/written/messages_upsert"
    found = b.opportunities
    tables.upsert_messages(msg.messages(found), path)
    chosen = found.where(F.col("broker_id") == "B001")
    tables.upsert_messages(msg.messages(chosen, signature="Otra firma"), path)
    tables.upsert_messages(msg.messages(found.where(F.lit(False))), path)
    return tables.read_messages_or_empty(b.spark, path)


def reloaded_model_scores(b: ClientBook) -> DataFrame:
    path = f"{b.folder}/written/model"
    tables.save_model(b.model, path)
    model, inputs = tables.load_model(path)
    return churn_model.score_clients(model, b.features).withColumn("inputs", F.lit(", ".join(inputs)))


UPSERTED = (
    "SELECT broker_id, broker_name, client_id, client_name, opportunity_type, priority, "
    f"CASE WHEN broker_id = 'B001' THEN replace(message, {o.quote('— ' + o.SIGNATURE)}, '— Otra firma') "
    "ELSE message END AS message, source, context FROM msg"
)
add("A1_read_transactions", lambda b: landed(b, "parquet").select(names(RAW)), f"SELECT {RAW} FROM raw")
add("A1_read_transactions_csv", read_csv,
    "SELECT tx_id, balance_owner_uuid, broker_id AS broker_id_clean, client_name AS client_name_clean, "
    f"volume_usd, spread_bps, {TIME} AS happened FROM tx")
add("A2_read_features", lambda b: read_named(b, "features"),
    f"SELECT {o.SCORED_COLUMNS} FROM feat")
add("A3_read_opportunities", lambda b: read_named(b, "opportunities"),
    f"SELECT {o.OPP_COLUMNS} FROM opp")
add("A4_read_scores", read_scores,
    "SELECT client_id, churn_probability, churn_score, risk_label FROM scores")
add("A5_read_messages", lambda b: b.write_messages(), f"SELECT {MESSAGE_ROW} FROM msg")
add("A6_get_or_build", built_features, f"SELECT {o.SCORED_COLUMNS} FROM feat")
add("A6_rebuilt_for_new_input", rebuilt, " UNION ALL ".join(
    f"SELECT '{step}' AS step, count(DISTINCT client_id) AS clients, CAST(count(*) AS BIGINT) AS dated FROM tx "
    f"WHERE client_id IS NOT NULL AND ts IS NOT NULL AND {rows}"
    for step, rows in (("half", "tx_id % 2 = 0"), ("all", "true"), ("again", "true"))))
add("A7_write_features", lambda b: round_trip(b, "features", b.features), f"SELECT {o.SCORED_COLUMNS} FROM feat")
add("A8_write_opportunities", lambda b: round_trip(b, "opportunities", b.opportunities),
    f"SELECT {o.OPP_COLUMNS} FROM opp")
add("A9_write_scores",
    lambda b: round_trip(b, "churn_scores", scores_of(b).orderBy(F.desc("churn_probability"), "client_id")),
    f"SELECT {SCORE_ROW} FROM scores")
add("A10_churn_report", lambda b: churn_model.report_text(b.churn_report))
add("A11_model_save_load", reloaded_model_scores)
add("A11_reloaded_difference", lambda b: reloaded_difference(b),
    f"SELECT client_id, true AS same, '{', '.join(fv.MODEL_FEATURES)}' AS inputs FROM feat")
add("A12_upsert_messages", upserted, UPSERTED)

# --- B. projections --------------------------------------------------------------------
add("B1_volume", lambda b: b.transactions.select("tx_id", "bp_num", "volume_usd"),
    "SELECT tx_id, bp_num, volume_usd FROM tx")
add("B2_spread", lambda b: b.transactions.select("tx_id", "spread_bps"), "SELECT tx_id, spread_bps FROM tx")
add("B1_volume_mixed_book", lambda b: mixed_book(b).transactions.select("tx_id", "bp_num", "volume_usd", "is_valid_completed"),
    "SELECT tx_id, bp_num, volume_usd, valid AS is_valid_completed FROM mixed")
add("B3_time_mixed_book", lambda b: mixed_book(b).transactions.select("tx_id", time_text("trigger_at_dt").alias("happened")),
    f"SELECT tx_id, {TIME} AS happened FROM mixed")
add("E0_features_mixed_book", lambda b: cf.build_features(mixed_book(b).transactions), f"SELECT {o.FEATURE_COLUMNS} FROM m_base")
add("B3_time", lambda b: b.transactions.select("tx_id", time_text("trigger_at_dt").alias("happened")),
    f"SELECT tx_id, {TIME} AS happened FROM tx")
add("B4_broker_clean", lambda b: b.transactions.select("tx_id", "broker_id_clean", "broker_name_clean"),
    "SELECT tx_id, broker_id AS broker_id_clean, broker_name AS broker_name_clean FROM tx")
add("B5_has_broker", lambda b: b.transactions.select("tx_id", F.col("has_broker").cast("int").alias("has_broker")),
    "SELECT tx_id, CAST(has_broker AS INTEGER) AS has_broker FROM tx")
add("B6_client_name", lambda b: b.transactions.select("tx_id", "client_name_clean"),
    "SELECT tx_id, client_name AS client_name_clean FROM tx")
add("B7_valid_completed",
    lambda b: b.transactions.select("tx_id", F.col("is_valid_completed").cast("int").alias("valid")),
    "SELECT tx_id, CAST(valid AS INTEGER) AS valid FROM tx")
add("B8_month", lambda b: b.transactions.select("tx_id", "month"), "SELECT tx_id, month FROM tx")
add("B9_hour_weekday", lambda b: b.transactions.select("tx_id", "hour", "weekday"),
    "SELECT tx_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday FROM tx")
add("B10_fill_features", lambda b: churn_model.fill_features(b.features).select("client_id", *fv.MODEL_FEATURES),
    "SELECT client_id, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in fv.MODEL_FEATURES) + " FROM feat")
add("B11_segment_rule",
    lambda b: b.features.select(
        "client_id", rfm.segment(F.col("rfm_score"), F.col("days_since_last_tx")).alias("segment")),
    "SELECT client_id, segment FROM feat")
add("B12_context", lambda b: b.features.select("client_id", opps.context().alias("context")),
    f"SELECT client_id, {o.CONTEXT} AS context FROM feat")
add("B13_activity_light",
    lambda b: b.features.select("client_id", rep.activity_light(F.col("days_since_last_tx")).alias("activity")),
    f"SELECT client_id, {o.LIGHT} AS activity FROM feat")
add("B14_trend_label",
    lambda b: b.features.select("client_id", rep.trend_label(F.col("volume_trend")).alias("trend")),
    f"SELECT client_id, {o.TREND} AS trend FROM feat")
add("B15_best_contact",
    lambda b: b.features.select(
        "client_id", rep.best_contact(F.col("preferred_day"), F.col("preferred_hour")).alias("best_contact")),
    f"SELECT client_id, {o.CONTACT} AS best_contact FROM feat")
add("B16_display_labels",
    lambda b: b.opportunities.select(
        "client_id", "opportunity_type", rep.type_label(F.col("opportunity_type")).alias("type"),
        rep.priority_label(F.col("priority")).alias("priority"),
        rep.segment_label(F.col("segment")).alias("segment")),
    f"SELECT client_id, opportunity_type, {o.TYPE_LABEL} AS type, {o.PRIORITY_LABEL} AS priority, "
    f"{o.SEGMENT_LABEL} AS segment FROM opp")
add("B17_number_texts",
    lambda b: b.features.select(
        "client_id", rep.inactive_text(F.col("days_since_last_tx")).alias("inactive"),
        rep.money_text(F.col("total_volume_usd")).alias("total_volume"),
        F.col("tx_count_30d").cast("int").alias("tx_30d"), F.col("tx_count_90d").cast("int").alias("tx_90d")),
    f"SELECT client_id, {o.INACTIVE} AS inactive, {o.MONEY} AS total_volume, "
    "CAST(tx_count_30d AS INTEGER) AS tx_30d, CAST(tx_count_90d AS INTEGER) AS tx_90d FROM feat")
add("B18_churn_percent",
    lambda b: scores_of(b).select("client_id", churn.percent_text(F.col("churn_probability")).alias("churn_percent")),
    "SELECT client_id, round_even(churn_probability * 100, 1) AS churn_percent FROM scores")
add("B19_report_columns",
    lambda b: rep.opportunity_table(b.opportunities, None, (), ()).drop("churn_percent"),
    "SELECT broker_id, client, type, priority, inactive, total_volume_usd FROM opp_table")
add("B20_trend_words",
    lambda b: b.features.select(
        "client_id",
        signed_word(F.col("volume_trend"), fv.CONTEXT_TREND_WORDS).alias("in_context"),
        signed_word(F.col("volume_trend"), fv.PROMPT_TREND_WORDS).alias("in_prompt"),
        signed_word(F.col("volume_trend"), fv.MESSAGE_TREND_WORDS).alias("in_message")),
    f"SELECT client_id, {o.sign_word('volume_trend', fv.CONTEXT_TREND_WORDS)} AS in_context, "
    f"{o.sign_word('volume_trend', fv.PROMPT_TREND_WORDS)} AS in_prompt, "
    f"{o.sign_word('volume_trend', fv.MESSAGE_TREND_WORDS)} AS in_message FROM feat")
add("B21_day_names",
    lambda b: b.features.select(
        "client_id",
        # a shifted day shows the text for an index past Sunday
        day_name(F.col("preferred_day") + 1, fv.CONTEXT_NO_DAY).alias("in_context"),
        day_name(F.col("preferred_day") + 1, fv.MESSAGE_NO_DAY).alias("in_message")),
    f"SELECT client_id, {o.day_name('(preferred_day + 1)', fv.CONTEXT_NO_DAY)} AS in_context, "
    f"{o.day_name('(preferred_day + 1)', fv.MESSAGE_NO_DAY)} AS in_message FROM feat")


# --- C. filters --------------------------------------------------------------------------
def look_back_counts(b: ClientBook) -> DataFrame:
    tx = b.transactions
    at, ref = F.col("trigger_at_dt"), cleaning.reference_date(tx)
    since = lambda days: at >= ref - F.make_dt_interval(F.lit(days))
    return tx.groupBy("status").agg(
        F.count_if(since(30)).alias("last_30d"), F.count_if(since(90)).alias("last_90d"),
        F.count_if(since(56)).alias("last_8w"))


def label_windows(b: ClientBook) -> DataFrame:
    tx = b.transactions
    past = F.col("trigger_at_dt") < churn.label_cutoff(tx)
    return tx.where(F.col("trigger_at_dt").isNotNull()).groupBy(
        F.col("balance_owner_uuid").alias("client_id")
    ).agg(F.count_if(past).alias("past"), F.count_if(~past).alias("recent"))


def above_median(b: ClientBook) -> DataFrame:
    p50, _ = opps.volume_limits(b.features)
    return b.features.where(F.col("total_volume_usd") > p50).select("client_id", "total_volume_usd")


OPP_KEY = "broker_id, client_id, opportunity_type, priority"
add("C1_monetary_subset",
    lambda b: b.transactions.where("is_valid_completed").select("tx_id", "volume_usd"),
    "SELECT tx_id, volume_usd FROM tx WHERE valid")
add("C2_dated_rows",
    lambda b: b.transactions.where(F.col("trigger_at_dt").isNotNull()).select("tx_id"),
    "SELECT tx_id FROM tx WHERE ts IS NOT NULL")
add("C3_processable_clients", lambda b: b.features.select("client_id", "tx_count_total"),
    "SELECT client_id, count(ts) AS tx_count_total FROM tx WHERE client_id IS NOT NULL GROUP BY 1 HAVING count(ts) > 0")
add("C4_look_back", look_back_counts,
    "SELECT status, count(*) FILTER (WHERE ts >= r - INTERVAL 30 DAY) AS last_30d, "
    "count(*) FILTER (WHERE ts >= r - INTERVAL 90 DAY) AS last_90d, "
    "count(*) FILTER (WHERE ts >= r - INTERVAL 56 DAY) AS last_8w FROM tx, ref GROUP BY 1")
add("C5_label_windows", label_windows,
    "SELECT client_id, count(*) FILTER (WHERE ts < c) AS past, count(*) FILTER (WHERE ts >= c) AS recent "
    "FROM tx, ref WHERE ts IS NOT NULL GROUP BY 1")
add("C6_minimum_history", lambda b: label_windows(b).where(F.col("past") >= fv.MIN_PAST_TX).select("client_id", "past"),
    "SELECT client_id, count(*) AS past FROM tx, ref WHERE ts < c GROUP BY 1 HAVING count(*) >= 2")
add("C7_completed_with_broker", lambda b: cleaning.completed_with_broker(b.transactions).select("tx_id"),
    "SELECT tx_id FROM with_broker")
add("C8_positive_volume",
    lambda b: cleaning.completed_with_broker(b.transactions).where("volume_usd > 0").select("tx_id", "volume_usd"),
    "SELECT tx_id, volume_usd FROM with_broker WHERE volume_usd > 0")
add("C9_reporting_subset", lambda b: cleaning.reporting_subset(b.transactions).select("tx_id", "volume_usd"),
    "SELECT tx_id, volume_usd FROM tx WHERE reported")
add("C10_one_broker", lambda b: b.opportunities.where(F.col("broker_id") == "B001").select(names(OPP_KEY)),
    f"SELECT {OPP_KEY} FROM opp WHERE broker_id = 'B001'")
add("C11_filter_sets",
    lambda b: opps.filter_opportunities(b.opportunities, ["high"], ["CHURN_RISK", "UPSELL"]).select(names(OPP_KEY)),
    f"SELECT {OPP_KEY} FROM opp WHERE priority = 'high' AND opportunity_type IN ('CHURN_RISK', 'UPSELL')")
add("C11_empty_means_all", lambda b: opps.filter_opportunities(b.opportunities, [], []).select(names(OPP_KEY)),
    f"SELECT {OPP_KEY} FROM opp")
add("C12_one_type", lambda b: opps.of_type(b.opportunities, "UPSELL").select(names(OPP_KEY)),
    f"SELECT {OPP_KEY} FROM opp WHERE opportunity_type = 'UPSELL'")
add("C12_all_types", lambda b: opps.of_type(b.opportunities, fv.ALL_TYPES).select(names(OPP_KEY)),
    f"SELECT {OPP_KEY} FROM opp")
add("C13_default_filter",
    lambda b: opps.filter_opportunities(
        b.opportunities, fv.DEFAULT_PRIORITY_FILTER, fv.DEFAULT_TYPE_FILTER).select(names(OPP_KEY)),
    f"SELECT {OPP_KEY} FROM opp WHERE priority IN ('high', 'medium') AND opportunity_type <> 'BEST_TIME'")
add("C14_dated_months",
    lambda b: b.transactions.where(F.col("month").isNotNull()).groupBy("month").agg(F.count(F.lit(1)).alias("n")),
    "SELECT month, count(*) AS n FROM tx WHERE month IS NOT NULL GROUP BY 1")
add("C15_segment_set",
    lambda b: b.features.where(F.col("segment").isin("activo_sano", "en_riesgo")).select("client_id", "segment"),
    "SELECT client_id, segment FROM feat WHERE segment IN ('activo_sano', 'en_riesgo')")
add("C16_above_median", above_median,
    "SELECT client_id, total_volume_usd FROM feat, edges WHERE total_volume_usd > p50")
add("C17_preview",
    lambda b: opps.preview(b.opportunities).select(*names(OPP_KEY), F.col("position").cast("bigint").alias("position")),
    f"SELECT {OPP_KEY}, row_number() OVER (PARTITION BY broker_id ORDER BY rule_no, rank_in_rule) AS position "
    "FROM ranked_opp WHERE opportunity_type <> 'BEST_TIME' QUALIFY position <= 2")

add("C17_preview_texts", lambda b: msg.preview_texts(b.opportunities),
    f"SELECT broker_id, position, client_id, opportunity_type, message FROM (SELECT {OPP_KEY}, "
    "row_number() OVER (PARTITION BY broker_id ORDER BY rule_no, rank_in_rule) AS position "
    "FROM ranked_opp WHERE opportunity_type <> 'BEST_TIME' QUALIFY position <= 2) "
    "JOIN (SELECT client_id, opportunity_type, message FROM msg) USING (client_id, opportunity_type)")


# --- D. joins ------------------------------------------------------------------------------
def reference_attached(b: ClientBook) -> DataFrame:
    tx = b.transactions
    micros = F.unix_micros(cleaning.reference_date(tx)) - F.unix_micros("trigger_at_dt")
    return tx.select("tx_id", (micros / F.lit(86_400_000_000)).alias("days_before_reference"))


def limits_attached(b: ClientBook) -> DataFrame:
    p50, p75 = opps.volume_limits(b.features)
    return b.features.select("client_id", F.lit(p50).alias("p50"), F.lit(p75).alias("p75"))


def edges_attached(b: ClientBook) -> DataFrame:
    edges = rfm.quartile_edges(b.features)
    return b.features.select(
        "client_id",
        *[F.round(F.lit(edge), 6).alias(f"{score}{i}")
          for score, (feature, _) in rfm.SCORES.items() for i, edge in enumerate(edges[feature])])


def training_rows(b: ClientBook) -> DataFrame:
    return churn_model.training_set(b.features, b.churn_labels).select("client_id", "churned", *fv.MODEL_FEATURES)


OPP_TABLE = "broker_id, client, type, priority, inactive, total_volume_usd, churn_percent"
STATUS = (
    "broker_id, client_id, client, activity, segment, inactive, tx_30d, tx_90d, total_volume, trend, "
    "best_contact, churn_percent, days_since_last_tx"
)
GRID = "SELECT broker_id, weekday, hour, n FROM grid"
RISK_COUNTS = (
    "SELECT l AS risk_label, (SELECT count(*) FROM scores WHERE risk_label = l) AS clients "
    "FROM (VALUES ('Bajo'), ('Medio'), ('Alto'), ('Crítico')) t(l)"
)
add("D1_features_labels", training_rows,
    "SELECT client_id, churned, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in fv.MODEL_FEATURES)
    + " FROM feat JOIN labels USING (client_id)")
add("D2_opportunities_scores", lambda b: rep.opportunity_table(b.opportunities, scores_of(b), (), ()),
    f"SELECT {OPP_TABLE} FROM opp_table")
add("D3_status_scores", lambda b: rep.client_status(b.features, scores_of(b)).select("client_id", "churn_percent"),
    "SELECT client_id, churn_percent FROM status_table")
add("D4_reference_date", reference_attached,
    "SELECT tx_id, CAST(epoch_us(r) - epoch_us(ts) AS DOUBLE) / 86400000000.0::DOUBLE AS days_before_reference "
    "FROM tx, ref")
add("D5_volume_limits", limits_attached, "SELECT client_id, p50, p75 FROM feat, edges")
add("D6_quantile_edges", edges_attached,
    "SELECT client_id, " + ", ".join(
        f"round({arr}[{i + 1}], 6) AS {s}{i}" for s, arr in (("R", "er"), ("F", "ef"), ("M", "em")) for i in range(5))
    + " FROM feat, edges")
add("D7_modal_broker", lambda b: b.features.select("client_id", "broker_id", "broker_name"),
    "SELECT client_id, broker_id, broker_name FROM feat")
add("D8_activity_grid", lambda b: rep.activity_grid(b.transactions, b.features), GRID)
add("D9_outside_texts",
    lambda b: msg.messages(b.opportunities, outside_texts(b.opportunities)),
    f"SELECT {MESSAGE_ROW} FROM mixed_msg")
add("D10_risk_labels_filled", lambda b: churn.risk_counts(scores_of(b)), RISK_COUNTS)

# --- E. aggregations: per client ------------------------------------------------------------
for key, columns in {
    "E1_days_since_last": "days_since_last_tx",
    "E2_tx_total": "tx_count_total",
    "E3_tx_recent": "tx_count_30d, tx_count_90d",
    "E4_tx_completed": "tx_count_completed",
    "E5_success_rate": "success_rate",
    "E6_avg_volume": "avg_volume_usd",
    "E7_total_volume": "total_volume_usd",
    "E8_avg_spread": "avg_spread_bps",
    "E9_spread_vs_minimum": "spread_vs_minimum",
    "E10_preferred_hour": "preferred_hour",
    "E11_preferred_day": "preferred_day",
    "E12_broker_id": "broker_id",
    "E13_names": "client_name, broker_name",
    "E15_volume_trend": "volume_trend",
}.items():
    add(key, lambda b, columns=columns: b.features.select("client_id", *names(columns)),
        f"SELECT client_id, {columns} FROM f_base")
add("E0_features_from_transactions", lambda b: cf.build_features(b.transactions),
    f"SELECT {o.FEATURE_COLUMNS} FROM f_base")
add("E14_weekly_volume", lambda b: cf.weekly_volume(b.transactions),
    "SELECT client_id, wk AS week, CAST(wvol AS DOUBLE) AS volume_usd FROM f_weekly")

# --- E. aggregations: whole book and per broker ---------------------------------------------
SEGMENTS_BY_BROKER = "SELECT broker_id, segment, count(*) AS clients FROM feat GROUP BY 1, 2"
MONTHLY = (
    "SELECT broker_id, month, CAST(sum(CAST(volume_usd AS DECIMAL(18,2))) AS DOUBLE) AS volume_usd FROM own "
    "WHERE month IS NOT NULL GROUP BY 1, 2"
)
HISTOGRAM = """
    SELECT CAST(b AS INTEGER) AS bin, lo + b * (hi - lo) / 50 AS low_edge, coalesce(n, 0) AS n
    FROM range(50) t(b) CROSS JOIN (SELECT min(x) AS lo, max(x) AS hi FROM logs)
      LEFT JOIN (SELECT least(CAST(floor((x - lo) / (hi - lo) * 50) AS INTEGER), 49) AS bin0, count(*) AS n
        FROM logs, (SELECT min(x) AS lo, max(x) AS hi FROM logs) GROUP BY 1) ON bin0 = b"""
PERCENTILES = (
    "SELECT CAST(p AS INTEGER) AS percent, round(q, 6) AS volume_usd FROM (SELECT unnest([25, 50, 75, 95, 99]) AS p, "
    "unnest(quantile_cont(volume_usd, [0.25, 0.5, 0.75, 0.95, 0.99])) AS q FROM with_broker WHERE volume_usd > 0)"
)
NULLS = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS data_type, "
    f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / count(*) * 100 AS null_percent FROM tx"
    for c, t in zip(profile.PROFILED, ["string"] * 6 + ["double"] * 4)
)
add("E16_load_quality", lambda b: profile.load_quality(b.transactions),
    "SELECT count(*) AS row_count, count(ts) AS dated, count(*) FILTER (WHERE valid) AS valid_completed, "
    "count(*) FILTER (WHERE has_broker) AS with_broker, count(DISTINCT client_id) AS clients FROM tx")
add("E17_feature_summary", lambda b: cf.feature_summary(b.features),
    "SELECT count(*) AS clients, count(*) FILTER (WHERE broker_id <> 'DIRECTO') AS with_broker, "
    "count(*) FILTER (WHERE broker_id = 'DIRECTO') AS without_broker FROM feat")
add("E18_segment_counts", lambda b: rfm.segment_counts(b.features),
    "SELECT segment, count(*) AS clients FROM feat GROUP BY 1")
add("E19_type_counts", lambda b: opps.type_counts(b.opportunities),
    "SELECT opportunity_type, count(*) AS n FROM opp GROUP BY 1")
add("E20_volume_limits", lambda b: limits_attached(b).select("p50", "p75").distinct(), "SELECT p50, p75 FROM edges")
add("E21_table_shape", lambda b: profile.table_shape(b.raw),
    "SELECT count(*) AS row_count, CAST(11 AS INTEGER) AS column_count FROM raw")
add("E22_null_profile", lambda b: profile.null_profile(b.transactions), NULLS)
add("E23_date_range",
    lambda b: profile.date_range(b.transactions).select(
        time_text("first_time").alias("first_time"), time_text("last_time").alias("last_time")),
    "SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_time, "
    "strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_time FROM tx")
add("E24_universe", lambda b: profile.universe(b.transactions),
    "SELECT count(DISTINCT intermediary_uuid) AS brokers, count(DISTINCT balance_owner_uuid) AS clients, "
    "count(*) AS transactions FROM with_broker")
add("E25_volume_percentiles",
    lambda b: profile.volume_percentiles(b.transactions).withColumn("volume_usd", F.round("volume_usd", 6)), PERCENTILES)
add("E26_broker_volume", lambda b: profile.broker_volume(b.transactions), "SELECT * FROM broker_rev")
add("E27_broker_clients", lambda b: profile.broker_clients(b.transactions), "SELECT * FROM broker_cli")
add("E16_load_quality_of_sets", lambda b: client_sets.load_quality(b.client_sets), ORACLES["E16_load_quality"])
add("E24_universe_of_sets", lambda b: client_sets.universe(b.client_sets), ORACLES["E24_universe"])
add("E27_broker_clients_of_sets", lambda b: client_sets.broker_clients(b.client_sets), ORACLES["E27_broker_clients"])
add("E27_clients_per_month", lambda b: client_sets.broker_clients(b.client_sets, "month"),
    "SELECT intermediary_uuid, intermediary_name, month, count(DISTINCT balance_owner_uuid) AS n_clients FROM tx "
    "WHERE has_broker AND status = 'COMPLETED' AND intermediary_uuid IS NOT NULL AND intermediary_name IS NOT NULL GROUP BY ALL")
add("E28_status_distribution", lambda b: profile.status_distribution(b.transactions),
    "SELECT status, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM tx) * 100 AS percent "
    "FROM tx WHERE status IS NOT NULL GROUP BY 1")
add("E29_volume_histogram",
    lambda b: profile.volume_histogram(b.transactions).withColumn("low_edge", F.round("low_edge", 9)),
    f"SELECT bin, round(low_edge, 9) AS low_edge, n FROM ({HISTOGRAM})")
add("E30_churn_labels", lambda b: churn.churn_labels(b.transactions), "SELECT client_id, churned FROM labels")
add("E31_label_summary", lambda b: churn.label_summary(b.churn_labels),
    "SELECT count(*) AS labelled, CAST(sum(churned) AS BIGINT) AS churned, "
    "CAST(count(*) - sum(churned) AS BIGINT) AS active, "
    "CAST(sum(churned) AS DOUBLE) / count(*) * 100 AS churn_rate FROM labels")
add("E32_risk_counts", lambda b: churn.risk_counts(scores_of(b)), RISK_COUNTS)
add("E33_broker_card", lambda b: rep.broker_card(b.features, b.opportunities), "SELECT * FROM card")
add("E34_broker_kpis",
    lambda b: rep.broker_kpis(b.transactions, b.features).withColumn("avg_volume_usd", F.round("avg_volume_usd", 6)),
    "SELECT * REPLACE (round(avg_volume_usd, 6) AS avg_volume_usd) FROM kpis")
add("E35_broker_types", lambda b: opps.type_counts(b.opportunities, "broker_id"),
    "SELECT broker_id, opportunity_type, count(*) AS n FROM opp GROUP BY 1, 2")
add("E36_broker_segments", lambda b: rfm.segment_counts(b.features, "broker_id"), SEGMENTS_BY_BROKER)
add("E37_monthly_volume", lambda b: rep.monthly_volume(b.transactions), MONTHLY)
add("E38_activity_counts", lambda b: rep.activity_counts(b.transactions),
    "SELECT broker_id, CAST(d AS INTEGER) AS weekday, CAST(h AS INTEGER) AS hour, n FROM own_cells")
add("E39_preferred_counts", lambda b: rep.preferred_counts(b.features),
    "SELECT broker_id, CAST(d AS INTEGER) AS weekday, CAST(h AS INTEGER) AS hour, n FROM book_cells")
add("E40_overview", lambda b: rep.overview(b.features, b.opportunities),
    "SELECT (SELECT count(DISTINCT broker_id) FROM opp) AS brokers, count(DISTINCT client_id) AS clients, "
    "count(*) FILTER (WHERE segment = 'en_riesgo') AS at_risk FROM feat")
add("E41_opportunity_totals", lambda b: rep.opportunity_totals(b.opportunities),
    "SELECT broker_id, count(*) FILTER (WHERE opportunity_type <> 'BEST_TIME') AS opportunities, "
    "count(*) FILTER (WHERE priority = 'high') AS high_priority FROM opp GROUP BY 1")
add("E42_message_counts", lambda b: msg.source_counts(msg.messages(b.opportunities, outside_texts(b.opportunities))),
    "SELECT broker_id, count(*) AS messages, count(*) FILTER (WHERE source = 'ollama') AS by_model, "
    "count(*) FILTER (WHERE source <> 'ollama') AS by_template FROM mixed_msg GROUP BY 1")
add("E43_broker_names", lambda b: opps.broker_names(b.features),
    "SELECT bid AS broker_id, bname AS broker_name FROM broker_name_of")

# --- F. ranking and bucketing ----------------------------------------------------------------
add("F1_quantile_buckets", lambda b: rfm.add_rfm(b.features.drop("R", "F", "M")).select("client_id", "R", "F", "M"),
    "SELECT client_id, R, F, M FROM feat")
add("F2_recency", lambda b: b.features.select("client_id", "R"), "SELECT client_id, R FROM feat")
add("F3_frequency_money", lambda b: b.features.select("client_id", "F", "M"), "SELECT client_id, F, M FROM feat")
add("F4_rfm_score", lambda b: b.features.select("client_id", "rfm_score"), "SELECT client_id, rfm_score FROM feat")
add("F5_segment", lambda b: b.features.select("client_id", "segment"), "SELECT client_id, segment FROM feat")
add("F6_risk_label", lambda b: scores_of(b).select("client_id", "risk_label"), "SELECT client_id, risk_label FROM scores")
add("F7_churn_score", lambda b: scores_of(b).select("client_id", "churn_score"), "SELECT client_id, churn_score FROM scores")
add("F8_stratified_folds",
    lambda b: metrics.stratified_folds(b.churn_labels).groupBy("churned", "fold").agg(F.count(F.lit(1)).alias("n")),
    "SELECT churned, CAST((i - 1) % 5 AS INTEGER) AS fold, count(*) AS n FROM "
    "(SELECT churned, row_number() OVER (PARTITION BY churned ORDER BY client_id) AS i FROM labels) GROUP BY 1, 2")
add("F9_score_ranks", lambda b: metrics.rank_table(scored_of(b)),
    "SELECT churn_probability, CAST(pos AS BIGINT) AS positives, CAST(neg AS BIGINT) AS negatives, "
    "(SELECT count(*) FROM scored s WHERE s.churn_probability < t.churn_probability) "
    "+ (pos + neg + 1) / 2.0::DOUBLE AS average_rank FROM thresholds t")
add("F10_precision_recall", lambda b: metrics.precision_recall_table(scored_of(b)),
    "SELECT churn_probability, CAST(pos AS BIGINT) AS positives, CAST(cpos AS BIGINT) AS positives_so_far, "
    "CAST(cneg AS BIGINT) AS negatives_so_far, CAST(cpos AS DOUBLE) / CAST(cpos + cneg AS DOUBLE) AS precision, "
    "CAST(cpos AS DOUBLE) / (SELECT sum(churned) FROM scored) AS recall FROM pr")

# --- G. sorts, limits, top-k ------------------------------------------------------------------
TOP = "SELECT broker_id, {n} AS position, client_id, client_name, total_volume_usd, segment FROM feat"
POSITION = "row_number() OVER (PARTITION BY broker_id ORDER BY total_volume_usd DESC, client_id)"


def top_clients(rows: int) -> Query:
    return lambda b: rep.top_clients(b.features, rows).withColumn("position", F.col("position").cast("bigint"))


RANKED = "broker_id, client_id, opportunity_type, rule_no, rank_in_rule"
add("G1_top_brokers_volume",
    lambda b: profile.top_brokers(profile.broker_volume(b.transactions), "total_volume_usd"),
    "SELECT * FROM broker_rev ORDER BY total_volume_usd DESC, 1, 2 LIMIT 10")
add("G2_top_brokers_clients",
    lambda b: profile.top_brokers(profile.broker_clients(b.transactions), "n_clients"),
    "SELECT * FROM broker_cli ORDER BY n_clients DESC, 1, 2 LIMIT 10")
add("G3_top10_clients", top_clients(10), TOP.format(n=POSITION) + " QUALIFY position <= 10")
add("G4_top15_clients", top_clients(15), TOP.format(n=POSITION) + " QUALIFY position <= 15")
add("G5_top_risk", lambda b: churn_model.top_risk(scores_of(b)),
    f"SELECT {SCORE_ROW} FROM scores ORDER BY churn_probability DESC, client_id LIMIT 10")
add("G6_listing_order", lambda b: opps.ranked(b.opportunities).select(names(RANKED)), f"SELECT {RANKED} FROM ranked_opp")
add("G7_client_table_order", lambda b: rep.by_recency(rep.client_status(b.features)).drop("churn_percent"),
    f"SELECT {STATUS.replace('churn_percent, ', '')} FROM status_table ORDER BY broker_id, days_since_last_tx, client_id")
add("G7_type_choices", lambda b: rep.type_choices(b.opportunities),
    "SELECT 'Todas' AS choice UNION ALL SELECT DISTINCT opportunity_type FROM opp")
add("G8_broker_list", lambda b: rep.broker_list(b.opportunities),
    "SELECT DISTINCT broker_id, broker_name FROM opp ORDER BY broker_name, broker_id")
add("G9_first_broker", lambda b: rep.first_broker(b.opportunities), "SELECT min(broker_id) AS broker_id FROM opp")

# --- U. set operations; R. rules ----------------------------------------------------------------
RULE = "broker_id, broker_name, client_id, opportunity_type, priority, total_volume_usd, volume_trend, segment"
add("U1_union_of_rules", lambda b: opps.detect(b.features), f"SELECT {o.OPP_COLUMNS} FROM opp")
add("U2_distinct_brokers", lambda b: b.features.select("broker_id", "broker_name").distinct(),
    "SELECT DISTINCT broker_id, broker_name FROM feat")
add("U3_replace_broker_rows", upserted, UPSERTED)
for key, kind in zip(
    ("R1_churn_risk", "R2_reactivation", "R3_upsell", "R4_best_time"), fv.OPPORTUNITY_TYPES
):
    add(key, lambda b, kind=kind: opps.of_type(opps.detect(b.features), kind).select(names(RULE)),
        f"SELECT {RULE} FROM opp WHERE opportunity_type = '{kind}'")

# --- K. messages ------------------------------------------------------------------------------------
add("K1_templates",
    lambda b: b.opportunities.select("client_id", "opportunity_type", msg.message_text().alias("message")),
    "SELECT client_id, opportunity_type, message FROM msg")
add("K2_prompts", lambda b: msg.prompts(b.opportunities),
    f"SELECT broker_id, client_id, opportunity_type, {o.SITUATION} AS situation, {o.PROMPT} AS prompt FROM opp")
add("K3_messages", lambda b: msg.messages(b.opportunities), f"SELECT {MESSAGE_ROW} FROM msg")
add("K3_messages_one_broker",
    lambda b: msg.messages(b.opportunities.where(F.col("broker_id") == fv.DIRECT_BROKER)),
    f"SELECT {MESSAGE_ROW} FROM msg WHERE broker_id = 'DIRECTO'")
add("K4_message_filters",
    lambda b: opps.filter_opportunities(
        msg.messages(b.opportunities), ("high", "medium"), ("CHURN_RISK", "UPSELL")),
    f"SELECT {MESSAGE_ROW} FROM msg WHERE priority IN ('high', 'medium') AND opportunity_type IN ('CHURN_RISK', 'UPSELL')")
add("K4_message_defaults", lambda b: msg.default_messages(msg.messages(b.opportunities)),
    f"SELECT {MESSAGE_ROW} FROM msg WHERE priority IN ('high', 'medium')")


# --- M. churn model -----------------------------------------------------------------------------------
def feature_vectors(b: ClientBook) -> DataFrame:
    assembler = churn_model.unfitted_model().getStages()[0]
    return assembler.transform(b.training).select(
        "client_id", F.posexplode(vector_to_array("inputs")).alias("position", "value"))


def importance_ranks(b: ClientBook) -> DataFrame:
    return churn_model.importances(b.model)


def metrics_row(b: ClientBook) -> DataFrame:
    scored = scored_of(b)
    return metrics.ranking_metrics(scored).select(
        *[F.round(c, 9).alias(c) for c in ("roc_auc", "average_precision")])


def fits(scores: DataFrame, *extra: str) -> DataFrame:
    """What must hold for each row of a score table, whatever the model gives."""
    p, score = F.col("churn_probability"), F.col("churn_score")
    return scores.select(
        "client_id", *extra, p.between(0, 1).alias("in_range"),
        (F.abs(score - p * 100) <= 0.5 + 1e-9).alias("score_fits"),
        F.expr("risk_label = CASE " + " ".join(
            f"WHEN churn_probability <= {limit} THEN '{name}'" for name, limit in zip(fv.RISK_LABELS, fv.RISK_LIMITS)
        ) + f" ELSE '{fv.RISK_LABELS[-1]}' END").alias("label_fits"))


FITS = "true AS in_range, true AS score_fits, true AS label_fits"


def tree_facts(b: ClientBook) -> DataFrame:
    """Size of the stored model, beside each client that it scores."""
    model = b.model
    return b.churn_scores.select(
        "client_id", F.lit(len(model.trees)).alias("rounds"),
        F.lit(model.depth <= churn_model.DEPTH).alias("shallow"),
        F.lit(model.rate).alias("rate"), F.lit(len(model.inputs)).alias("inputs"))


def first_tree(b: ClientBook) -> DataFrame:
    """Splits and leaves of the first tree of the stored model."""
    found = boosting.node_table(b.model).where("tree = 0").drop("tree")
    return found.withColumns({c: F.round(c, 6) for c in ("threshold", "gain", "cover", "value")})


def reloaded_difference(b: ClientBook) -> DataFrame:
    """Per client, whether the saved and loaded model gives the score of the model in use."""
    again = reloaded_model_scores(b).select("client_id", F.col("churn_probability").alias("again"), "inputs")
    return b.churn_scores.join(again, "client_id").select(
        "client_id", (F.abs(F.col("churn_probability") - F.col("again")) < 1e-12).alias("same"), "inputs")


def fold_sizes(b: ClientBook) -> DataFrame:
    p = F.col("churn_probability")
    return b.validated.groupBy("churned", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("client_id").alias("clients"),
        F.min(p.between(0, 1)).alias("in_range"))


def evaluator_agrees(b: ClientBook) -> DataFrame:
    """The area under the out-of-fold ROC curve against Spark ML's evaluator; clients on both sides."""
    raw = b.validated.select(F.col("churned").cast("double").alias("label"), F.col("churn_probability").alias("raw"))
    area = BinaryClassificationEvaluator(rawPredictionCol="raw", labelCol="label", numBins=0).evaluate(raw)
    counted = b.validated.agg(
        F.count_if(F.col("churned") == 1).alias("churned"), F.count_if(F.col("churned") == 0).alias("active"))
    ours = metrics.ranking_metrics(b.validated)
    return counted.select(
        "churned", "active", (F.abs(ours.select("roc_auc").scalar() - F.lit(area)) < 1e-9).alias("roc_agrees"),
        ours.select("average_precision").scalar().between(0, 1).alias("precision_in_range"))


def importance_facts(b: ClientBook) -> DataFrame:
    found = churn_model.importances(b.model)     # ten rows
    total = found.agg(F.round(F.sum("importance"), 9)).scalar()
    return found.select("feature", (F.col("importance") >= 0).alias("positive"), total.alias("total"))


def report_facts(report: DataFrame) -> DataFrame:
    """Keys of the report; values where they do not depend on the model."""
    known = F.col("section").isin("head", "dataset")
    return report.select("section", "key", F.when(known, F.round("value", 9)).alias("value"))


FEATURE_LIST = ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE)" for c in fv.MODEL_FEATURES)
LINES = "line, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support"


def rounded_report(b: ClientBook) -> DataFrame:
    lines = metrics.classification_report(scored_of(b))
    return lines.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


add("M1_feature_vectors", feature_vectors,
    "SELECT client_id, CAST(unnest(range(10)) AS INTEGER) AS position, "
    f"unnest([{FEATURE_LIST}]) AS value FROM feat JOIN labels USING (client_id)")
add("M2_boosted_trees",
    lambda b: churn_model.score_clients(b.model, b.features))
add("M2_tree_facts", tree_facts,
    f"SELECT client_id, {ROUNDS} AS rounds, true AS shallow, 0.05::DOUBLE AS rate, 10 AS inputs FROM feat")
add("M2_first_tree", first_tree, o.first_tree(
    churn_model.SEED, churn_model.DEPTH, churn_model.RATE, churn_model.ROW_SHARE, churn_model.COLUMN_SHARE, boosting.BINS))
add("M3_out_of_fold", lambda b: b.validated)
add("M3_fold_sizes", fold_sizes,
    "SELECT churned, CAST((i - 1) % 5 AS INTEGER) AS fold, count(*) AS n, count(*) AS clients, true AS in_range FROM "
    "(SELECT churned, row_number() OVER (PARTITION BY churned ORDER BY client_id) AS i FROM labels) GROUP BY 1, 2")
add("M4_ranking_metrics", metrics_row,
    "SELECT round((SELECT sum(t.pos * ((SELECT coalesce(sum(neg), 0) FROM thresholds u "
    "WHERE u.churn_probability < t.churn_probability) + t.neg / 2.0::DOUBLE)) / (sum(t.pos) * sum(t.neg)) "
    "FROM thresholds t), 9) AS roc_auc, round((SELECT sum(pos * (CAST(cpos AS DOUBLE) / (cpos + cneg))) / sum(pos) "
    "FROM pr), 9) AS average_precision")
add("M4_out_of_fold_metrics", lambda b: metrics.ranking_metrics(b.validated))
add("M4_evaluator_agrees", evaluator_agrees,
    "SELECT count(*) FILTER (WHERE churned = 1) AS churned, count(*) FILTER (WHERE churned = 0) AS active, "
    "true AS roc_agrees, true AS precision_in_range FROM labels")
add("M5_classification_report", rounded_report, f"SELECT {LINES} FROM report_lines")
add("M6_final_fit", lambda b: churn_model.score_clients(b.model, b.features).select("client_id", "churn_probability"))
add("M6_final_fit_facts", lambda b: fits(churn_model.score_clients(b.model, b.features)), f"SELECT client_id, {FITS} FROM feat")
add("M7_importances", importance_ranks)
add("M7_importance_facts", importance_facts,
    f"SELECT unnest([{', '.join(map(o.quote, fv.MODEL_FEATURES))}]) AS feature, true AS positive, 1.0::DOUBLE AS total")
add("M8_score_clients", lambda b: b.churn_scores)
add("M8_score_facts", lambda b: fits(b.churn_scores, "client_name", "broker_id", "broker_name", "segment"),
    f"SELECT client_id, client_name, broker_id, broker_name, segment, {FITS} FROM feat")
add("M9_features_before_cutoff",
    lambda b: cf.build_features_before(b.transactions, churn.label_cutoff(b.transactions)),
    f"SELECT {o.FEATURE_COLUMNS} FROM p_base")



def features_at_cutoffs(b: ClientBook) -> DataFrame:
    """Features at five midnights from the daily state."""
    last = b.transactions.agg(F.to_date(F.max("trigger_at_dt"))).first()[0]
    found = b.features_at([last - timedelta(days=d) for d in o.CUTOFF_DAYS])
    return found.withColumn("cutoff", F.col("cutoff").cast("string"))


add("M9_features_at_cutoffs", features_at_cutoffs, " UNION ALL ".join(
    f"SELECT strftime({o.cutoff(days)}, '%Y-%m-%d') AS cutoff, {o.FEATURE_COLUMNS} FROM cut{k}_base"
    for k, days in enumerate(o.CUTOFF_DAYS)))

# --- P. reports -------------------------------------------------------------------------------------------
EDA = f"""
    SELECT 'shape' AS section, k AS key, CAST(v AS DOUBLE) AS value FROM (SELECT 'row_count' AS k, count(*) AS v FROM tx)
    UNION ALL SELECT 'nulls', column_name, null_percent FROM ({NULLS})
    UNION ALL SELECT 'dates', 'first_time', epoch_us(min(ts)) / 1e6::DOUBLE FROM tx
    UNION ALL SELECT 'dates', 'last_time', epoch_us(max(ts)) / 1e6::DOUBLE FROM tx
    UNION ALL SELECT 'universe', 'brokers', CAST(count(DISTINCT intermediary_uuid) AS DOUBLE) FROM with_broker
    UNION ALL SELECT 'universe', 'clients', CAST(count(DISTINCT balance_owner_uuid) AS DOUBLE) FROM with_broker
    UNION ALL SELECT 'universe', 'transactions', CAST(count(*) AS DOUBLE) FROM with_broker
    UNION ALL SELECT 'volume', 'p' || percent, volume_usd FROM ({PERCENTILES})
    UNION ALL SELECT 'top_volume', k, total_volume_usd FROM (SELECT intermediary_uuid || ' ' || intermediary_name AS k, *
      FROM broker_rev ORDER BY total_volume_usd DESC, intermediary_uuid, intermediary_name LIMIT 10)
    UNION ALL SELECT 'top_clients', k, n_clients FROM (SELECT intermediary_uuid || ' ' || intermediary_name AS k, *
      FROM broker_cli ORDER BY n_clients DESC, intermediary_uuid, intermediary_name LIMIT 10)
    UNION ALL SELECT 'status', status, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM tx) * 100 FROM tx
      WHERE status IS NOT NULL GROUP BY status
    UNION ALL SELECT 'histogram', CAST(bin AS VARCHAR), n FROM ({HISTOGRAM})"""
REPORT = f"""
    SELECT section, key, round(value, 9) AS value FROM (
    SELECT 'dataset' AS section, 'clients' AS key, CAST(count(*) AS DOUBLE) AS value FROM feat
    UNION ALL SELECT 'dataset', 'labelled', count(*) FROM labels
    UNION ALL SELECT 'dataset', 'churned', count(*) FROM labels WHERE churned = 1
    UNION ALL SELECT 'dataset', 'active', count(*) FROM labels WHERE churned = 0
    UNION ALL SELECT 'dataset', 'churn_rate', avg(churned) * 100 FROM labels
    UNION ALL SELECT 'metrics', 'roc_auc', roc_auc FROM ({ORACLES["M4_ranking_metrics"]})
    UNION ALL SELECT 'metrics', 'average_precision', average_precision FROM ({ORACLES["M4_ranking_metrics"]})
    UNION ALL SELECT 'classification', line || ' / ' || unnest(['precision', 'recall', 'f1', 'support']),
      unnest([precision, recall, f1, CAST(support AS DOUBLE)]) FROM report_lines
    UNION ALL SELECT 'risk', risk_label, clients FROM ({RISK_COUNTS}))"""
KPI_TEXTS = (
    "SELECT broker_id, CASE WHEN total_volume_usd >= 1e6 THEN '$' || printf('%.1f', total_volume_usd / 1e6::DOUBLE) || 'M' "
    f"ELSE {o.MONEY} END AS volume, '$' || {o.grouped('avg_volume_usd')} AS mean_ticket, "
    "format('{:,}', transactions) AS transactions, CAST(clients AS VARCHAR) AS clients FROM kpis"
)
HOURS = ", ".join(f"CAST(sum(n) FILTER (WHERE hour = {h}) AS BIGINT) AS h{h:02d}" for h in range(24))
add("P1_opportunity_table", lambda b: rep.opportunity_table(b.opportunities, scores_of(b)),
    f"SELECT {OPP_TABLE} FROM opp_table WHERE raw_priority IN ('high', 'medium') AND opportunity_type <> 'BEST_TIME'")
add("P2_broker_card", lambda b: rep.card_texts(rep.broker_card(b.features, b.opportunities)),
    f"SELECT broker_id, CAST(clients AS VARCHAR) AS clients, {o.MONEY} || ' USD vol. total' AS total_volume, "
    "CAST(active AS VARCHAR) AS active, CAST(active_percent AS VARCHAR) || '% del portafolio' AS active_share, "
    f"CAST(at_risk AS VARCHAR) AS at_risk, '$' || {o.grouped('at_risk_volume_usd')} || ' en juego' AS at_risk_volume, "
    "CAST(dormant AS VARCHAR) AS dormant, CAST(upsell AS VARCHAR) AS upsell FROM card")
add("P3_broker_kpis", lambda b: rep.kpi_texts(rep.broker_kpis(b.transactions, b.features)), KPI_TEXTS)
add("P4_distributions", lambda b: rep.distributions(b.features, b.opportunities),
    f"SELECT broker_id, 'type' AS kind, opportunity_type AS key, {o.choose('opportunity_type', fv.TYPE_LABELS)} AS label, "
    "count(*) AS n FROM opp GROUP BY ALL "
    f"UNION ALL SELECT broker_id, 'segment', segment, {o.SEGMENT_LABEL}, count(*) FROM feat GROUP BY ALL")
add("P5_top_clients", top_clients(10), TOP.format(n=POSITION) + " QUALIFY position <= 10")
add("P5_top_clients_fallback",
    lambda b: rep.top_clients_without_transactions(b.transactions, b.features).withColumn(
        "position", F.col("position").cast("bigint")),
    f"SELECT * FROM ({TOP.format(n=POSITION)} QUALIFY position <= 15) WHERE broker_id NOT IN (SELECT broker_id FROM own)")
add("P6_monthly_volume", lambda b: rep.monthly_volume(b.transactions).orderBy("broker_id", "month"), MONTHLY)
add("P7_activity_matrix", lambda b: rep.activity_matrix(rep.activity_grid(b.transactions, b.features)),
    f"SELECT broker_id, weekday, {HOURS} FROM grid GROUP BY 1, 2")
add("P8_client_status", lambda b: rep.by_recency(rep.client_status(b.features, scores_of(b))),
    f"SELECT {STATUS} FROM status_table")
add("P9_overview", lambda b: rep.overview(b.features, b.opportunities), ORACLES["E40_overview"])
add("P9_opportunity_totals", lambda b: rep.opportunity_totals(b.opportunities), ORACLES["E41_opportunity_totals"])
add("P10_profile_report",
    lambda b: profile.profile_report(b.transactions).withColumn(
        "value", F.when(F.col("section") == "volume", F.round("value", 6)).otherwise(F.col("value"))), EDA)
HEAD = f"""
    SELECT 'head' AS section, 'learner: {churn_model.LEARNER}' AS key, CAST({ROUNDS} AS DOUBLE) AS value
    UNION ALL SELECT 'head', 'reference_date', epoch_us(max(ts)) / 1e6::DOUBLE FROM tx
    UNION ALL SELECT 'head', 'window_days', CAST({fv.CHURN_WINDOW_DAYS} AS DOUBLE)"""
NAMED = f"SELECT 'importance' AS section, unnest([{', '.join(map(o.quote, fv.MODEL_FEATURES))}]) AS key"
add("P11_churn_report",
    lambda b: churn_model.churn_report(
        b.features, b.churn_labels, scored_of(b), b.model, scores_of(b), b.reference_date)
    .withColumn("value", F.when(F.col("section") != "importance", F.round("value", 9))),
    f"{REPORT} UNION ALL {HEAD} UNION ALL SELECT section, key, CAST(NULL AS DOUBLE) FROM ({NAMED})")
add("A10_report_facts", lambda b: report_facts(b.churn_report),
    f"SELECT section, key, CASE WHEN section = 'dataset' THEN value END AS value FROM ({REPORT}) "
    f"UNION ALL {HEAD} UNION ALL SELECT section, key, CAST(NULL AS DOUBLE) FROM ({NAMED})")
