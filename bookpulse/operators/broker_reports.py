"""Reports per broker, for all brokers in one job; pick one broker with a filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookpulse.fixed_values import (
    ACTIVITY_LABELS,
    ACTIVITY_LIMITS,
    ALL_TYPES,
    CONTACT_TEXT,
    DAY_NAMES,
    DEFAULT_PRIORITY_FILTER,
    DEFAULT_TYPE_FILTER,
    DIRECT_BROKER,
    PRIORITY_ICONS,
    PRIORITY_LABELS,
    SEGMENT_LABELS,
    STRONG_TREND,
    TREND_LABELS,
    TYPE_ICONS,
    TYPE_LABELS,
)
from bookpulse.functions.numbers import exact_sum, halves, joined, parts, ratio
from bookpulse.functions.text import fill, grouped, label, plain
from bookpulse.operators.cleaning import reporting_subset
from bookpulse.operators.labels import percent_text
from bookpulse.operators.opportunities import filter_opportunities

_CELLS = 7 * 24


# --- row-wise labels ---------------------------------------------------------------
def activity_light(days: Column) -> Column:
    """Activity class by days since the last transaction."""
    active, attention, idle = ACTIVITY_LIMITS
    names = ACTIVITY_LABELS
    return (
        F.when(days < active, names[0]).when(days <= attention, names[1])
        .when(days <= idle, names[2]).otherwise(names[3])
    )


def trend_label(trend: Column) -> Column:
    """Trend class by weekly slope."""
    return (
        F.when(trend > STRONG_TREND, TREND_LABELS["strong_up"]).when(trend > 0, TREND_LABELS["up"])
        .when(trend < -STRONG_TREND, TREND_LABELS["strong_down"]).when(trend < 0, TREND_LABELS["down"])
        .otherwise(TREND_LABELS["flat"])
    )


def best_contact(day: Column, hour: Column) -> Column:
    """Preferred weekday and hour as text; the day index wraps at seven."""
    names = F.array(*[F.lit(n) for n in DAY_NAMES])
    return fill(CONTACT_TEXT, {
        "day": F.get(names, F.pmod(day, F.lit(7))),
        "hour": F.lpad(hour.cast("string"), 2, "0"),
    })


def _marked(labels: dict[str, str], icons: dict[str, str]) -> dict[str, str]:
    return {key: f"{icons[key]} {shown}" for key, shown in labels.items()}


def type_label(key: Column) -> Column:
    return label(key, _marked(TYPE_LABELS, TYPE_ICONS))


def priority_label(key: Column) -> Column:
    return label(key, _marked(PRIORITY_LABELS, PRIORITY_ICONS))


def segment_label(key: Column) -> Column:
    return label(key, SEGMENT_LABELS)


def inactive_text(days: Column) -> Column:
    return F.concat(plain(days), F.lit("d"))


def money_text(amount: Column) -> Column:
    return F.concat(F.lit("$"), grouped(amount))


# --- tables -------------------------------------------------------------------------
def own_transactions(tx: DataFrame) -> DataFrame:
    """Reporting transactions that carry a broker of their own."""
    return reporting_subset(tx).where(F.col("broker_id_clean") != DIRECT_BROKER)


def opportunity_table(
    opportunities: DataFrame,
    scores: DataFrame | None = None,
    priorities: Sequence[str] = DEFAULT_PRIORITY_FILTER,
    types: Sequence[str] = DEFAULT_TYPE_FILTER,
) -> DataFrame:
    """Opportunities as shown to a broker, with the churn percent where a score exists."""
    shown = filter_opportunities(opportunities, priorities, types)
    if scores is None:
        shown = shown.withColumn("churn_probability", F.lit(None).cast("double"))
    else:
        shown = shown.join(scores.select("client_id", "churn_probability"), "client_id", "left")
    return shown.select(
        "broker_id",
        F.col("client_name").alias("client"),
        type_label(F.col("opportunity_type")).alias("type"),
        priority_label(F.col("priority")).alias("priority"),
        inactive_text(F.col("days_since_last_tx")).alias("inactive"),
        "total_volume_usd",
        percent_text(F.col("churn_probability")).alias("churn_percent"),
    )


def client_status(features: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Status of each client as shown to its broker."""
    clients = features
    if scores is None:
        clients = clients.withColumn("churn_probability", F.lit(None).cast("double"))
    else:
        clients = clients.join(scores.select("client_id", "churn_probability"), "client_id", "left")
    return clients.select(
        "broker_id", "client_id",
        F.col("client_name").alias("client"),
        activity_light(F.col("days_since_last_tx")).alias("activity"),
        segment_label(F.col("segment")).alias("segment"),
        inactive_text(F.col("days_since_last_tx")).alias("inactive"),
        F.col("tx_count_30d").cast("int").alias("tx_30d"),
        F.col("tx_count_90d").cast("int").alias("tx_90d"),
        money_text(F.col("total_volume_usd")).alias("total_volume"),
        trend_label(F.col("volume_trend")).alias("trend"),
        best_contact(F.col("preferred_day"), F.col("preferred_hour")).alias("best_contact"),
        percent_text(F.col("churn_probability")).alias("churn_percent"),
        "days_since_last_tx",
    )


def by_recency(status: DataFrame) -> DataFrame:
    """Output order of the client table."""
    return status.orderBy("broker_id", "days_since_last_tx", "client_id")


_VOLUME, _MEAN = (tuple(f"{name}_{k}" for k in range(5)) for name in ("volume", "mean"))


def client_cells(features: DataFrame) -> DataFrame:
    """Counts and sums per broker and segment, of which all totals over clients are made.

    Amounts stay apart in limbs, so totals of cells are as exact as totals of clients.
    """
    amounts = (("total_volume_usd", _VOLUME), ("avg_volume_usd", _MEAN))
    split = {f"{names[0]}_{k}": half for c, names in amounts for k, half in zip("wfb", halves(F.col(c)))}
    limbs = {
        name: part for _, names in amounts for name, part in zip(names, parts(*[F.col(f"{names[0]}_{k}") for k in "wfb"]))
    }
    rows = features.select("broker_id", "segment", "client_id", "tx_count_completed", "total_volume_usd", "avg_volume_usd")
    return rows.withColumns(split).withColumns(limbs).groupBy("broker_id", "segment").agg(
        F.count(F.lit(1)).alias("clients"), F.count("client_id").alias("named"), F.sum("tx_count_completed").alias("tx"),
        *[F.sum(c).alias(c) for c in (*_VOLUME, *_MEAN)],
    )


def opportunity_cells(opportunities: DataFrame) -> DataFrame:
    """Opportunities per broker, type and priority."""
    return opportunities.groupBy("broker_id", "opportunity_type", "priority").agg(F.count(F.lit(1)).alias("n"))


def _amount(names: Sequence[str], only: Column | None = None) -> Column:
    """Total of an amount over cells, or over those for which ``only`` holds."""
    return joined([F.sum(F.col(c) if only is None else F.when(only, F.col(c))) for c in names])


def broker_card(features: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Headline numbers of each broker's client book."""
    return card_of(client_cells(features), opportunity_cells(opportunities))


def card_of(clients: DataFrame, opportunities: DataFrame) -> DataFrame:
    """``broker_card`` from cells."""
    at_risk = F.col("segment") == "en_riesgo"

    def of(segment: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("segment") == segment, F.col("clients"))), F.lit(0))

    book = clients.groupBy("broker_id").agg(
        F.sum("clients").alias("clients"), of("activo_sano").alias("active"), of("en_riesgo").alias("at_risk"),
        of("reactivar").alias("dormant"), _amount(_VOLUME).cast("double").alias("total_volume_usd"),
        F.coalesce(_amount(_VOLUME, at_risk).cast("double"), F.lit(0.0)).alias("at_risk_volume_usd"),
    )
    upsell = (
        opportunities.where(F.col("opportunity_type") == "UPSELL")
        .groupBy("broker_id").agg(F.sum("n").alias("upsell"))
    )
    return book.join(upsell, "broker_id", "left").withColumns({
        "upsell": F.coalesce("upsell", F.lit(0)),
        "active_percent": F.bround(F.col("active") / F.col("clients") * 100, 0).cast("int"),
    })


def broker_kpis(tx: DataFrame, features: DataFrame) -> DataFrame:
    """Volume, mean ticket, transactions and clients of each broker in ``features``."""
    return kpis_of(tx, client_cells(features))


def kpis_of(tx: DataFrame, clients: DataFrame) -> DataFrame:
    """``broker_kpis`` with the client side from cells.

    Numbers come from the broker's own completed transactions; a broker without any, and
    clients without a broker, fall back to the client features (mean of client means).
    """
    own = (
        own_transactions(tx)
        .groupBy(F.col("broker_id_clean").alias("broker_id"))
        .agg(
            exact_sum(F.col("volume_usd")).alias("own_volume"),
            F.count(F.lit(1)).alias("own_tx"),
        )
    )
    book = clients.groupBy("broker_id").agg(
        _amount(_VOLUME).alias("book_volume"), _amount(_MEAN).alias("book_means"),
        F.sum("tx").alias("book_tx"), F.sum("named").alias("clients"),
    )
    has_own = F.col("own_tx").isNotNull()
    return book.join(own, "broker_id", "left").select(
        "broker_id",
        F.when(has_own, "transactions").otherwise("features").alias("basis"),
        F.coalesce("own_volume", "book_volume").cast("double").alias("total_volume_usd"),
        F.when(has_own, ratio(F.col("own_volume"), F.col("own_tx")))
        .otherwise(ratio(F.col("book_means"), F.col("clients"))).alias("avg_volume_usd"),
        F.coalesce("own_tx", "book_tx").alias("transactions"),
        "clients",
    )


def card_texts(card: DataFrame) -> DataFrame:
    """The broker card as shown."""
    with_text = lambda column, text: F.concat(column, F.lit(text))
    return card.select(
        "broker_id",
        F.col("clients").cast("string").alias("clients"),
        with_text(money_text(F.col("total_volume_usd")), " USD vol. total").alias("total_volume"),
        F.col("active").cast("string").alias("active"),
        with_text(F.col("active_percent").cast("string"), "% del portafolio").alias("active_share"),
        F.col("at_risk").cast("string").alias("at_risk"),
        with_text(money_text(F.col("at_risk_volume_usd")), " en juego").alias("at_risk_volume"),
        F.col("dormant").cast("string").alias("dormant"),
        F.col("upsell").cast("string").alias("upsell"),
    )


def kpi_texts(kpis: DataFrame) -> DataFrame:
    """KPIs as shown: volumes of a million and more in millions with one digit."""
    total = F.col("total_volume_usd")
    return kpis.select(
        "broker_id",
        F.when(total >= 1e6, F.concat(F.lit("$"), plain(total / 1e6, 1), F.lit("M")))
        .otherwise(money_text(total)).alias("volume"),
        money_text(F.col("avg_volume_usd")).alias("mean_ticket"),
        F.format_number("transactions", 0).alias("transactions"),
        F.col("clients").cast("string").alias("clients"),
    )


def distributions(features: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Opportunities per type and clients per segment of each broker, with display labels."""
    return distributions_of(client_cells(features), opportunity_cells(opportunities))


def distributions_of(clients: DataFrame, opportunities: DataFrame) -> DataFrame:
    """``distributions`` from cells; a cell of clients is a row of it already."""
    kinds = opportunities.groupBy("broker_id", "opportunity_type").agg(F.sum("n").alias("n")).select(
        "broker_id", F.lit("type").alias("kind"), F.col("opportunity_type").alias("key"),
        label(F.col("opportunity_type"), TYPE_LABELS).alias("label"), "n",
    )
    segments = clients.select(
        "broker_id", F.lit("segment").alias("kind"), F.col("segment").alias("key"),
        segment_label(F.col("segment")).alias("label"), F.col("clients").alias("n"),
    )
    return kinds.unionByName(segments)


def top_clients(features: DataFrame, rows: int = 10) -> DataFrame:
    """Largest clients of each broker; equal volumes go by client id.

    The rank limit is applied before the shuffle, so at most ``rows`` clients per broker
    and task are moved.
    """
    order = Window.partitionBy("broker_id").orderBy(F.desc("total_volume_usd"), "client_id")
    return (
        features.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= rows)
        .select("broker_id", "position", "client_id", "client_name", "total_volume_usd", "segment")
    )


def top_clients_without_transactions(tx: DataFrame, features: DataFrame, rows: int = 15) -> DataFrame:
    """Largest clients of the brokers that have no completed transactions of their own.

    Shown in place of the monthly volume of such a broker.
    """
    active = own_transactions(tx).select(F.col("broker_id_clean").alias("broker_id")).distinct()
    return top_clients(features, rows).join(active, "broker_id", "left_anti")


def monthly_volume(tx: DataFrame) -> DataFrame:
    """Completed volume per transaction broker and month; undated rows have no month."""
    return (
        own_transactions(tx)
        .where(F.col("month").isNotNull())
        .groupBy(F.col("broker_id_clean").alias("broker_id"), "month")
        .agg(exact_sum(F.col("volume_usd")).cast("double").alias("volume_usd"))
    )


def _cell_counts(df: DataFrame, broker: str, weekday: Column, hour: Column) -> DataFrame:
    return df.groupBy(
        F.col(broker).alias("broker_id"), weekday.cast("int").alias("weekday"), hour.cast("int").alias("hour")
    ).agg(F.count(F.lit(1)).alias("n"))


def activity_counts(tx: DataFrame) -> DataFrame:
    """Dated completed transactions per transaction broker, weekday and hour."""
    dated = own_transactions(tx).where(F.col("trigger_at_dt").isNotNull())
    return _cell_counts(dated, "broker_id_clean", F.col("weekday"), F.col("hour"))


def preferred_counts(features: DataFrame) -> DataFrame:
    """Clients per broker, preferred weekday and preferred hour."""
    return _cell_counts(
        features, "broker_id", F.pmod("preferred_day", F.lit(7)), F.pmod("preferred_hour", F.lit(24))
    )


def activity_grid(tx: DataFrame, features: DataFrame) -> DataFrame:
    """168 rows (weekday x hour) per broker in ``features``, empty cells with 0.

    Counts completed transactions of the broker; a broker without any, and clients
    without a broker, count clients by their preferred day and hour. Each broker's cells
    fit one map of at most 168 entries, so zero cells need no join.
    """
    own = _cell_counts(own_transactions(tx), "broker_id_clean", F.col("weekday"), F.col("hour"))
    found = own.withColumn("basis", F.lit("tx")).unionByName(
        preferred_counts(features).withColumn("basis", F.lit("book"))
    )

    def held(basis: str) -> Column:
        entry = F.struct(F.col("weekday") * 24 + F.col("hour"), "n")
        dated = (F.col("basis") == basis) & F.col("hour").isNotNull()
        return F.map_from_entries(F.collect_list(F.when(dated, entry))).alias(basis)

    per_broker = found.groupBy("broker_id").agg(
        F.max(F.col("basis") == "tx").alias("has_tx"), F.max(F.col("basis") == "book").alias("in_book"),
        held("tx"), held("book"),
    )
    counts = F.when(F.col("has_tx"), F.col("tx")).otherwise(F.col("book"))
    return (
        per_broker.where("in_book")
        .select("broker_id", counts.alias("counts"),
                F.explode(F.sequence(F.lit(0), F.lit(_CELLS - 1))).alias("cell"))
        .select(
            "broker_id",
            F.floor(F.col("cell") / 24).cast("int").alias("weekday"),
            (F.col("cell") % 24).cast("int").alias("hour"),
            F.coalesce(F.try_element_at("counts", "cell"), F.lit(0)).cast("bigint").alias("n"),
        )
    )


def activity_matrix(grid: DataFrame) -> DataFrame:
    """The grid with one column per hour."""
    hours = [F.sum(F.when(F.col("hour") == h, F.col("n"))).alias(f"h{h:02d}") for h in range(24)]
    return grid.groupBy("broker_id", "weekday").agg(*hours)


def broker_list(opportunities: DataFrame) -> DataFrame:
    """Brokers that have opportunities, by name."""
    return opportunities.select("broker_id", "broker_name").distinct().orderBy("broker_name", "broker_id")


def type_choices(opportunities: DataFrame) -> DataFrame:
    """Types a broker can choose from: all of them, then those that occur, by name."""
    found = opportunities.select(F.col("opportunity_type").alias("choice"), F.lit(1).alias("place")).distinct()
    everything = opportunities.agg(F.lit(ALL_TYPES).alias("choice"), F.lit(0).alias("place"))
    return everything.unionByName(found).orderBy("place", "choice").select("choice")


def first_broker(opportunities: DataFrame) -> DataFrame:
    """Broker a message run starts with when none is named."""
    return opportunities.agg(F.min("broker_id").alias("broker_id"))


def overview(features: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Brokers with opportunities, clients, and clients at risk, over the whole book."""
    return overview_of(client_cells(features), opportunity_cells(opportunities))


def overview_of(clients: DataFrame, opportunities: DataFrame) -> DataFrame:
    """``overview`` from cells: brokers are the few rows that are left of the opportunities."""
    brokers = opportunities.agg(F.count_distinct("broker_id")).scalar()
    at_risk = F.sum(F.when((F.col("segment") == "en_riesgo"), F.col("clients")))
    return clients.agg(
        F.coalesce(F.sum("named"), F.lit(0)).alias("clients"), F.coalesce(at_risk, F.lit(0)).alias("at_risk"),
    ).select(brokers.alias("brokers"), "clients", "at_risk")


def opportunity_totals(opportunities: DataFrame) -> DataFrame:
    """Per broker: opportunities without contact times, and all of high priority."""
    return totals_of(opportunity_cells(opportunities))


def totals_of(opportunities: DataFrame) -> DataFrame:
    """``opportunity_totals`` from cells."""
    def of(rows: Column) -> Column:
        return F.coalesce(F.sum(F.when(rows, F.col("n"))), F.lit(0))

    return opportunities.groupBy("broker_id").agg(
        of(F.col("opportunity_type") != "BEST_TIME").alias("opportunities"),
        of(F.col("priority") == "high").alias("high_priority"),
    )
