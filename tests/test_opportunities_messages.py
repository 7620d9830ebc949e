import pytest
from conftest import by_key, column
from pyspark.sql import functions as F

from bookpulse import fixed_values as fv
from bookpulse.operators import messages as msg
from bookpulse.operators import opportunities as opps
from bookpulse.sources import tables

LIMITS = (500.0, 1000.0)


def found(df, limits=LIMITS):
    return sorted((r["client_id"], r["opportunity_type"], r["priority"]) for r in opps.detect(df, limits).collect())


def test_volume_limits_are_strict(features):
    df = features(
        {"client_id": "a", "segment": "reactivar", "total_volume_usd": 500.0},
        {"client_id": "b", "segment": "reactivar", "total_volume_usd": 500.01},
        {"client_id": "c", "segment": "en_riesgo", "total_volume_usd": 1000.0},
        {"client_id": "d", "segment": "en_riesgo", "total_volume_usd": 1000.01},
        {"client_id": "e", "segment": "perdido", "total_volume_usd": 9e9},
    )
    assert found(df) == [
        ("b", "REACTIVATION", "medium"), ("c", "BEST_TIME", "low"), ("c", "CHURN_RISK", "medium"),
        ("d", "BEST_TIME", "low"), ("d", "CHURN_RISK", "high")]


@pytest.mark.parametrize(
    ("trend", "recent", "gap", "expected"),
    [(1.0, 0, 20.1, "high"), (1.0, 0, 20.0, "medium"), (1.0, 0, None, "medium"), (0.0, 5, 99.0, "medium"),
     (0.0, 4, 99.0, None), (-1.0, 5, 99.0, "medium")],
)
def test_upsell(features, trend, recent, gap, expected):
    df = features({"volume_trend": trend, "tx_count_90d": recent, "spread_vs_minimum": gap})
    upsell = [p for _, kind, p in found(df) if kind == "UPSELL"]
    assert upsell == ([expected] if expected else [])


def test_broker_name_is_that_of_the_first_client(features):
    df = features(
        {"client_id": "c2", "broker_name": "Second"}, {"client_id": "c1", "broker_name": "First"})
    assert set(column(opps.detect(df, LIMITS), "broker_name")) == {"First"}


def test_context_text(features):
    df = features({"total_volume_usd": 1234567.5, "avg_spread_bps": None, "volume_trend": -1.0,
                   "days_since_last_tx": 1200.4, "preferred_day": 7})
    assert column(df.select(opps.context().alias("c")), "c") == [
        "Segmento: activo_sano | Último tx: hace 1200 días | Volumen total: $1,234,568 USD | "
        "Volumen promedio: $100 USD | Tendencia: cayendo | Mejor hora: 9:00 N/A | Spread promedio: nan bps"]


@pytest.fixture
def listed(features):
    return opps.detect(features(
        {"client_id": "a", "segment": "en_riesgo", "total_volume_usd": 10.0},
        {"client_id": "b", "segment": "en_riesgo", "total_volume_usd": 2000.0},
        {"client_id": "c", "segment": "activo_sano", "total_volume_usd": 30.0},
        {"client_id": "d", "segment": "activo_sano", "broker_id": "B2", "total_volume_usd": 30.0},
    ), LIMITS)


def test_listing_order_and_ranks(listed):
    ordered = [(r["client_id"], r["opportunity_type"]) for r in listed.orderBy(*opps.listing_order()).collect()]
    assert ordered == [
        ("b", "CHURN_RISK"), ("a", "CHURN_RISK"), ("c", "UPSELL"), ("a", "BEST_TIME"), ("b", "BEST_TIME"),
        ("c", "BEST_TIME"), ("d", "UPSELL"), ("d", "BEST_TIME")]
    ranks = {(r["client_id"], r["opportunity_type"]): r["rank_in_rule"] for r in opps.ranked(listed).collect()}
    assert (ranks["b", "CHURN_RISK"], ranks["a", "CHURN_RISK"], ranks["c", "BEST_TIME"]) == (1, 2, 3)


def test_filters(listed):
    assert opps.filter_opportunities(listed).count() == 8
    assert opps.filter_opportunities(listed, fv.DEFAULT_PRIORITY_FILTER, fv.DEFAULT_TYPE_FILTER).count() == 4
    assert opps.filter_opportunities(listed, ["high"]).count() == 3
    assert opps.of_type(listed, "UPSELL").count() == 2
    assert opps.of_type(listed, fv.ALL_TYPES).count() == 8


def test_preview_takes_two_per_broker(listed):
    rows = [(r["broker_id"], r["client_id"], r["position"]) for r in opps.preview(listed).collect()]
    assert sorted(rows) == [("B1", "a", 2), ("B1", "b", 1), ("B2", "d", 1)]


def test_message_texts(listed, features):
    texts = {(r["client_id"], r["opportunity_type"]): r["message"]
             for r in msg.messages(listed, company="Cambio Uno").collect()}
    assert texts["b", "CHURN_RISK"].startswith("🔔 [CHURN_RISK]\nCliente: Ana\n\n📊 Situación: Lleva 10 días sin operar. ")
    assert "$2,000 USD" in texts["b", "CHURN_RISK"] and "Martes 9:00" in texts["b", "CHURN_RISK"]
    assert "mayores a $150 USD" in texts["c", "UPSELL"]
    assert all(t.endswith("\n\n— Cambio Uno AI") for t in texts.values())


#: The whole text of each type, letter for letter, so that a wrong word cannot hide behind the library's own table.
WHOLE_TEXTS = {
    "CHURN_RISK": (
        "🔔 [CHURN_RISK]\nCliente: Ana\n\n📊 Situación: Lleva 10 días sin operar. Su volumen histórico es de $2,000 USD.\n"
        "💡 Por qué importa: Este cliente representa un riesgo de churn de alto valor. Perderlo impacta directamente tu comisión.\n"
        "✅ Acción sugerida: Contáctalo hoy. Pregúntale si tiene necesidades de cambio de divisas pendientes. "
        "Mejor hora: Martes 9:00.\n\n— Cambio Uno AI"),
    "REACTIVATION": (
        "🔔 [REACTIVATION]\nCliente: Ana\n\n📊 Situación: Inactivo 10 días. Operó $2,000 USD en total contigo.\n"
        "💡 Por qué importa: Reactivar un cliente existente cuesta 5x menos que adquirir uno nuevo.\n"
        "✅ Acción sugerida: Envíale un recordatorio con el tipo de cambio del día. "
        "Mejor contactarlo el Martes a las 9:00.\n\n— Cambio Uno AI"),
    "UPSELL": (
        "🔔 [UPSELL]\nCliente: Ana\n\n📊 Situación: Cliente activo con volumen en crecimiento. Promedio de $100 USD por operación.\n"
        "💡 Por qué importa: Está en el mejor momento para aumentar el ticket promedio o frecuencia.\n"
        "✅ Acción sugerida: Ofrécele condiciones preferenciales para operaciones mayores a $150 USD. "
        "Contáctalo el Martes a las 9:00.\n\n— Cambio Uno AI"),
    "BEST_TIME": (
        "🔔 [BEST_TIME]\nCliente: Ana\n\n📊 Situación: Cliente activo. Su patrón histórico muestra mayor actividad los Martes a las 9:00.\n"
        "💡 Por qué importa: Contactar en el momento correcto aumenta la tasa de conversión.\n"
        "✅ Acción sugerida: Programa tu mensaje para el próximo Martes a las 9:00.\n\n— Cambio Uno AI"),
}


def test_whole_texts(listed):
    one = listed.limit(1).withColumns({
        "days_since_last_tx": F.lit(10.2), "total_volume_usd": F.lit(2000.0), "avg_volume_usd": F.lit(100.0),
        "volume_trend": F.lit(1.0), "preferred_day": F.lit(1), "preferred_hour": F.lit(9), "client_name": F.lit("Ana"),
    })
    for kind, text in WHOLE_TEXTS.items():
        rows = msg.messages(one.withColumn("opportunity_type", F.lit(kind)), company="Cambio Uno").collect()
        assert [r["message"] for r in rows] == [text]


def test_unknown_type_and_day(listed):
    odd = listed.limit(1).withColumns({"opportunity_type": F.lit("NEW"), "preferred_day": F.lit(9)})
    assert column(msg.messages(odd), "message") == ["🔔 Oportunidad detectada para Ana."]
    upsell = odd.withColumn("opportunity_type", F.lit("UPSELL"))
    assert "Contáctalo el entre semana a las 9:00." in column(msg.messages(upsell), "message")[0]
    assert column(msg.prompts(odd), "situation") == ["hay una oportunidad comercial"]


def test_outside_texts_win_unless_blank(listed, spark):
    given = spark.createDataFrame(
        [("b", "CHURN_RISK", " written \n"), ("a", "CHURN_RISK", " \t"), ("b", "CHURN_RISK", ""),
         ("c", "UPSELL", "same"), ("c", "UPSELL", "same")],
        "client_id string, opportunity_type string, text string")
    rows = {(r["client_id"], r["opportunity_type"]): r for r in msg.messages(listed, given).collect()}
    assert len(rows) == 8
    assert (rows["b", "CHURN_RISK"]["message"], rows["b", "CHURN_RISK"]["source"]) == ("written", "ollama")
    assert rows["a", "CHURN_RISK"]["source"] == "template"
    counts = by_key(msg.source_counts(msg.messages(listed, given)), "broker_id")
    assert counts["B1"] == {"broker_id": "B1", "messages": 6, "by_model": 2, "by_template": 4}


def test_upsert_replaces_only_the_brokers_of_a_run(listed, spark, tmp_path):
    path = str(tmp_path / "messages")
    assert tables.read_messages_or_empty(spark, path).count() == 0
    tables.upsert_messages(msg.messages(listed), path)
    first = listed.where("broker_id = 'B1' AND client_id = 'a'")
    tables.upsert_messages(msg.messages(first, signature="new"), path)
    stored = tables.read_messages_or_empty(spark, path)
    assert sorted(zip(column(stored, "broker_id"), column(stored, "client_id"))) == [
        ("B1", "a"), ("B1", "a"), ("B2", "d"), ("B2", "d")]
    assert all(m.endswith("— new") for m in column(stored.where("broker_id = 'B1'"), "message"))
    tables.upsert_messages(msg.messages(first, signature="new"), path)
    tables.upsert_messages(msg.messages(first.where("false")), path)
    assert tables.read_messages_or_empty(spark, path).count() == 4
