"""Message texts for opportunities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookpulse import schemas
from bookpulse.fixed_values import (
    LARGER_TICKET_FACTOR,
    MESSAGE_NO_DAY,
    MESSAGE_TEXTS,
    MESSAGE_TREND_WORDS,
    MODEL_SOURCE,
    OTHER_MESSAGE_TEXT,
    OTHER_SITUATION_TEXT,
    PROMPT_TEXT,
    PROMPT_TREND_WORDS,
    SITUATION_TEXTS,
    TEMPLATE_SOURCE,
)
from bookpulse.functions.text import day_name, fill, grouped, plain, signed_word
from bookpulse.operators.opportunities import filter_opportunities, preview

COMPANY = "Casa de Cambio"


def _fields(trend_words: tuple[str, str, str], company: str, signature: str | None) -> dict:
    return {
        "client_name": F.col("client_name"),
        "days": plain(F.col("days_since_last_tx")),
        "total": grouped(F.col("total_volume_usd")),
        "average": grouped(F.col("avg_volume_usd")),
        "larger": grouped(F.col("avg_volume_usd") * LARGER_TICKET_FACTOR),
        "trend": signed_word(F.col("volume_trend"), trend_words),
        "day": day_name(F.col("preferred_day"), MESSAGE_NO_DAY),
        "hour": F.col("preferred_hour"),
        "segment": F.col("segment"),
        "opportunity_type": F.col("opportunity_type"),
        "company": company,
        "signature": f"{company} AI" if signature is None else signature,
    }


def _by_type(texts: dict[str, str], other: str, fields: dict) -> Column:
    chain = F
    for kind, text in texts.items():
        chain = chain.when(F.col("opportunity_type") == kind, fill(text, fields))
    return chain.otherwise(fill(other, fields))


def message_text(company: str = COMPANY, signature: str | None = None) -> Column:
    """Ready-to-send text of an opportunity row."""
    return _by_type(MESSAGE_TEXTS, OTHER_MESSAGE_TEXT, _fields(MESSAGE_TREND_WORDS, company, signature))


def situation_text() -> Column:
    """One-line situation of an opportunity row, as used in the prompt."""
    return _by_type(SITUATION_TEXTS, OTHER_SITUATION_TEXT, _fields(PROMPT_TREND_WORDS, "", ""))


def prompt_text(company: str = COMPANY, signature: str | None = None) -> Column:
    """Prompt for an outside text model."""
    fields = _fields(PROMPT_TREND_WORDS, company, signature)
    return fill(PROMPT_TEXT, fields | {"situation": situation_text()})


def prompts(opportunities: DataFrame, company: str = COMPANY, signature: str | None = None) -> DataFrame:
    """Opportunity keys with situation and prompt, the input of an outside text model."""
    return opportunities.select(
        "broker_id", "client_id", "opportunity_type",
        situation_text().alias("situation"),
        prompt_text(company, signature).alias("prompt"),
    )


def messages(
    opportunities: DataFrame,
    outside_texts: DataFrame | None = None,
    company: str = COMPANY,
    signature: str | None = None,
) -> DataFrame:
    """One message per opportunity of every broker in ``opportunities``.

    A non-empty outside text (``client_id, opportunity_type, text``) wins over the
    template. Filter the opportunities first to run a single broker.
    """
    rendered = opportunities.withColumn("template", message_text(company, signature))
    if outside_texts is None:
        rendered = rendered.withColumn("outside", F.lit(None).cast("string"))
    else:
        stripped = F.regexp_replace("text", r"^\s+|\s+$", "")
        given = outside_texts.select(
            "client_id", "opportunity_type", F.nullif(stripped, F.lit("")).alias("outside")
        ).where(F.col("outside").isNotNull())
        # Several texts for one opportunity must not multiply it.
        given = given.groupBy("client_id", "opportunity_type").agg(F.min("outside").alias("outside"))
        rendered = rendered.join(given, ["client_id", "opportunity_type"], "left")
    return rendered.withColumns(
        {
            "message": F.coalesce("outside", "template"),
            "source": F.when(F.col("outside").isNotNull(), MODEL_SOURCE).otherwise(TEMPLATE_SOURCE),
        }
    ).select(schemas.MESSAGES.names)


def preview_texts(opportunities: DataFrame, rows: int = 2, company: str = COMPANY, signature: str | None = None) -> DataFrame:
    """First opportunities of each broker with their rendered template."""
    return preview(opportunities, rows).select(
        "broker_id", F.col("position").cast("bigint").alias("position"), "client_id", "opportunity_type",
        message_text(company, signature).alias("message"),
    )


def default_messages(messages_: DataFrame) -> DataFrame:
    """What a message list shows at first: high and medium priority, all types."""
    return filter_opportunities(messages_, ("high", "medium"))


def source_counts(messages_: DataFrame) -> DataFrame:
    """Messages per broker: all, written by a model, from templates."""
    by_model = F.col("source") == MODEL_SOURCE
    return messages_.groupBy("broker_id").agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(by_model).alias("by_model"),
        F.count_if(~by_model).alias("by_template"),
    )
