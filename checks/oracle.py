"""DuckDB SQL over the raw test tables, written independently of the Spark code.

Each query is a chain of named steps (``WITH``) and a final select. ``sql(select)`` adds
exactly the steps the select mentions, directly or through other steps.
"""

from __future__ import annotations

import re

from bookpulse import fixed_values as fv
from bookpulse.operators.messages import COMPANY

SIGNATURE = f"{COMPANY} AI"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def choose(column: str, pairs: dict[str, str], otherwise: str | None = None) -> str:
    whens = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in pairs.items())
    return f"CASE {column} {whens} ELSE {otherwise or column} END"


def grouped(x: str) -> str:
    return f"format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT))"


def plain(x: str) -> str:
    return f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"


def day_name(day: str, otherwise: str) -> str:
    return f"CASE WHEN {day} < 7 THEN {NAMES}[{day} + 1] ELSE {quote(otherwise)} END"


def sign_word(x: str, words: tuple[str, str, str]) -> str:
    return f"CASE WHEN {x} > 0 THEN {quote(words[0])} WHEN {x} < 0 THEN {quote(words[1])} ELSE {quote(words[2])} END"


def filled(text: str, values: dict[str, str]) -> str:
    """The text with every {name} replaced by the SQL expression ``values[name]``."""
    pieces = re.split(r"\{(\w+)\}", text)
    sql_pieces = [
        values[p] if i % 2 else quote(p) for i, p in enumerate(pieces) if p
    ]
    return "(" + " || ".join(sql_pieces) + ")"


NAMES = "[" + ", ".join(quote(n) for n in fv.DAY_NAMES) + "]"


def text_values(words: tuple[str, str, str]) -> dict[str, str]:
    return {
        "client_name": "client_name",
        "days": plain("days_since_last_tx"),
        "total": grouped("total_volume_usd"),
        "average": grouped("avg_volume_usd"),
        "larger": grouped("avg_volume_usd * 1.5::DOUBLE"),
        "trend": sign_word("volume_trend", words),
        "day": day_name("preferred_day", fv.MESSAGE_NO_DAY),
        "hour": "CAST(preferred_hour AS VARCHAR)",
        "segment": "segment",
        "opportunity_type": "opportunity_type",
        "company": quote(COMPANY),
        "signature": quote(SIGNATURE),
    }


def by_type(texts: dict[str, str], other: str, values: dict[str, str]) -> str:
    whens = " ".join(
        f"WHEN {quote(kind)} THEN {filled(text, values)}" for kind, text in texts.items()
    )
    return f"CASE opportunity_type {whens} ELSE {filled(other, values)} END"


CONTEXT = filled(
    fv.CONTEXT_TEXT,
    {
        "segment": "segment",
        "days": plain("days_since_last_tx"),
        "total": grouped("total_volume_usd"),
        "average": grouped("avg_volume_usd"),
        "trend": sign_word("volume_trend", fv.CONTEXT_TREND_WORDS),
        "hour": "CAST(preferred_hour AS VARCHAR)",
        "day": day_name("preferred_day", fv.CONTEXT_NO_DAY),
        "spread": "coalesce(printf('%.2f', avg_spread_bps), 'nan')",
    },
)
MESSAGE = by_type(fv.MESSAGE_TEXTS, fv.OTHER_MESSAGE_TEXT, text_values(fv.MESSAGE_TREND_WORDS))
SITUATION = by_type(fv.SITUATION_TEXTS, fv.OTHER_SITUATION_TEXT, text_values(fv.PROMPT_TREND_WORDS))
PROMPT = filled(fv.PROMPT_TEXT, text_values(fv.PROMPT_TREND_WORDS) | {"situation": f"({SITUATION})"})

TYPE_SHOWN = {k: f"{fv.TYPE_ICONS[k]} {v}" for k, v in fv.TYPE_LABELS.items()}
PRIORITY_SHOWN = {k: f"{fv.PRIORITY_ICONS[k]} {v}" for k, v in fv.PRIORITY_LABELS.items()}
TYPE_LABEL = choose("opportunity_type", TYPE_SHOWN)
PRIORITY_LABEL = choose("priority", PRIORITY_SHOWN)
SEGMENT_LABEL = choose("segment", fv.SEGMENT_LABELS)
LIGHT = (
    f"CASE WHEN days_since_last_tx < 14 THEN {quote(fv.ACTIVITY_LABELS[0])} "
    f"WHEN days_since_last_tx <= 30 THEN {quote(fv.ACTIVITY_LABELS[1])} "
    f"WHEN days_since_last_tx <= 90 THEN {quote(fv.ACTIVITY_LABELS[2])} ELSE {quote(fv.ACTIVITY_LABELS[3])} END"
)
TREND = (
    f"CASE WHEN volume_trend > 500 THEN {quote(fv.TREND_LABELS['strong_up'])} "
    f"WHEN volume_trend > 0 THEN {quote(fv.TREND_LABELS['up'])} "
    f"WHEN volume_trend < -500 THEN {quote(fv.TREND_LABELS['strong_down'])} "
    f"WHEN volume_trend < 0 THEN {quote(fv.TREND_LABELS['down'])} ELSE {quote(fv.TREND_LABELS['flat'])} END"
)
CONTACT = f"({NAMES}[preferred_day % 7 + 1] || ' a las ' || lpad(CAST(preferred_hour AS VARCHAR), 2, '0') || ':00')"
RULE_NO = "CASE opportunity_type WHEN 'CHURN_RISK' THEN 1 WHEN 'REACTIVATION' THEN 2 WHEN 'UPSELL' THEN 3 ELSE 4 END"
MONEY = "('$' || " + grouped("total_volume_usd") + ")"
INACTIVE = "(" + plain("days_since_last_tx") + " || 'd')"
FEATURE_COLUMNS = (
    "client_id, client_name, days_since_last_tx, tx_count_total, tx_count_30d, tx_count_90d, "
    "tx_count_completed, success_rate, avg_volume_usd, total_volume_usd, volume_trend, avg_spread_bps, "
    "spread_vs_minimum, preferred_hour, preferred_day, broker_id, broker_name"
)
SCORED_COLUMNS = FEATURE_COLUMNS + ", R, F, M, rfm_score, segment"
OPP_COLUMNS = (
    "broker_id, broker_name, client_id, client_name, opportunity_type, priority, days_since_last_tx, "
    "total_volume_usd, avg_volume_usd, volume_trend, segment, preferred_hour, preferred_day, context"
)


def bucket_sql(value: str, edges: str) -> str:
    """Quantile bucket by counting the distinct edges below the value."""
    distinct = f"list_distinct({edges})"
    return (
        f"CASE WHEN len({distinct}) < 2 OR {value} IS NULL THEN 2 ELSE "
        f"greatest(1, len(list_filter({distinct}, lambda x: x < {value}))) END"
    )


def base_steps(prefix: str, rows: str, as_of: str) -> dict[str, str]:
    """Feature steps over table ``rows`` at time ``as_of``; step names start with ``prefix``."""
    p = prefix
    return {
        f"{p}plain": f"""
            SELECT client_id, max(ts) AS last_ts, count(ts) AS dated,
              count(*) FILTER (WHERE ts >= {as_of} - INTERVAL 30 DAY) AS n30,
              count(*) FILTER (WHERE ts >= {as_of} - INTERVAL 90 DAY) AS n90,
              count(*) FILTER (WHERE valid) AS nc,
              CAST(sum(CAST(volume_usd AS DECIMAL(18,2))) FILTER (WHERE valid) AS DOUBLE) AS vol,
              CAST(sum(CAST(spread_bps AS DECIMAL(18,2))) FILTER (WHERE valid) AS DOUBLE) AS spr,
              count(spread_bps) FILTER (WHERE valid) AS nspr,
              CAST(sum(CAST(minimum_spread AS DECIMAL(18,2))) FILTER (WHERE valid) AS DOUBLE) AS mins,
              count(minimum_spread) FILTER (WHERE valid) AS nmin
            FROM {rows} WHERE client_id IS NOT NULL GROUP BY client_id HAVING count(ts) > 0""",
        f"{p}hours": f"""
            SELECT client_id, h FROM (SELECT client_id, hour(ts) AS h, count(*) AS n FROM {rows}
              WHERE ts IS NOT NULL GROUP BY 1, 2)
            QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY n DESC, h) = 1""",
        f"{p}days": f"""
            SELECT client_id, d FROM (SELECT client_id, isodow(ts) - 1 AS d, count(*) AS n FROM {rows}
              WHERE ts IS NOT NULL GROUP BY 1, 2)
            QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY n DESC, d) = 1""",
        f"{p}brokers": f"""
            SELECT client_id, broker_id FROM (SELECT client_id, broker_id, count(*) AS n FROM {rows}
              WHERE broker_id IS NOT NULL GROUP BY 1, 2)
            QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY n DESC, broker_id) = 1""",
        f"{p}broker_names": f"""
            SELECT t.client_id, t.broker_name FROM {rows} t JOIN {p}brokers b
              ON t.client_id = b.client_id AND t.broker_id = b.broker_id
            WHERE t.broker_name IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY t.client_id
              ORDER BY t.ts NULLS LAST, t.broker_name) = 1""",
        f"{p}client_names": f"""
            SELECT client_id, client_name FROM {rows} WHERE client_name IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY ts NULLS LAST, client_name) = 1""",
        f"{p}weekly": f"""
            SELECT client_id,
              CAST(floor((epoch_us(ts) - epoch_us({as_of} - INTERVAL 56 DAY)) / (7 * 86400000000.0)) AS INTEGER) AS wk,
              sum(CAST(volume_usd AS DECIMAL(18,2))) AS wvol
            FROM {rows} WHERE valid AND ts >= {as_of} - INTERVAL 56 DAY GROUP BY 1, 2""",
        f"{p}trend": f"""
            SELECT client_id, CAST(count(*) * sum(wk * wvol) - sum(wk) * sum(wvol) AS DOUBLE)
                / CAST(count(*) * sum(wk * wk) - sum(wk) * sum(wk) AS DOUBLE) AS slope
            FROM {p}weekly GROUP BY 1 HAVING count(*) >= 2""",
        f"{p}base": f"""
            SELECT a.client_id, coalesce(cn.client_name, substr(a.client_id, 1, 8)) AS client_name,
              CAST(epoch_us({as_of}) - epoch_us(a.last_ts) AS DOUBLE) / 86400000000.0::DOUBLE AS days_since_last_tx,
              a.dated AS tx_count_total, a.n30 AS tx_count_30d, a.n90 AS tx_count_90d, a.nc AS tx_count_completed,
              CAST(a.nc AS DOUBLE) / a.dated AS success_rate,
              CASE WHEN a.nc = 0 THEN 0.0::DOUBLE ELSE a.vol / a.nc END AS avg_volume_usd,
              coalesce(a.vol, 0.0::DOUBLE) AS total_volume_usd,
              coalesce(t.slope, 0.0::DOUBLE) AS volume_trend,
              CASE WHEN a.nc = 0 THEN 0.0::DOUBLE WHEN nspr > 0 THEN a.spr / a.nspr END AS avg_spread_bps,
              CASE WHEN a.nc = 0 THEN 0.0::DOUBLE WHEN nspr > 0 AND nmin > 0 THEN a.spr / a.nspr - a.mins / a.nmin END
                AS spread_vs_minimum,
              CAST(h.h AS INTEGER) AS preferred_hour, CAST(d.d AS INTEGER) AS preferred_day,
              coalesce(b.broker_id, 'DIRECTO') AS broker_id,
              coalesce(bn.broker_name, b.broker_id, 'DIRECTO') AS broker_name
            FROM {p}plain a JOIN {p}hours h USING (client_id) JOIN {p}days d USING (client_id)
              LEFT JOIN {p}brokers b USING (client_id) LEFT JOIN {p}broker_names bn USING (client_id)
              LEFT JOIN {p}client_names cn USING (client_id) LEFT JOIN {p}trend t USING (client_id)""",
    }


#: Midnights at which features are compared, in days before the day of the last transaction.
CUTOFF_DAYS = (0, 15, 45, 90, 150)


def cutoff(days: int) -> str:
    return f"(SELECT date_trunc('day', max(ts)) - INTERVAL {days} DAY FROM tx)"


STEPS: dict[str, str] = {
    "raw": """
        SELECT o_orderkey AS tx_id, 'C' || lpad(CAST(client AS VARCHAR), 9, '0') AS balance_owner_uuid,
          CASE WHEN client % 35 = 0 THEN '' ELSE c_name END AS balance_owner_name,
          CASE WHEN client % 15 = 0 THEN '' WHEN sk IS NOT NULL
            THEN 'B' || lpad(CAST(sk % 20 AS VARCHAR), 3, '0') END AS intermediary_uuid,
          CASE WHEN sk % 20 = 7 THEN '' WHEN sk IS NOT NULL
            THEN 'Broker ' || CAST(sk % 20 AS VARCHAR) END AS intermediary_name,
          CASE WHEN o_orderkey % 101 = 0 THEN '' ELSE
            strftime(TIMESTAMP '2001-08-01' - to_minutes(CAST(120 * date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') AS BIGINT))
              - to_days(CAST([0, 0, 0, 0, 20, 70, 120, 250][CAST((o_custkey // 5) % 8 AS INTEGER) + 1] AS INTEGER))
              + to_hours(CAST(o_orderkey % 24 AS BIGINT)) + to_seconds(CAST(o_orderkey % 3600 AS DOUBLE)),
              '%Y-%m-%d %H:%M:%S') || '+00' END AS trigger_at,
          CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'CANCELED'
            ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'COMPLETED' ELSE 'PENDING' END END AS status,
          CASE WHEN o_orderkey % 97 = 0 THEN 'N/A'
            ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS balance_paid,
          100000000.0::DOUBLE AS er_paid_to_usd,
          (o_orderkey % 60) * 100000000.0::DOUBLE AS profit_spread_bps,
          CAST(o_orderkey % 20 AS DOUBLE) AS minimum_spread
        FROM (SELECT *, o_custkey - o_custkey % 5 AS client FROM orders) o
          LEFT JOIN customer ON o_custkey = c_custkey
          LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS sk FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey""",
    "tx0": """
        SELECT *, balance_owner_uuid AS client_id, nullif(balance_owner_name, '') AS client_name,
          nullif(intermediary_uuid, '') AS broker_id, nullif(intermediary_name, '') AS broker_name,
          TRY_CAST(balance_paid AS DOUBLE) AS bp_num,
          TRY_CAST(balance_paid AS DOUBLE) * er_paid_to_usd / 1e8::DOUBLE AS volume_usd,
          profit_spread_bps / 1e8::DOUBLE AS spread_bps,
          TRY_CAST(regexp_replace(trigger_at, '\\+00$', '') AS TIMESTAMP) AS ts
        FROM raw""",
    "tx": """
        SELECT *, broker_name IS NOT NULL AS has_broker, strftime(ts, '%Y-%m') AS month,
          coalesce(status = 'COMPLETED' AND volume_usd > 0 AND ts IS NOT NULL, false) AS valid,
          coalesce(status = 'COMPLETED' AND volume_usd > 0, false) AS reported
        FROM tx0""",
    "mixed0": """
        SELECT * REPLACE (CASE WHEN tx_id % 89 <> 0 THEN bp_num * ([1.0, 2.0, 3.0, 7.0][CAST(tx_id % 4 + 1 AS INTEGER)]::DOUBLE * 100000000.0::DOUBLE)
            / 100000000.0::DOUBLE END AS volume_usd,
          CASE WHEN tx_id % 12 IN (5, 6) THEN date_trunc('day', ts) WHEN tx_id % 12 IN (2, 4, 7, 9) THEN date_trunc('minute', ts)
            ELSE ts END AS ts)
        FROM tx0""",
    "mixed": """
        SELECT *, broker_name IS NOT NULL AS has_broker,
          coalesce(status = 'COMPLETED' AND volume_usd > 0 AND ts IS NOT NULL, false) AS valid
        FROM mixed0""",
    **base_steps("m_", "mixed", "(SELECT max(ts) FROM mixed)"),
    "ref": "SELECT max(ts) AS r, max(ts) - INTERVAL 90 DAY AS c FROM tx",
    **base_steps("f_", "tx", "(SELECT r FROM ref)"),
    "past_tx": "SELECT * FROM tx WHERE ts < (SELECT c FROM ref)",
    **base_steps("p_", "past_tx", "(SELECT c FROM ref)"),
    **{name: step for k, days in enumerate(CUTOFF_DAYS) for name, step in {
        f"cut{k}_tx": f"SELECT * FROM tx WHERE ts < {cutoff(days)}",
        **base_steps(f"cut{k}_", f"cut{k}_tx", cutoff(days)),
    }.items()},
    "edges": """
        SELECT quantile_cont(days_since_last_tx, [0, 0.25, 0.5, 0.75, 1]) AS er,
          quantile_cont(CAST(tx_count_90d AS DOUBLE), [0, 0.25, 0.5, 0.75, 1]) AS ef,
          quantile_cont(total_volume_usd, [0, 0.25, 0.5, 0.75, 1]) AS em,
          quantile_cont(total_volume_usd, 0.5) AS p50, quantile_cont(total_volume_usd, 0.75) AS p75
        FROM f_base""",
    "rfm0": f"""
        SELECT f_base.*, CAST(5 - {bucket_sql("days_since_last_tx", "er")} AS INTEGER) AS R,
          CAST({bucket_sql("tx_count_90d", "ef")} AS INTEGER) AS F,
          CAST({bucket_sql("total_volume_usd", "em")} AS INTEGER) AS M
        FROM f_base, edges""",
    "feat": """
        SELECT *, R + F + M AS rfm_score, CASE WHEN R + F + M >= 9 THEN 'activo_sano'
          WHEN R + F + M >= 6 THEN CASE WHEN days_since_last_tx > 45 THEN 'en_riesgo' ELSE 'activo_sano' END
          WHEN days_since_last_tx > 180 THEN 'perdido' WHEN days_since_last_tx > 30 THEN 'reactivar'
          ELSE 'en_riesgo' END AS segment
        FROM rfm0""",
    "broker_name_of": """
        SELECT broker_id AS bid, first(broker_name ORDER BY client_id) AS bname FROM feat GROUP BY 1""",
    "opp0": """
        SELECT feat.*, 'CHURN_RISK' AS opportunity_type,
          CASE WHEN total_volume_usd > p75 THEN 'high' ELSE 'medium' END AS priority
        FROM feat, edges WHERE segment = 'en_riesgo'
        UNION ALL SELECT feat.*, 'REACTIVATION', 'medium' FROM feat, edges
        WHERE segment = 'reactivar' AND total_volume_usd > p50
        UNION ALL SELECT feat.*, 'UPSELL',
          CASE WHEN volume_trend > 0 AND spread_vs_minimum > 20 THEN 'high' ELSE 'medium' END
        FROM feat WHERE segment = 'activo_sano' AND (volume_trend > 0 OR tx_count_90d >= 5)
        UNION ALL SELECT feat.*, 'BEST_TIME', 'low' FROM feat WHERE segment IN ('activo_sano', 'en_riesgo')""",
    "opp": f"""
        SELECT opp0.* REPLACE (bname AS broker_name), {CONTEXT} AS context
        FROM opp0 JOIN broker_name_of ON broker_id = bid""",
    "ranked_opp": f"""
        SELECT *, {RULE_NO} AS rule_no, row_number() OVER (PARTITION BY broker_id, opportunity_type
          ORDER BY CASE WHEN opportunity_type = 'BEST_TIME' THEN 0 ELSE -total_volume_usd END, client_id) AS rank_in_rule
        FROM opp""",
    "labels": """
        SELECT client_id, CASE WHEN count(*) FILTER (WHERE ts >= c) = 0 THEN 1 ELSE 0 END AS churned
        FROM tx, ref WHERE ts IS NOT NULL AND client_id IS NOT NULL
        GROUP BY client_id HAVING count(*) FILTER (WHERE ts < c) >= 2""",
    "proba": """
        SELECT *, CAST(CAST(substr(client_id, 2) AS BIGINT) * 7919 % 1000 AS DOUBLE) / 1000.0::DOUBLE
          AS churn_probability FROM feat""",
    "scores": """
        SELECT client_id, client_name, broker_id, broker_name, segment, churn_probability,
          CAST(round_even(churn_probability * 100, 0) AS INTEGER) AS churn_score,
          CASE WHEN churn_probability <= 0.3 THEN 'Bajo' WHEN churn_probability <= 0.6 THEN 'Medio'
            WHEN churn_probability <= 0.8 THEN 'Alto' ELSE 'Crítico' END AS risk_label
        FROM proba""",
    "scored": "SELECT client_id, churned, churn_probability FROM labels JOIN scores USING (client_id)",
    "thresholds": """
        SELECT churn_probability, sum(churned) AS pos, count(*) - sum(churned) AS neg FROM scored GROUP BY 1""",
    "pr": """
        SELECT churn_probability, pos, sum(pos) OVER w AS cpos, sum(neg) OVER w AS cneg
        FROM thresholds WINDOW w AS (ORDER BY churn_probability DESC)""",
    "with_broker": "SELECT * FROM tx WHERE has_broker AND status = 'COMPLETED'",
    "own": "SELECT * FROM tx WHERE reported AND broker_id IS NOT NULL",
    "logs": "SELECT log10(greatest(volume_usd, 1)) AS x FROM with_broker WHERE volume_usd > 0",
    "broker_rev": """
        SELECT intermediary_uuid, intermediary_name,
          CAST(sum(CAST(volume_usd AS DECIMAL(18,2))) AS DOUBLE) AS total_volume_usd, count(*) AS tx_count
        FROM with_broker WHERE volume_usd > 0 AND intermediary_uuid IS NOT NULL GROUP BY 1, 2""",
    "broker_cli": """
        SELECT intermediary_uuid, intermediary_name, count(DISTINCT balance_owner_uuid) AS n_clients
        FROM with_broker WHERE intermediary_uuid IS NOT NULL GROUP BY 1, 2""",
    "cells": "SELECT d, h FROM range(7) t(d), range(24) u(h)",
    "book_brokers": "SELECT DISTINCT broker_id FROM feat",
    "own_cells": """
        SELECT broker_id, isodow(ts) - 1 AS d, hour(ts) AS h, count(*) AS n FROM own
        WHERE ts IS NOT NULL GROUP BY 1, 2, 3""",
    "book_cells": """
        SELECT broker_id, preferred_day % 7 AS d, preferred_hour % 24 AS h, count(*) AS n FROM feat GROUP BY 1, 2, 3""",
    "grid": """
        SELECT b.broker_id, CAST(c.d AS INTEGER) AS weekday, CAST(c.h AS INTEGER) AS hour,
          CASE WHEN b.broker_id IN (SELECT broker_id FROM own) THEN coalesce(o.n, 0) ELSE coalesce(f.n, 0) END AS n
        FROM book_brokers b CROSS JOIN cells c
          LEFT JOIN own_cells o ON o.broker_id = b.broker_id AND o.d = c.d AND o.h = c.h
          LEFT JOIN book_cells f ON f.broker_id = b.broker_id AND f.d = c.d AND f.h = c.h""",
    "kpis": """
        SELECT broker_id, CASE WHEN ntx IS NOT NULL THEN 'transactions' ELSE 'features' END AS basis,
          coalesce(tvol, fvol) AS total_volume_usd,
          CASE WHEN ntx IS NOT NULL THEN tvol / ntx ELSE favg END AS avg_volume_usd,
          coalesce(ntx, ftx) AS transactions, clients
        FROM (SELECT broker_id, CAST(sum(CAST(total_volume_usd AS DECIMAL(18,2))) AS DOUBLE) AS fvol,
                avg(avg_volume_usd) AS favg,
                CAST(sum(tx_count_completed) AS BIGINT) AS ftx, count(DISTINCT client_id) AS clients
              FROM feat GROUP BY 1)
          LEFT JOIN (SELECT broker_id, CAST(sum(CAST(volume_usd AS DECIMAL(18,2))) AS DOUBLE) AS tvol, count(*) AS ntx
              FROM own GROUP BY 1) USING (broker_id)""",
    "card": """
        SELECT broker_id, count(*) AS clients, count(*) FILTER (WHERE segment = 'activo_sano') AS active,
          count(*) FILTER (WHERE segment = 'en_riesgo') AS at_risk,
          count(*) FILTER (WHERE segment = 'reactivar') AS dormant,
          CAST(sum(CAST(total_volume_usd AS DECIMAL(18,2))) AS DOUBLE) AS total_volume_usd,
          coalesce(CAST(sum(CAST(total_volume_usd AS DECIMAL(18,2))) FILTER (WHERE segment = 'en_riesgo') AS DOUBLE), 0)
            AS at_risk_volume_usd,
          (SELECT count(*) FROM opp o WHERE o.broker_id = feat.broker_id AND opportunity_type = 'UPSELL') AS upsell,
          CAST(round_even(count(*) FILTER (WHERE segment = 'activo_sano') / CAST(count(*) AS DOUBLE) * 100, 0) AS INTEGER)
            AS active_percent
        FROM feat GROUP BY broker_id""",
    "opp_table": f"""
        SELECT broker_id, client_id, client_name AS client, opportunity_type, priority AS raw_priority,
          {TYPE_LABEL} AS type, {PRIORITY_LABEL} AS priority, {INACTIVE} AS inactive, total_volume_usd,
          round_even(churn_probability * 100, 1) AS churn_percent
        FROM opp LEFT JOIN (SELECT client_id, churn_probability FROM scores) USING (client_id)""",
    "status_table": f"""
        SELECT broker_id, client_id, client_name AS client, {LIGHT} AS activity, {SEGMENT_LABEL} AS segment,
          {INACTIVE} AS inactive, CAST(tx_count_30d AS INTEGER) AS tx_30d, CAST(tx_count_90d AS INTEGER) AS tx_90d,
          {MONEY} AS total_volume, {TREND} AS trend, {CONTACT} AS best_contact,
          round_even(churn_probability * 100, 1) AS churn_percent, days_since_last_tx
        FROM feat LEFT JOIN (SELECT client_id, churn_probability FROM scores) USING (client_id)""",
    "outside": """
        SELECT client_id, opportunity_type, CASE WHEN CAST(substr(client_id, 2) AS BIGINT) % 20 = 0
            THEN 'Hola ' || client_name ELSE '' END AS text
        FROM opp WHERE CAST(substr(client_id, 2) AS BIGINT) % 10 = 0""",
    "msg": f"SELECT *, {MESSAGE} AS message, 'template' AS source FROM opp",
    "mixed_msg": """
        SELECT msg.* REPLACE (coalesce(nullif(text, ''), message) AS message,
          CASE WHEN nullif(text, '') IS NULL THEN 'template' ELSE 'ollama' END AS source)
        FROM msg LEFT JOIN outside USING (client_id, opportunity_type)""",
    "clf": """
        SELECT count(*) FILTER (WHERE churned = 1 AND churn_probability > 0.5) AS tp,
          count(*) FILTER (WHERE churned = 0 AND churn_probability > 0.5) AS fp,
          count(*) FILTER (WHERE churned = 1 AND churn_probability <= 0.5) AS fn,
          count(*) FILTER (WHERE churned = 0 AND churn_probability <= 0.5) AS tn FROM scored""",
    "by_class": """
        SELECT 'Activo' AS line, CASE WHEN tn + fn > 0 THEN tn / CAST(tn + fn AS DOUBLE) ELSE 0 END AS precision,
          CASE WHEN tn + fp > 0 THEN tn / CAST(tn + fp AS DOUBLE) ELSE 0 END AS recall, tn + fp AS support FROM clf
        UNION ALL SELECT 'Churned', CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END,
          CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END, tp + fn FROM clf""",
    "class_lines": """
        SELECT line, precision, recall,
          CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, support
        FROM by_class""",
    "report_lines": """
        SELECT * FROM class_lines
        UNION ALL SELECT 'accuracy', a, a, a, n FROM
          (SELECT (tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE) AS a, tp + tn + fp + fn AS n FROM clf)
        UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM class_lines
        UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
          sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM class_lines""",
}


def first_tree(seed: int, depth: int, rate: float, row_share: float, column_share: float, bins: int) -> str:
    """The first boosted tree over the labelled clients, level by level, as one nested select."""
    n, unit, turn = len(fv.MODEL_FEATURES), float(1 << 32), seed * 1_000_003
    wrap, odd = 1 << 64, (11400714819323198485, 13787848793156543929, 10723151780598845931)
    values = ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE)" for c in fv.MODEL_FEATURES)

    def times(x: str, factor: int) -> str:
        return f"CAST((CAST({x} AS UHUGEINT) * {factor}::UHUGEINT) % {wrap}::UHUGEINT AS UBIGINT)"

    def mix(x: str, turn: int) -> str:
        start = f"CAST((CAST({x} AS UHUGEINT) + {(turn + 1) * odd[0] % wrap}::UHUGEINT) % {wrap}::UHUGEINT AS UBIGINT)"
        once = f"(SELECT {times('xor(z, z >> 30)', odd[1])} FROM (SELECT {start} AS z))"
        twice = f"(SELECT {times('xor(z, z >> 27)', odd[2])} FROM (SELECT {once} AS z))"
        return f"(SELECT xor(z, z >> 31) FROM (SELECT {twice} AS z))"

    worth = "({0} * {0} / ({1} + 1.0::DOUBLE))".format
    steps = [f"""train AS (SELECT client_id, churned, [{values}] AS x, ('0x' || substr(md5(client_id), 1, 15))::BIGINT AS key
        FROM feat JOIN labels USING (client_id))""", """
      long AS (SELECT client_id, unnest(range(""" + str(n) + """)) AS f, unnest(x) AS x FROM train)""", f"""
      edge AS (SELECT f, list_sort(list_distinct(list(x))) AS cuts FROM (
        SELECT f, x, row_number() OVER (PARTITION BY f ORDER BY x) AS rn, count(*) OVER (PARTITION BY f) AS n FROM long)
        WHERE rn IN (SELECT unnest(list_transform(range(1, {bins}), lambda k: CAST(ceil(k * n / {float(bins)}::DOUBLE) AS BIGINT))))
        GROUP BY f)""", f"""
      used AS (SELECT f FROM (SELECT f, {mix('f + 1', -turn - 2)} AS place FROM range({n}) t(f)) ORDER BY place
        LIMIT {max(1, int(column_share * n))})""", """
      binned AS (SELECT client_id, f, len(list_filter(cuts, lambda e: e < x)) AS b FROM long JOIN edge USING (f))""", f"""
      prior AS (SELECT avg(churned) AS p FROM train)""", f"""
      drawn AS (SELECT client_id, round_even((p - churned) * {unit}, 0) AS g, round_even(p * (1 - p) * {unit}, 0) AS h
        FROM train, prior WHERE ({mix('key', turn)} >> 32) < {int(row_share * (1 << 32))})""", """
      node0 AS (SELECT client_id, 0 AS node FROM drawn)"""]
    for d in range(depth):
        steps.append(f"""
      cell{d} AS (SELECT node, f, b, sum(g) AS g, sum(h) AS h FROM node{d} JOIN drawn USING (client_id)
        JOIN binned USING (client_id) JOIN used USING (f) GROUP BY node, f, b),
      side{d} AS (SELECT node, f, b, sum(g) OVER w / {unit} AS gl, sum(h) OVER w / {unit} AS hl,
        sum(g) OVER (PARTITION BY node, f) / {unit} AS g, sum(h) OVER (PARTITION BY node, f) / {unit} AS h
        FROM cell{d} WINDOW w AS (PARTITION BY node, f ORDER BY b)),
      best{d} AS (SELECT node, f, b, gain, h FROM (SELECT *, {worth('gl', 'hl')} + {worth('(g - gl)', '(h - hl)')} - {worth('g', 'h')} AS gain
        FROM side{d} WHERE hl >= 1 AND h - hl >= 1) WHERE gain > 1e-6
        QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, b) = 1),
      node{d + 1} AS (SELECT client_id, 2 * node + 1 + CAST(coalesce(binned.b > best{d}.b, false) AS INTEGER) AS node
        FROM node{d} LEFT JOIN best{d} USING (node) LEFT JOIN binned USING (client_id, f))""")
    names = ", ".join(quote(c) for c in fv.MODEL_FEATURES)
    splits = " UNION ALL ".join(
        f"SELECT node, [{names}][f + 1] AS input, cuts[b + 1] AS threshold, gain, h AS cover, NULL::DOUBLE AS value "
        f"FROM best{d} JOIN edge USING (f)" for d in range(depth))
    return f"""SELECT * FROM (
      WITH {','.join(steps)}
      SELECT CAST(node AS INTEGER) AS node, input, round(threshold, 6) AS threshold, round(gain, 6) AS gain,
        round(cover, 6) AS cover, round(value, 6) AS value
      FROM ({splits} UNION ALL SELECT node, NULL, NULL, NULL, sum(h) / {unit},
        -{rate} * (sum(g) / {unit}) / (sum(h) / {unit} + 1.0::DOUBLE) FROM node{depth} JOIN drawn USING (client_id) GROUP BY node))"""


def sql(select: str) -> str:
    """``select`` with the steps it needs in front."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in STEPS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(STEPS[name])

    visit(select)
    steps = ", ".join(f"{n} AS MATERIALIZED ({STEPS[n]})" for n in STEPS if n in needed)
    return f"WITH {steps} {select}" if steps else select
