"""Vocabularies, limits, labels and texts that decide results.

Everything below is a fixed value: change it and reports change. Texts hold
``{placeholders}`` which :func:`bookpulse.functions.text.fill` turns into columns.
"""

# --- Fixed values: vocabularies -------------------------------------------------
SEGMENTS = ("activo_sano", "en_riesgo", "reactivar", "perdido")
OPPORTUNITY_TYPES = ("CHURN_RISK", "REACTIVATION", "UPSELL", "BEST_TIME")
PRIORITIES = ("high", "medium", "low")
RISK_LABELS = ("Bajo", "Medio", "Alto", "Crítico")
DIRECT_BROKER = "DIRECTO"
COMPLETED = "COMPLETED"
ALL_TYPES = "Todas"
MODEL_SOURCE = "ollama"
TEMPLATE_SOURCE = "template"
DAY_NAMES = ("Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado", "Domingo")

# --- Fixed values: limits -------------------------------------------------------
MONEY_SCALE = 1e8                 # rates and spreads arrive multiplied by this
RECENT_DAYS = (30, 90)            # look-back counts
TREND_WEEKS = 8                   # look-back of the weekly volume trend
RFM_BUCKETS = 4
HEALTHY_SCORE, MIDDLE_SCORE = 9, 6
RISK_DAYS, LOST_DAYS, DORMANT_DAYS = 45, 180, 30
UPSELL_MIN_RECENT_TX, UPSELL_SPREAD_GAP = 5, 20
CHURN_WINDOW_DAYS, MIN_PAST_TX = 90, 2
RISK_LIMITS = (0.3, 0.6, 0.8)     # upper, closed limits of the first three risk labels
ACTIVITY_LIMITS = (14, 30, 90)
STRONG_TREND = 500
HISTOGRAM_BINS = 50
DEFAULT_PRIORITY_FILTER = ("high", "medium")
DEFAULT_TYPE_FILTER = ("CHURN_RISK", "REACTIVATION", "UPSELL")
PREVIEW_TYPES = ("CHURN_RISK", "REACTIVATION", "UPSELL")

# --- Fixed values: model inputs (columns that give the label away stay out) -----
MODEL_FEATURES = (
    "tx_count_total",
    "tx_count_completed",
    "success_rate",
    "avg_volume_usd",
    "total_volume_usd",
    "volume_trend",
    "avg_spread_bps",
    "spread_vs_minimum",
    "preferred_hour",
    "preferred_day",
)

# --- Fixed values: display labels -----------------------------------------------
SEGMENT_LABELS = {
    "activo_sano": "Cliente Activo",
    "en_riesgo": "En Riesgo de Irse",
    "reactivar": "Dormido — Recuperable",
    "perdido": "Sin Actividad Reciente",
}
TYPE_LABELS = {
    "CHURN_RISK": "Riesgo de Pérdida",
    "REACTIVATION": "Recuperar Cliente",
    "UPSELL": "Crecer Cuenta",
    "BEST_TIME": "Ventana de Contacto",
}
TYPE_ICONS = {"CHURN_RISK": "🚨", "REACTIVATION": "💤", "UPSELL": "📈", "BEST_TIME": "🎯"}
PRIORITY_LABELS = {"high": "Alta", "medium": "Media", "low": "Baja"}
PRIORITY_ICONS = {"high": "🔴", "medium": "🟡", "low": "🟢"}
ACTIVITY_LABELS = ("🟢 Activo", "🟡 Atención", "🟠 Inactivo", "🔴 Sin actividad")
TREND_LABELS = {
    "strong_up": "📈 Fuerte alza",
    "up": "↗️ Creciendo",
    "strong_down": "📉 Caída fuerte",
    "down": "↘️ Bajando",
    "flat": "➡️ Estable",
}
# rising, falling, flat
CONTEXT_TREND_WORDS = ("creciendo", "cayendo", "estable")
PROMPT_TREND_WORDS = ("en crecimiento", "en caída", "estable")
MESSAGE_TREND_WORDS = ("en crecimiento", "a la baja", "estable")
CONTEXT_NO_DAY = "N/A"
MESSAGE_NO_DAY = "entre semana"

# --- Fixed values: texts --------------------------------------------------------
CONTEXT_TEXT = (
    "Segmento: {segment} | Último tx: hace {days} días | Volumen total: ${total} USD | "
    "Volumen promedio: ${average} USD | Tendencia: {trend} | Mejor hora: {hour}:00 {day} | "
    "Spread promedio: {spread} bps"
)
CONTACT_TEXT = "{day} a las {hour}:00"
MESSAGE_TEXTS = {
    "CHURN_RISK": (
        "🔔 [CHURN_RISK]\nCliente: {client_name}\n\n"
        "📊 Situación: Lleva {days} días sin operar. Su volumen histórico es de ${total} USD.\n"
        "💡 Por qué importa: Este cliente representa un riesgo de churn de alto valor. "
        "Perderlo impacta directamente tu comisión.\n"
        "✅ Acción sugerida: Contáctalo hoy. Pregúntale si tiene necesidades de cambio de divisas "
        "pendientes. Mejor hora: {day} {hour}:00.\n\n— {signature}"
    ),
    "REACTIVATION": (
        "🔔 [REACTIVATION]\nCliente: {client_name}\n\n"
        "📊 Situación: Inactivo {days} días. Operó ${total} USD en total contigo.\n"
        "💡 Por qué importa: Reactivar un cliente existente cuesta 5x menos que adquirir uno nuevo.\n"
        "✅ Acción sugerida: Envíale un recordatorio con el tipo de cambio del día. "
        "Mejor contactarlo el {day} a las {hour}:00.\n\n— {signature}"
    ),
    "UPSELL": (
        "🔔 [UPSELL]\nCliente: {client_name}\n\n"
        "📊 Situación: Cliente activo con volumen {trend}. Promedio de ${average} USD por operación.\n"
        "💡 Por qué importa: Está en el mejor momento para aumentar el ticket promedio o frecuencia.\n"
        "✅ Acción sugerida: Ofrécele condiciones preferenciales para operaciones mayores a "
        "${larger} USD. Contáctalo el {day} a las {hour}:00.\n\n— {signature}"
    ),
    "BEST_TIME": (
        "🔔 [BEST_TIME]\nCliente: {client_name}\n\n"
        "📊 Situación: Cliente activo. Su patrón histórico muestra mayor actividad los {day} a las "
        "{hour}:00.\n"
        "💡 Por qué importa: Contactar en el momento correcto aumenta la tasa de conversión.\n"
        "✅ Acción sugerida: Programa tu mensaje para el próximo {day} a las {hour}:00.\n\n— {signature}"
    ),
}
OTHER_MESSAGE_TEXT = "🔔 Oportunidad detectada para {client_name}."
LARGER_TICKET_FACTOR = 1.5
SITUATION_TEXTS = {
    "CHURN_RISK": "este cliente lleva {days} días sin operar y está en riesgo de perderse",
    "REACTIVATION": "este cliente lleva {days} días inactivo y tiene potencial de reactivación",
    "UPSELL": (
        "este cliente está activo y su volumen está {trend}, es momento de aumentar el negocio"
    ),
    "BEST_TIME": "el mejor momento para contactar a este cliente es los {day} a las {hour}:00",
}
OTHER_SITUATION_TEXT = "hay una oportunidad comercial"
PROMPT_TEXT = (
    "Eres el asistente AI de {company}, una fintech de cambio de divisas (FX) entre México y "
    "Estados Unidos.\n"
    "Genera un mensaje de WhatsApp en español para un broker/promotor de {company} sobre uno de "
    "sus clientes.\n\n"
    "DATOS DEL CLIENTE:\n"
    "- Nombre: {client_name}\n"
    "- Situación: {situation}\n"
    "- Volumen histórico total: ${total} USD\n"
    "- Volumen promedio por transacción: ${average} USD\n"
    "- Tendencia de volumen: {trend}\n"
    "- Mejor hora para contactar: {day} a las {hour}:00\n"
    "- Segmento: {segment}\n\n"
    "FORMATO REQUERIDO (máximo 150 palabras, usa estos emojis exactos):\n"
    "🔔 [{opportunity_type}]\n"
    "Cliente: {client_name}\n\n"
    "📊 Situación: [qué está pasando con este cliente]\n"
    "💡 Por qué importa: [impacto en el negocio del broker]\n"
    "✅ Acción sugerida: [qué hacer y cuándo hacerlo]\n\n"
    "— {signature}\n\n"
    "Sé directo, concreto y accionable. NO uses más de 150 palabras."
)
