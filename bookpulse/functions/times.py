"""Reading times that are written in many forms.

A time is a date part, then perhaps a time of day with seconds, a fraction and AM or PM, then
perhaps a zone. Each date part is one pattern that takes the text apart into the same fields,
so every combination with a time part is read; a text of another form, or without a full
date, is NULL. ISO times, by far the most, are cast before any pattern is tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = "(" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in _MONTHS).replace("sep(?:tember)?", "sept?(?:ember)?") + r")\.?"
_WEEKDAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,?\s+)?"
_CLOCK = r"(?:(?:[T ]\s*|,\s+)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*([ap]m)?)?"
_ZONE = r"\s*(z|utc|gmt|[+-](?:0\d|1[0-4])(?::?[0-5]\d)?)?"
_MARK = "\u0001"
#: Date part, and its groups for the fields year, month and day; ``first`` and ``second`` are told apart later.
_DATES = (
    (r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", ("$1", "$2", "$3")),
    (r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})", ("$3", "?$1", "$2")),
    (rf"{_WEEKDAY}(\d{{1,2}})(?:st|nd|rd|th)?[- ]\s*{_MONTH}[-, ]\s*(\d{{4}})", ("$3", "$2", "$1")),
    (rf"{_WEEKDAY}{_MONTH}[- ]\s*(\d{{1,2}})(?:st|nd|rd|th)?(?:[-, ]\s*)(\d{{4}})", ("$3", "$1", "$2")),
)
_PATTERNS = (
    *((rf"(?i)^{date}{_CLOCK}{_ZONE}$", _MARK.join((*fields, "$4", "$5", "$6", "$7", "$8", "$9"))) for date, fields in _DATES),
    # Digits only: date, then perhaps time, with or without a space.
    (rf"(?i)^(\d{{4}})(\d{{2}})(\d{{2}})(?:[T ]?(\d{{2}})(\d{{2}})(\d{{2}})?)?{_ZONE}$", _MARK.join(("$1", "$2", "$3", "$4", "$5", "$6", "", "", "$7"))),
    (rf"(?i)^(\d{{4}})(\d{{2}})(\d{{2}}){_CLOCK}{_ZONE}$", _MARK.join(("$1", "$2", "$3", "$4", "$5", "$6", "$7", "$8", "$9"))),
)
_NUMERIC = r"^\s*(\d{1,2})[-/.](\d{1,2})[-/.]\d{4}\b"


def _fields(bare: Column) -> Column:
    """Nine texts (year, month, day, hour, minute, second, fraction, am or pm, zone); other text stays whole."""
    for pattern, fields in _PATTERNS:
        bare = F.regexp_replace(bare, pattern, fields)  # a text that was taken apart fits no further pattern
    return F.split(bare, _MARK)


def _number(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(text.try_cast("int"))


def _assembled(parts: Column, day_first: bool) -> Column:
    year, month, day, hour, minute, second, fraction, half, zone = (F.get(parts, F.lit(i)) for i in range(9))
    first, second_field = F.substring(month, 2, 2).try_cast("int"), day.try_cast("int")
    either, over = F.startswith(month, F.lit("?")), F.lit(12)
    # The usual order, unless only the other one can be meant.
    swapped = (second_field <= over) if day_first else (first > over)
    by_name = ((F.instr(F.lit("".join(m[:3] for m in _MONTHS)), F.lower(F.substring(month, 1, 3))) + 2) / 3).cast("int")
    month_no = F.when(either, F.when(swapped, second_field).otherwise(first)).when(
        month.rlike("^[0-9]+$"), month.try_cast("int")).otherwise(by_name)
    day_no = F.when(either & swapped, first).otherwise(second_field)
    h = _number(hour)
    hour_no = F.when(half == "", h).when(h.between(1, 12), h % 12 + F.when(F.lower(half) == "pm", 12).otherwise(0))
    seconds = F.concat(
        F.when(second == "", "0").otherwise(second), F.lit("."), F.rpad(F.substring(fraction, 1, 6), 6, "0")
    ).try_cast("decimal(8,6)")
    digits = F.regexp_replace(zone, "[^0-9+-]", "")
    offset = F.when(digits == "", F.lit("UTC")).otherwise(
        F.concat(F.substring(digits, 1, 3), F.lit(":"), F.rpad(F.substring(digits, 4, 2), 2, "0")))
    date = (year.try_cast("int"), month_no, day_no, hour_no, _number(minute), seconds)
    here = F.try_make_timestamp(*date)
    return F.when(zone == "", here).otherwise(F.try_make_timestamp(*date, offset))


def read_time(text: Column, day_first: bool = False) -> Column:
    """Text to a time; NULL without a full date, so that nothing depends on the day of the run.

    Times without a zone are read in the session zone. In ``04/07/2025`` the month is first, or
    the day with ``day_first``; where that field cannot be it (``25/07/2025``) it is the other.
    """
    bare = F.trim(text)
    iso = F.when(bare.rlike(r"^\d{4,}-\d{1,2}-\d{1,2}"), bare.try_cast("timestamp"))
    parts = F.transform(F.array(_fields(bare)), lambda p: F.when(F.size(p) == 9, _assembled(p, day_first)))[0]
    return F.coalesce(iso, parts.cast("timestamp"))


def date_order(df: DataFrame, column: str) -> DataFrame:
    """One row: dates like 04/07/2025 whose first field must be the day, whose second must be, and the others."""
    first, second = (F.regexp_extract(F.col(column), _NUMERIC, k).try_cast("int") for k in (1, 2))
    return df.select(first.alias("a"), second.alias("b")).agg(
        F.count_if((F.col("a") > 12) & (F.col("b") <= 12)).alias("day_first"),
        F.count_if((F.col("b") > 12) & (F.col("a") <= 12)).alias("month_first"),
        F.count_if((F.col("a") <= 12) & (F.col("b") <= 12)).alias("either"),
    )


def reads_day_first(df: DataFrame, column: str) -> bool:
    """True if some date of the column can only have its day first, and none its month: one scan."""
    found = date_order(df, column).first()
    return found.day_first > 0 and found.month_first == 0
