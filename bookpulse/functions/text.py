"""Text columns: number formats, day names, labels and filled-in texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from bookpulse.fixed_values import DAY_NAMES


def grouped(value: Column, digits: int = 0) -> Column:
    """``1,234`` style, half-even; a missing number reads ``nan``."""
    return F.coalesce(F.format_number(value, digits), F.lit("nan"))


def plain(value: Column, digits: int = 0) -> Column:
    """``1234`` style, half-even; a missing number reads ``nan``."""
    return F.replace(grouped(value, digits), F.lit(","), F.lit(""))


def day_name(day: Column, otherwise: str) -> Column:
    """Name of weekday 0..6 (Monday is 0); any other index reads ``otherwise``."""
    names = F.array(*[F.lit(n) for n in DAY_NAMES])
    return F.when(day.between(0, 6), F.get(names, day)).otherwise(F.lit(otherwise))


def signed_word(value: Column, words: Sequence[str]) -> Column:
    """One of (rising, falling, flat) by the sign of ``value``."""
    rising, falling, flat = words
    return F.when(value > 0, rising).when(value < 0, falling).otherwise(flat)


def label(key: Column, labels: Mapping[str, str]) -> Column:
    """Display label of ``key``; an unknown key keeps its own text."""
    chain = F
    for known, shown in labels.items():
        chain = chain.when(key == known, F.lit(shown))
    return chain.otherwise(key)


def fill(text: str, columns: Mapping[str, Column | str]) -> Column:
    """Turn a text with ``{placeholders}`` into one ``concat`` over columns."""
    parts: list[Column] = []
    for literal, name, _, _ in Formatter().parse(text):
        if literal:
            parts.append(F.lit(literal))
        if name:
            value = columns[name]
            parts.append(F.lit(value) if isinstance(value, str) else value.cast("string"))
    return F.concat(*parts)
