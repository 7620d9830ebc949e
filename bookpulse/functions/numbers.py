"""Number reading and order-independent sums."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers below this are added digit by digit, in any order; beyond it, as doubles.
_EXACT_BELOW = 1e18
_PLACES = 14                       # decimal places that are kept
_LIMB = 10**7                      # limbs have seven digits: BIGINT sums hold 9 * 10^11 of them
_WEIGHTS = tuple(Decimal(_LIMB**k) for k in (3, 2, 1, 0))   # in units of the last place
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def finite(value: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def read_number(text: Column) -> Column:
    """Text to DOUBLE; anything but a plain or exponent number becomes NULL.

    The pattern is stricter than the cast, which also takes type suffixes ("1.5d").
    """
    return F.when(text.rlike(_NUMBER), finite(text.try_cast("double")))


def halves(value: Column) -> tuple[Column, Column, Column]:
    """Whole units and 10^-14ths of ``value`` as BIGINT; the value itself beyond 10^18.

    A number counts with 15 significant digits and at most 14 decimal places, which keeps
    every amount that is written in so many.
    """
    inside = F.when(F.abs(value) < _EXACT_BELOW, value).when(value.isNotNull(), 0.0)
    whole = inside.cast("bigint")
    digits = F.greatest(_PLACES - F.floor(F.log10(F.greatest(F.abs(inside), F.lit(1.0)))), F.lit(0))
    kept = F.rint((inside - whole) * F.pow(F.lit(10.0), digits))
    fraction = (kept * F.pow(F.lit(10.0), _PLACES - digits)).cast("bigint")
    return whole, fraction, F.when(F.abs(value) >= _EXACT_BELOW, value)


def parts(whole: Column, fraction: Column, beyond: Column) -> tuple[Column, ...]:
    """Four BIGINT limbs of a number's halves, and what is beyond them.

    Adding limbs instead of doubles gives the same sum in whatever order rows arrive, so a
    recomputed task cannot move a client across a bucket edge. Unlike DECIMAL sums they
    stay fixed-width in hash aggregates.
    """
    limbs = [limb for n in (whole, fraction) for limb in (F.call_function("div", n, F.lit(_LIMB)), n % _LIMB)]
    return *limbs, beyond


def joined(sums: Sequence[Column]) -> Column:
    """Summed parts as one DOUBLE: exact but for the rounding of the result."""
    *limbs, beyond = sums
    total = sum((limb.cast("decimal(38,0)") * F.lit(w) for limb, w in zip(limbs[1:], _WEIGHTS[1:])),
                limbs[0].cast("decimal(38,0)") * F.lit(_WEIGHTS[0]))
    near = F.concat(total.cast("string"), F.lit(f"e-{_PLACES}")).cast("double")  # rounds once
    return near + F.coalesce(beyond, F.lit(0.0))


def exact_sum(value: Column) -> Column:
    """Sum as DOUBLE that does not depend on the order of rows."""
    return joined([F.sum(part) for part in parts(*halves(value))])


def ratio(total: Column, count: Column) -> Column:
    """``total / count`` as DOUBLE, NULL when the count is 0."""
    return F.when(count > 0, total.cast("double") / count)
