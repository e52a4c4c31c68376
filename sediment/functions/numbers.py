"""Shares, ratios and the rounding of published figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_fixed(x: Column, digits: int) -> Column:
    """x to a fixed number of decimals by its exact binary value, ties away from zero; round() would go by the shortest decimal.

    format_number() rounds ties to even, and only multiples of 1 / 2**(digits + 1) can be ties.
    """
    tie = x * 2 ** (digits + 1)
    return F.when(tie == F.floor(tie), F.round(x, digits)).otherwise(F.regexp_replace(F.format_number(x, digits), ",", "").cast("double"))


def share(n: Column, d: Column) -> Column:
    """n in percent of d, one decimal; null for a zero denominator."""
    return to_fixed(F.try_divide(n.cast("double"), d.cast("double")) * 100, 1)


def pct(n: Column, d: Column) -> Column:
    """share(), but 0 for a zero denominator."""
    return F.coalesce(share(n, d), F.lit(0.0))


def ratio(a: Column, b: Column, digits: int = 2) -> Column:
    """a / b; null if b is zero."""
    return to_fixed(F.try_divide(a.cast("double"), b.cast("double")), digits)


def quotient(a: Column, b: Column) -> Column:
    """Not rounded; null if b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def counted(n: Column, one: str, many: str | None = None) -> Column:
    """A number with thousands separators, and the word for one or for many."""
    return F.concat(F.format_number(n, 0), F.lit(" "), F.when(n == 1, one).otherwise(many or one + "s"))


def lift_note(index: Column) -> Column:
    """How many times as often; whole numbers from ten on."""
    figure = F.when(index >= 10, F.format_number(F.floor(index + 0.5), 0)).otherwise(F.format_number(to_fixed(index, 1), 1))
    return F.when(index.isNull(), "only in this cohort").otherwise(F.concat(figure, F.lit("×")))
