"""Rates, ratios and dates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def div(numerator: Column, denominator: Column) -> Column:
    """Integer division; null when the denominator is zero."""
    return F.call_function("div", numerator, F.nullif(denominator, F.lit(0)))


def ratio_rounded(numerator: Column, denominator: Column, places: int = 2,
                  scale: int = 1) -> Column:
    """``scale * numerator / denominator`` rounded half-up, decided in whole numbers.

    Rounding a double that sits near a .5 tie depends on the engine; this does not. Works for
    counts and for decimal sums, returns a double, and is null for a zero denominator.
    """
    unit = 10 ** places
    magnitude = div(F.abs(numerator) * F.lit(2 * unit * scale) + denominator, denominator * 2)
    signed = F.when(numerator < 0, -magnitude).otherwise(magnitude)
    return signed.cast("double") / F.lit(float(unit))


def percent(numerator: Column, denominator: Column) -> Column:
    """Percentage with two decimals."""
    return ratio_rounded(numerator, denominator, places=2, scale=100)


def fraction(numerator: Column, denominator: Column) -> Column:
    """Plain quotient as a double, null for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient of two measures, null unless both are present, finite and divisible."""
    quotient = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return F.when(F.isnan(quotient) | (F.abs(quotient) == INFINITY), None).otherwise(quotient)


def zero_ratio(numerator: Column, denominator: Column) -> Column:
    """Dashboard form of a ratio: zero where the denominator is absent or zero."""
    return (F.when(denominator.isNull() | (denominator == 0), 0.0)
            .otherwise(fraction(numerator, denominator)))


def not_nan(value: Column) -> Column:
    """NaN counts as missing."""
    return F.nanvl(value, F.lit(None).cast("double"))


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def month_of(day: Column) -> Column:
    """First day of the month, as a date."""
    return F.trunc(day, "month")


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def clip(value: Column, low: float, high: float) -> Column:
    """Limit to a range. ``greatest``/``least`` skip nulls, so null is kept explicitly."""
    limited = F.greatest(F.least(value, F.lit(high)), F.lit(low))
    return F.when(value.isNotNull(), limited)


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def sum_where(value: Column, condition: Column) -> Column:
    return F.sum(F.when(condition, value))


def rank_in(value: Column, ordered: list[str]) -> Column:
    """Position of a label in a fixed order; labels outside it come last."""
    position = F.lit(len(ordered) + 1)
    for index in range(len(ordered), 0, -1):
        position = F.when(value == ordered[index - 1], index).otherwise(position)
    return position
