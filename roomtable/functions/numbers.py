"""Column helpers for rounding, clipping and null-safe ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """Round half up by plain IEEE steps, so that any engine gives the same bits.

    Short roundings go through nine digits first: a sum that should be an exact tie
    is then one, whatever order its terms were added in.
    """
    if digits < 7:
        value = _half_up(value, 9)
    return _half_up(value, digits)


def _half_up(value: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def clip(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, _lit(low)), _lit(high))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, null where there is nothing to measure."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def codes(*pairs: tuple[Column, str]) -> Column:
    """Array of the codes whose condition is true, in the order given."""
    flagged = F.array(*[F.when(condition, F.lit(code)) for condition, code in pairs])
    return F.filter(flagged, lambda code: code.isNotNull())


def piped(codes_array: Column) -> Column:
    return F.array_join(F.array_sort(codes_array), "|")


def one_of(value: Column, allowed) -> Column:
    return value.isin(list(allowed))


def count_where(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
