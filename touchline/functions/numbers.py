"""Lenient numbers and their display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "—"


def lenient_double(value: Column) -> Column:
    """Number or null; text NaN counts as missing."""
    return F.nanvl(value.try_cast("double"), F.lit(None).cast("double"))


def safe_int(value: Column) -> Column:
    """Truncated and never negative; whatever is no number becomes 0."""
    return F.greatest(F.coalesce(value.try_cast("double").try_cast("bigint"), F.lit(0)), F.lit(0))


def fixed(value: Column, places: int = 2) -> Column:
    """Fixed number of decimals, or a dash."""
    number = lenient_double(value)
    shown = F.format_string(f"%.{places}f", number)
    return F.when(number.isNotNull(), shown).otherwise(F.lit(MISSING))


def signed(value: Column) -> Column:
    return F.concat(F.when(value > 0, "+").otherwise(""), value.cast("string"))


def half_even(value: Column) -> Column:
    """Nearest whole number, ties to the even one."""
    return F.rint(value).cast("bigint")


def exact(value: Column) -> Column:
    """Decimal form used for sums, so that no total depends on addition order."""
    return F.coalesce(value.cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)"))


def rounded(value: Column, places: int) -> Column:
    """Half-up rounding done on the decimal digits, returned as a double."""
    return F.round(value.cast("decimal(28,6)"), places).cast("double")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
