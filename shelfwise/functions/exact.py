"""Means, deviations and rounding whose result does not depend on how rows were spread over tasks.

All start from whole-number or decimal totals, which add up the same in any order.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

WIDE = "decimal(38,0)"
MICROS = "decimal(28,6)"


def integer_mean(total: Column, n: Column) -> Column:
    """Mean of whole numbers, cut towards zero."""
    return F.call_function("div", total, F.nullif(n, F.lit(0)))


def mean(total: Column, n: Column) -> Column:
    """Mean as a double; null over no rows."""
    return total.cast("double") / F.nullif(n, F.lit(0)).cast("double")


def total(value: Column) -> Column:
    """Sum of doubles that is the same in any order: each is taken to six places and added as a decimal."""
    return F.sum(value.cast(MICROS)).cast("double")


def half_up_mean(total: Column, n: Column, places: int) -> Column:
    """Mean of decimal values rounded half away from zero once, from the exact total."""
    scaled = (total * F.lit(10**places)).cast(WIDE)
    count = F.nullif(n, F.lit(0)).cast(WIDE)
    size = F.call_function("div", F.abs(scaled) * 2 + count, count * 2)
    signed = F.when(scaled < 0, -size).otherwise(size)
    unit = F.lit(Decimal(1).scaleb(-places))
    return (signed.cast("decimal(20,0)") * unit).cast(f"decimal(38,{places})")


def sample_stdev(n: Column, total: Column, squares: Column) -> Column:
    """Sample standard deviation of whole numbers from count, sum and sum of squares; null below two rows.

    Deviations are taken from the whole part of the mean first, in exact arithmetic, so that large values
    with a small spread lose no digits.
    """
    wide = total.cast(WIDE)
    centre = F.call_function("div", wide, F.nullif(n, F.lit(0))).cast(WIDE)
    rest = wide - centre * n
    around_centre = (squares - centre * (wide + rest)).cast("double")
    count, remainder = n.cast("double"), rest.cast("double")
    spread = around_centre - remainder * remainder / count
    spread = F.when(spread < 0, 0.0).otherwise(spread)  # a total beyond its type stays null
    return F.when(n > 1, F.sqrt(spread / (count - 1)))


def round_half_up(value: Column, places: int) -> Column:
    """Double rounded half away from zero, ignoring binary noise six digits further on."""
    return F.round(value.cast(f"decimal(38,{places + 6})"), places).cast("double")
