"""Values as text, for the last projection of a report only."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F


def _fixed(places: int) -> Callable[[Column], Column]:
    pattern = "0." + "0" * places
    return lambda value: F.call_function("format_number", value, F.lit(pattern))


one_place = _fixed(1)
three_places = _fixed(3)


def money(value: Column) -> Column:
    """``$1,234.56``."""
    return F.concat(F.lit("$"), F.format_number(value, 2))


def whole(value: Column) -> Column:
    """``1,234``."""
    return F.format_number(value, 0)


def month(value: Column) -> Column:
    """``Jan 2022``."""
    return F.date_format(value, "MMM yyyy")


def as_text(df: DataFrame, formats: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """``df`` with the named columns turned to text; the others stay."""
    return df.withColumns({name: form(F.col(f"`{name}`")) for name, form in formats.items()})
