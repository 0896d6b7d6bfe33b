"""Text to typed values: strict (a bad value stops the query) or coercing (a bad value becomes null)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

DAY_FIRST = "d/M/yyyy"
DAY_FIRST_SHAPE = r"^\d{1,2}/\d{1,2}/\d{4}$"


def coerce_int(raw: Column) -> Column:
    return raw.try_cast("int")


def coerce_long(raw: Column) -> Column:
    return raw.try_cast("bigint")


def coerce_decimal(raw: Column, precision: int, scale: int) -> Column:
    return raw.try_cast(f"decimal({precision},{scale})")


def coerce_date(raw: Column) -> Column:
    """Day-first date, with or without leading zeros. Text of another shape is not worth a parse attempt."""
    text = F.trim(raw)
    return F.when(text.rlike(DAY_FIRST_SHAPE), F.try_to_date(text, DAY_FIRST))


def strict(raw: Column, parsed: Column, name: str) -> Column:
    """``parsed``, or an error that names the column and the value that could not be read."""
    message = F.concat(F.lit(f"{name}: cannot read value '"), raw, F.lit("'"))
    return F.when(raw.isNotNull() & parsed.isNull(), F.raise_error(message)).otherwise(parsed)


def to_number(value: Column, dtype: T.DataType) -> Column:
    """Numbers pass unchanged; text that is no finite number becomes null."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        number = value
    elif isinstance(dtype, T.NumericType):
        return value
    else:
        number = value.try_cast("double")
    infinite = F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.when(~infinite, number)


def to_day(value: Column, dtype: T.DataType) -> Column:
    """Date of a date, timestamp or ISO text value; null when it is none."""
    if isinstance(dtype, T.DateType):
        return value
    return value.try_cast("date")


def clean_text(value: Column) -> Column:
    """Text without white space at either end (tabs and line ends included)."""
    return F.regexp_replace(value.cast("string"), r"^\s+|\s+$", "")
