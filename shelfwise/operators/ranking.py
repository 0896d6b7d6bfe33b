"""Orders and top-k. Product id breaks ties, which also lets a range sort split equal values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _keys(df: DataFrame, columns: tuple[str | Column, ...]) -> list[Column]:
    ties = [name for name in ("product_id", "promotions") if name in df.columns]
    return [F.desc(c) if isinstance(c, str) else c for c in columns] + [F.asc(name) for name in ties]


def descending(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.orderBy(*_keys(df, columns))


def top(df: DataFrame, k: int, *columns: str | Column) -> DataFrame:
    return df.orderBy(*_keys(df, columns)).limit(k)
