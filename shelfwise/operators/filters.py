"""Row filters of the dashboard. They read only product columns, so they fit sales rows and rollups alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.params import Params
from shelfwise.schemas import REQUIRED_COLUMNS

BIGINT_LIMIT = 2**63


def in_categories(categories: Sequence[str] | None) -> Column:
    """Exact match; None keeps all rows, an empty selection none."""
    return F.lit(True) if categories is None else F.col("product_category").isin(list(categories))


def has_promotion(promo: str) -> Column:
    """``all``, or promoted / not promoted in any case; an unknown status is neither."""
    if promo == "all":
        return F.lit(True)
    return F.lower(F.coalesce(F.col("promotions").cast("string"), F.lit(""))) == promo


def is_sku(sku_id: int | None) -> Column:
    """One product; None keeps all rows."""
    if sku_id is None:
        return F.lit(True)
    if not -BIGINT_LIMIT <= sku_id < BIGINT_LIMIT:
        return F.lit(False)
    return F.col("product_id") == sku_id


def keeps(params: Params) -> Column:
    return in_categories(params.categories) & has_promotion(params.promo) & is_sku(params.sku_id)


def apply(df: DataFrame, params: Params) -> DataFrame:
    return df.where(keeps(params))


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows with product, category, date and quantity present.

    One condition per column, so that each reaches the scan it belongs to.
    """
    for name in REQUIRED_COLUMNS:
        if name in df.columns:
            df = df.where(F.col(name).isNotNull())
    return df
