"""Column sets and types of the staging, base and joined tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _all_text(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


STAGING_PRODUCTS = _all_text("product_id", "product_category", "promotions")
STAGING_SALES = _all_text("product_id", "sales_date", "inventory_quantity", "product_cost")
STAGING_FACTORS = _all_text("sales_date", "gdp", "inflation_rate", "seasonal_factor")

PRODUCTS = T.StructType(
    [
        T.StructField("product_id", T.LongType()),
        T.StructField("product_category", T.StringType()),
        T.StructField("promotions", T.StringType()),
    ]
)
SALES = T.StructType(
    [
        T.StructField("sales_id", T.LongType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("sales_date", T.DateType()),
        T.StructField("inventory_quantity", T.IntegerType()),
        T.StructField("product_cost", T.DecimalType(10, 2)),
    ]
)
FACTORS = T.StructType(
    [
        T.StructField("sales_date", T.DateType()),
        T.StructField("gdp", T.DecimalType(18, 2)),
        T.StructField("inflation_rate", T.DecimalType(5, 2)),
        T.StructField("seasonal_factor", T.DecimalType(5, 2)),
    ]
)

TABLES = {"product_information": PRODUCTS, "sales_data": SALES, "external_factors": FACTORS}

# Text widths of the base tables.
TEXT_LIMITS = {"product_category": 50, "promotions": 10}

MACRO_COLUMNS = ("gdp", "inflation_rate", "seasonal_factor")
EXTRACT_COLUMNS = (
    "sales_id",
    "product_id",
    "product_category",
    "promotions",
    "sales_date",
    "inventory_quantity",
    "product_cost",
    *MACRO_COLUMNS,
)
REQUIRED_COLUMNS = ("product_id", "product_category", "sales_date", "inventory_quantity")


def missing_columns(columns: list[str], required: tuple[str, ...] = REQUIRED_COLUMNS) -> list[str]:
    """Required columns that are absent, sorted."""
    return sorted(set(required) - set(columns))
