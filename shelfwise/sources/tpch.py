"""The inventory model over TPC-H style order tables.

A product is a part from one supplier; a return marks it as promoted. Orders stand in for macro data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfwise.plans import load
from shelfwise.star import Star

SUPPLIERS = 1_000_000


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _product_id() -> Column:
    return (F.col("l_partkey") * SUPPLIERS + F.col("l_suppkey")).alias("product_id")


def _products(lines: DataFrame, parts: DataFrame) -> DataFrame:
    promotions = F.when(F.col("l_returnflag") == "R", "Yes").otherwise("No")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        _product_id(), F.col("p_type").alias("product_category"), promotions.alias("promotions")
    )


def _sales(lines: DataFrame) -> DataFrame:
    return lines.select(
        _product_id(),
        F.col("l_shipdate").cast("date").alias("sales_date"),
        F.col("l_quantity").cast("int").alias("inventory_quantity"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("product_cost"),
    )


def raw_products(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line, so ids repeat and their promotion values conflict."""
    return _products(_table(spark, folder, "lineitem"), _table(spark, folder, "part"))


def raw_sales(spark: SparkSession, folder: str) -> DataFrame:
    return _sales(_table(spark, folder, "lineitem"))


def raw_factors(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order, so dates repeat."""
    date = F.col("o_orderdate").cast("date")
    return _table(spark, folder, "orders").select(
        date.alias("sales_date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("gdp"),
        ((F.col("o_orderkey") % 400) / F.lit(100)).cast("decimal(5,2)").alias("inflation_rate"),
        ((850 + 25 * F.month(date)).cast("decimal(10,3)") / 1000).cast("decimal(5,2)").alias("seasonal_factor"),
    )


def as_text(raw: DataFrame) -> DataFrame:
    """Raw rows as a text file would hold them, dates day first."""
    return raw.select(
        *(
            (F.date_format(name, "dd/MM/yyyy") if name == "sales_date" else F.col(name).cast("string")).alias(name)
            for name in raw.columns
        )
    )


def star(spark: SparkSession, folder: str) -> Star:
    """Base tables without row numbers on the sales."""
    lines = _table(spark, folder, "lineitem")
    return Star(
        load.dedupe_products(_products(lines, _table(spark, folder, "part")), measured=lines.select(_product_id())),
        _sales(lines),
        load.average_by_date(raw_factors(spark, folder)),
    )
