"""Joins of the star, with a measured size before any broadcast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
SALTS = 64
ROW_OVERHEAD_BYTES = 16


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows of ``df`` as a broadcast would hold them, from one aggregate over them."""

    def width(field: T.StructField) -> Column:
        if isinstance(field.dataType, T.StringType):
            return F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0)) + 8
        return F.lit(16 if isinstance(field.dataType, T.DecimalType) else 8)

    row = reduce(lambda a, b: a + b, (width(f) for f in df.schema.fields), F.lit(ROW_OVERHEAD_BYTES))
    return df.agg(F.coalesce(F.sum(row.cast("bigint")), F.lit(0))).first()[0]


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: str,
    how: str,
    *,
    split_by: list[str],
    limit_bytes: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Join many rows to a side that is expected to be small, on a key few values of which may be hot.

    ``small`` is read once to measure it, for which only its texts are needed: it should be a written table or an aggregate
    over one. Within the limit it is
    broadcast and ``big`` does not move. Beyond it, each key is split over salts taken from ``split_by``,
    so that a key with a third of all rows still spreads over many tasks.
    """
    if measured_bytes(small) <= limit_bytes:
        return big.join(F.broadcast(small), on, how)
    return salted_join(big, small, on, how, split_by=split_by)


def salted_join(big: DataFrame, small: DataFrame, on: str, how: str, *, split_by: list[str]) -> DataFrame:
    salted_big = big.withColumn("salt", F.pmod(F.xxhash64(*split_by), F.lit(SALTS)).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    return salted_big.join(small.select("*", salts), [on, "salt"], how).drop("salt")


def with_products(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Rows that carry ``product_id`` with the category and promotion status of their product."""
    return rows.join(products, "product_id", "inner")


def with_factors(rows: DataFrame, factors: DataFrame, measured: bool = True) -> DataFrame:
    """Sales with the factors of their date; a sale whose date has none keeps nulls.

    ``factors`` should be a written table. It has one row per calendar date. Without ``measured`` the join is left to Spark, which
    broadcasts by its own threshold and else splits a hot date.
    """
    if not measured:
        return rows.join(factors, "sales_date", "left")
    return join_small(rows, factors, "sales_date", "left", split_by=rows.columns)


def orphans(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Product ids sold but not listed, with the number of sales (product_id, num_sales)."""
    sold = sales.groupBy("product_id").agg(F.count("*").alias("num_sales"))
    return sold.join(products.select("product_id"), "product_id", "left_anti")
