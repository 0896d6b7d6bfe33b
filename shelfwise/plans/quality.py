"""Checks of the loaded tables, as rows (check, expected, actual, ok).

Checks of one table share one pass over it: its rows are counted by key, and all figures come from the counts.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shelfwise import schemas
from shelfwise.functions import rules
from shelfwise.star import Star

# Row counts the first load is known to give, and the least a live table should hold.
EXPECTED_ROWS = {"product_information": 1375, "sales_data": 1500, "external_factors": 1019}
MINIMUM_ROWS = {"product_information": 1000, "sales_data": 1000, "external_factors": 500}


@dataclass(frozen=True)
class Check:
    """A figure that should equal ``expected``, or reach it."""

    name: str
    actual: Column
    expected: int = 0
    at_least: bool = False

    def row(self) -> Column:
        actual = F.coalesce(self.actual, F.lit(0)).cast("bigint")
        expected = F.lit(self.expected).cast("bigint")
        ok = actual >= expected if self.at_least else actual == expected
        return F.struct(F.lit(self.name).alias("check"), expected.alias("expected"), actual.alias("actual"), ok.alias("ok"))


def _run(counts: DataFrame, checks: list[Check]) -> DataFrame:
    one_row = counts.agg(F.array(*(check.row() for check in checks)).alias("checks"))
    return one_row.select(F.inline("checks"))


def _key_checks(table: str, key: str) -> list[Check]:
    """Key values that repeat, and rows without a key; reads counts per key in ``num_rows``."""
    missing = F.col(key).isNull()
    return [
        Check(f"{table}: repeated {key}", F.count_if((F.col("num_rows") > 1) & ~missing)),
        Check(f"{table}: missing {key}", F.sum(F.when(missing, F.col("num_rows")))),
    ]


def _row_check(table: str, rows: Mapping[str, int], exact_count: bool) -> list[Check]:
    if table not in rows:
        return []
    kind = "rows" if exact_count else "least rows"
    return [Check(f"{table}: {kind}", F.sum("num_rows"), rows[table], at_least=not exact_count)]


def product_checks(star: Star, rows: Mapping[str, int] = MINIMUM_ROWS, exact_count: bool = False) -> DataFrame:
    """Key, row count and text widths of the products."""
    table = "product_information"
    too_long = {
        name: F.count_if(F.length(name) > limit).alias(f"long_{name}") for name, limit in schemas.TEXT_LIMITS.items()
    }
    counts = star.products.groupBy("product_id").agg(F.count("*").alias("num_rows"), *too_long.values())
    widths = [
        Check(f"{table}: {name} over {limit}", F.sum(f"long_{name}")) for name, limit in schemas.TEXT_LIMITS.items()
    ]
    return _run(counts, [*_key_checks(table, "product_id"), *_row_check(table, rows, exact_count), *widths])


def sales_checks(star: Star, rows: Mapping[str, int] = MINIMUM_ROWS, exact_count: bool = False) -> DataFrame:
    """Row count, missing values, unknown products, and products without a category, over the sales."""
    table = "sales_data"
    sold = star.sales.groupBy("product_id").agg(
        F.count("*").alias("num_rows"), F.count_if(F.col("sales_date").isNull()).alias("undated")
    )
    listed = star.products.groupBy("product_id").agg(
        F.bool_or(F.col("product_category").isNull()).alias("no_category"), F.lit(True).alias("listed")
    )
    no_product = F.col("product_id").isNull()
    unknown = ~no_product & F.col("listed").isNull()
    return _run(
        sold.join(listed, "product_id", "left"),
        [
            *_row_check(table, rows, exact_count),
            Check(f"{table}: missing product_id", F.sum(F.when(no_product, F.col("num_rows")))),
            Check(f"{table}: missing sales_date", F.sum("undated")),
            Check(f"{table}: unknown product_id", F.sum(F.when(unknown, F.col("num_rows")))),
            Check("inventory_summary: missing product_category", F.sum(F.when(F.col("no_category"), F.col("num_rows")))),
        ],
    )


def sales_key_checks(star: Star) -> DataFrame:
    """The row number of the sales as a key."""
    counts = star.sales.groupBy("sales_id").agg(F.count("*").alias("num_rows"))
    return _run(counts, _key_checks("sales_data", "sales_id"))


def factor_checks(star: Star, rows: Mapping[str, int] = MINIMUM_ROWS, exact_count: bool = False) -> DataFrame:
    """Key and row count of the external factors."""
    table = "external_factors"
    counts = star.factors.groupBy("sales_date").agg(F.count("*").alias("num_rows"))
    return _run(counts, [*_key_checks(table, "sales_date"), *_row_check(table, rows, exact_count)])


def all_checks(star: Star, rows: Mapping[str, int] = MINIMUM_ROWS, exact_count: bool = False) -> DataFrame:
    """Every check of the base tables; row numbers are checked where the sales have them."""
    parts = [check(star, rows, exact_count) for check in (product_checks, sales_checks, factor_checks)]
    if "sales_id" in star.sales.columns:
        parts.append(sales_key_checks(star))
    return reduce(DataFrame.unionByName, parts)


def column_checks(frames: Mapping[str, DataFrame], required: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """Required columns that are absent, per frame. Reads schemas only."""
    spark = next(iter(frames.values())).sparkSession
    rows = []
    for name, columns in required.items():
        absent = len(schemas.missing_columns(frames[name].columns, columns))
        rows.append((f"{name}: missing columns", 0, absent, absent == 0))
    return spark.createDataFrame(rows, "check string, expected bigint, actual bigint, ok boolean")


def conflicting_promotions(staging_products: DataFrame) -> DataFrame:
    """Product ids staged both as promoted and as not promoted."""
    yes = rules.is_yes(F.col("promotions"))
    sides = staging_products.groupBy("product_id").agg(F.count("*").alias("num_rows"), F.count_if(yes).alias("num_yes"))
    return sides.where((F.col("num_yes") > 0) & (F.col("num_yes") < F.col("num_rows")))


def repeated_dates(staging_factors: DataFrame) -> DataFrame:
    """Dates staged more than once."""
    counts = staging_factors.groupBy("sales_date").agg(F.count("*").alias("num_rows"))
    return counts.where(F.col("num_rows") > 1)


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()
