"""Sales added up before they meet another table.

Grouping by product (and date or month) first leaves at most one row per group on the join, however many
sales one product holds; Spark combines rows on the map side, so a hot product costs each task one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from shelfwise.functions import exact

# Fractional quantities are taken to this many decimal places, so that their totals are exact as well.
FRACTION_PLACES = 6
TICKS_PER_UNIT = 10**FRACTION_PLACES

# Distinct products as a sketch that merges: 2^SKETCH_LG registers, for a standard error of 0.8 per cent of the count.
SKETCH = "product_sketch"
SKETCH_LG = 14

SKU_KEYS = ["product_id", "product_category", "promotions"]

# A task that adds rows up on the map side holds all groups it meets. Up to so many groups in all, this is left to Spark.
MAP_SIDE_GROUPS = 1_000_000
# Beyond them, rows are dealt by the key first, to tasks of so many rows.
ROWS_PER_TASK = 500_000


def _is_whole(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.IntegralType)


def _amount(df: DataFrame) -> Column:
    """Quantity of a row in units, as an exact number."""
    quantity = F.col("inventory_quantity")
    return quantity.cast("bigint") if _is_whole(df, "inventory_quantity") else quantity.cast(f"decimal(28,{FRACTION_PLACES})")


def _square(df: DataFrame) -> Column:
    """Square of a quantity: in units, or in squared ticks where quantities are fractional."""
    ticks = _amount(df) if _is_whole(df, "inventory_quantity") else _amount(df) * TICKS_PER_UNIT
    ticks = ticks.cast("decimal(19,0)")
    return (ticks * ticks).cast(exact.WIDE)


def ticks_per_unit(df: DataFrame) -> int:
    """Scale of ``units_squared`` in a rollup, whose ``units`` are always in units."""
    return 1 if _is_whole(df, "units") else TICKS_PER_UNIT


def _total_type(df: DataFrame) -> str:
    return "bigint" if _is_whole(df, "inventory_quantity") else f"decimal(38,{FRACTION_PLACES})"


def measures(df: DataFrame) -> list[Column]:
    """Totals per group that add up further: row and value counts, units, their squares, cost, date span."""
    return [
        F.count("*").alias("num_rows"),
        F.count("inventory_quantity").alias("num_quantities"),
        F.sum(_amount(df)).cast(_total_type(df)).alias("units"),
        F.sum(_square(df)).cast(exact.WIDE).alias("units_squared"),
        F.count("product_cost").alias("num_costs"),
        F.sum("product_cost").alias("cost"),
        F.min("sales_date").alias("first_date"),
        F.max("sales_date").alias("last_date"),
    ]


def dealt(df: DataFrame, key: str, measured: DataFrame) -> DataFrame:
    """Rows to be added up by ``key``, dealt by it first where their groups are too many to be held on the map side.

    Then few rows of a task have a key in common, and adding them up before the exchange only holds them. With few groups the
    rows stay where they are, so that a hot key leaves each task as one row. ``measured`` has the same keys and is read once or
    twice for them: it should be a table, or cheap columns of one.
    """
    num_rows = measured.count()
    if num_rows <= MAP_SIDE_GROUPS or measured.agg(F.approx_count_distinct(key)).first()[0] <= MAP_SIDE_GROUPS:
        return df
    return df.repartition(-(-num_rows // ROWS_PER_TASK), key)


def rollup(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.groupBy(*keys).agg(*measures(df))


def sketched(df: DataFrame, *keys: str | Column) -> DataFrame:
    """A rollup with a sketch of the distinct products of each group."""
    return df.groupBy(*keys).agg(*measures(df), F.hll_sketch_agg("product_id", F.lit(SKETCH_LG)).alias(SKETCH))


def distinct_products() -> Column:
    """Estimated number of distinct products of a sketched rollup."""
    return F.hll_sketch_estimate(SKETCH)


def merge(rollups: DataFrame, *keys: str | Column) -> DataFrame:
    """Add rollups up to a coarser grain; sketches, where there are any, are united."""
    sketches = [F.hll_union_agg(SKETCH).alias(SKETCH)] if SKETCH in rollups.columns else []
    units_type = rollups.schema["units"].dataType
    return rollups.groupBy(*keys).agg(
        F.sum("num_rows").alias("num_rows"),
        F.sum("num_quantities").alias("num_quantities"),
        F.sum("units").cast(units_type).alias("units"),
        F.sum("units_squared").cast(exact.WIDE).alias("units_squared"),
        F.sum("num_costs").alias("num_costs"),
        F.sum("cost").alias("cost"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        F.count("*").alias("num_parts"),
        *sketches,
    )


def units(df: DataFrame) -> Column:
    """Units of a rollup: a whole number, or a double where quantities are fractional."""
    return F.col("units") if _is_whole(df, "units") else F.col("units").cast("double")


def mean_units(df: DataFrame) -> Column:
    return exact.mean(units(df), F.col("num_quantities"))


def rounded_mean(df: DataFrame, n: Column, places: int) -> Column:
    """Units over ``n`` as a double, rounded half away from zero once, from the exact total."""
    scale = ticks_per_unit(df)
    ticks = F.col("units") if scale == 1 else (F.col("units") * scale).cast(exact.WIDE)
    return exact.half_up_mean(ticks, n * scale, places).cast("double")


def mean_cost() -> Column:
    return exact.mean(F.col("cost"), F.col("num_costs"))


def stdev_units(df: DataFrame) -> Column:
    """Sample standard deviation of quantity per row; null for a single row."""
    scale = ticks_per_unit(df)
    total = F.col("units") if scale == 1 else (F.col("units") * scale).cast(exact.WIDE)
    return exact.sample_stdev(F.col("num_quantities"), total, F.col("units_squared")) / scale
