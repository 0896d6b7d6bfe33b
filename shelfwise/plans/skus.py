"""Totals per product, statistics per category, and the reorder and overstock figures made from both."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfwise.functions import rules
from shelfwise.operators import joins, rollups
from shelfwise.operators.rollups import SKU_KEYS
from shelfwise.params import Params
from shelfwise.star import Star
from shelfwise.workspace import materialise


def sku_totals(star: Star) -> DataFrame:
    """Sales totals of each product with its category and promotion status.

    Sales are added up by product before the join. Both sides are then partitioned by product id, so the
    sales move once. Among few products a hot one arrives as one row per task; see ``rollups.dealt`` for many.
    """
    sales = rollups.dealt(star.sales, "product_id", measured=star.sales)
    return joins.with_products(rollups.rollup(sales, "product_id"), star.products)


def write_totals(totals: DataFrame) -> DataFrame:
    """Written SKU totals: one pass over the sales serves every report and every choice of parameters."""
    return materialise(totals, "sku-totals")


def category_stats(totals: DataFrame) -> DataFrame:
    """Mean, sample deviation and sum of quantity per category, each sales row counting once."""
    merged = rollups.merge(totals, "product_category")
    return merged.select(
        "product_category",
        rollups.mean_units(merged).alias("avg_demand"),
        rollups.stdev_units(merged).alias("category_stdev"),
        rollups.units(merged).alias("total_units"),
    )


def sku_metrics(totals: DataFrame, params: Params = Params(), how: str = "inner") -> DataFrame:
    """Demand, cost, capital, overstock flag and reorder point of each SKU in ``totals``.

    ``totals`` should be written, as it is read for the category statistics and again for the SKUs. The
    category baseline covers exactly the rows in ``totals``, so filters move it.
    """
    stats = category_stats(totals).drop("total_units")
    joined = joins.join_small(totals, stats, "product_category", how, split_by=["product_id"])
    demand, cost = F.col("sku_demand"), F.col("sku_cost")
    lead_time = params.lead_time_days
    return (
        joined.select(
            *SKU_KEYS,
            rollups.units(totals).alias("sku_units"),
            rollups.mean_units(totals).alias("sku_demand"),
            rollups.mean_cost().alias("sku_cost"),
            "avg_demand",
            "category_stdev",
            "num_costs",
            "cost",
        )
        .withColumns(
            {
                "capital_tied_up": demand * cost,
                "is_overstock": rules.is_overstock(demand, F.col("avg_demand"), params.overstock_ratio),
                "lead_time_demand": rules.lead_time_demand(demand, lead_time),
                "safety_stock": rules.safety_stock(F.col("category_stdev"), params.z, lead_time),
            }
        )
        .withColumn("reorder_point", F.col("lead_time_demand") + F.col("safety_stock"))
    )
