"""Batch analysis of the base tables.

``totals`` is a frame of ``skus.sku_totals``, ``metrics`` one of ``skus.sku_metrics`` and ``dated`` one of
``sales_by_date``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.functions import exact, rules
from shelfwise.operators import joins, ranking, rollups
from shelfwise.params import Params
from shelfwise.schemas import EXTRACT_COLUMNS
from shelfwise.star import Star


def _whole_mean_units() -> Column:
    return exact.integer_mean(F.col("units"), F.col("num_quantities")).cast("int")


# --- joined rows -----------------------------------------------------------------------------------


def inventory_summary(star: Star, measured: bool = True) -> DataFrame:
    """Every sale with its product and, where the date has any, its external factors.

    Reads written (or stored) dimension tables; see ``Star.with_written_dimensions``, and ``joins.with_factors`` for ``measured``.
    """
    joined = joins.with_factors(joins.with_products(star.sales, star.products), star.factors, measured)
    return joined.select(*(name for name in EXTRACT_COLUMNS if name in joined.columns))


def sales_by_date(star: Star) -> DataFrame:
    """Sales totals per date with its factors; ``has_factors`` is null for a date that has none.

    Sales shrink to one row per date before they meet the factors, so neither side needs a broadcast.
    """
    factors = star.factors.withColumn("has_factors", F.lit(True))
    return rollups.rollup(star.sales, "sales_date").join(factors, "sales_date", "left")


def coverage_gap(dated: DataFrame) -> DataFrame:
    """Number of joined rows without a gdp value: no factors for the date, or none recorded."""
    missing = F.when(F.col("gdp").isNull(), F.col("num_rows"))
    return dated.agg(F.coalesce(F.sum(missing), F.lit(0)).alias("sales_without_gdp"))


def uncovered_dates(dated: DataFrame) -> DataFrame:
    """Sales dates that have no row of external factors at all."""
    gaps = dated.where(F.col("has_factors").isNull())
    return gaps.select("sales_date", F.col("num_rows").alias("num_sales")).orderBy("sales_date")


# --- demand ----------------------------------------------------------------------------------------


def demand_profile(star: Star) -> DataFrame:
    """Count, whole mean, range and deviation of quantity per product, most volatile first."""
    totals = star.sales.groupBy("product_id").agg(
        *rollups.measures(star.sales),
        F.min("inventory_quantity").alias("min_units"),
        F.max("inventory_quantity").alias("max_units"),
    )
    profile = totals.select(
        "product_id",
        F.col("num_rows").alias("num_sales_records"),
        _whole_mean_units().alias("avg_units_per_sale"),
        "min_units",
        "max_units",
        rollups.stdev_units(totals).alias("demand_volatility"),
    )
    return ranking.descending(profile, "demand_volatility")


def category_velocity(totals: DataFrame) -> DataFrame:
    """Records, units, whole mean quantity and mean cost per category, most units first."""
    merged = rollups.merge(totals, "product_category")
    result = merged.select(
        "product_category",
        F.col("num_rows").alias("total_records"),
        rollups.units(merged).alias("total_units_moved"),
        _whole_mean_units().alias("avg_units_per_sale"),
        exact.half_up_mean(F.col("cost"), F.col("num_costs"), 6).alias("avg_unit_cost"),
    )
    return result.orderBy(F.desc("total_units_moved"), "product_category")


def category_volatility(totals: DataFrame) -> DataFrame:
    merged = rollups.merge(totals, "product_category")
    result = merged.select("product_category", rollups.stdev_units(merged).alias("category_stdev"))
    return result.orderBy(F.desc("category_stdev"), "product_category")


def observations_per_product(star: Star) -> DataFrame:
    counts = star.sales.groupBy("product_id").agg(F.count("*").alias("num_records"))
    return ranking.descending(counts, "num_records")


def observation_histogram(star: Star) -> DataFrame:
    """How many products have one sale, two sales, and so on."""
    counts = star.sales.groupBy("product_id").agg(F.count("*").alias("num_records"))
    return counts.groupBy("num_records").agg(F.count("*").alias("how_many_products")).orderBy("num_records")


def single_observation_share(star: Star) -> DataFrame:
    """Products seen once, in per cent of all products sold, to one place."""
    histogram = observation_histogram(star)
    sums = histogram.agg(
        F.sum("how_many_products").alias("products"),
        F.coalesce(F.sum(F.when(F.col("num_records") == 1, F.col("how_many_products"))), F.lit(0)).alias("single"),
    )
    share = exact.half_up_mean(F.col("single") * 100, F.col("products"), 1).cast("double")
    return sums.withColumn("single_share_pct", share)


def monthly_trend(star: Star) -> DataFrame:
    """Transactions, mean quantity and units per category and month; months without sales do not appear."""
    star = star.with_written_products()
    rows = joins.with_products(star.sales, star.products)
    return trend(rollups.rollup(rows, "product_category", F.trunc("sales_date", "MM").alias("month_start")))


def trend(merged: DataFrame) -> DataFrame:
    """The trend from totals per category and ``month_start``."""
    return merged.select(
        "product_category",
        "month_start",
        F.col("num_rows").alias("num_transactions"),
        rollups.rounded_mean(merged, F.col("num_quantities"), 1).alias("avg_units_per_sale"),
        rollups.units(merged).alias("total_units_moved"),
    ).orderBy("product_category", "month_start")


def turnover_by_category(totals: DataFrame) -> DataFrame:
    """Units per distinct product and mean cost per category, fastest turnover first."""
    by_product = rollups.merge(totals, "product_category", "product_id").drop("num_parts")
    merged = rollups.merge(by_product, "product_category")
    result = merged.select(
        "product_category",
        rollups.rounded_mean(merged, F.col("num_parts"), 1).alias("avg_units_per_product"),
        exact.half_up_mean(F.col("cost"), F.col("num_costs"), 2).alias("avg_unit_cost"),
    )
    return result.orderBy(F.desc("avg_units_per_product"), "product_category")


def sketched_by_month(star: Star) -> DataFrame:
    """Rollups per category, promotion status and month with sketches of the products sold. They merge to any span of months, which exact
    distinct counts do not."""
    star = star.with_written_products()
    rows = joins.with_products(star.sales, star.products)
    return rollups.sketched(rows, "product_category", "promotions", F.trunc("sales_date", "MM").alias("month_start"))


def turnover_estimate(sketched: DataFrame) -> DataFrame:
    """``turnover_by_category`` from sketched rollups: the number of products, and so the turnover, is an estimate."""
    merged = rollups.merge(sketched, "product_category")
    result = merged.select(
        "product_category",
        rollups.rounded_mean(merged, rollups.distinct_products(), 1).alias("avg_units_per_product"),
        exact.half_up_mean(F.col("cost"), F.col("num_costs"), 2).alias("avg_unit_cost"),
    )
    return result.orderBy(F.desc("avg_units_per_product"), "product_category")


# --- promotion, season, inflation ------------------------------------------------------------------


def promotion_impact(totals: DataFrame, whole: bool = False) -> DataFrame:
    """Mean quantity (cut to a whole number on request) and records by promotion status."""
    merged = rollups.merge(totals, "promotions")
    return merged.select(
        "promotions",
        (_whole_mean_units() if whole else rollups.mean_units(merged)).alias("avg_units_per_sale"),
        F.col("num_rows").alias("num_records"),
    ).orderBy("promotions")


def _season(dated: DataFrame, labels: tuple[str, str, str], whole: bool) -> DataFrame:
    band = rules.season_band(F.col("seasonal_factor"), labels).alias("season_band")
    merged = rollups.merge(dated.where("has_factors"), band)
    return merged.select(
        "season_band",
        (_whole_mean_units() if whole else rollups.mean_units(merged)).alias("avg_units_per_sale"),
        F.col("num_rows").alias("num_records"),
    )


def season_impact(dated: DataFrame, whole: bool = False) -> DataFrame:
    """Mean quantity and records by season band, highest mean first."""
    bands = _season(dated, rules.SEASON_LABELS, whole)
    return bands.orderBy(F.desc("avg_units_per_sale"), "season_band")


def season_chart(dated: DataFrame) -> DataFrame:
    """Season bands in the order low, normal, high."""
    labels = rules.SEASON_CHART_LABELS
    low, normal, _ = labels
    place = F.when(F.col("season_band") == low, 0).when(F.col("season_band") == normal, 1).otherwise(2)
    return _season(dated, labels, whole=False).orderBy(place)


def inflation_by_month(dated: DataFrame) -> DataFrame:
    """Units and mean inflation per month, each sale counting its date's inflation once."""
    covered = dated.where("has_factors")
    weight = F.when(F.col("inflation_rate").isNotNull(), F.col("num_rows"))
    by_month = covered.groupBy(F.trunc("sales_date", "MM").alias("month_start")).agg(
        exact.mean(F.sum(F.col("inflation_rate") * F.col("num_rows")), F.sum(weight)).alias("avg_inflation"),
        F.sum("units").cast(covered.schema["units"].dataType).alias("units"),
    )
    by_month = by_month.select("month_start", "avg_inflation", rollups.units(by_month).alias("total_units_moved"))
    return by_month.orderBy("month_start")


# --- reorder points --------------------------------------------------------------------------------


def product_reorder_points(star: Star, params: Params = Params()) -> DataFrame:
    """Reorder point from each product's own deviation, which is unknown (null) for a single sale."""
    totals = rollups.rollup(star.sales, "product_id")
    lead_time = params.lead_time_days
    result = (
        totals.select(
            "product_id",
            _whole_mean_units().alias("avg_demand"),
            rollups.stdev_units(totals).alias("demand_stdev"),
        )
        .withColumn("lead_time_demand", rules.lead_time_demand(F.col("avg_demand"), lead_time))
        .withColumn("safety_stock", rules.safety_stock(F.col("demand_stdev"), params.z, lead_time))
        .withColumn("reorder_point", F.col("lead_time_demand") + F.col("safety_stock"))
    )
    return ranking.descending(result, "reorder_point")


def reorder_points(metrics: DataFrame) -> DataFrame:
    """Reorder point from the product's demand and its category's deviation, highest first."""
    result = metrics.select(
        "product_id",
        "product_category",
        F.col("sku_demand").alias("product_avg_demand"),
        "category_stdev",
        "lead_time_demand",
        "safety_stock",
        "reorder_point",
    )
    return ranking.descending(result, "reorder_point")


def _rounded(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        "product_id",
        "product_category",
        "promotions",
        exact.round_half_up(F.col("sku_demand"), 1).alias("avg_demand"),
        exact.round_half_up(F.col("reorder_point"), 1).alias("reorder_point"),
    )


def top_reorder(metrics: DataFrame, k: int = 10) -> DataFrame:
    """The k highest reorder points (after rounding), with promotion status."""
    return ranking.top(_rounded(metrics), k, "reorder_point")


def top_reorder_chart(metrics: DataFrame, k: int = 10) -> DataFrame:
    ranked = top_reorder(metrics, k)
    label = rules.long_label(F.col("product_id"), F.col("product_category"))
    return ranked.select("product_id", "product_category", "reorder_point", label.alias("label"))


def stockout_risk(metrics: DataFrame, k: int = 10) -> DataFrame:
    """The k products in highest demand (after rounding) with their reorder points."""
    ranked = ranking.top(_rounded(metrics).drop("promotions"), k, "avg_demand")
    return ranked.withColumn("label", rules.short_label(F.col("product_id"), F.col("product_category")))


# --- overstock -------------------------------------------------------------------------------------


def overstock_register(metrics: DataFrame) -> DataFrame:
    """Products under the given share of their category's demand, most capital first."""
    result = metrics.where("is_overstock").select(
        "product_id",
        "product_category",
        exact.round_half_up(F.col("sku_demand"), 1).alias("product_avg_demand"),
        exact.round_half_up(F.col("avg_demand"), 1).alias("category_avg_demand"),
        exact.half_up_mean(F.col("cost"), F.col("num_costs"), 2).alias("avg_unit_cost"),
        exact.round_half_up(F.col("capital_tied_up"), 2).alias("capital_tied_up_estimate"),
        rules.risk_flag(F.col("is_overstock")).alias("risk_flag"),
    )
    return ranking.descending(result, "capital_tied_up_estimate")


def capital_by_category(metrics: DataFrame) -> DataFrame:
    """Capital in flagged products per category, most first."""
    flagged = metrics.where("is_overstock").groupBy("product_category")
    return flagged.agg(exact.total(F.col("capital_tied_up")).alias("total_capital_tied_up")).orderBy(
        F.desc("total_capital_tied_up"), "product_category"
    )
