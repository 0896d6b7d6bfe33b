"""The nine chart data sets, made together from shared totals."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfwise.plans import analysis, skus
from shelfwise.star import Star
from shelfwise.workspace import materialise


def chart_data(star: Star) -> dict[str, DataFrame]:
    """Chart name to data. Totals per SKU, written once, feed six of the nine; totals per date feed two."""
    star = star.with_written_dimensions()
    totals = skus.write_totals(skus.sku_totals(star))
    metrics = skus.sku_metrics(totals)
    dated = materialise(analysis.sales_by_date(star), "sales-by-date")
    return {
        "category_volatility": analysis.category_volatility(totals),
        "overstock_capital": analysis.capital_by_category(metrics),
        "demand_trend": demand_trend(star),
        "top10_reorder": analysis.top_reorder_chart(metrics),
        "promotion_impact": analysis.promotion_impact(totals),
        "seasonal_demand_bands": analysis.season_chart(dated),
        "understocking_risk": analysis.stockout_risk(metrics),
        "turnover_by_category": analysis.turnover_by_category(totals),
        "inflation_demand": analysis.inflation_by_month(dated),
    }


def demand_trend(star: Star) -> DataFrame:
    """Units per category and month."""
    return analysis.monthly_trend(star).select("product_category", "month_start", "total_units_moved")
