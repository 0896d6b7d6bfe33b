"""Business rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Labels of the season bands and of the risk flag.
SEASON_LABELS = ("Low season", "Normal", "High season")
SEASON_CHART_LABELS = ("Low Season", "Normal", "High Season")
OVERSTOCK_LABEL = "Overstock risk — low velocity"
NORMAL_LABEL = "Normal"


def is_yes(promotions: Column) -> Column:
    """Whether a raw promotion text says yes; case and blanks around it do not matter."""
    return F.coalesce(F.lower(F.trim(promotions)) == "yes", F.lit(False))


def yes_wins(any_yes: Column) -> Column:
    return F.when(any_yes, "Yes").otherwise("No")


def season_band(factor: Column, labels: tuple[str, str, str] = SEASON_LABELS) -> Column:
    """Below 0.95, up to 1.05, and the rest, to which a missing factor belongs as well."""
    low, normal, high = labels
    border = "decimal(5,2)"
    return (
        F.when(factor < F.lit("0.95").cast(border), low)
        .when(factor <= F.lit("1.05").cast(border), normal)
        .otherwise(high)
    )


def lead_time_demand(demand: Column, lead_time_days: int) -> Column:
    return demand * F.lit(lead_time_days)


def safety_stock(stdev: Column, z: float, lead_time_days: int) -> Column:
    """Buffer for demand spread over the lead time; an unknown spread counts as none."""
    return F.lit(float(z)) * F.coalesce(stdev, F.lit(0.0)) * F.sqrt(F.lit(float(lead_time_days)))


def is_overstock(demand: Column, category_demand: Column, ratio: float) -> Column:
    """Demand strictly below the given share of the category mean."""
    return demand < category_demand * F.lit(float(ratio))


def risk_flag(overstock: Column) -> Column:
    return F.when(overstock, OVERSTOCK_LABEL).otherwise(NORMAL_LABEL)


def short_label(product_id: Column, category: Column) -> Column:
    """``ID 9402 (Smar)``."""
    return F.concat(F.lit("ID "), product_id.cast("string"), F.lit(" ("), F.substring(category, 1, 4), F.lit(")"))


def long_label(product_id: Column, category: Column) -> Column:
    """``9402 (SmartPhones)``."""
    return F.concat(product_id.cast("string"), F.lit(" ("), category, F.lit(")"))
