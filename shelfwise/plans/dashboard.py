"""Dashboard figures over a cleaned and filtered extract.

Two ways lead in. From base tables (``clean_star``) sales are added up by product, month or date before
they are joined, which suits large data. From rows joined elsewhere (``clean_extract``) they are grouped
as they are. Filters read product columns only, so they apply to the rollups and one written copy of the
SKU totals answers any choice of parameters.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from shelfwise import schemas
from shelfwise.functions import casts, display, exact, rules
from shelfwise.operators import filters, joins, ranking, rollups
from shelfwise.operators.rollups import SKU_KEYS
from shelfwise.params import LEAD_TIMES, OVERSTOCK_RATIOS, SERVICE_LEVELS, Params
from shelfwise.plans import skus
from shelfwise.star import Star

NUMBER_COLUMNS = ("inventory_quantity", "product_cost", *schemas.MACRO_COLUMNS)
TEXT_COLUMNS = ("product_category", "promotions")

# Column headings of the register and of the action list.
REGISTER_COLUMNS = {
    "product_id": "Product ID",
    "product_category": "Category",
    "promotions": "Promoted",
    "sku_demand": "Avg Daily Demand",
    "sku_cost": "Unit Cost ($)",
    "capital_tied_up": "Capital Tied Up ($)",
}
ACTION_COLUMNS = {
    "product_id": "Product ID",
    "product_category": "Category",
    "promotions": "Promoted",
    "sku_demand": "Avg Daily Demand",
    "lead_time_demand": "Lead Time Demand",
    "safety_stock": "Safety Stock Buffer",
    "reorder_point": "Calculated Reorder Point",
    "capital_tied_up": "Capital Tied Up ($)",
    "is_overstock": "Overstock Risk Flag",
}

# Labels of the headline cards, each with the note under it.
KPI_CARDS = {
    "Capital at Risk": "Demand < {share}% of baseline",
    "Flagged Overstock SKUs": "Low-velocity target",
    "Inventory Quantity Analyzed": "Filtered dataset",
    "Target Service Level": "Lead time: {days} days",
}


# --- cleaning --------------------------------------------------------------------------------------


def _cleaned(df: DataFrame) -> DataFrame:
    """Coerce dates and numbers, trim texts, and keep rows whose key columns are present."""
    types = {field.name: field.dataType for field in df.schema.fields}
    clean: dict[str, Column] = {}
    for name, dtype in types.items():
        if name == "sales_date":
            clean[name] = casts.to_day(F.col(name), dtype)
        elif name in NUMBER_COLUMNS:
            clean[name] = casts.to_number(F.col(name), dtype)
        elif name in TEXT_COLUMNS:
            clean[name] = casts.clean_text(F.col(name))
    return filters.complete_rows(df.withColumns(clean))


def clean_extract(joined: DataFrame) -> DataFrame:
    """The joined rows, cleaned. Raises when a required column is absent."""
    missing = schemas.missing_columns(joined.columns)
    if missing:
        raise ValueError(f"required columns are missing: {', '.join(missing)}")
    return _cleaned(joined)


def clean_star(star: Star) -> Star:
    """The base tables under the same rules, so that joining them gives the cleaned extract."""
    return Star(_cleaned(star.products), _cleaned(star.sales), star.factors)


class CachedExtract:
    """A persisted frame that is rebuilt when older than ``ttl_seconds`` or on ``refresh``."""

    def __init__(
        self,
        build: Callable[[], DataFrame],
        ttl_seconds: float = 300,
        clock: Callable[[], float] = time.monotonic,
    ) -> None:
        self._build, self._ttl, self._clock = build, ttl_seconds, clock
        self._frame: DataFrame | None = None
        self._built_at = 0.0

    def get(self) -> DataFrame:
        if self._frame is None or self._clock() - self._built_at >= self._ttl:
            self.refresh()
        return self._frame

    def refresh(self) -> None:
        if self._frame is not None:
            self._frame.unpersist()
        self._frame = self._build().persist()
        self._built_at = self._clock()


# --- rollups of the filtered rows ------------------------------------------------------------------


def totals_from_star(star: Star, params: Params = Params()) -> DataFrame:
    return filters.apply(skus.sku_totals(star), params)


def totals_from_extract(extract: DataFrame, params: Params = Params()) -> DataFrame:
    """Totals of rows joined elsewhere.

    The keys are grouped as one struct. Over a join still to be run, grouping by the bare product id would keep the join's
    partitions, and with them a hot product in one task; the struct has an exchange of its own, before which
    every task adds up its rows, so that Spark may split a hot product in the join.
    """
    totals = rollups.rollup(filters.apply(extract, params), F.struct(*SKU_KEYS).alias("sku"))
    return totals.select("sku.*", *(c for c in totals.columns if c != "sku"))


# --- statistics ------------------------------------------------------------------------------------


def categories(totals: DataFrame) -> DataFrame:
    """Categories to choose from, sorted."""
    return totals.select("product_category").dropna().distinct().orderBy("product_category")


def category_stats(totals: DataFrame) -> DataFrame:
    """Category statistics; the deviation of a single row counts as zero."""
    return skus.category_stats(totals).fillna(0.0, subset=["category_stdev"])


def volatility(totals: DataFrame) -> DataFrame:
    stats = category_stats(totals).select("product_category", "category_stdev")
    return stats.orderBy(F.desc("category_stdev"), "product_category")


def sku_metrics(totals: DataFrame, params: Params = Params()) -> DataFrame:
    """SKU figures; a product without any cost counts as costing nothing. ``totals`` should be written."""
    metrics = skus.sku_metrics(totals, params, how="left")
    no_cost = {"category_stdev": 0.0, "sku_cost": 0.0, "capital_tied_up": 0.0}
    return metrics.fillna(no_cost).drop("cost", "num_costs")


def overstock(metrics: DataFrame) -> DataFrame:
    """Flagged SKUs, most capital first."""
    return ranking.descending(metrics.where("is_overstock"), "capital_tied_up")


def kpis(metrics: DataFrame, params: Params = Params()) -> DataFrame:
    """One row of headline figures."""
    flagged = F.col("is_overstock")
    return metrics.agg(
        F.coalesce(exact.total(F.when(flagged, F.col("capital_tied_up"))), F.lit(0.0)).alias("capital_at_risk"),
        F.count_if(flagged).alias("flagged_skus"),
        F.coalesce(F.sum("sku_units"), F.lit(0)).cast("double").alias("units_analyzed"),
    ).select(
        "*",
        F.lit(params.service_level).alias("service_level"),
        F.lit(params.lead_time_days).alias("lead_time_days"),
    )


def kpi_steps(metrics: DataFrame, ratios: Iterable[float] = OVERSTOCK_RATIOS) -> DataFrame:
    """Capital, flagged SKUs and units of each category at each overstock ratio, all from one pass over the SKUs.

    A category's baseline does not depend on which other categories are chosen, so these rows answer any choice of
    categories. Other filters move the baseline and need SKUs of their own.
    """
    demand, baseline = F.col("sku_demand"), F.col("avg_demand")

    def step(ratio: float) -> Column:
        flagged = rules.is_overstock(demand, baseline, ratio)
        capital = F.sum(F.when(flagged, F.col("capital_tied_up").cast(exact.MICROS)))
        return F.struct(F.lit(ratio).alias("overstock_ratio"), capital.alias("capital"), F.count_if(flagged).alias("flagged_skus"))

    steps = F.array(*(step(ratio) for ratio in ratios)).alias("steps")
    per_category = metrics.groupBy("product_category").agg(steps, F.sum("sku_units").alias("units"))
    return per_category.select("product_category", "units", F.inline("steps"))


def kpi_grid(
    steps: DataFrame,
    categories: Iterable[str] | None = None,
    ratios: Iterable[float] = OVERSTOCK_RATIOS,
    lead_times: Iterable[int] = LEAD_TIMES,
    service_levels: Iterable[str] = SERVICE_LEVELS,
) -> DataFrame:
    """The row of ``kpis`` for every stop of the three sliders, with its overstock_ratio; the same rows as one plan per choice would give."""
    kept = steps if categories is None else steps.where(F.col("product_category").isin(list(categories)))

    def total(ratio: float) -> Column:
        here = F.col("overstock_ratio") == F.lit(ratio)
        return F.struct(
            F.lit(ratio).alias("overstock_ratio"),
            F.coalesce(F.sum(F.when(here, F.col("capital"))).cast("double"), F.lit(0.0)).alias("capital_at_risk"),
            F.coalesce(F.sum(F.when(here, F.col("flagged_skus"))), F.lit(0)).alias("flagged_skus"),
            F.coalesce(F.sum(F.when(here, F.col("units"))), F.lit(0)).cast("double").alias("units_analyzed"),
        )

    rows = kept.agg(F.array(*(total(ratio) for ratio in ratios)).alias("rows")).select(F.inline("rows"))
    rows = rows.withColumn("service_level", F.explode(F.array(*map(F.lit, service_levels))))
    return rows.withColumn("lead_time_days", F.explode(F.array(*map(F.lit, lead_times))))


def data_summary(all_totals: DataFrame, params: Params = Params()) -> DataFrame:
    """Records and products of all rows, and the date span of the filtered ones."""
    kept = filters.keeps(params)
    return all_totals.agg(
        F.coalesce(F.sum("num_rows"), F.lit(0)).alias("records"),
        F.count_distinct("product_id").alias("skus"),
        F.min(F.when(kept, F.col("first_date"))).alias("first_date"),
        F.max(F.when(kept, F.col("last_date"))).alias("last_date"),
    )


def data_summary_estimate(sketched: DataFrame, params: Params = Params()) -> DataFrame:
    """The same from sketched rollups by category and promotion status (``rollups.sketched``); the products are an estimate."""
    kept = filters.keeps(params)
    return sketched.agg(
        F.coalesce(F.sum("num_rows"), F.lit(0)).alias("records"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(rollups.SKETCH)), F.lit(0)).alias("skus"),
        F.min(F.when(kept, F.col("first_date"))).alias("first_date"),
        F.max(F.when(kept, F.col("last_date"))).alias("last_date"),
    )


def capital_by_category(metrics: DataFrame) -> DataFrame:
    """Capital in flagged SKUs per category, also in thousands, most first."""
    flagged = metrics.where("is_overstock").groupBy("product_category")
    sums = flagged.agg(exact.total(F.col("capital_tied_up")).alias("capital_tied_up"))
    return sums.withColumn("capital_k", F.col("capital_tied_up") / 1000).orderBy(
        F.desc("capital_tied_up"), "product_category"
    )


def top_reorder(metrics: DataFrame, k: int = 10) -> DataFrame:
    """The k highest reorder targets with a label and the demand behind them."""
    ranked = ranking.top(metrics.select(*SKU_KEYS, "sku_demand", "reorder_point"), k, "reorder_point")
    label = rules.short_label(F.col("product_id"), F.col("product_category"))
    return ranked.select(*SKU_KEYS, label.alias("product_label"), "sku_demand", "reorder_point")


# --- time and macro factors ------------------------------------------------------------------------


def trend_from_star(star: Star, params: Params = Params()) -> DataFrame:
    """Units per category and month, named by the month's last day; only months with sales appear.

    Most products have few sales a month, so sales are joined row by row: they move once, to the written products.
    """
    star = star.with_written_products()
    return trend_from_extract(joins.with_products(star.sales, star.products), params)


def trend_from_extract(extract: DataFrame, params: Params = Params()) -> DataFrame:
    rows = filters.apply(extract, params)
    month_end = F.last_day("sales_date").alias("month_end")
    rolled = rollups.rollup(rows, "product_category", month_end)
    result = rolled.select("product_category", F.col("month_end").alias("sales_date"), rollups.units(rolled).alias("inventory_quantity"))
    return result.orderBy("product_category", "sales_date")


def _macro(rows: DataFrame, weight: Column, columns: Iterable[str]) -> DataFrame:
    """Mean, minimum and maximum per macro column that has any value; ``weight`` sales share each row."""

    def figures(name: str) -> Column:
        value = F.col(name)
        known = F.sum(F.when(value.isNotNull(), weight))
        return F.struct(
            F.lit(name).alias("metric"),
            exact.mean(F.sum(value * weight), known).alias("Average"),
            F.min(value).cast("double").alias("Minimum"),
            F.max(value).cast("double").alias("Maximum"),
        )

    one_row = rows.agg(F.array(*(figures(name) for name in columns)).alias("figures"))
    metrics = one_row.select(F.inline("figures"))
    return metrics.where(F.col("Average").isNotNull())


def macro_from_star(star: Star, params: Params = Params()) -> DataFrame:
    """Macro figures over the filtered sales, counted per date. Sales are joined row by row, as for the trend."""
    star = star.with_written_products()
    kept = filters.apply(joins.with_products(star.sales, star.products), params)
    per_date = kept.groupBy("sales_date").agg(F.count("*").alias("num_rows"))
    dated = per_date.join(star.factors, "sales_date", "left")
    return _macro(dated, F.col("num_rows"), schemas.MACRO_COLUMNS)


def macro_from_extract(extract: DataFrame, params: Params = Params()) -> DataFrame:
    columns = [name for name in schemas.MACRO_COLUMNS if name in extract.columns]
    return _macro(filters.apply(extract, params), F.lit(1), columns)


# --- tables for people -----------------------------------------------------------------------------


def _renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(old).alias(new) for old, new in names.items()))


def overstock_table(metrics: DataFrame) -> DataFrame:
    """The register under its headings."""
    return _renamed(overstock(metrics), REGISTER_COLUMNS)


def overstock_table_text(metrics: DataFrame) -> DataFrame:
    formats = {
        "Avg Daily Demand": display.one_place,
        "Unit Cost ($)": display.money,
        "Capital Tied Up ($)": display.money,
    }
    return display.as_text(overstock_table(metrics), formats)


def action_list(metrics: DataFrame) -> DataFrame:
    """All SKUs under their headings: flagged ones first, then most capital."""
    ranked = ranking.descending(metrics, "is_overstock", "capital_tied_up")
    return _renamed(ranked, ACTION_COLUMNS)


def action_list_text(metrics: DataFrame) -> DataFrame:
    one_place = dict.fromkeys(
        ["Avg Daily Demand", "Lead Time Demand", "Safety Stock Buffer", "Calculated Reorder Point"],
        display.one_place,
    )
    return display.as_text(action_list(metrics), {**one_place, "Capital Tied Up ($)": display.money})


def kpi_cards(figures: DataFrame, params: Params = Params()) -> DataFrame:
    """The headline figures as four cards (label, value, note)."""
    values = [
        display.money(F.col("capital_at_risk")),
        F.concat(display.whole(F.col("flagged_skus")), F.lit(" SKUs")),
        F.concat(display.whole(F.col("units_analyzed")), F.lit(" Units")),
        F.col("service_level"),
    ]
    share, days = int(params.overstock_ratio * 100), params.lead_time_days
    notes = [note.format(share=share, days=days) for note in KPI_CARDS.values()]
    cards = F.array(
        *(
            F.struct(F.lit(label).alias("label"), value.alias("value"), F.lit(note).alias("note"))
            for label, note, value in zip(KPI_CARDS, notes, values)
        )
    )
    return figures.select(F.inline(cards))


def summary_text(summary: DataFrame) -> DataFrame:
    """The data summary as two captions."""
    records, products = display.whole(F.col("records")), display.whole(F.col("skus"))
    first, last = display.month(F.col("first_date")), display.month(F.col("last_date"))
    # fixed values: the texts of the two captions
    return summary.select(
        F.format_string("Loaded %s records across %s SKUs.", records, products).alias("loaded"),
        F.format_string("Filtered period: %s – %s", first, last).alias("period"),
    )


def macro_text(macro: DataFrame) -> DataFrame:
    return display.as_text(macro, dict.fromkeys(["Average", "Minimum", "Maximum"], display.three_places))
