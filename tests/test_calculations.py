"""The eight-row extract through the real functions."""

from __future__ import annotations

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from shelfwise import Params
from shelfwise.functions import rules
from shelfwise.operators import rollups
from shelfwise.plans import analysis, dashboard, skus

LAPTOP_STDEV = 26.936654085712526
PHONE_STDEV = 10.719919153924002


@pytest.fixture(scope="module")
def totals(joined):
    return skus.write_totals(dashboard.totals_from_extract(dashboard.clean_extract(joined)))


@pytest.fixture(scope="module")
def metrics(totals):
    return dashboard.sku_metrics(totals).cache()


def by_sku(metrics):
    return {(r.product_id, r.promotions): r for r in metrics.collect()}


def test_category_stats(totals):
    found = {r.product_category: r for r in dashboard.category_stats(totals).collect()}
    assert found["Laptops"].avg_demand == 29.25
    assert found["Laptops"].total_units == 117.0
    assert found["Laptops"].category_stdev == pytest.approx(LAPTOP_STDEV, abs=1e-12)
    assert found["SmartPhones"].avg_demand == 11.75
    assert found["SmartPhones"].total_units == 47.0
    assert found["SmartPhones"].category_stdev == pytest.approx(PHONE_STDEV, abs=1e-12)


def test_sku_metrics(metrics):
    expected = {
        (101, "Yes"): (6.0, 800.0, 4800.0, True, 42.0, 117.591684973896),
        (102, "No"): (52.5, 600.0, 31500.0, False, 367.5, 117.591684973896),
        (103, "No"): (22.0, 400.0, 8800.0, False, 154.0, 46.797696257401),
        (103, "Yes"): (20.0, 400.0, 8000.0, False, 140.0, 46.797696257401),
        (104, "No"): (2.5, 350.0, 875.0, True, 17.5, 46.797696257401),
    }
    found = by_sku(metrics)
    assert found.keys() == expected.keys()
    for key, (demand, cost, capital, flagged, lead, safety) in expected.items():
        r = found[key]
        assert (r.sku_demand, r.sku_cost, r.capital_tied_up, r.is_overstock, r.lead_time_demand) == (
            demand, cost, capital, flagged, lead,
        )
        assert r.safety_stock == pytest.approx(safety, abs=1e-9)
        assert r.reorder_point == pytest.approx(lead + safety, abs=1e-9)


def test_kpis(metrics):
    params = Params()
    row = dashboard.kpis(metrics, params).first()
    assert tuple(row) == (5675.0, 2, 164.0, "95%", 7)
    cards = [tuple(r) for r in dashboard.kpi_cards(dashboard.kpis(metrics, params), params).collect()]
    assert cards == [
        ("Capital at Risk", "$5,675.00", "Demand < 50% of baseline"),
        ("Flagged Overstock SKUs", "2 SKUs", "Low-velocity target"),
        ("Inventory Quantity Analyzed", "164 Units", "Filtered dataset"),
        ("Target Service Level", "95%", "Lead time: 7 days"),
    ]


def test_kpis_of_nothing(joined):
    none = Params(categories=())
    totals = skus.write_totals(dashboard.totals_from_extract(joined, none))
    assert tuple(dashboard.kpis(dashboard.sku_metrics(totals, none), none).first())[:3] == (0.0, 0, 0.0)


def test_register_and_action_list(metrics):
    register = dashboard.overstock_table_text(metrics)
    assert [tuple(r) for r in register.collect()] == [
        (101, "Laptops", "Yes", "6.0", "$800.00", "$4,800.00"),
        (104, "SmartPhones", "No", "2.5", "$350.00", "$875.00"),
    ]
    assert register.columns == list(dashboard.REGISTER_COLUMNS.values())
    listed = dashboard.action_list(metrics)
    assert listed.columns == list(dashboard.ACTION_COLUMNS.values())
    assert [r["Product ID"] for r in listed.collect()] == [101, 104, 102, 103, 103]
    assert [r["Overstock Risk Flag"] for r in listed.collect()] == [True, True, False, False, False]


def test_capital_by_category(metrics):
    found = [tuple(r) for r in dashboard.capital_by_category(metrics).collect()]
    assert found == [("Laptops", 4800.0, 4.8), ("SmartPhones", 875.0, 0.875)]


def test_top_targets(metrics):
    top = dashboard.top_reorder(metrics, 2).collect()
    assert [(r.product_id, r.promotions, r.product_label) for r in top] == [
        (102, "No", "ID 102 (Lapt)"),
        (103, "No", "ID 103 (Smar)"),
    ]


def test_volatility_order(totals):
    assert [r.product_category for r in dashboard.volatility(totals).collect()] == ["Laptops", "SmartPhones"]


def test_promotion_impact(totals):
    found = {r.promotions: (r.avg_units_per_sale, r.num_records) for r in analysis.promotion_impact(totals).collect()}
    assert found["Yes"] == (pytest.approx(32 / 3), 3)
    assert found["No"] == (pytest.approx(26.4), 5)


def test_turnover_counts_distinct_products(totals):
    found = {r.product_category: tuple(r)[1:] for r in analysis.turnover_by_category(totals).collect()}
    assert found["Laptops"][0] == 58.5 and float(found["Laptops"][1]) == 700.0
    assert found["SmartPhones"][0] == 23.5 and float(found["SmartPhones"][1]) == 375.0


def test_season_bands(joined):
    dated = rollups.rollup(joined, "sales_date", "seasonal_factor").withColumn("has_factors", F.lit(True))
    dated = dated.withColumn("seasonal_factor", F.col("seasonal_factor").cast("decimal(5,2)"))
    found = [tuple(r) for r in analysis.season_chart(dated).collect()]
    assert [r[0] for r in found] == ["Low Season", "Normal", "High Season"]
    assert found[0][1:] == (2.0, 1)
    assert found[1][1:] == (pytest.approx(77 / 3), 3)
    assert found[2][1:] == (21.25, 4)


@pytest.mark.parametrize(
    "factor, band",
    [("0.94", "Low season"), ("0.95", "Normal"), ("1.05", "Normal"), ("1.06", "High season"), (None, "High season")],
)
def test_season_borders(spark, factor, band):
    df = spark.range(1).select(F.lit(factor).cast("decimal(5,2)").alias("f"))
    assert df.select(rules.season_band(F.col("f"))).first()[0] == band


def test_monthly_trend_has_no_gap_rows(joined):
    found = [tuple(r) for r in dashboard.trend_from_extract(joined).collect()]
    assert found == [
        ("Laptops", date(2022, 1, 31), 55.0),
        ("Laptops", date(2022, 2, 28), 7.0),
        ("Laptops", date(2022, 3, 31), 55.0),
        ("SmartPhones", date(2022, 1, 31), 2.0),
        ("SmartPhones", date(2022, 2, 28), 20.0),
        ("SmartPhones", date(2022, 4, 30), 22.0),
        ("SmartPhones", date(2022, 5, 31), 3.0),
    ]


def test_macro_snapshot_leaves_out_empty_columns(joined):
    without = joined.withColumn("gdp", F.lit(None).cast("double"))
    found = [tuple(r) for r in dashboard.macro_text(dashboard.macro_from_extract(without)).collect()]
    assert found == [("inflation_rate", "5.250", "5.100", "5.400"), ("seasonal_factor", "1.050", "0.900", "1.200")]


def test_data_summary(totals):
    summary = dashboard.data_summary(totals, Params(categories=("SmartPhones",)))
    assert tuple(summary.first()) == (8, 4, date(2022, 1, 22), date(2022, 5, 10))
    assert tuple(dashboard.summary_text(summary).first()) == (
        "Loaded 8 records across 4 SKUs.",
        "Filtered period: Jan 2022 – May 2022",
    )


def test_baselines_move_with_filters(joined):
    one = Params(sku="101")
    totals = skus.write_totals(dashboard.totals_from_extract(joined, one))
    row = dashboard.sku_metrics(totals, one).first()
    assert row.avg_demand == row.sku_demand == 6.0
    assert not row.is_overstock


def test_single_row_category_has_no_spread(joined):
    totals = skus.write_totals(dashboard.totals_from_extract(joined.where("sales_id = 7")))
    assert dashboard.category_stats(totals).first().category_stdev == 0.0
    row = dashboard.sku_metrics(totals).first()
    assert row.safety_stock == 0.0 and row.reorder_point == 14.0


def test_missing_cost_counts_as_none(joined):
    costless = joined.withColumn("product_cost", F.when(F.col("product_id") != 101, F.col("product_cost")))
    totals = skus.write_totals(dashboard.totals_from_extract(costless))
    row = by_sku(dashboard.sku_metrics(totals))[(101, "Yes")]
    assert row.sku_cost == 0.0 and row.capital_tied_up == 0.0 and row.is_overstock


def test_missing_promotion_stays_a_group(joined):
    unknown = joined.withColumn("promotions", F.when(F.col("product_id") != 104, F.col("promotions")))
    totals = skus.write_totals(dashboard.totals_from_extract(unknown))
    assert by_sku(dashboard.sku_metrics(totals))[(104, None)].sku_demand == 2.5


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(5.0, 10.0), (4.999, 10.0)], "demand double, mean double")
    assert [r[0] for r in df.select(rules.is_overstock(F.col("demand"), F.col("mean"), 0.5)).collect()] == [False, True]


def flagged(totals, ratio):
    return dashboard.sku_metrics(totals, Params(overstock_ratio=ratio)).where("is_overstock").count()


def test_more_is_flagged_at_a_higher_ratio(totals):
    counts = [flagged(totals, ratio) for ratio in (0.2, 0.5, 0.8)]
    assert counts == sorted(counts)


@pytest.mark.parametrize("short, long", [(7, 14), (3, 30)])
def test_reorder_point_grows_with_lead_time(totals, short, long):
    a = by_sku(dashboard.sku_metrics(totals, Params(lead_time_days=short)))
    b = by_sku(dashboard.sku_metrics(totals, Params(lead_time_days=long)))
    assert all(b[k].reorder_point >= a[k].reorder_point >= 0 for k in a)


def test_safety_stock_grows_with_service_level(totals):
    levels = [by_sku(dashboard.sku_metrics(totals, Params(service_level=s))) for s in ("90%", "95%", "99%")]
    for key in levels[0]:
        stocks = [level[key].safety_stock for level in levels]
        assert stocks == sorted(stocks) and stocks[0] < stocks[2]


@pytest.mark.parametrize("z, days, stdev", [(1.65, 7, 10.0), (1.28, 14, 5.0), (2.33, 3, 20.0)])
def test_safety_stock_formula(spark, z, days, stdev):
    found = spark.range(1).select(rules.safety_stock(F.lit(stdev), z, days)).first()[0]
    assert found == pytest.approx(z * stdev * math.sqrt(days), abs=1e-9)
