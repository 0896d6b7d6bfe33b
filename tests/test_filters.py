from __future__ import annotations

import pytest

from shelfwise import Params
from shelfwise.operators import filters


def kept(joined, **choices):
    return filters.apply(joined, Params(**choices))


@pytest.mark.parametrize(
    "categories, count",
    [(None, 8), (("Laptops",), 4), (("Laptops", "SmartPhones"), 8), ((), 0), (("Televisions",), 0), (("laptops",), 0)],
)
def test_categories(joined, categories, count):
    assert kept(joined, categories=categories).count() == count


@pytest.mark.parametrize("promo, count", [("all", 8), ("yes", 3), ("no", 5)])
def test_promotion(joined, promo, count):
    assert kept(joined, promo=promo).count() == count


def test_promotion_sides_are_disjoint_and_complete(joined):
    yes = {r.sales_id for r in kept(joined, promo="yes").collect()}
    no = {r.sales_id for r in kept(joined, promo="no").collect()}
    assert not yes & no and len(yes | no) == 8


def test_promotion_ignores_case_and_drops_unknown(spark):
    df = spark.createDataFrame([("YES",), ("yes",), ("No",), (None,), ("maybe",)], "promotions string")
    assert df.where(filters.has_promotion("yes")).count() == 2
    assert df.where(filters.has_promotion("no")).count() == 1


@pytest.mark.parametrize(
    "sku, count",
    [("101", 2), ("", 8), ("   ", 8), ("abc", 8), ("99999", 0), ("  102  ", 2), ("1" * 30, 0), ("10.5", 8)],
)
def test_sku_text(joined, sku, count):
    assert kept(joined, sku=sku).count() == count


def test_sku_warning():
    assert Params(sku="abc").sku_warning == "Product ID must be numeric."
    assert Params(sku=" 7 ").sku_warning is None and Params().sku_warning is None


def test_combined(joined):
    assert kept(joined, categories=("Laptops",), promo="yes").count() == 2
    assert kept(joined, categories=("SmartPhones",), promo="yes", sku="103").count() == 1


@pytest.mark.parametrize(
    "wrong",
    [{"promo": "maybe"}, {"overstock_ratio": 0.1}, {"overstock_ratio": 0.9}, {"lead_time_days": 0}, {"lead_time_days": 31}, {"service_level": "97%"}],
)
def test_params_reject(wrong):
    with pytest.raises(ValueError):
        Params(**wrong)


@pytest.mark.parametrize("level, z", [("90%", 1.28), ("95%", 1.65), ("99%", 2.33)])
def test_service_levels(level, z):
    assert Params(service_level=level).z == z


def test_complete_rows(spark):
    df = spark.createDataFrame(
        [(1, "a", "2022-01-01", 1), (None, "a", "2022-01-01", 1), (1, None, "2022-01-01", 1), (1, "a", None, 1), (1, "a", "2022-01-01", None)],
        "product_id int, product_category string, sales_date string, inventory_quantity int",
    )
    assert filters.complete_rows(df).count() == 1
