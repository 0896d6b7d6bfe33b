from __future__ import annotations

import statistics
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from shelfwise.functions import exact
from shelfwise.operators import rollups


def one_group(spark, quantities, kind="int"):
    rows = [(1, q, None, None) for q in quantities]
    return spark.createDataFrame(rows, f"product_id int, inventory_quantity {kind}, product_cost decimal(10,2), sales_date date")


def stdev(spark, quantities, kind="int"):
    rolled = rollups.rollup(one_group(spark, quantities, kind), "product_id")
    return rolled.select(rollups.stdev_units(rolled)).first()[0]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-(2**31), 2**31 - 1), min_size=2, max_size=8))
def test_stdev_of_whole_numbers(spark, quantities):
    assert stdev(spark, quantities) == pytest.approx(statistics.stdev(quantities), rel=1e-12, abs=1e-9)


def test_stdev_of_large_values_with_small_spread(spark):
    assert stdev(spark, [2_000_000_000, 2_000_000_001, 2_000_000_002]) == 1.0


def test_stdev_needs_two_rows(spark):
    assert stdev(spark, [5]) is None
    assert stdev(spark, [5, None]) is None
    assert stdev(spark, [None]) is None


def test_stdev_of_equal_rows(spark):
    assert stdev(spark, [7, 7, 7]) == 0.0


def test_stdev_of_fractions(spark):
    values = [0.25, 1.5, 3.125]
    assert stdev(spark, values, "double") == pytest.approx(statistics.stdev(values), rel=1e-12)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-(10**12), 10**12), min_size=1, max_size=7), st.sampled_from([2, 6]))
def test_half_up_mean(spark, cents, places):
    total = Decimal(sum(cents)) / 100
    df = spark.createDataFrame([(total, len(cents))], "total decimal(20,2), n bigint")
    found = df.select(exact.half_up_mean(F.col("total"), F.col("n"), places)).first()[0]
    mean = Fraction(sum(cents), 100 * len(cents))
    unit = Fraction(1, 10**places)
    size = (abs(mean) / unit + Fraction(1, 2)).__floor__() * unit
    assert Fraction(found) == (size if mean >= 0 else -size)


def test_half_up_mean_rounds_once(spark):
    # 0.0049999997 would turn into 0.005 and then 0.01 if it were first cut to six places.
    df = spark.createDataFrame([(Decimal("49999.99"), 10_000_000)], "total decimal(20,2), n bigint")
    assert df.select(exact.half_up_mean(F.col("total"), F.col("n"), 2)).first()[0] == Decimal("0.00")


def test_half_up_mean_of_the_largest_stored_value(spark):
    df = spark.createDataFrame([(Decimal("9999999999999999.99"), 1)], "total decimal(20,2), n bigint")
    assert df.select(exact.half_up_mean(F.col("total"), F.col("n"), 2)).first()[0] == Decimal("9999999999999999.99")


def test_means_over_no_rows_are_null(spark):
    df = spark.createDataFrame([(None, 0)], "total bigint, n bigint")
    total, n = F.col("total"), F.col("n")
    found = df.select(exact.mean(total, n), exact.integer_mean(total, n), exact.half_up_mean(total, n, 2)).first()
    assert tuple(found) == (None, None, None)


@pytest.mark.parametrize("total, n, mean", [(7, 2, 3), (-7, 2, -3), (6, 3, 2)])
def test_integer_mean_cuts_towards_zero(spark, total, n, mean):
    df = spark.createDataFrame([(total, n)], "total bigint, n bigint")
    assert df.select(exact.integer_mean(F.col("total"), F.col("n"))).first()[0] == mean


@pytest.mark.parametrize("value", [1.005, 2.675, 4320.924999999999, -1.005, 0.125, 828.949999])
def test_round_half_up(spark, value):
    found = spark.range(1).select(exact.round_half_up(F.lit(value), 2)).first()[0]
    tidy = Decimal(repr(value)).quantize(Decimal("0.00000001"), ROUND_HALF_UP)
    assert found == float(tidy.quantize(Decimal("0.01"), ROUND_HALF_UP))


def test_merging_rollups_equals_rolling_up_once(spark):
    rows = [(p, q, Decimal(q) / 4, None) for p in range(7) for q in range(p + 3)]
    df = spark.createDataFrame(rows, "product_id int, inventory_quantity int, product_cost decimal(10,2), sales_date date")
    direct = rollups.rollup(df.withColumn("g", F.col("product_id") % 2), "g")
    merged = rollups.merge(rollups.rollup(df, "product_id").withColumn("g", F.col("product_id") % 2), "g")
    columns = ["g", "num_rows", "num_quantities", "units", "units_squared", "num_costs", "cost"]
    assert sorted(direct.select(columns).collect()) == sorted(merged.select(columns).collect())
    assert merged.select(rollups.stdev_units(merged)).count() == 2
