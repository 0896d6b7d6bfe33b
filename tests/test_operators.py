"""Row numbers, joins, ranking, cleaning, and files."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfwise import Star, workspace
from shelfwise.functions import casts, display
from shelfwise.operators import joins, ranking
from shelfwise.operators.keys import dense_key
from shelfwise.plans import charts, dashboard, load, quality, skus
from shelfwise.sources import jdbc, sinks


@pytest.mark.parametrize("order_by", [None, ["k", "v"]])
def test_dense_key_has_no_gaps(spark, order_by):
    df = spark.range(1000, numPartitions=7).selectExpr("id % 3 AS k", "id % 5 AS v").where("v <> 1")
    ids = [r.n for r in dense_key(df, "n", order_by).collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))


def test_dense_key_follows_the_order(spark):
    df = spark.range(500, numPartitions=6).selectExpr("(id * 37) % 101 AS k")
    numbered = dense_key(df, "n", ["k"]).orderBy("n").collect()
    assert [r.k for r in numbered] == sorted(r.k for r in numbered)


def test_dense_key_splits_equal_rows(spark):
    df = spark.range(4000, numPartitions=4).select(F.lit(1).alias("k"))
    numbered = dense_key(df, "n", ["k"])
    assert numbered.agg(F.count_distinct("n"), F.min("n"), F.max("n")).first()[:] == (4000, 1, 4000)


def test_dense_key_of_nothing(spark):
    assert dense_key(spark.range(0).toDF("k"), "n", ["k"]).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_broadcast_join(spark, rows, how):
    big = spark.range(300).selectExpr("id AS product_id", "if(id < 200, 'hot', concat('c', id % 5)) AS c")
    small = spark.createDataFrame([("hot", 1), ("c1", 2), ("c2", 3)], "c string, v int")
    near = joins.join_small(big, small, "c", how, split_by=["product_id"])
    far = joins.join_small(big, small, "c", how, split_by=["product_id"], limit_bytes=0)
    assert rows(near, "product_id", "c", "v") == rows(far, "product_id", "c", "v")
    assert "BroadcastExchange" in near._jdf.queryExecution().optimizedPlan().toString() or "broadcast" in str(
        near._jdf.queryExecution().optimizedPlan()
    )
    assert "salt" in str(far._jdf.queryExecution().optimizedPlan())


def test_measured_bytes_grow_with_rows(spark):
    small = spark.createDataFrame([("a" * 100, 1)], "c string, v int")
    assert joins.measured_bytes(small) > 100
    assert joins.measured_bytes(small.union(small)) == 2 * joins.measured_bytes(small)
    assert joins.measured_bytes(small.limit(0)) == 0


def test_ties_go_to_the_smaller_product(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 1.0), (9, 2.0)], "product_id int, v double")
    assert [r.product_id for r in ranking.top(df, 3, "v").collect()] == [9, 1, 2]


def test_materialised_tables_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workspace, "shared_folder", lambda spark: str(tmp_path / "mine"))
    assert workspace.materialise(spark.range(5), "numbers").count() == 5
    assert list(tmp_path.rglob("*.parquet"))
    assert workspace.clear_workspace(spark)
    assert not list(tmp_path.rglob("*.parquet"))


def test_shared_folder_is_the_session_setting(spark):
    folder = spark.conf.get(workspace.CHECKPOINT_KEY, None)
    if folder:
        assert workspace.shared_folder(spark).startswith(folder.rstrip("/"))
    assert spark.sparkContext.applicationId in workspace.shared_folder(spark)
    assert workspace.new_path(spark, "a") != workspace.new_path(spark, "a")


def test_clean_extract_coerces(spark, joined, rows):
    text = joined.select(*(F.col(c).cast("string").alias(c) for c in joined.columns))
    dirty = text.withColumns(
        {
            "product_category": F.concat(F.lit(" \t"), "product_category", F.lit("\r")),
            "inventory_quantity": F.when(F.col("sales_id") == "1", "lots").otherwise(F.col("inventory_quantity")),
            "sales_date": F.when(F.col("sales_id") == "2", "yesterday").otherwise(F.col("sales_date")),
            "product_cost": F.when(F.col("sales_id") == "3", "free").otherwise(F.col("product_cost")),
            "promotions": F.when(F.col("sales_id") != "4", F.concat(F.lit(" "), "promotions")),
        }
    )
    clean = dashboard.clean_extract(dirty)
    found = {r.sales_id: r for r in clean.collect()}
    assert sorted(found) == ["3", "4", "5", "6", "7", "8"]
    assert found["3"].product_cost is None and found["4"].promotions is None
    assert {r.product_category for r in found.values()} == {"Laptops", "SmartPhones"}
    assert found["5"].promotions == "Yes" and found["5"].sales_date == date(2022, 2, 14)


def test_clean_extract_names_missing_columns(joined):
    with pytest.raises(ValueError, match="product_category, sales_date"):
        dashboard.clean_extract(joined.drop("sales_date", "product_category"))


def test_numbers_that_are_not_finite_are_missing(spark):
    df = spark.createDataFrame([("1.5",), ("NaN",), ("Infinity",), ("x",), (None,)], "v string")
    found = df.select(casts.to_number(F.col("v"), df.schema["v"].dataType)).collect()
    assert [r[0] for r in found] == [1.5, None, None, None, None]


@pytest.mark.parametrize(
    "form, value, text",
    [
        (display.money, 1234.5, "$1,234.50"),
        (display.money, 0.125, "$0.12"),
        (display.one_place, 1234.25, "1234.2"),
        (display.three_places, 2.0, "2.000"),
        (display.whole, 1234567.0, "1,234,567"),
    ],
)
def test_display(spark, form, value, text):
    assert spark.range(1).select(form(F.lit(value))).first()[0] == text


def test_month_label(spark):
    assert spark.range(1).select(display.month(F.lit(date(2022, 1, 31)))).first()[0] == "Jan 2022"


# --- files and extracts ----------------------------------------------------------------------------


def test_action_list_file(spark, joined, tmp_path):
    totals = skus.write_totals(dashboard.totals_from_extract(joined))
    listed = dashboard.action_list(dashboard.sku_metrics(totals))
    path = sinks.export_csv(listed, str(tmp_path / sinks.ACTION_LIST_NAME), one_file=True)
    files = list((tmp_path / sinks.ACTION_LIST_NAME).glob("part-*.csv"))
    lines = files[0].read_text(encoding="utf-8").splitlines()
    assert len(files) == 1 and len(lines) == 6
    assert lines[0].startswith("Product ID,Category,Promoted,Avg Daily Demand")
    assert lines[1].startswith("101,Laptops,Yes,6.0,42.0") and lines[1].endswith(",4800.0,True")
    assert spark.read.csv(path, header=True).count() == 5


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_reports_replace_earlier_ones(spark, tmp_path, fmt):
    for n in (3, 5):
        paths = sinks.write_reports({"numbers": spark.range(n)}, str(tmp_path), fmt)
    assert spark.read.format(fmt).option("header", True).load(paths["numbers"]).count() == 5


def test_cached_extract(spark):
    now = [0.0]
    built = []

    def build():
        built.append(now[0])
        return spark.range(len(built))

    extract = dashboard.CachedExtract(build, ttl_seconds=300, clock=lambda: now[0])
    assert extract.get().count() == 1
    now[0] = 299.0
    assert extract.get().count() == 1
    now[0] = 300.0
    assert extract.get().count() == 2
    extract.refresh()
    assert extract.get().count() == 3 and built == [0.0, 300.0, 300.0]


def test_database_slices():
    options = jdbc.slice_options("jdbc:x", "SELECT * FROM v;", key="sales_id", low=1, high=1500, slices=8, driver="d")
    assert options["dbtable"] == "(SELECT * FROM v) AS source"
    assert (options["partitionColumn"], options["lowerBound"], options["upperBound"]) == ("sales_id", "1", "1500")
    assert options["numPartitions"] == "8" and options["driver"] == "d"
    assert jdbc.slice_options("u", "sales_data", key="k", low=0, high=1, slices=1)["dbtable"] == "sales_data"
    with pytest.raises(ValueError):
        jdbc.slice_options("u", "t", key="k", low=0, high=1, slices=0)


# --- checks ----------------------------------------------------------------------------------------


@pytest.fixture
def star(spark):
    products = spark.createDataFrame([(1, "a", "Yes"), (2, None, "No")], "product_id bigint, product_category string, promotions string")
    sales = spark.createDataFrame(
        [(1, 1, date(2022, 1, 1), 5, Decimal(3)), (2, 2, date(2022, 1, 1), 6, Decimal(4)), (3, 2, date(2022, 2, 1), 7, None)],
        "sales_id bigint, product_id bigint, sales_date date, inventory_quantity int, product_cost decimal(10,2)",
    )
    factors = spark.createDataFrame(
        [(date(2022, 1, 1), Decimal(1), Decimal(1), Decimal(1))],
        "sales_date date, gdp decimal(18,2), inflation_rate decimal(5,2), seasonal_factor decimal(5,2)",
    )
    return Star(products, sales, factors)


def figures(df):
    return {r["check"]: (r.expected, r.actual, r.ok) for r in df.collect()}


def test_checks_of_sound_tables(star):
    counts = {"product_information": 2, "sales_data": 3, "external_factors": 1}
    found = figures(quality.all_checks(star, counts, exact_count=True))
    assert found.pop("inventory_summary: missing product_category") == (0, 2, False)
    assert all(ok for _, _, ok in found.values()) and found["sales_data: rows"] == (3, 3, True)
    assert not figures(quality.all_checks(star))["sales_data: least rows"][2]


def test_checks_find_faults(star):
    bad = Star(
        star.products.union(star.products).withColumn("product_category", F.lit("x" * 51)),
        star.sales.union(star.sales.selectExpr("sales_id", "product_id + 8", "CAST(NULL AS DATE)", "inventory_quantity", "product_cost"))
        .union(star.sales.selectExpr("9L", "CAST(NULL AS BIGINT)", "sales_date", "inventory_quantity", "product_cost").limit(1)),
        star.factors.union(star.factors).union(star.factors.withColumn("sales_date", F.lit(None).cast("date"))),
    )
    found = {name: actual for name, (_, actual, _) in figures(quality.all_checks(bad)).items()}
    assert found["product_information: repeated product_id"] == 2
    assert found["product_information: product_category over 50"] == 4
    assert found["sales_data: repeated sales_id"] == 3
    assert found["sales_data: missing product_id"] == 1
    assert found["sales_data: missing sales_date"] == 3
    assert found["sales_data: unknown product_id"] == 3
    assert found["sales_data: least rows"] == 7
    assert found["external_factors: repeated sales_date"] == 1
    assert found["external_factors: missing sales_date"] == 1


def test_column_checks(star):
    found = figures(
        quality.column_checks(
            {"sales": star.sales, "products": star.products},
            {"sales": ("product_id", "sales_date"), "products": ("product_id", "price", "colour")},
        )
    )
    assert found == {"sales: missing columns": (0, 0, True), "products: missing columns": (0, 2, False)}


def test_duplicate_reports(spark, rows):
    products = spark.createDataFrame([(1, "a", "Yes"), (1, "a", "no"), (2, "b", "YES"), (2, "b", "yes")], "product_id int, product_category string, promotions string")
    assert rows(quality.conflicting_promotions(products)) == [(1, 2, 1)]
    dates = spark.createDataFrame([("x",), ("x",), ("y",)], "sales_date string")
    assert rows(quality.repeated_dates(dates)) == [("x", 2)]
    assert quality.has_rows(products) and not quality.has_rows(products.limit(0))


def test_chart_data_has_nine_sets(star):
    data = charts.chart_data(star)
    assert len(data) == 9
    assert {r.product_id for r in data["understocking_risk"].collect()} == {1}
    assert data["seasonal_demand_bands"].count() == 1


def test_load_mode_is_repeatable(star):
    numbered = load.number_sales(star.sales.drop("sales_id"))
    assert sorted(r.sales_id for r in numbered.collect()) == [1, 2, 3]
