"""Raw text files to base tables."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest

from shelfwise import schemas
from shelfwise.operators import joins
from shelfwise.plans import analysis, load
from shelfwise.sources import csv

PRODUCTS = """Product_ID,Product_Category,Promotions\r
7,Laptops,No\r
007,Laptops, yes \r
8,SmartPhones,NO\r
9,,No\r
10,"Quoted",YES\r
"""
SALES = """Product_ID,Sales_Date,Inventory_Quantity,Product_Cost
7,31/10/2019,5,10.255
8,03/04/2020,7,20.00
8,1/2/2020,,3
"""
FACTORS = """Sales_Date,GDP,Inflation_Rate,Seasonal_Factor
31/10/2019,100.00,1.10,1.00
31/10/2019,100.01,1.15,0.95
03/04/2020,50,,1.2
"""


def write(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


@pytest.fixture
def staged(spark, tmp_path):
    def read(products=PRODUCTS, sales=SALES, factors=FACTORS):
        return (
            csv.read_staging(spark, write(tmp_path, "p.csv", products), schemas.STAGING_PRODUCTS),
            csv.read_staging(spark, write(tmp_path, "s.csv", sales), schemas.STAGING_SALES),
            csv.read_staging(spark, write(tmp_path, "f.csv", factors), schemas.STAGING_FACTORS),
        )

    return read


def test_products_dedupe_and_yes_wins(staged, rows):
    products, _, _ = staged()
    assert rows(load.load_products(products)) == [
        (10, '"Quoted"', "Yes"),
        (7, "Laptops", "Yes"),
        (8, "SmartPhones", "No"),
        (9, None, "No"),
    ]


def test_sales_are_typed(staged, rows):
    _, sales, _ = staged()
    assert rows(load.load_sales(sales)) == [
        (7, date(2019, 10, 31), 5, Decimal("10.26")),
        (8, date(2020, 2, 1), None, Decimal("3.00")),
        (8, date(2020, 4, 3), 7, Decimal("20.00")),
    ]


def test_factors_average_and_round_twice(staged, rows):
    _, _, factors = staged()
    assert rows(load.load_factors(factors)) == [
        (date(2019, 10, 31), Decimal("100.01"), Decimal("1.13"), Decimal("0.98")),
        (date(2020, 4, 3), Decimal("50.00"), None, Decimal("1.20")),
    ]


def test_schemas(staged):
    star = load.load_star(*staged())
    for df, schema in zip((star.products, star.sales, star.factors), schemas.TABLES.values()):
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schema]


@pytest.mark.parametrize(
    "bad, column",
    [
        ("7,2019-10-31,5,1", "sales.sales_date"),
        ("7,31/02/2019,5,1", "sales.sales_date"),
        ("7,31/10/2019,many,1", "sales.inventory_quantity"),
        ("7,31/10/2019,5.0,1", "sales.inventory_quantity"),
        ("7,31/10/2019,5,cheap", "sales.product_cost"),
        ("x,31/10/2019,5,1", "sales.product_id"),
        (",31/10/2019,5,1", "sales.product_id"),
        ("7,,5,1", "sales.sales_date"),
    ],
)
def test_bad_sales(staged, bad, column):
    _, sales, _ = staged(sales=SALES + bad + "\n")
    with pytest.raises(Exception, match=column):
        load.load_sales(sales).collect()


def test_coerce_keeps_what_can_be_read(staged, rows):
    text = SALES + "7,2019-10-31,5,1\n8,1/1/2020,many,cheap\nx,1/1/2020,1,1\n"
    _, sales, _ = staged(sales=text)
    assert (8, date(2020, 1, 1), None, None) in rows(load.load_sales(sales, load.COERCE))
    assert load.load_sales(sales, load.COERCE).count() == 4
    assert rows(load.rejects(sales, "sales")) == [
        ("inventory_quantity", "many"),
        ("product_cost", "cheap"),
        ("product_id", "x"),
        ("sales_date", "2019-10-31"),
    ]


def test_sale_without_product(staged):
    frames = staged(sales=SALES + "99,1/1/2020,1,1\n")
    with pytest.raises(load.LoadError, match="99"):
        load.load_star(*frames)
    star = load.load_star(*frames, mode=load.COERCE)
    assert star.sales.count() == 3
    assert sorted(r.sales_id for r in star.sales.collect()) == [1, 2, 3]


def test_orphans(staged, rows):
    products, sales, _ = staged(sales=SALES + "99,1/1/2020,1,1\n99,2/1/2020,1,1\n")
    found = joins.orphans(load.load_sales(sales), load.load_products(products))
    assert rows(found) == [(99, 2)]


def test_summary_keeps_sales_without_factors(staged, rows):
    star = load.load_star(*staged())
    summary = analysis.inventory_summary(star)
    assert summary.columns == list(schemas.EXTRACT_COLUMNS)
    assert rows(summary, "sales_id", "product_id", "sales_date", "gdp") == [
        (1, 7, date(2019, 10, 31), Decimal("100.01")),
        (2, 8, date(2020, 2, 1), None),
        (3, 8, date(2020, 4, 3), Decimal("50.00")),
    ]
    dated = analysis.sales_by_date(star)
    assert analysis.coverage_gap(dated).first()[0] == 1
    assert rows(analysis.uncovered_dates(dated)) == [(date(2020, 2, 1), 1)]


def test_gap_counts_dates_with_an_empty_gdp(staged):
    star = load.load_star(*staged(factors=FACTORS + "1/2/2020,,2.0,1.0\n"))
    dated = analysis.sales_by_date(star)
    assert analysis.coverage_gap(dated).first()[0] == 1
    assert analysis.uncovered_dates(dated).count() == 0


def test_staging_counts_and_preview(staged, rows):
    frames = staged()
    assert rows(load.staging_counts(*frames)) == [("external_factors", 3), ("product_information", 5), ("sales_data", 3)]
    assert [r.product_id for r in load.preview(load.load_products(frames[0]), "product_id", 2).collect()] == [7, 8]


def test_save_is_repeatable(spark, staged, tmp_path):
    star = load.load_star(*staged())
    for _ in range(2):
        load.save_star(star, str(tmp_path / "tables"))
    again = load.open_star(spark, str(tmp_path / "tables"))
    assert again.sales.count() == 3 and again.products.count() == 4 and again.factors.count() == 2


def test_views(spark, staged):
    products, sales, _ = staged()
    load.publish({"staging_products": products, "staging_sales": sales})
    load.publish({"staging_products": products})
    assert spark.sql("SELECT count(*) FROM staging_products").first()[0] == 5
    load.drop_views(spark, ["staging_products", "staging_sales"])
    assert not spark.catalog.tableExists("staging_products")


def test_star_answers_sql(spark, staged, rows):
    load.publish_star(load.load_star(*staged()))
    joined = spark.sql(
        "SELECT p.product_category, SUM(s.inventory_quantity) AS units FROM sales_data s "
        "JOIN product_information p ON s.product_id = p.product_id GROUP BY p.product_category"
    )
    assert rows(joined) == [("Laptops", 5), ("SmartPhones", 7)]
    assert spark.sql("SELECT COUNT(*) FROM inventory_summary WHERE gdp IS NULL").first()[0] == 1
    load.drop_views(spark, [*schemas.TABLES, "inventory_summary"])


def test_line_with_a_missing_field(spark, tmp_path):
    path = write(tmp_path, "s.csv", SALES + "7,1/1/2020\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        csv.read_staging(spark, path, schemas.STAGING_SALES).collect()
    found = csv.read_staging_with_bad_lines(spark, path, schemas.STAGING_SALES).cache()
    assert [r.bad_line for r in found.where("bad_line IS NOT NULL").collect()] == ["7,1/1/2020"]
    assert found.count() == 4
