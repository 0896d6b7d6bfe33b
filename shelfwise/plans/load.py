"""Text staging rows to typed base tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from shelfwise import schemas
from shelfwise.functions import casts, exact, rules
from shelfwise.operators import joins, rollups
from shelfwise.operators.keys import dense_key
from shelfwise.plans import analysis
from shelfwise.sources import csv
from shelfwise.star import Star
from shelfwise.workspace import materialise

STRICT = "strict"
COERCE = "coerce"

STAGING = {"products": schemas.STAGING_PRODUCTS, "sales": schemas.STAGING_SALES, "factors": schemas.STAGING_FACTORS}
KEY_COLUMNS = {"products": ["product_id"], "sales": ["product_id", "sales_date"], "factors": ["sales_date"]}
# Fixed value: so many lines that cannot be read are set aside by default.
TOLERATED_LINES = 10

SALES_ORDER = ["product_id", "sales_date", "inventory_quantity", "product_cost"]


class LoadError(ValueError):
    """A table breaks one of its keys."""


def _parsers(kind: str) -> dict[str, Column]:
    """How each text column of a staging table is read; null where it cannot be."""
    product_id = {"product_id": casts.coerce_long(F.col("product_id"))}
    sales_date = {"sales_date": casts.coerce_date(F.col("sales_date"))}
    if kind == "products":
        return product_id
    if kind == "sales":
        return {
            **product_id,
            **sales_date,
            "inventory_quantity": casts.coerce_int(F.col("inventory_quantity")),
            "product_cost": casts.coerce_decimal(F.col("product_cost"), 10, 2),
        }
    return {
        **sales_date,
        "gdp": casts.coerce_decimal(F.col("gdp"), 18, 2),
        "inflation_rate": casts.coerce_decimal(F.col("inflation_rate"), 5, 2),
        "seasonal_factor": casts.coerce_decimal(F.col("seasonal_factor"), 5, 2),
    }


def _typed(staging: DataFrame, kind: str, mode: str, not_null: list[str]) -> DataFrame:
    """Typed staging rows. Strict stops at a bad or missing key; coerce leaves such rows to ``rejects``."""
    parsed = _parsers(kind)
    if mode == COERCE:
        return staging.withColumns(parsed).dropna(subset=not_null)
    checked = {name: casts.strict(F.col(name), value, f"{kind}.{name}") for name, value in parsed.items()}
    for name in not_null:
        missing = F.raise_error(F.lit(f"{kind}.{name}: value is missing"))
        checked[name] = F.coalesce(checked[name], missing.cast(_type_of(kind, name)))
    return staging.withColumns(checked)


def _type_of(kind: str, name: str) -> str:
    table = {"products": schemas.PRODUCTS, "sales": schemas.SALES, "factors": schemas.FACTORS}[kind]
    return table[name].dataType.simpleString()


def rejects(staging: DataFrame, kind: str) -> DataFrame:
    """One row per text value that cannot be read (column_name, raw_value)."""

    def entry(name: str) -> Column:
        return F.struct(F.lit(name).alias("column_name"), F.col(name).alias("raw_value"))

    bad = [
        F.when(F.col(name).isNotNull() & value.isNull(), entry(name)) for name, value in _parsers(kind).items()
    ]
    found = F.explode(F.array_compact(F.array(*bad))).alias("bad")
    return staging.select(found).select("bad.column_name", "bad.raw_value")


def _fault(kind: str) -> Column:
    """Why a staged row cannot be loaded: its number of fields, or the columns that are missing or cannot be read; null if it can."""
    values = _parsers(kind)
    bad = [
        F.when(value.isNull() if name in KEY_COLUMNS[kind] else F.col(name).isNotNull() & value.isNull(), F.lit(name))
        for name, value in values.items()
    ]
    names = F.nullif(F.concat_ws(", ", *bad), F.lit(""))
    return F.when(F.col(csv.BAD_LINE).isNotNull(), F.lit("fields")).otherwise(names)


def load_tolerant(spark: SparkSession, paths: Mapping[str, str], tolerated: int = TOLERATED_LINES) -> tuple[Star, DataFrame]:
    """The star from the files in ``paths`` (products, sales, factors), and the lines set aside.

    A line that cannot be read is set aside with its file and row number (tbl, file, row_number, fault, line). With more than ``tolerated`` of them in all
    three files together the load stops, before any table is made; the message names the first. What is left is loaded strictly, without row numbers on
    the sales, ready for ``storage.rebuild`` or ``storage.append``.
    """
    staged, aside = {}, []
    for kind, schema in STAGING.items():
        placed = csv.read_staging_with_places(spark, paths[kind], schema).withColumn("fault", _fault(kind))
        bad = placed.where(F.col("fault").isNotNull()).select(*csv.PLACE, "fault", csv.raw_line(schema).alias("line"))
        numbered = csv.with_row_numbers(materialise(bad, "bad-lines"), placed)
        aside.append(numbered.select(F.lit(kind).alias("tbl"), "file", "row_number", "fault", "line"))
        staged[kind] = placed.where(F.col("fault").isNull()).select(schema.names)
    lines = materialise(reduce(DataFrame.unionByName, aside), "lines-aside")
    found = lines.count()
    if found > tolerated:
        first = lines.orderBy("tbl", "file", "row_number").first()
        raise LoadError(f"{found} lines cannot be read, {tolerated} are tolerated; the first is row {first['row_number']} of {first['file']}: {first['line']}")
    return load_star(staged["products"], staged["sales"], staged["factors"], numbered=False), lines


def load_products(staging: DataFrame, mode: str = STRICT) -> DataFrame:
    """One row per product id: greatest category text, and promoted when any of its rows says so."""
    return dedupe_products(_typed(staging, "products", mode, ["product_id"]))


def dedupe_products(rows: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """One row per product id. ``measured`` has the same ids, where they are cheap to read; see ``rollups.dealt``."""
    rows = rows if measured is None else rollups.dealt(rows, "product_id", measured)
    return rows.groupBy("product_id").agg(
        F.max("product_category").alias("product_category"),
        rules.yes_wins(F.bool_or(rules.is_yes(F.col("promotions")))).alias("promotions"),
    )


def load_sales(staging: DataFrame, mode: str = STRICT) -> DataFrame:
    """Typed sales rows, without row numbers."""
    return _typed(staging, "sales", mode, ["product_id", "sales_date"]).select(*SALES_ORDER)


def number_sales(sales: DataFrame, order_by: list[str] | None = SALES_ORDER, first: int = 1) -> DataFrame:
    """Sales with ``sales_id`` from ``first`` on: the same on each load by default, or in scan order for ``order_by=None``."""
    return dense_key(sales, "sales_id", order_by, first)


def typed_sales(staging: DataFrame, mode: str = STRICT) -> DataFrame:
    """The same as a written table: texts are read and parsed once, whatever is asked of the rows afterwards."""
    return materialise(load_sales(staging, mode), "typed-sales")


def sales_of_product(sales: DataFrame, product_id: int) -> DataFrame:
    """One product's sales with the row numbers that ``number_sales`` gives them.

    Numbers follow the product first, so that those of one product start behind a count of the sales of lesser ids; nothing but its own
    rows is sorted.
    """
    before = sales.where((F.col("product_id") < product_id) | F.col("product_id").isNull()).count()
    return number_sales(sales.where(F.col("product_id") == product_id), first=before + 1)


def load_factors(staging: DataFrame, mode: str = STRICT) -> DataFrame:
    """One row per date: the mean of each measure, rounded to two places."""
    return average_by_date(_typed(staging, "factors", mode, ["sales_date"]))


def average_by_date(rows: DataFrame) -> DataFrame:
    def stored_mean(name: str) -> Column:
        mean = exact.half_up_mean(F.sum(name), F.count(name), 2)
        return mean.cast(schemas.FACTORS[name].dataType).alias(name)

    return rows.groupBy("sales_date").agg(*(stored_mean(name) for name in schemas.MACRO_COLUMNS))


def staging_counts(products: DataFrame, sales: DataFrame, factors: DataFrame) -> DataFrame:
    """Rows per table (tbl, row_count)."""
    tables = {"product_information": products, "sales_data": sales, "external_factors": factors}
    counts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("tbl"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def preview(table: DataFrame, key: str, rows: int = 5) -> DataFrame:
    """The first rows by key."""
    return table.orderBy(key).limit(rows)


def preview_sales(sales: DataFrame, rows: int = 5) -> DataFrame:
    """The sales that would be numbered first, with those numbers; the table is not sorted for it."""
    first = sales.orderBy(*SALES_ORDER).limit(rows)
    return first.select(F.row_number().over(Window.orderBy(*SALES_ORDER)).cast("bigint").alias("sales_id"), *sales.columns)


def load_star(
    products: DataFrame,
    sales: DataFrame,
    factors: DataFrame,
    mode: str = STRICT,
    order_by: list[str] | None = SALES_ORDER,
    numbered: bool = True,
) -> Star:
    """Load the three staging frames. A sale without a product stops a strict load; coerce leaves it out. Sales that go into a store get
    their row numbers there, so that they are not ``numbered`` here."""
    star = Star(load_products(products, mode), typed_sales(sales, mode), load_factors(factors, mode))
    star = star.with_written_dimensions()
    if mode == COERCE:
        listed = star.sales.join(star.products.select("product_id"), "product_id", "left_semi")
        return replace(star, sales=number_sales(listed, order_by) if numbered else listed)
    unknown = joins.orphans(star.sales, star.products).orderBy("product_id").first()
    if unknown:
        raise LoadError(f"sales of product {unknown['product_id']}, which is not listed")
    return replace(star, sales=number_sales(star.sales, order_by)) if numbered else star


def save_star(star: Star, folder: str) -> None:
    """Write the three base tables, in place of earlier ones."""
    for name, df in zip(schemas.TABLES, (star.products, star.sales, star.factors)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def open_star(spark: SparkSession, folder: str) -> Star:
    """Read the base tables that ``save_star`` wrote."""
    products, sales, factors = (
        spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in schemas.TABLES.items()
    )
    return Star(products, sales, factors, written=True)


def publish(frames: Mapping[str, DataFrame]) -> None:
    """Register frames as temporary views, replacing earlier ones of the same name."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def publish_star(star: Star) -> None:
    """Register the base tables and the joined view ``inventory_summary`` for SQL.

    Nothing runs here, and the view holds no choice of join: Spark makes it at each use, for the sizes of that time.
    """
    publish(dict(zip(schemas.TABLES, (star.products, star.sales, star.factors))))
    publish({"inventory_summary": analysis.inventory_summary(star, measured=False)})


def drop_views(spark: SparkSession, names: list[str]) -> None:
    """Remove temporary views, such as staging after a good load."""
    for name in names:
        spark.catalog.dropTempView(name)
