"""Every query by name, over a folder of TPC-H style tables.

Results are made comparable across engines: decimals become doubles, and figures that rest on a square
root or on a sum of doubles are rounded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from shelfwise import schemas
from shelfwise.functions import exact
from shelfwise.operators import filters, rollups
from shelfwise.operators.keys import dense_key
from shelfwise.operators.rollups import SKU_KEYS
from shelfwise.params import Params
from shelfwise.plans import analysis, charts, dashboard, load, quality, skus, snapshot, storage
from shelfwise.sources import csv, sinks, tpch
from shelfwise.sources.versions import VersionedFolder
from shelfwise.star import Star
from shelfwise.workspace import materialise, new_path

Query = Callable[[SparkSession, str], DataFrame]

FILTERED = Params(categories=("ECONOMY", "PROMO"), promo="yes", overstock_ratio=0.65, lead_time_days=14, service_level="99%")
NOT_PROMOTED = Params(promo="no", overstock_ratio=0.35, lead_time_days=3, service_level="90%")
# The product search is a filter by one id; the extract it searches covers all sales.
ONE_SKU = Params(sku="  23000007 ")


def comparable(df: DataFrame, rounding: dict[str, int] | None = None) -> DataFrame:
    rounding = rounding or {}

    def column(field: T.StructField):
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            value = value.cast("double")
        if field.name in rounding:
            value = exact.round_half_up(value, rounding[field.name])
        return value.alias(field.name)

    return df.select(*(column(field) for field in df.schema.fields))


# --- inputs ----------------------------------------------------------------------------------------


def _numbered(star: Star) -> Star:
    """The star with row numbers on the sales and written dimensions, for row-level results."""
    return replace(star.with_written_dimensions(), sales=load.number_sales(star.sales))


def _totals(spark: SparkSession, folder: str) -> DataFrame:
    return skus.sku_totals(tpch.star(spark, folder))


def _with_quantity(spark: SparkSession, folder: str, quantity: str) -> Star:
    """The star with other quantities, which need not be whole or small."""
    star = tpch.star(spark, folder)
    return replace(star, sales=star.sales.withColumn("inventory_quantity", F.expr(quantity)))


def _totals_of(spark: SparkSession, folder: str, quantity: str) -> DataFrame:
    return skus.sku_totals(_with_quantity(spark, folder, quantity))


def _dates_of(spark: SparkSession, folder: str, quantity: str) -> DataFrame:
    return analysis.sales_by_date(_with_quantity(spark, folder, quantity))


EIGHTHS = "cast(inventory_quantity as double) / 8"
LARGE = "cast(inventory_quantity as bigint) * 100000000"


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    return skus.sku_metrics(skus.write_totals(_totals(spark, folder)))


def _clean(spark: SparkSession, folder: str) -> Star:
    return dashboard.clean_star(tpch.star(spark, folder))


def _board_totals(spark: SparkSession, folder: str, params: Params = Params()) -> DataFrame:
    return dashboard.totals_from_star(_clean(spark, folder), params)


def _board_metrics(spark: SparkSession, folder: str, params: Params = Params()) -> DataFrame:
    return dashboard.sku_metrics(skus.write_totals(_board_totals(spark, folder, params)), params)


def _text_staging(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    raw = (tpch.raw_products, tpch.raw_sales, tpch.raw_factors)
    return tuple(tpch.as_text(read(spark, folder)) for read in raw)


def _extract(spark: SparkSession, folder: str) -> DataFrame:
    return dashboard.clean_extract(analysis.inventory_summary(_numbered(tpch.star(spark, folder))))


def _extract_without_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """The extract for figures, which need no row numbers."""
    return dashboard.clean_extract(analysis.inventory_summary(tpch.star(spark, folder).with_written_dimensions()))


def _one_product(spark: SparkSession, folder: str) -> DataFrame:
    """The extract of the product that was searched for: the filter comes first, and only its sales are numbered."""
    star = tpch.star(spark, folder)
    sales = load.sales_of_product(star.sales, ONE_SKU.sku_id)
    star = replace(star, products=filters.apply(star.products, ONE_SKU), sales=sales).with_written_dimensions()
    return filters.apply(dashboard.clean_extract(analysis.inventory_summary(star)), ONE_SKU)


# --- queries with steps of their own ---------------------------------------------------------------


def _load_products(spark: SparkSession, folder: str) -> DataFrame:
    return load.load_products(tpch.as_text(tpch.raw_products(spark, folder)))


def _load_sales(spark: SparkSession, folder: str) -> DataFrame:
    return load.number_sales(load.typed_sales(tpch.as_text(tpch.raw_sales(spark, folder))))


def _load_factors(spark: SparkSession, folder: str) -> DataFrame:
    return load.load_factors(tpch.as_text(tpch.raw_factors(spark, folder)))


def _scan_order_ids(spark: SparkSession, folder: str) -> DataFrame:
    numbered = load.number_sales(tpch.raw_sales(spark, folder), order_by=None)
    return numbered.agg(
        F.count("*").alias("sales"),
        F.min("sales_id").alias("first_id"),
        F.max("sales_id").alias("last_id"),
        F.count_distinct("sales_id").alias("distinct_ids"),
    )


def _csv_load(spark: SparkSession, folder: str) -> DataFrame:
    """Raw files written as text, read back, loaded, saved, opened and counted."""
    home = new_path(spark, "csv")
    names = ("products", "sales", "factors")
    layouts = (schemas.STAGING_PRODUCTS, schemas.STAGING_SALES, schemas.STAGING_FACTORS)
    for name, df in zip(names, _text_staging(spark, folder)):
        df.write.csv(f"{home}/{name}", header=True)
    staged = [csv.read_staging(spark, f"{home}/{name}", schema) for name, schema in zip(names, layouts)]
    load.save_star(load.load_star(*staged), f"{home}/tables")
    star = load.open_star(spark, f"{home}/tables")
    counts = load.staging_counts(star.products, star.sales, star.factors)
    units = star.sales.agg(F.sum("inventory_quantity").alias("units"), F.sum("product_cost").alias("cost"))
    both = counts.unionByName(units.withColumn("tbl", F.lit("sales_data")), allowMissingColumns=True)
    return both.groupBy("tbl").agg(*(F.max(c).alias(c) for c in both.columns if c != "tbl"))


def _quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.all_checks(tpch.star(spark, folder).with_written_dimensions())


def _rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Sales whose dates are read as prices and prices as dates: each value is rejected."""
    raw = tpch.as_text(tpch.raw_sales(spark, folder))
    swapped = raw.select(
        "product_id",
        F.col("product_cost").alias("sales_date"),
        "inventory_quantity",
        F.col("sales_date").alias("product_cost"),
    )
    return load.rejects(swapped, "sales").groupBy("column_name").agg(
        F.count("*").alias("num_rejects"), F.count_distinct("raw_value").alias("num_values")
    )


def _view_by_sql(spark: SparkSession, folder: str) -> DataFrame:
    """The published view, asked in SQL."""
    load.publish_star(tpch.star(spark, folder))
    return spark.sql(
        "SELECT product_category, promotions, COUNT(*) AS num_sales, SUM(inventory_quantity) AS units, COUNT(gdp) AS with_gdp "
        "FROM inventory_summary GROUP BY product_category, promotions"
    )


def _dirty_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Joined rows as untidy text: blanks around names, missing keys, words among the numbers, impossible dates, and no gdp
    at all. Faults follow from the product id."""
    joined = analysis.inventory_summary(tpch.star(spark, folder).with_written_dimensions())

    def fault(divisor: int, rest: int, value: str | None, name: str) -> Column:
        return F.when(F.col("product_id") % divisor == rest, F.lit(value)).otherwise(F.col(name).cast("string"))

    padded = F.when(F.col("product_id") % 5 == 0, F.concat(F.lit("\t "), "product_category", F.lit(" \n"))).otherwise(F.col("product_category"))
    return joined.withColumn("product_category", padded).withColumns(
        {
            "product_category": fault(7, 1, None, "product_category"),
            "promotions": fault(3, 0, None, "promotions"),
            "sales_date": fault(13, 3, "2021-02-30", "sales_date"),
            "inventory_quantity": fault(11, 2, "many", "inventory_quantity"),
            "product_cost": fault(17, 4, "free", "product_cost"),
            "gdp": F.lit("unknown"),
            "inflation_rate": F.col("inflation_rate").cast("string"),
        }
    )


def _cleaned_dirty(spark: SparkSession, folder: str) -> DataFrame:
    return dashboard.clean_extract(_dirty_extract(spark, folder))


def _dirty_totals(spark: SparkSession, folder: str) -> DataFrame:
    totals = dashboard.totals_from_extract(_cleaned_dirty(spark, folder))
    return totals.select(*SKU_KEYS, "num_rows", rollups.units(totals).alias("units"), "num_costs")


def _extract_totals(spark: SparkSession, folder: str, params: Params = Params()) -> DataFrame:
    return dashboard.totals_from_extract(_extract_without_numbers(spark, folder), params)


def _extract_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return dashboard.sku_metrics(skus.write_totals(_extract_totals(spark, folder)))


def _dirty_checks(spark: SparkSession, folder: str) -> DataFrame:
    """The table checks over tables in which each kind of fault occurs; the sales have a poor key as well."""
    star = tpch.star(spark, folder).with_written_dimensions()
    last = F.col("product_id") % 10
    products = star.products.withColumns(
        {
            "product_category": F.when(last != 5, F.col("product_category")),
            "promotions": F.when(last == 6, "promoted twice").otherwise(F.col("promotions")),
        }
    )
    sales = star.sales.withColumns(
        {
            "sales_id": F.when(F.col("product_id") % 4 != 0, F.col("product_id")),
            "product_id": F.when(last == 2, -F.col("product_id")).when(last != 1, F.col("product_id")),
            "sales_date": F.when(last != 3, F.col("sales_date")),
        }
    )
    factors = star.factors.withColumn("sales_date", F.when(F.month("sales_date") != 3, F.col("sales_date")))
    return quality.all_checks(
        Star(products.unionByName(products.where(last == 4)), sales, factors.unionByName(factors.where(F.month("sales_date") == 2)))
    )


def _action_places(spark: SparkSession, folder: str) -> DataFrame:
    """The place of each product in the action list, as the rows come."""
    placed = dense_key(dashboard.action_list(_board_metrics(spark, folder)), "place")
    return placed.select("place", "Product ID", "Overstock Risk Flag")


def _trend_places(spark: SparkSession, folder: str) -> DataFrame:
    return dense_key(analysis.monthly_trend(tpch.star(spark, folder)), "place").select("place", "product_category", "month_start")


def _conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return quality.conflicting_promotions(tpch.raw_products(spark, folder))


def _kpis(spark: SparkSession, folder: str, params: Params = Params()) -> DataFrame:
    return dashboard.kpis(_board_metrics(spark, folder, params), params)


def _summary(spark: SparkSession, folder: str) -> DataFrame:
    return dashboard.data_summary(_board_totals(spark, folder), FILTERED)


def _exported(spark: SparkSession, folder: str) -> DataFrame:
    listed = dashboard.action_list(_board_metrics(spark, folder))
    path = sinks.export_csv(listed, new_path(spark, sinks.ACTION_LIST_NAME))
    layout = sinks.with_text_flags(listed).schema
    return spark.read.schema(layout).csv(path, header=True)


def _chart_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """The nine reports written out, and their rows counted from the files."""
    paths = sinks.write_reports(charts.chart_data(tpch.star(spark, folder)), new_path(spark, "reports"))
    sizes = [
        spark.read.parquet(path).agg(F.lit(name).alias("report"), F.count("*").alias("row_count"))
        for name, path in paths.items()
    ]
    result = sizes[0]
    for size in sizes[1:]:
        result = result.unionByName(size)
    return result


def _filtered_rows(params: Params) -> Query:
    return lambda spark, folder: filters.apply(_extract(spark, folder), params)


# --- the versioned store ---------------------------------------------------------------------------

SECOND_LOAD = date(1996, 1, 1)


def _halves(spark: SparkSession, folder: str) -> tuple[Star, Star]:
    """The star parted by date: products come with their first sale. Products are made, marked and written once for both halves."""
    star = tpch.star(spark, folder)
    early = F.col("sales_date") < F.lit(SECOND_LOAD)
    sold = star.sales.where(early).select("product_id").distinct().withColumn("is_early", F.lit(True))
    products = materialise(star.products.join(sold, "product_id", "left"), "halves")
    factors = materialise(star.factors, "factors")

    def half(listed: Column, kept: Column) -> Star:
        return Star(products.where(listed).drop("is_early"), star.sales.where(kept), factors.where(kept), written=True)

    return half(F.col("is_early"), early), half(F.col("is_early").isNull(), ~early)


#: Stores of this process by application, folder and state of the files there.
_STORES: dict[tuple[str, str, str], str] = {}


def _two_loads(spark: SparkSession, folder: str) -> storage.Store:
    """A store loaded in two steps. Queries share it while its files last and the given tables stay as they are."""
    sources = [spark.read.parquet(f"{folder}/{name}.parquet") for name in ("lineitem", "part", "orders")]
    key = (spark.sparkContext.applicationId, folder, snapshot.source_state(sources)["digest"])
    home = _STORES.get(key)
    if home and len(VersionedFolder(spark, home).numbers()) == 2:
        return storage.open_store(spark, home)
    first, second = _halves(spark, folder)
    home = _STORES[key] = new_path(spark, "store")
    storage.rebuild(first, home)
    return storage.append(second, home)


def _rebuilt_twice(spark: SparkSession, folder: str) -> DataFrame:
    """Two rebuilds, and a third that dies when products and factors have been written; then what a reader finds."""
    home = new_path(spark, "store")
    star = tpch.star(spark, folder).with_written_dimensions()
    storage.rebuild(replace(star, sales=star.sales.where(F.col("product_id") % 2 == 0)), home)
    storage.rebuild(star, home)
    broken = star.sales.withColumn("inventory_quantity", F.when(F.col("product_id") > 0, F.raise_error(F.lit("cut off")).cast("int")))
    try:
        storage.rebuild(replace(star, products=star.products.where("product_id % 3 = 0"), sales=broken), home)
    except Exception as error:
        if "cut off" not in str(error) and not isinstance(error, load.LoadError):
            raise
    found = storage.open_store(spark, home)
    counts = load.staging_counts(found.products, found.sales(), found.factors)
    units = found.sales().agg(F.sum("inventory_quantity").alias("units"), F.max("sales_id").alias("last_id"))
    both = counts.unionByName(units.withColumn("tbl", F.lit("sales_data")), allowMissingColumns=True)
    return both.groupBy("tbl").agg(*(F.max(c).alias(c) for c in both.columns if c != "tbl")).withColumn("version", F.lit(found.number))


def _numbered_by_load(spark: SparkSession, folder: str) -> DataFrame:
    return _two_loads(spark, folder).sales().drop("month", "hot")


def _from_store(plan: Callable[[storage.Store], DataFrame], rounding: dict[str, int] | None = None) -> Query:
    return lambda spark, folder: comparable(plan(_two_loads(spark, folder)), rounding)


def _reorder_from_store(store: storage.Store) -> DataFrame:
    return analysis.reorder_points(skus.sku_metrics(skus.write_totals(storage.sku_totals(store))))


def _one_quarter(store: storage.Store) -> DataFrame:
    return storage.inventory_summary(store, date(1995, 12, 1), date(1996, 2, 29))


# --- files with bad lines --------------------------------------------------------------------------


def _files_with_bad_lines(spark: SparkSession, folder: str, nations: int) -> dict[str, str]:
    """The tables as text files, with five bad lines among the sales (one per region) and one per nation up to ``nations`` in the others."""
    home = new_path(spark, "csv")
    region, nation = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("region", "nation"))
    key = F.col("r_regionkey").cast("string")
    few = nation.where(F.col("n_nationkey") < nations).select(F.col("n_nationkey").cast("string").alias("key"), "n_name")
    bad = {
        "products": few.where("key % 2 = 0").select(F.concat_ws(",", F.concat(F.lit("P"), "key"), "n_name", F.lit("No"))),
        "sales": region.select(F.concat_ws(",", key, F.lit("30/02/2021"), F.lit("x"), F.lit("1.5"))),
        "factors": few.where("key % 2 = 1").select(F.concat_ws(",", "key", "n_name")),
    }
    paths = {}
    for (kind, schema), rows in zip(load.STAGING.items(), _text_staging(spark, folder)):
        lines = rows.select(F.concat_ws(",", *(F.coalesce(F.col(c), F.lit("")) for c in schema.names)).alias("line"))
        both = lines.unionByName(bad[kind].toDF("line"))
        paths[kind] = f"{home}/{kind}"
        both.select(F.col("line").alias(",".join(schema.names))).write.csv(paths[kind], header=True, sep="\u0001")
    return paths


def _tolerated(spark: SparkSession, folder: str, nations: int) -> DataFrame:
    """A load of files with bad lines into a store: the lines set aside, and the rows loaded (none if the load was refused)."""
    home = new_path(spark, "store")
    try:
        star, aside = load.load_tolerant(spark, _files_with_bad_lines(spark, folder, nations))
    except load.LoadError as refused:
        found = int(str(refused).split()[0])
        nothing = _text_staging(spark, folder)[1].agg(F.count("*").alias("rows_offered"))
        return nothing.select("rows_offered", F.lit(found).alias("bad_lines"), F.lit(len(VersionedFolder(spark, home).numbers())).alias("versions"))
    store = storage.rebuild(star, home)
    loaded = load.staging_counts(store.products, store.sales(), store.factors).select(F.col("tbl"), F.lit(None).cast("string").alias("fault"), F.lit(None).cast("string").alias("line"), F.col("row_count").alias("num_rows"))
    listed = aside.where("row_number > 0").groupBy("tbl", "fault", "line").agg(F.count("*").alias("num_rows"))
    return loaded.unionByName(listed)


# --- a written extract -----------------------------------------------------------------------------


def _snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Asked three times, refreshed once, and asked of a missing choice: rows of the extract, and how often it was written."""
    tables = ("lineitem", "part", "orders")
    kept = snapshot.ExtractSnapshot(
        spark,
        new_path(spark, "extract"),
        lambda: [spark.read.parquet(f"{folder}/{name}.parquet") for name in tables],
        lambda *_: _extract_without_numbers(spark, folder),
        ttl_seconds=float("inf"),
    )
    extract = kept.get()
    asked = [kept.state()["number"], (kept.get(), kept.state()["number"])[1], (kept.refresh(), kept.state()["number"])[1]]
    figures = extract.agg(F.count("*").alias("row_count"), F.sum("inventory_quantity").alias("units"), F.count("gdp").alias("with_gdp"))
    none_left = not quality.has_rows(filters.apply(extract, Params(categories=("NONE SUCH",))))
    return figures.select("*", F.lit(quality.has_rows(extract)).alias("has_rows"), F.lit(none_left).alias("none_left"), F.lit("-".join(map(str, asked))).alias("versions"))


# --- approximate counts ----------------------------------------------------------------------------

NEAR_PERCENT = 3


def _turnover_estimate(spark: SparkSession, folder: str) -> DataFrame:
    """The exact turnover, and whether the one from merged sketches lies within NEAR_PERCENT of it (and a rounding step)."""
    star = tpch.star(spark, folder)
    exact_rows = comparable(analysis.turnover_by_category(skus.sku_totals(star)))
    rough = comparable(analysis.turnover_estimate(materialise(analysis.sketched_by_month(star), "sketches")))
    rough = rough.select("product_category", F.col("avg_units_per_product").alias("rough"), F.col("avg_unit_cost").alias("same_cost"))
    both = exact_rows.join(rough, "product_category")
    near = F.abs(F.col("rough") - F.col("avg_units_per_product")) * 100 <= F.col("avg_units_per_product") * NEAR_PERCENT + 10
    return both.select("product_category", "avg_units_per_product", "avg_unit_cost", near.alias("is_near"), (F.col("same_cost") == F.col("avg_unit_cost")).alias("same_cost"))


def _summary_estimate(spark: SparkSession, folder: str) -> DataFrame:
    sketched = materialise(analysis.sketched_by_month(_clean(spark, folder)), "sketches")
    rough = dashboard.data_summary_estimate(sketched, FILTERED).first()
    same = (F.col("records") == rough["records"]) & (F.col("first_date") == rough["first_date"]) & (F.col("last_date") == rough["last_date"])
    near = F.abs(F.col("skus") - rough["skus"]) * 100 <= F.col("skus") * NEAR_PERCENT
    return _summary(spark, folder).select("*", same.alias("same_rest"), near.alias("is_near"))


# --- every stop of the sliders ---------------------------------------------------------------------


def _kpi_grid(spark: SparkSession, folder: str, params: Params = Params()) -> DataFrame:
    """The filters that move the baselines make the SKUs; the categories are chosen from the finished steps."""
    metrics = _board_metrics(spark, folder, replace(params, categories=None))
    return dashboard.kpi_grid(dashboard.kpi_steps(metrics), params.categories)


# --- rows on what leaves no rows otherwise ---------------------------------------------------------


def _season_places(spark: SparkSession, folder: str) -> DataFrame:
    chart = analysis.season_chart(analysis.sales_by_date(tpch.star(spark, folder)))
    return dense_key(chart, "place").select("place", "season_band", "num_records")


def _views_after_load(spark: SparkSession, folder: str) -> DataFrame:
    """Which views are left when a load has published its tables and dropped its staging, and what they hold."""
    staged = dict(zip(("staging_products", "staging_sales", "staging_factors"), _text_staging(spark, folder)))
    load.publish(staged)
    load.publish_star(load.load_star(*(spark.table(name) for name in staged)))
    load.drop_views(spark, list(staged))
    left = [name for name in (*staged, *schemas.TABLES, "inventory_summary") if spark.catalog.tableExists(name)]
    sizes = [spark.table(name).agg(F.lit(name).alias("view_name"), F.count("*").alias("row_count")) for name in left]
    return reduce(DataFrame.unionByName, sizes)


def _column_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Required columns of the extract as it is, and of one without two of them; with the rows that both would have."""
    extract = analysis.inventory_summary(tpch.star(spark, folder).with_written_dimensions())
    frames = {"extract": extract, "poor_extract": extract.drop("product_category", "sales_date", "gdp")}
    checks = quality.column_checks(frames, dict.fromkeys(frames, schemas.REQUIRED_COLUMNS))
    return checks.withColumn("row_count", F.lit(extract.count()).cast("bigint"))


def _row_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each choice of filters leaves any row of the joined extract, and what its figures are then."""
    totals = skus.write_totals(_board_totals(spark, folder))
    choices = {"everything": Params(), "combined": FILTERED, "unknown_category": Params(categories=("NONE SUCH",)), "no_category": Params(categories=())}
    parts = []
    for name, params in choices.items():
        kept = filters.apply(totals, params)
        figures = dashboard.kpis(dashboard.sku_metrics(kept, params), params)
        parts.append(figures.select(F.lit(name).alias("choice"), F.lit(quality.has_rows(kept)).alias("has_rows"), "flagged_skus", "units_analyzed"))
    return reduce(DataFrame.unionByName, parts)


# --- the registry ----------------------------------------------------------------------------------

STDEV = {"category_stdev": 6}
REORDER = {"category_stdev": 6, "safety_stock": 6, "reorder_point": 6}
METRIC = {**REORDER, "capital_tied_up": 6}
ACTION = {"Safety Stock Buffer": 6, "Calculated Reorder Point": 6, "Capital Tied Up ($)": 6}


def _on_star(plan: Callable[[Star], DataFrame], rounding: dict[str, int] | None = None) -> Query:
    return lambda spark, folder: comparable(plan(tpch.star(spark, folder)), rounding)


def _on_dates(plan: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_star(lambda star: plan(analysis.sales_by_date(star)))


def _on(source: Callable, plan: Callable[[DataFrame], DataFrame], rounding: dict[str, int] | None = None, **given) -> Query:
    return lambda spark, folder: comparable(plan(source(spark, folder, **given)), rounding)


def _as_is(source: Callable, rounding: dict[str, int] | None = None, **given) -> Query:
    return lambda spark, folder: comparable(source(spark, folder, **given), rounding)


def _filter_counts(totals: DataFrame) -> DataFrame:
    """Sales that each choice of filters keeps; selecting no category keeps none."""
    choices = {
        "everything": Params(),
        "two_categories": Params(categories=FILTERED.categories),
        "no_category": Params(categories=()),
        "unknown_category": Params(categories=("NONE SUCH",)),
        "promoted": Params(promo="yes"),
        "not_promoted": Params(promo="no"),
        "combined": FILTERED,
        "unreadable_sku": Params(sku="abc"),
    }
    return totals.agg(*(F.sum(F.when(filters.keeps(p), F.col("num_rows")).otherwise(0)).alias(n) for n, p in choices.items()))


def _row_counts(totals: DataFrame) -> DataFrame:
    return totals.select(*SKU_KEYS, "num_rows")


def _board_skus(metrics: DataFrame) -> DataFrame:
    return metrics.drop("sku_units")


QUERIES: dict[str, Query] = {
    # load
    "q01_load_products": _as_is(_load_products),
    "q02_load_sales": _as_is(_load_sales),
    "q03_load_factors": _as_is(_load_factors),
    "q04_staging_counts": lambda spark, folder: load.staging_counts(*_text_staging(spark, folder)),
    "q05_table_counts": _on_star(lambda star: load.staging_counts(star.products, star.sales, star.factors)),
    "q05_preview_products": _on_star(lambda star: load.preview(star.products, "product_id")),
    "q05_preview_sales": _on_star(lambda star: load.preview_sales(star.sales)),
    "q05_preview_factors": _on_star(lambda star: load.preview(star.factors, "sales_date")),
    "s01_csv_load": _as_is(_csv_load),
    "s06_scan_order_ids": _as_is(_scan_order_ids),
    "s08_view_by_sql": _as_is(_view_by_sql),
    # joined rows
    "q06_inventory_summary": _on_star(lambda star: analysis.inventory_summary(_numbered(star))),
    "q07_coverage_gap": _on_dates(analysis.coverage_gap),
    "q07_uncovered_dates": _on_dates(analysis.uncovered_dates),
    # batch analysis
    "q08_demand_profile": _on_star(analysis.demand_profile, {"demand_volatility": 6}),
    "q09_category_velocity": _on(_totals, analysis.category_velocity),
    "q10_product_reorder_points": _on_star(
        analysis.product_reorder_points, {"demand_stdev": 6, "safety_stock": 6, "reorder_point": 6}
    ),
    "q11_promotion_impact_whole": _on(_totals, lambda totals: analysis.promotion_impact(totals, whole=True)),
    "q12_promotion_impact": _on(_totals, analysis.promotion_impact),
    "q13_season_impact_whole": _on_dates(lambda dated: analysis.season_impact(dated, whole=True)),
    "q14_season_impact": _on_dates(analysis.season_impact),
    "q15_season_chart": _on_dates(analysis.season_chart),
    "q16_observations_per_product": _on_star(analysis.observations_per_product),
    "q17_observation_histogram": _on_star(analysis.observation_histogram),
    "q17_single_observation_share": _on_star(analysis.single_observation_share),
    "q18_reorder_points": _on(_metrics, analysis.reorder_points, REORDER),
    "q19_top_reorder": _on(_metrics, analysis.top_reorder),
    "q20_top_reorder_chart": _on(_metrics, analysis.top_reorder_chart),
    "q21_overstock_register": _on(_metrics, analysis.overstock_register),
    "q22_capital_by_category": _on(_metrics, analysis.capital_by_category, {"total_capital_tied_up": 2}),
    "q23_monthly_trend": _on_star(analysis.monthly_trend),
    "q24_monthly_trend_chart": _on_star(charts.demand_trend),
    "q25_category_volatility": _on(_totals, analysis.category_volatility, STDEV),
    "q26_stockout_risk": _on(_metrics, analysis.stockout_risk),
    "q27_turnover_by_category": _on(_totals, analysis.turnover_by_category),
    "q28_inflation_by_month": _on_dates(analysis.inflation_by_month),
    # the same on fractional and on large quantities
    "q08_demand_profile_eighths": _on(_with_quantity, analysis.demand_profile, {"demand_volatility": 6}, quantity=EIGHTHS),
    "q10_product_reorder_points_eighths": _on(
        _with_quantity, analysis.product_reorder_points, {"demand_stdev": 6, "safety_stock": 6, "reorder_point": 6}, quantity=EIGHTHS
    ),
    "q12_promotion_impact_eighths": _on(_totals_of, analysis.promotion_impact, quantity=EIGHTHS),
    "q25_category_volatility_eighths": _on(_totals_of, analysis.category_volatility, STDEV, quantity=EIGHTHS),
    "q23_monthly_trend_eighths": _on(_with_quantity, analysis.monthly_trend, quantity=EIGHTHS),
    "q28_inflation_by_month_eighths": _on(_dates_of, analysis.inflation_by_month, quantity=EIGHTHS),
    "q12_promotion_impact_large": _on(_totals_of, analysis.promotion_impact, quantity=LARGE),
    "q25_category_volatility_large": _on(_totals_of, analysis.category_volatility, {"category_stdev": 0}, quantity=LARGE),
    "q23_monthly_trend_places": _as_is(_trend_places),
    # dashboard
    "q29_clean_extract_dirty": _as_is(_cleaned_dirty),
    "q32_totals_dirty": _as_is(_dirty_totals),
    "q40_macro_dirty": _on(_cleaned_dirty, dashboard.macro_from_extract, {"Average": 6}),
    "q29_clean_extract": _as_is(_extract),
    "q30_filtered_extract": _as_is(_filtered_rows(FILTERED)),
    "f01_filter_counts": _on(_board_totals, _filter_counts),
    "f02_not_promoted": _on(_board_totals, _row_counts, params=NOT_PROMOTED),
    "f03_one_sku": _as_is(_one_product),
    "q31_category_stats": _on(_board_totals, dashboard.category_stats, STDEV),
    "q31_category_stats_filtered": _on(_board_totals, dashboard.category_stats, STDEV, params=FILTERED),
    "q31_category_stats_extract": _on(_extract_totals, dashboard.category_stats, STDEV),
    "q31_category_stats_extract_filtered": _on(_extract_totals, dashboard.category_stats, STDEV, params=FILTERED),
    "q32_sku_metrics_extract": _on(_extract_metrics, _board_skus, METRIC),
    "q32_sku_metrics": _on(_board_metrics, _board_skus, METRIC),
    "q32_sku_metrics_filtered": _on(_board_metrics, _board_skus, METRIC, params=FILTERED),
    "q33_overstock_list": _on(_board_metrics, dashboard.overstock_table, {"Capital Tied Up ($)": 6}),
    "q33_overstock_text": _on(_board_metrics, dashboard.overstock_table_text),
    "q34_kpis": _as_is(_kpis, {"capital_at_risk": 2}),
    "q34_kpis_not_promoted": _as_is(_kpis, {"capital_at_risk": 2}, params=NOT_PROMOTED),
    "q34_kpi_cards": _on(_kpis, dashboard.kpi_cards),
    "q35_data_summary": _as_is(_summary),
    "q35_summary_text": _on(_summary, dashboard.summary_text),
    "q36_capital_by_category": _on(_board_metrics, dashboard.capital_by_category, {"capital_tied_up": 2, "capital_k": 4}),
    "q37_volatility_by_category": _on(_board_totals, dashboard.volatility, STDEV),
    "q38_top_reorder_targets": _on(_board_metrics, dashboard.top_reorder, {"reorder_point": 6}),
    "q39_monthly_trend": lambda spark, folder: dashboard.trend_from_star(_clean(spark, folder)),
    "q39_monthly_trend_filtered": lambda spark, folder: dashboard.trend_from_star(_clean(spark, folder), FILTERED),
    "q40_macro_snapshot": lambda spark, folder: dashboard.macro_from_star(_clean(spark, folder)),
    "q40_macro_text": lambda spark, folder: dashboard.macro_text(dashboard.macro_from_star(_clean(spark, folder), FILTERED)),
    "q41_action_list": _on(_board_metrics, dashboard.action_list, ACTION),
    "q41_action_list_text": _on(_board_metrics, dashboard.action_list_text),
    "q41_action_list_places": _as_is(_action_places),
    "q42_action_list_export": _as_is(_exported, ACTION),
    "q43_categories": _on(_board_totals, dashboard.categories),
    "s12_chart_reports": _as_is(_chart_sizes),
    # the versioned store
    "s04_rebuilt_twice": _as_is(_rebuilt_twice),
    "s06_ids_go_on": _as_is(_numbered_by_load),
    "q06_summary_of_months": _from_store(_one_quarter),
    "q18_reorder_points_refreshed": _from_store(_reorder_from_store, REORDER),
    "q23_monthly_trend_refreshed": _from_store(storage.monthly_trend),
    "q39_monthly_trend_refreshed": _from_store(storage.month_end_trend),
    # files with bad lines, a written extract, approximate counts, all sliders
    "d01_checks_of_loads": _from_store(storage.checks),
    "d08_nine_bad_lines": _as_is(_tolerated, nations=4),
    "d08_eleven_bad_lines": _as_is(_tolerated, nations=6),
    "s10_extract_snapshot": _as_is(_snapshot),
    "q27_turnover_estimate": _as_is(_turnover_estimate),
    "q35_data_summary_estimate": _as_is(_summary_estimate),
    "q34_kpi_grid": _as_is(_kpi_grid, {"capital_at_risk": 2}),
    "q34_kpi_grid_filtered": _as_is(_kpi_grid, {"capital_at_risk": 2}, params=FILTERED),
    # what leaves no rows otherwise
    "q15_season_places": _as_is(_season_places),
    "s09_views_after_load": _as_is(_views_after_load),
    "d05_required_columns": _as_is(_column_checks),
    "d10_rows_left": _as_is(_row_checks),
    # data quality
    "d01_table_checks": _as_is(_quality),
    "d01_table_checks_dirty": _as_is(_dirty_checks),
    "d08_rejects": _as_is(_rejects),
    "d09_conflicting_promotions": _as_is(_conflicts),
    "d09_repeated_dates": lambda spark, folder: quality.repeated_dates(tpch.raw_factors(spark, folder)),
}
