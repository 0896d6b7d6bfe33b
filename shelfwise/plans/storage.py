"""The base tables as a versioned store: rebuilt in one step, appended to load by load, with monthly totals kept up to date.

A rebuild starts a new generation of tables in a folder of its own. Products and sales are bucketed by product, the sales and
their monthly totals are partitioned by month as well, and every table by load. A version names its generation and its loads; what a load
wrote that no version names does not count. Loads add partitions and never change any, so that older versions stay as they were.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from shelfwise import schemas
from shelfwise.operators import joins, rollups
from shelfwise.plans import analysis, load, quality
from shelfwise.sources.versions import VersionedFolder
from shelfwise.star import Star

#: Sales of one bucket, which decides the number of buckets at a rebuild, and the most buckets there may be.
BUCKET_ROWS = 250_000
MOST_BUCKETS = 4096
#: A product is hot in a load with over one in so many of its sales, and over so many; there are fewer than HOT_SHARE such products.
HOT_SHARE = 1000
HOT_ROWS = 100_000
SALTS = 64
#: A load with over so many times BUCKET_ROWS sales per bucket is added up from plain files, as the buckets would be too few tasks.
CROWDED = 8

DATA = "data"
PRODUCTS, SALES, FACTORS = schemas.TABLES
MONTHS = "sales_by_month"
LAYOUT = {PRODUCTS: ["load"], SALES: ["load", "hot", "month"], FACTORS: ["load"], MONTHS: ["load", "month"]}
PARTITION_TYPES = {"load": "string", "hot": "int", "month": "date"}
BUCKETED = (PRODUCTS, SALES, MONTHS)


def month_of(day: Column | str) -> Column:
    return F.trunc(day, "MM")


@dataclass(frozen=True)
class Store:
    """One version of the store. Its frames read what the version names, whatever is loaded afterwards."""

    spark: SparkSession
    folder: str
    state: dict

    @property
    def number(self) -> int:
        return self.state["number"]

    def _table(self, name: str) -> DataFrame:
        rows = self.spark.table(_table_name(self.state["generation"], name))
        return rows.where(F.col("load").isin(self.state["loads"]))

    @property
    def products(self) -> DataFrame:
        return self._table(PRODUCTS).drop("load")

    @property
    def factors(self) -> DataFrame:
        return self._table(FACTORS).drop("load")

    def sales(self, first: date | None = None, last: date | None = None) -> DataFrame:
        """The sales, of the months of ``first`` to ``last`` only if these are given, with the columns month and hot."""
        rows = self._table(SALES).drop("load")
        for bound, beyond in ((first, lambda m, b: m >= b), (last, lambda m, b: m <= b)):
            if bound:
                rows = rows.where(beyond(F.col("month"), F.lit(bound.replace(day=1))))
        return rows

    def months(self) -> DataFrame:
        """Totals of the sales per product and month, mergeable (see ``rollups``), each month from the load that wrote it last."""
        rows = self.spark.table(_table_name(self.state["generation"], MONTHS))
        current = [f"{load_id} {month}" for month, load_id in self.state["months"].items()]
        return rows.where(F.concat_ws(" ", "load", F.col("month").cast("string")).isin(current)).drop("load")

    def star(self) -> Star:
        return Star(self.products, self.sales().drop("month", "hot"), self.factors, written=True)


# --- tables and their definitions ------------------------------------------------------------------


def _table_name(generation: str, name: str) -> str:
    return f"shelfwise_{generation}_{name}"


def _register(spark: SparkSession, folder: str, state: dict) -> None:
    """Define a generation's tables in the session's catalog over their folders, with the partitions found there."""
    for name, layout in LAYOUT.items():
        table, path = _table_name(state["generation"], name), _path(folder, state, name)
        if not spark.catalog.tableExists(table):
            columns = T.StructType.fromJson(state["schemas"][name]).fields
            listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
            listed += "".join(f", `{p}` {PARTITION_TYPES[p]}" for p in layout)
            buckets = f"CLUSTERED BY (product_id) SORTED BY (product_id) INTO {state['buckets']} BUCKETS" if name in BUCKETED else ""
            spark.sql(f"CREATE TABLE {table} ({listed}) USING parquet PARTITIONED BY ({', '.join(layout)}) {buckets} LOCATION '{path}'")
        spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")


def _path(folder: str, state: dict, name: str) -> str:
    return f"{folder.rstrip('/')}/{DATA}/{state['generation']}/{name}"


def forget(spark: SparkSession, state: dict) -> None:
    """Drop the definitions of a generation's tables from the session's catalog; the files stay."""
    for name in LAYOUT:
        spark.sql(f"DROP TABLE IF EXISTS {_table_name(state['generation'], name)}")


def _write(rows: DataFrame, folder: str, state: dict, name: str) -> None:
    writer = rows.write.mode("append").format("parquet").partitionBy(*LAYOUT[name]).option("path", _path(folder, state, name))
    if name in BUCKETED:
        writer = writer.bucketBy(state["buckets"], "product_id").sortBy("product_id")
    writer.saveAsTable(_table_name(state["generation"], name))


def _by_bucket(rows: DataFrame, buckets: int, *more: Column | str) -> DataFrame:
    """Rows of one bucket (and month) together, so that a load writes few files."""
    return rows.repartition(F.pmod(F.hash("product_id"), F.lit(buckets)), *more)


# --- opening ---------------------------------------------------------------------------------------


def open_store(spark: SparkSession, folder: str, number: int | None = None) -> Store:
    """The latest version, or an earlier one."""
    state = VersionedFolder(spark, folder).read(number)
    if state is None:
        raise FileNotFoundError(f"nothing has been loaded into {folder}")
    _register(spark, folder, state)
    return Store(spark, folder, state)


# --- loading ---------------------------------------------------------------------------------------


def rebuild(star: Star, folder: str, *, buckets: int | None = None, hot_rows: int = HOT_ROWS) -> Store:
    """Replace everything in ``folder`` by ``star``, whose sales have no row numbers yet. The new version appears when all three tables are written."""
    spark = star.sales.sparkSession
    versions = VersionedFolder(spark, folder)
    number = max(versions.numbers(), default=0) + 1
    state = {"generation": uuid.uuid4().hex, "buckets": buckets, "loads": [], "months": {}, "last_id": 0, "seen": {}}
    return _load(star, folder, state, number, None, hot_rows)


def append(star: Star, folder: str, *, hot_rows: int = HOT_ROWS) -> Store:
    """Add new products, sales and factors to the latest version.

    Row numbers go on where the last load ended. A product id or a date that is stored already, and a sale of an unknown product, stop the load
    before anything is published.
    """
    before = open_store(star.sales.sparkSession, folder)
    return _load(star, folder, before.state, before.number + 1, before, hot_rows)


def _load(star: Star, folder: str, state: dict, number: int, before: Store | None, hot_rows: int) -> Store:
    spark = star.sales.sparkSession
    star = star.with_written_dimensions()
    load_id = f"{number:09d}-{uuid.uuid4().hex[:8]}"
    per_month = star.sales.groupBy(month_of("sales_date").alias("month")).agg(F.count("*").alias("num_rows")).orderBy("month").collect()
    total, touched = sum(row["num_rows"] for row in per_month), [row["month"] for row in per_month]
    uncategorised, hot = _check_keys(star, before, max(hot_rows, total // HOT_SHARE))
    buckets = state["buckets"] or min(MOST_BUCKETS, max(1, -(-total // BUCKET_ROWS)))
    state = {**state, "buckets": buckets}

    numbered = load.number_sales(star.sales, first=state["last_id"] + 1)
    hot_flag = F.col("product_id").isin(hot).cast("int") if hot else F.lit(0)
    sales = numbered.withColumns({"load": F.lit(load_id), "hot": F.coalesce(hot_flag, F.lit(0)), "month": month_of("sales_date")})
    salt = F.when(F.col("hot") == 1, F.col("sales_id") % SALTS).otherwise(0)
    tables = {
        PRODUCTS: _counted(star.products.repartition(buckets, "product_id"), "product_id").withColumn("load", F.lit(load_id)),
        FACTORS: _counted(star.factors, "sales_date").withColumn("load", F.lit(load_id)),
        SALES: _by_bucket(sales, buckets, "month", salt),
    }
    seen = {}
    for name in (*tables, MONTHS):
        if name == MONTHS:
            own = _months_of_load(star, folder, state, load_id, bool(hot), total)
            tables[MONTHS] = _with_stored_months(own, before, touched, buckets).withColumn("load", F.lit(load_id))
        frame = tables[name]
        observed = Observation()
        watched = frame.observe(observed, *_metrics(name)).drop(COPIES)
        _write(watched, folder, state, name)
        seen[name] = dict(observed.get)
    seen[SALES]["uncategorised"] = uncategorised
    for name, key in ((PRODUCTS, "product_id"), (FACTORS, "sales_date")):
        if seen[name]["repeated"]:
            raise load.LoadError(f"{name}: {seen[name]['repeated']} values of {key} stand in several rows")

    plain = {
        name: T.StructType([f for f in frame.schema.fields if f.name not in (*LAYOUT[name], COPIES)]).jsonValue() for name, frame in tables.items()
    }
    state |= {
        "number": number,
        "time": time.time(),
        "loads": [*state["loads"], load_id],
        "last_id": seen[SALES]["last"] or state["last_id"],
        "seen": {**state["seen"], load_id: seen},
        "months": {**state["months"], **{str(month): load_id for month in touched}},
        "hot": sorted({*state.get("hot", []), *hot}),
        "schemas": state.get("schemas") or plain,
    }
    VersionedFolder(spark, folder).publish(number, state)
    _register(spark, folder, state)
    return Store(spark, folder, state)


#: How many rows share a key, while a table with unique keys is written.
COPIES = "copies"


def _counted(rows: DataFrame, key: str) -> DataFrame:
    """One row per key with the number of its rows, which should be one."""
    others = [F.max(name).alias(name) for name in rows.columns if name != key]
    return rows.groupBy(key).agg(*others, F.count("*").alias(COPIES))


def _metrics(table: str) -> list[Column]:
    """What is counted of a table while it is written, so that no check has to read it again."""
    if table == MONTHS:
        return [F.count(F.lit(1)).alias("rows")]
    if table == SALES:
        missing = [F.count_if(F.col(name).isNull()).alias(f"missing_{name}") for name in ("sales_id", "product_id", "sales_date")]
        return [F.count("*").alias("rows"), F.min("sales_id").alias("first"), F.max("sales_id").alias("last"), *missing]
    key = "product_id" if table == PRODUCTS else "sales_date"
    n, is_null = F.col(COPIES), F.col(key).isNull()
    figures = {"rows": F.sum(n), "repeated": F.count_if((n > 1) & ~is_null), "missing": F.sum(F.when(is_null, n))}
    if table == PRODUCTS:
        figures |= {f"long_{name}": F.count_if(F.length(name) > width) for name, width in schemas.TEXT_LIMITS.items()}
    return [F.coalesce(value, F.lit(0)).alias(name) for name, value in figures.items()]


def checks(store: Store, rows: Mapping[str, int] = quality.MINIMUM_ROWS, exact_count: bool = False) -> DataFrame:
    """The rows of ``quality.all_checks`` from what was counted while the loads were written; no table is read.

    Unknown products and repeated keys stop a load, so that their checks hold in every version. Row numbers repeat if a load has fewer
    of them than rows.
    """
    loads = [store.state["seen"][load_id] for load_id in store.state["loads"]]

    def total(table: str, name: str) -> int:
        return sum(seen[table][name] for seen in loads)

    sales = [seen[SALES] for seen in loads]
    numbers = sum(seen["last"] - seen["first"] + 1 for seen in sales if seen["rows"])
    found = {
        f"{PRODUCTS}: repeated product_id": total(PRODUCTS, "repeated"),
        f"{PRODUCTS}: missing product_id": total(PRODUCTS, "missing"),
        **{f"{PRODUCTS}: {name} over {width}": total(PRODUCTS, f"long_{name}") for name, width in schemas.TEXT_LIMITS.items()},
        f"{SALES}: missing product_id": total(SALES, "missing_product_id"),
        f"{SALES}: missing sales_date": total(SALES, "missing_sales_date"),
        f"{SALES}: unknown product_id": 0,
        "inventory_summary: missing product_category": total(SALES, "uncategorised"),
        f"{SALES}: repeated sales_id": max(0, total(SALES, "rows") - numbers - total(SALES, "missing_sales_id")),
        f"{SALES}: missing sales_id": total(SALES, "missing_sales_id"),
        f"{FACTORS}: repeated sales_date": total(FACTORS, "repeated"),
        f"{FACTORS}: missing sales_date": total(FACTORS, "missing"),
    }
    listed = [(name, 0, actual, actual == 0) for name, actual in found.items()]
    for table, expected in rows.items():
        actual = total(table, "rows")
        ok = actual == expected if exact_count else actual >= expected
        listed.append((f"{table}: {'rows' if exact_count else 'least rows'}", expected, actual, ok))
    return store.spark.createDataFrame(listed, "check string, expected bigint, actual bigint, ok boolean")


def _months_of_load(star: Star, folder: str, state: dict, load_id: str, hot: bool, total: int) -> DataFrame:
    """Totals per product and month of the sales that a load has written.

    Written sales lie in their buckets, and their totals go into the same ones, so that nothing is moved. Hot products, and all of a
    load far larger than the buckets were made for, are read as plain files instead, in any number of tasks, and combined before they move.
    """
    spark, path, buckets = star.sales.sparkSession, _path(folder, state, SALES), state["buckets"]
    table = spark.table(_table_name(state["generation"], SALES))
    own = table.where(F.col("load") == load_id)
    crowded = total > CROWDED * BUCKET_ROWS * buckets
    if not (hot or crowded):
        return rollups.rollup(own, "product_id", "month")
    files = spark.read.schema(table.schema).option("basePath", path).parquet(f"{path}/load={load_id}")
    spread = _by_bucket(rollups.rollup(files if crowded else files.where("hot = 1"), "product_id", "month"), buckets, "month")
    return spread if crowded else rollups.rollup(own.where("hot = 0"), "product_id", "month").unionByName(spread)


def _with_stored_months(own: DataFrame, before: Store | None, touched: list[date], buckets: int) -> DataFrame:
    """Totals of the months that a load touches: its own, merged with what is stored of just these months."""
    both = [month for month in touched if before and month and str(month) in before.state["months"]]
    if not both:
        return own
    is_stored = F.col("month").isin(both)
    stored = before.months().where(is_stored).select(own.columns)
    merged = rollups.merge(own.where(is_stored).unionByName(stored), "product_id", "month").drop("num_parts")
    return own.where(~is_stored | F.col("month").isNull()).unionByName(_by_bucket(merged, buckets, "month"))


def _check_keys(star: Star, before: Store | None, limit: int) -> tuple[int, list[int]]:
    """Raise for a product id or a date loaded before, and for a sale of a product that neither load knows.

    Returns the number of sales whose product has no category, and the products with over ``limit`` sales. One aggregate by product
    answers all of it, to which products of both loads and sales come as rows with the same columns.
    """

    def listed(products: DataFrame, is_new: bool) -> DataFrame:
        return products.select("product_id", F.col("product_category").isNull().alias("uncategorised"), F.lit(is_new).alias("is_new"), F.lit(0).alias("sold"))

    rows = listed(star.products, True)
    if before is not None:
        rows = rows.unionByName(listed(before.products, False))
    none = F.lit(None).cast("boolean")
    rows = rows.unionByName(star.sales.select("product_id", none.alias("uncategorised"), none.alias("is_new"), F.lit(1).alias("sold")))
    by_product = rows.groupBy("product_id").agg(
        F.bool_or("uncategorised").alias("uncategorised"),
        F.bool_or("is_new").alias("in_load"),
        F.bool_or(~F.col("is_new")).alias("in_store"),
        F.sum("sold").alias("num_rows"),
    )
    product, has_sales = F.col("product_id"), F.col("num_rows") > 0
    is_unknown = has_sales & (F.col("uncategorised").isNull() | product.isNull())
    result = by_product.agg(
        F.min(F.when(F.col("in_load") & F.col("in_store"), product)).alias("again"),
        F.count_if(is_unknown).alias("unknown"),
        F.min(F.when(is_unknown, product)).alias("example"),
        F.coalesce(F.sum(F.when(F.col("uncategorised"), F.col("num_rows"))), F.lit(0)).alias("uncategorised"),
        F.collect_list(F.when(F.col("num_rows") > limit, product)).alias("hot"),
    ).first()
    if result["again"] is not None:
        raise load.LoadError(f"product_id {result['again']} is stored already")
    if before is not None:
        again = star.factors.join(before.factors.select("sales_date"), "sales_date", "left_semi").orderBy("sales_date").first()
        if again:
            raise load.LoadError(f"sales_date {again['sales_date']} is stored already")
    if result["unknown"]:
        raise load.LoadError(f"sales of product {result['example']}, which is not listed")
    return result["uncategorised"], sorted(result["hot"])


def sweep(spark: SparkSession, folder: str, keep: int = 2) -> list[int]:
    """Delete all versions but the last ``keep``, and generations that no version left names; returns the versions deleted.

    Nothing may be loading meanwhile, as what an unfinished load has written belongs to no version either. Partitions
    of unfinished loads within a generation that stays are not read and stay until the next rebuild.
    """
    versions = VersionedFolder(spark, folder)
    numbers = versions.numbers()
    gone = numbers[: max(0, len(numbers) - keep)]
    for number in gone:
        versions.delete("versions", f"{number:09d}.json")
    used = {versions.read(number)["generation"] for number in versions.numbers()}
    for generation in versions.names(DATA):
        if generation not in used:
            forget(spark, {"generation": generation})
            versions.delete(DATA, generation)
    return gone


# --- reading ---------------------------------------------------------------------------------------


def joined_sales(store: Store, first: date | None = None, last: date | None = None) -> DataFrame:
    """Every sale (of the given months) with its product.

    Sales and products share their buckets and meet without being moved. Hot products, of which a store knows few, are the exception: their sales lie in
    partitions of their own, are read in any number of tasks, and meet a broadcast of just these products.
    """
    sales, products = store.sales(first, last).drop("month"), store.products
    plain = joins.with_products(sales.where("hot = 0").drop("hot"), products)
    if not store.state["hot"]:
        return plain
    few = F.broadcast(products.where(F.col("product_id").isin(store.state["hot"])))
    return plain.unionByName(joins.with_products(sales.where("hot = 1").drop("hot"), few))


def inventory_summary(store: Store, first: date | None = None, last: date | None = None) -> DataFrame:
    """The joined rows with external factors, of the given months only."""
    joined = joins.with_factors(joined_sales(store, first, last), store.factors)
    return joined.select(*schemas.EXTRACT_COLUMNS)


def sku_totals(store: Store) -> DataFrame:
    """``skus.sku_totals`` from the monthly totals, which need not be moved for it."""
    return joins.with_products(rollups.merge(store.months(), "product_id").drop("num_parts"), store.products)


def _by_category(store: Store, month: Column) -> DataFrame:
    rows = joins.with_products(store.months(), store.products)
    return rollups.merge(rows, "product_category", month)


def monthly_trend(store: Store) -> DataFrame:
    """``analysis.monthly_trend`` from the monthly totals."""
    return analysis.trend(_by_category(store, F.col("month").alias("month_start")))


def month_end_trend(store: Store) -> DataFrame:
    """Units per category and month named by its last day, from the monthly totals; months without any known quantity do not appear."""
    merged = _by_category(store, F.last_day("month").alias("sales_date"))
    known = merged.where((F.col("num_quantities") > 0) & F.col("product_category").isNotNull())
    return known.select("product_category", "sales_date", rollups.units(known).alias("inventory_quantity")).orderBy("product_category", "sales_date")
