"""The versioned store: what readers see, row numbers over loads, monthly totals and the layout."""

from __future__ import annotations

import re
from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from shelfwise import catalog
from shelfwise.operators import joins, rollups
from shelfwise.plans import analysis, dashboard, load, quality, skus, storage
from shelfwise.sources.versions import VersionConflict, VersionedFolder
from shelfwise.star import Star

DAYS = [date(2021, 1, 5), date(2021, 1, 28), date(2021, 2, 3), date(2021, 3, 31), date(2021, 12, 1)]


def star_of(spark, ids, days, factor_days=None):
    """Sales of every product on every day, some without quantity or cost."""
    products = [(i, f"C{i % 3}" if i % 7 else None, "Yes" if i % 2 else "No") for i in ids]
    sales = [(i, d, None if (i + d.day) % 11 == 0 else i % 13 + d.month, float(i) if i % 5 else None) for i in ids for d in days]
    factors = [(d, 1.5, 2.0, 1.0) for d in (days if factor_days is None else factor_days)]
    return Star(
        spark.createDataFrame(products, "product_id long, product_category string, promotions string"),
        spark.createDataFrame(sales, "product_id long, sales_date date, inventory_quantity int, product_cost double").withColumn(
            "product_cost", F.col("product_cost").cast("decimal(10,2)")
        ),
        spark.createDataFrame(factors, "sales_date date, gdp double, inflation_rate double, seasonal_factor double").select(
            "sales_date", F.col("gdp").cast("decimal(18,2)").alias("gdp"), *(F.col(c).cast("decimal(5,2)").alias(c) for c in ("inflation_rate", "seasonal_factor"))
        ),
    )


@pytest.fixture(scope="module")
def home(tmp_path_factory):
    return str(tmp_path_factory.mktemp("store"))


@pytest.fixture(scope="module")
def loads(spark, home):
    """A rebuild, and a second load with new products and days that touch one old month."""
    first = storage.rebuild(star_of(spark, range(1, 40), DAYS[:3]), home, buckets=3)
    more = star_of(spark, range(40, 60), DAYS[2:], DAYS[3:])
    second = storage.append(more, home)
    return first, second


def whole(store):
    return sorted(map(tuple, store.sales().drop("month", "hot").collect()))


# --- versions --------------------------------------------------------------------------------------


def test_a_version_is_published_once(spark, tmp_path):
    folder = VersionedFolder(spark, str(tmp_path / "new"))
    assert folder.numbers() == [] and folder.read() is None
    folder.publish(1, {"a": 1})
    folder.publish(12, {"a": "ü"})
    with pytest.raises(VersionConflict):
        folder.publish(12, {"a": 3})
    assert folder.numbers() == [1, 12] and folder.read() == {"a": "ü"} and folder.read(1) == {"a": 1}
    with pytest.raises(FileNotFoundError):
        folder.read(2)
    assert folder.names("versions") == ["000000001.json", "000000012.json"]
    with pytest.raises(FileNotFoundError):
        storage.open_store(spark, str(tmp_path / "empty"))


@pytest.mark.parametrize("table", [storage.FACTORS, storage.SALES])
def test_a_load_that_dies_between_tables_leaves_the_old_version(spark, tmp_path, monkeypatch, table):
    home = str(tmp_path)
    old = storage.rebuild(star_of(spark, range(1, 8), DAYS[:2]), home)
    before, write = whole(old), storage._write

    def dies(rows, folder, state, name):
        if name == table:
            raise RuntimeError("power cut")
        write(rows, folder, state, name)

    monkeypatch.setattr(storage, "_write", dies)
    for run in (storage.rebuild, storage.append):
        with pytest.raises(RuntimeError):
            run(star_of(spark, range(50, 60), DAYS[3:]), home)
    monkeypatch.undo()
    found = storage.open_store(spark, home)
    assert found.number == 1 and whole(found) == before and found.products.count() == 7
    again = storage.append(star_of(spark, range(50, 60), DAYS[3:]), home)
    assert again.number == 2 and again.sales().count() == 14 + 20 and again.products.count() == 17
    assert [r.sales_id for r in again.sales().orderBy("sales_id").collect()] == list(range(1, 35))


def test_two_loads_at_once_do_not_both_win(spark, tmp_path, monkeypatch):
    home = str(tmp_path)
    storage.rebuild(star_of(spark, range(1, 5), DAYS[:1]), home)
    check = storage._check_keys

    def overtaken(star, sold, before):
        monkeypatch.setattr(storage, "_check_keys", check)
        storage.append(star_of(spark, [77], DAYS[4:]), home)
        return check(star, sold, before)

    monkeypatch.setattr(storage, "_check_keys", overtaken)
    with pytest.raises(VersionConflict):
        storage.append(star_of(spark, [88], DAYS[3:4]), home)
    assert {r.product_id for r in storage.open_store(spark, home).products.collect()} == {1, 2, 3, 4, 77}


def test_older_versions_stay_as_they_were(spark, home, loads):
    first, second = loads
    assert (first.sales().count(), second.sales().count()) == (39 * 3, 39 * 3 + 20 * 3)
    assert first.products.count() == 39 and first.factors.count() == 3 and second.factors.count() == 5
    storage.forget(spark, second.state)
    assert whole(storage.open_store(spark, home, 1)) == whole(first)
    assert whole(storage.open_store(spark, home)) == whole(second)


def test_sweeping_keeps_the_last_versions(spark, tmp_path):
    home = str(tmp_path)
    for ids in (range(1, 3), range(1, 4), range(1, 5)):
        storage.rebuild(star_of(spark, ids, DAYS[:1]), home)
    assert storage.sweep(spark, home, keep=2) == [1] and VersionedFolder(spark, home).numbers() == [2, 3]
    assert len(VersionedFolder(spark, home).names("data")) == 2
    assert storage.open_store(spark, home, 2).products.count() == 3


# --- keys and row numbers --------------------------------------------------------------------------


def test_row_numbers_go_on(loads):
    first, second = loads
    old, new = whole(first), whole(second)
    assert [r[0] for r in new] == list(range(1, len(new) + 1)) and new[: len(old)] == old
    assert second.state["last_id"] == len(new) and [r[1:3] for r in new[len(old) :]] == sorted(r[1:3] for r in new[len(old) :])


@pytest.mark.parametrize(
    ("ids", "days", "factor_days", "message"),
    [([5], DAYS[3:4], [], "product_id 5 is stored"), ([900], DAYS[:1], DAYS[:1], "sales_date 2021-01-05 is stored")],
)
def test_keys_that_are_stored_stop_a_load(spark, home, loads, ids, days, factor_days, message):
    numbers = VersionedFolder(spark, home).numbers()
    with pytest.raises(load.LoadError, match=message):
        storage.append(star_of(spark, ids, days, factor_days), home)
    unknown = star_of(spark, [901, 902], DAYS[:1], [])
    with pytest.raises(load.LoadError, match="902"):
        storage.append(replace(unknown, products=unknown.products.where("product_id = 901")), home)
    assert VersionedFolder(spark, home).numbers() == numbers


def test_empty_loads(spark, tmp_path):
    none = star_of(spark, range(1, 3), DAYS[:1])
    none = Star(none.products.where("false"), none.sales.where("false"), none.factors.where("false"))
    store = storage.rebuild(none, str(tmp_path))
    assert store.sales().count() == store.products.count() == storage.monthly_trend(store).count() == 0
    store = storage.append(star_of(spark, range(1, 3), DAYS[:1]), str(tmp_path))
    store = storage.append(none, str(tmp_path))
    assert store.number == 3 and store.state["last_id"] == 2 and storage.joined_sales(store).count() == 2


def test_repeated_keys_stop_a_load(spark, tmp_path):
    star = star_of(spark, range(1, 5), DAYS[:1])
    with pytest.raises(load.LoadError, match="product_information: 2 values"):
        storage.rebuild(replace(star, products=star.products.unionByName(star.products.where("product_id > 2"))), str(tmp_path))
    with pytest.raises(load.LoadError, match="external_factors: 1 values"):
        storage.rebuild(replace(star, factors=star.factors.unionByName(star.factors)), str(tmp_path))
    assert VersionedFolder(spark, str(tmp_path)).numbers() == []


def test_checks_come_from_the_loads_themselves(spark, loads, monkeypatch):
    _, store = loads
    want = quality.all_checks(replace(store.star(), written=True), rows={"product_information": 60, "sales_data": 10, "external_factors": 5}).collect()

    def read_again(*_):
        raise AssertionError("a table is read")

    monkeypatch.setattr(storage.Store, "_table", read_again)
    found = storage.checks(store, rows={"product_information": 60, "sales_data": 10, "external_factors": 5})
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want))
    assert {r.check for r in found.where("not ok").collect()} == {"product_information: least rows", "inventory_summary: missing product_category"}


# --- monthly totals --------------------------------------------------------------------------------


def test_refreshed_totals_equal_totals_of_everything(spark, loads):
    _, store = loads
    star = store.star()
    assert storage.monthly_trend(store).collect() == analysis.monthly_trend(star).collect()
    clean = dashboard.clean_star(star)
    assert storage.month_end_trend(store).collect() == dashboard.trend_from_star(clean).collect()
    columns = ["product_id", "product_category", "promotions", "num_rows", "num_quantities", "units", "units_squared", "num_costs", "cost", "first_date", "last_date"]
    assert sorted(map(str, storage.sku_totals(store).select(columns).collect())) == sorted(map(str, skus.sku_totals(star).select(columns).collect()))
    by_month = rollups.rollup(star.sales, "product_id", F.trunc("sales_date", "MM").alias("month"))
    assert sorted(map(str, store.months().select(by_month.columns).collect())) == sorted(map(str, by_month.collect()))


def test_a_load_writes_only_the_months_it_touches(spark, home, loads):
    first, second = loads
    old, new = first.state["months"], second.state["months"]
    assert set(old) == {"2021-01-01", "2021-02-01"} and set(new) == {"2021-01-01", "2021-02-01", "2021-03-01", "2021-12-01"}
    assert new["2021-01-01"] == old["2021-01-01"] and new["2021-02-01"] != old["2021-02-01"]
    written = VersionedFolder(spark, home).names("data", second.state["generation"], storage.MONTHS, f"load={second.state['loads'][1]}")
    assert [name for name in written if name.startswith("month=")] == ["month=2021-02-01", "month=2021-03-01", "month=2021-12-01"]
    plan = second.months()._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryFileIndex(4 paths)" in plan


# --- layout ----------------------------------------------------------------------------------------


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sales_meet_their_products_without_being_moved(spark, loads, no_broadcast):
    _, store = loads
    for frame in (storage.joined_sales(store), storage.sku_totals(store)):
        plan = final_plan(frame)
        assert "Exchange" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_a_span_of_months_reads_only_its_partitions(spark, loads):
    _, store = loads
    some = storage.joined_sales(store, date(2021, 2, 14), date(2021, 3, 1))
    assert {r.sales_date for r in some.collect()} == {DAYS[2], DAYS[3]}
    paths = re.findall(r"_sales_data\[.*?InMemoryFileIndex\((\d+) paths", final_plan(some), re.S)
    assert set(paths) == {"3"}  # February of both loads, March of one
    summary = storage.inventory_summary(store, date(2021, 12, 1))
    assert summary.count() == 20 and summary.where("gdp is null").count() == 0


def test_hot_products_are_read_in_many_tasks(spark, tmp_path, no_broadcast):
    star = star_of(spark, range(1, 10), DAYS[:2])
    hot = spark.range(3000).select(F.lit(3).cast("long").alias("product_id"), F.lit(DAYS[0]).alias("sales_date"), F.lit(1).alias("inventory_quantity"), F.lit(None).cast("decimal(10,2)").alias("product_cost"))
    store = storage.rebuild(replace(star, sales=star.sales.unionByName(hot)), str(tmp_path), buckets=2, hot_rows=100)
    assert store.state["hot"] == [3]
    sales = store.sales()
    assert {r.product_id for r in sales.where("hot = 1").select("product_id").distinct().collect()} == {3}
    joined, plain = storage.joined_sales(store), joins.with_products(sales.drop("hot", "month"), store.products)
    assert sorted(map(str, joined.collect())) == sorted(map(str, plain.select(joined.columns).collect()))
    plan = final_plan(joined)
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan and "Bucketed: false" in plan
    assert storage.monthly_trend(store).collect() == analysis.monthly_trend(store.star()).collect()


# --- the work of a load ----------------------------------------------------------------------------


def months_of(store):
    """Monthly totals of a store, and the same from its sales."""
    found = store.months().select("product_id", "month", *[c for c in store.months().columns if c not in ("product_id", "month")])
    fresh = rollups.rollup(store.sales().drop("month", "hot"), "product_id", storage.month_of("sales_date").alias("month"))
    return sorted(map(tuple, found.collect()), key=repr), sorted(map(tuple, fresh.select(found.columns).collect()), key=repr)


def test_monthly_totals_of_a_load_are_added_up_where_its_sales_lie(spark, tmp_path, monkeypatch):
    seen = {}
    write = storage._write

    def watched(rows, folder, state, name):
        seen.setdefault(name, []).append(rows._jdf.queryExecution().executedPlan().toString())
        write(rows, folder, state, name)

    monkeypatch.setattr(storage, "_write", watched)
    storage.rebuild(star_of(spark, range(1, 40), DAYS[:2]), str(tmp_path), buckets=3)
    storage.append(star_of(spark, range(40, 60), DAYS[2:]), str(tmp_path))
    assert [plan.count("Exchange") for plan in seen[storage.MONTHS]] == [0, 0]
    stored, fresh = months_of(storage.open_store(spark, str(tmp_path)))
    assert stored == fresh and len(stored) == 39 + 3 * 20


@pytest.mark.parametrize("hot_rows, crowded", [(4, 8), (100_000, 0), (4, 0)])
def test_totals_of_hot_products_and_of_crowded_buckets(spark, tmp_path, monkeypatch, hot_rows, crowded):
    monkeypatch.setattr(storage, "CROWDED", crowded)
    first, second = star_of(spark, range(1, 40), DAYS[:3]), star_of(spark, range(40, 60), DAYS[2:], DAYS[3:])
    one = star_of(spark, [40], DAYS[2:]).sales
    second = replace(second, sales=second.sales.unionByName(one).unionByName(one))
    storage.rebuild(first, str(tmp_path), buckets=3)
    store = storage.append(second, str(tmp_path), hot_rows=hot_rows)
    assert store.state["hot"] == ([40] if hot_rows == 4 else [])
    stored, fresh = months_of(store)
    assert stored == fresh and len(stored) == 39 * 2 + 20 * 3


def test_products_of_two_loads_are_made_once(spark, tmp_path):
    """A product comes with its first sale; neither half joins again to find its products."""
    tables = {
        "lineitem": "SELECT id AS l_orderkey, id % 7 AS l_partkey, id % 2 AS l_suppkey, 3.0D AS l_quantity, 9.5D AS l_extendedprice, 'R' AS l_returnflag,"
        " CAST(date_add(DATE'1995-12-01', CAST(id * 4 AS INT)) AS TIMESTAMP) AS l_shipdate FROM range(20)",
        "part": "SELECT id AS p_partkey, 'PROMO' AS p_type FROM range(7)",
        "orders": "SELECT id AS o_orderkey, CAST(date_add(DATE'1995-12-01', CAST(id * 4 AS INT)) AS TIMESTAMP) AS o_orderdate, 5.0D AS o_totalprice FROM range(20)",
    }
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(str(tmp_path / f"{name}.parquet"))
    first, second = catalog._halves(spark, str(tmp_path))
    for half in (first, second):
        assert "Join" not in half.products._jdf.queryExecution().executedPlan().toString()
    ids = [{row["product_id"] for row in half.products.collect()} for half in (first, second)]
    assert ids[0] == {row["product_id"] for row in first.sales.collect()} and len(ids[0]) == 8
    assert not ids[0] & ids[1] and len(ids[0] | ids[1]) == 14
