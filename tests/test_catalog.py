"""Every query against its SQL, on given tables and on tables with hot keys, and the shape of the plans."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import SMOKE_FOLDER, entry, oracle_sql, queries
from check_oracle import connect, difference
from oracle.sql import ORACLES
from shelfwise import schemas
from shelfwise.catalog import QUERIES
from shelfwise.operators import joins, rollups
from shelfwise.operators.keys import _source_row
from shelfwise.plans import analysis, dashboard, load
from shelfwise.sources import tpch

SKEWED = [
    "q01_load_products",
    "q06_inventory_summary",
    "q08_demand_profile",
    "q18_reorder_points",
    "q21_overstock_register",
    "q23_monthly_trend",
    "q28_inflation_by_month",
    "q32_sku_metrics_filtered",
    "q24_monthly_trend_chart",
    "q31_category_stats_extract",
    "q32_totals_dirty",
    "q39_monthly_trend",
    "q41_action_list_places",
    "d01_table_checks_dirty",
    "q40_macro_snapshot",
]


@pytest.fixture(scope="module")
def given():
    return connect(SMOKE_FOLDER)


@pytest.fixture(scope="module")
def skewed_folder(spark, tmp_path_factory):
    """A third of all sales belong to one product, a third of the orders to one day."""
    folder = str(tmp_path_factory.mktemp("skewed"))
    lines = spark.read.parquet(f"{SMOKE_FOLDER}/lineitem.parquet")
    hot = F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "l_extendedprice"), F.lit(3)) == 0
    one = lines.select("l_partkey", "l_suppkey").first()
    lines.withColumns(
        {
            "l_partkey": F.when(hot, one.l_partkey).otherwise(F.col("l_partkey")),
            "l_suppkey": F.when(hot, one.l_suppkey).otherwise(F.col("l_suppkey")),
        }
    ).write.parquet(f"{folder}/lineitem.parquet")
    orders = spark.read.parquet(f"{SMOKE_FOLDER}/orders.parquet")
    day = orders.agg(F.min("o_orderdate")).first()[0]
    orders.withColumn(
        "o_orderdate", F.when(F.col("o_orderkey") % 3 == 0, F.lit(day).cast("timestamp_ntz")).otherwise(F.col("o_orderdate"))
    ).write.parquet(f"{folder}/orders.parquet")
    spark.read.parquet(f"{SMOKE_FOLDER}/part.parquet").write.parquet(f"{folder}/part.parquet")
    return folder


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, given, name):
    found = queries()[name](spark, SMOKE_FOLDER).toPandas()
    assert difference(found, given.execute(oracle_sql()[name]).df()) is None


@pytest.mark.parametrize("name", SKEWED)
def test_query_equals_sql_with_hot_keys(spark, skewed_folder, name):
    found = queries()[name](spark, skewed_folder).toPandas()
    assert difference(found, connect(skewed_folder).execute(oracle_sql()[name]).df()) is None


def test_entry(spark):
    assert entry(spark).count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_plans_stay_native(spark, name):
    plan = plan_of(queries()[name](spark, SMOKE_FOLDER))
    assert not re.search(r"Python|CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert "Window" not in plan or name == "q05_preview_sales"  # numbers five rows


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["q23_monthly_trend", "q24_monthly_trend_chart", "q39_monthly_trend", "q40_macro_snapshot"])
def test_sales_move_once_to_the_products(spark, skewed_folder, no_broadcast, name):
    """One exchange by product on either side; what follows is added up before it moves."""
    plan = plan_of(queries()[name](spark, skewed_folder))
    assert len(re.findall(r"Exchange hashpartitioning\(product_id", plan)) == 2
    assert not re.search(r"hashpartitioning\(product_id#\d+L?, [a-z_]", plan)


def test_extract_totals_have_an_exchange_of_their_own(spark, skewed_folder, no_broadcast):
    joined = analysis.inventory_summary(tpch.star(spark, skewed_folder).with_written_dimensions(), measured=False)
    plan = plan_of(dashboard.totals_from_extract(dashboard.clean_extract(joined)))
    assert "Exchange hashpartitioning(_groupingexpression#" in plan


def test_numbering_writes_one_copy(spark, tmp_path):
    """Rows of a Parquet file are told apart by their place in it; equal rows from elsewhere by numbers written first."""
    sales = tpch.raw_sales(spark, SMOKE_FOLDER)
    assert _source_row(sales) is not None and _source_row(spark.createDataFrame([(1,)], "a int")) is None
    doubled = sales.unionByName(sales)
    numbered = load.number_sales(doubled)
    assert numbered.agg(F.count("*"), F.count_distinct("sales_id"), F.max("sales_id")).first() == (2 * sales.count(),) * 3


def test_publishing_runs_nothing(spark, monkeypatch):
    monkeypatch.setattr(joins, "measured_bytes", lambda df: pytest.fail("a job ran"))
    star = tpch.star(spark, SMOKE_FOLDER)
    load.publish_star(star)
    assert "Hint" not in spark.table("inventory_summary")._jdf.queryExecution().analyzed().toString()
    load.drop_views(spark, [*schemas.TABLES, "inventory_summary"])


def test_sales_move_once_on_their_product(spark):
    """Both sides of the product join are partitioned by the grouping already."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(queries()["q12_promotion_impact"](spark, SMOKE_FOLDER))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange hashpartitioning\(product_id", plan)) == 2


@pytest.mark.parametrize("name", ["q11_promotion_impact_whole", "q12_promotion_impact_large"])
def test_many_products_are_dealt_before_they_are_added_up(spark, monkeypatch, name):
    """With more products than a task should hold, no task adds up before the exchange, and tasks follow the rows."""
    lines = spark.read.parquet(f"{SMOKE_FOLDER}/lineitem.parquet").count()
    before = {tuple(r) for r in queries()[name](spark, SMOKE_FOLDER).collect()}
    monkeypatch.setattr(rollups, "MAP_SIDE_GROUPS", 100)
    monkeypatch.setattr(rollups, "ROWS_PER_TASK", 500)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = queries()[name](spark, SMOKE_FOLDER)
        plan, after = plan_of(df), {tuple(r) for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tasks = -(-lines // 500)
    exchanges = re.findall(r"Exchange hashpartitioning\(product_id\S*, (\d+)\), (\w+).*\n\W*(\w+)", plan)
    assert [(n, why) for n, why, _ in exchanges] == [(str(tasks), "REPARTITION_BY_NUM")] * 2
    assert not [below for _, _, below in exchanges if "Aggregate" in below]
    assert after == before


def test_promotion_impact_holds_no_more_products_than_a_task_is_dealt(spark, monkeypatch):
    """Neither the sales nor the products are added up on the map side, and a task is dealt some ROWS_PER_TASK products at most."""
    monkeypatch.setattr(rollups, "MAP_SIDE_GROUPS", 50)
    monkeypatch.setattr(rollups, "ROWS_PER_TASK", 200)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(queries()["q12_promotion_impact"](spark, SMOKE_FOLDER))
        sales = tpch.star(spark, SMOKE_FOLDER).sales
        dealt = rollups.dealt(sales, "product_id", sales)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below = re.findall(r"Exchange hashpartitioning\(product_id.*\n\W*(\w+)", plan)
    assert len(below) == 2 and "HashAggregate" not in below
    held = dealt.groupBy(F.spark_partition_id()).agg(F.countDistinct("product_id").alias("n"))
    assert max(r.n for r in held.collect()) <= 2 * 200 < sales.select("product_id").distinct().count()


def test_few_products_are_added_up_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(rollups, "MAP_SIDE_GROUPS", 3)
    rows = spark.range(1000).select((F.col("id") % 3).alias("product_id"))
    many = spark.range(1000).select(F.col("id").alias("product_id"))
    assert rollups.dealt(rows, "product_id", rows) is rows
    assert rollups.dealt(many, "product_id", many).rdd.getNumPartitions() == 1


def test_hot_product_is_split_in_the_row_level_join(spark, skewed_folder):
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.files.maxPartitionBytes": "4KB",
        "spark.sql.files.openCostInBytes": "1",
        "spark.sql.shuffle.partitions": "24",
    }
    before = {key: spark.conf.get(key, None) for key in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        df = queries()["q06_inventory_summary"](spark, skewed_folder)
        found = df.toPandas()
        whole = df.agg(F.max(F.xxhash64(*df.columns)))
        whole.collect()
        plan = plan_of(whole)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert "skew=true" in plan
    assert difference(found, connect(skewed_folder).execute(oracle_sql()["q06_inventory_summary"]).df()) is None


def test_scans_read_the_columns_they_need(spark):
    plan = plan_of(queries()["q16_observations_per_product"](spark, SMOKE_FOLDER))
    assert re.findall(r"FileScan parquet \[([^\]]*)\]", plan)[0].count(",") == 1


def test_difference_notices(spark):
    pd = pytest.importorskip("pandas")
    a = pd.DataFrame({"k": [1, 2], "v": [1.0, None]})
    assert difference(a, a.iloc[::-1]) is None
    assert difference(a, a.assign(v=[1.0, 2.0])) and difference(a, a.head(1)) and difference(a, a.rename(columns={"v": "w"}))
    assert difference(a, a.assign(v=[1.0000001, None]))
