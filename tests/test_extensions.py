"""Lines set aside with their place, written extracts, estimates from sketches, and all slider stops at once."""

from __future__ import annotations

import itertools
from datetime import date

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import rollups
from shelfwise.params import LEAD_TIMES, OVERSTOCK_RATIOS, Params, SERVICE_LEVELS
from shelfwise.plans import dashboard, load, snapshot, storage
from shelfwise.schemas import STAGING_SALES
from shelfwise.sources import csv, sinks
from shelfwise.sources.versions import VersionedFolder

# --- bad lines -------------------------------------------------------------------------------------

GOOD = {
    "products": ["101,Laptops,Yes", "102,Laptops,No", "103,,"],
    "sales": ["101,15/01/2022,5,800.00", "102,1/2/2022,,600", "103,28/02/2022,7,"],
    "factors": ["15/01/2022,1.5,5.2,1.0", "1/2/2022,,,"],
}
BAD = {
    "products": ["x1,Laptops,Yes", ",Laptops,No", "104,Laptops"],
    "sales": ["101,31/02/2022,5,1", "101,15/01/2022,many,1", "101,15/01/2022,5,1,extra", ",15/01/2022,1,1", "101,15/01/2022,5,cheap"],
    "factors": ["2022-01-15,1,1,1", "16/01/2022,a,b,c", '"16/01/2022",1,1,1'],
}
FAULTS = {
    "products": ["product_id", "product_id", "fields"],
    "sales": ["sales_date", "inventory_quantity", "fields", "product_id", "product_cost"],
    "factors": ["sales_date", "gdp, inflation_rate, seasonal_factor", "sales_date"],
}


def files(tmp_path, bad: dict, end: str = "\n") -> dict[str, str]:
    paths = {}
    for kind, schema in load.STAGING.items():
        lines = [",".join(schema.names), *GOOD[kind][:1], *bad.get(kind, []), "", *GOOD[kind][1:]]
        folder = tmp_path / kind
        folder.mkdir()
        (folder / "a.csv").write_text(end.join(lines) + end)
        paths[kind] = str(folder)
    return paths


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_lines_that_cannot_be_read_are_set_aside_with_their_place(spark, tmp_path, end):
    bad = {kind: lines[:3] for kind, lines in BAD.items()}
    star, aside = load.load_tolerant(spark, files(tmp_path, bad, end))
    found = {(r.tbl, r.row_number): (r.fault, r.line, r.file.split("/")[-1]) for r in aside.collect()}
    want = {(k, n + 2): (FAULTS[k][n], line, "a.csv") for k, lines in bad.items() for n, line in enumerate(lines)}
    assert found == want and len(found) == 9
    assert (star.products.count(), star.sales.count(), star.factors.count()) == (3, 3, 2)
    store = storage.rebuild(star, str(tmp_path / "store"))
    assert [r.sales_id for r in store.sales().orderBy("sales_id").collect()] == [1, 2, 3]


def test_more_lines_than_are_tolerated_stop_the_load(spark, tmp_path):
    paths = files(tmp_path, BAD)
    with pytest.raises(load.LoadError, match=r"^11 lines cannot be read, 10 are tolerated; the first is row 2 of .*a\.csv: "):
        load.load_tolerant(spark, paths)
    star, aside = load.load_tolerant(spark, paths, tolerated=11)
    assert aside.count() == 11 and {(r.fault, r.line) for r in aside.collect()} == {(f, line) for k in BAD for f, line in zip(FAULTS[k], BAD[k])}
    clean, none = load.load_tolerant(spark, {k: paths[k] for k in paths} | files(_sub(tmp_path), {}), tolerated=0)
    assert none.count() == 0 and clean.sales.count() == 3


def _sub(path):
    (path / "clean").mkdir()
    return path / "clean"


def test_row_numbers_over_several_blocks_and_files(spark, tmp_path):
    rows = [f"{i},{i % 28 + 1}/1/2022,{i if i % 97 else 'bad'},1" for i in range(1, 4000)]
    for name, part in (("a", rows[:2500]), ("b", rows[2500:])):
        (tmp_path / f"{name}.csv").write_text("\n".join([",".join(STAGING_SALES.names), *part]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        placed = csv.read_staging_with_places(spark, str(tmp_path), STAGING_SALES)
        assert placed.select("file", "block").distinct().count() > 6
        found = csv.with_row_numbers(placed.where("inventory_quantity = 'bad'"), placed).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(found) == 41
    for r in found:
        part = rows[:2500] if r.file.endswith("a.csv") else rows[2500:]
        assert part[r.row_number - 1].split(",")[0] == r.product_id


# --- snapshots -------------------------------------------------------------------------------------


@pytest.fixture
def source(spark, tmp_path):
    path = str(tmp_path / "source")
    spark.range(10).write.parquet(path)
    return path


def extract_of(spark, tmp_path, source, **given):
    builds = []

    def build(rows):
        builds.append(1)
        return rows.withColumn("twice", F.col("id") * 2)

    kept = snapshot.ExtractSnapshot(spark, str(tmp_path / "kept"), lambda: [spark.read.parquet(source)], build, **given)
    return kept, builds


def test_an_extract_is_kept_until_its_time_or_its_source_changes(spark, tmp_path, source):
    now = [1000.0]
    kept, builds = extract_of(spark, tmp_path, source, ttl_seconds=300, clock=lambda: now[0])
    assert kept.is_stale()
    first = kept.get()
    now[0] += 299
    assert not kept.is_stale() and kept.get().count() == 10 and len(builds) == 1
    now[0] += 1
    kept.get()
    assert len(builds) == 2 and kept.state()["number"] == 2
    spark.range(20, 25).write.mode("overwrite").parquet(source)
    assert kept.is_stale() and sorted(r.id for r in kept.get().collect()) == [20, 21, 22, 23, 24]
    assert first.agg(F.sum("twice")).first()[0] == 90  # readers of the first keep it
    kept.refresh()
    assert kept.state()["number"] == 4
    other, _ = extract_of(spark, tmp_path, source, clock=lambda: now[0])
    assert not other.is_stale() and other.get().count() == 5  # another session finds it
    kept.sweep(keep=1)
    assert VersionedFolder(spark, str(tmp_path / "kept")).numbers() == [4] and kept.get().count() == 5


def test_an_extract_never_mixes_two_states_of_its_source(spark, tmp_path, source):
    tries = []

    def build(rows):
        tries.append(rows.count())
        if len(tries) == 1:
            spark.range(100, 103).write.mode("overwrite").parquet(source)
            return spark.range(1)
        return rows

    kept = snapshot.ExtractSnapshot(spark, str(tmp_path / "kept"), lambda: [spark.read.parquet(source)], build)
    assert sorted(r.id for r in kept.get().collect()) == [100, 101, 102] and tries == [10, 3]
    assert VersionedFolder(spark, str(tmp_path / "kept")).numbers() == [1]

    def restless(rows):
        spark.range(len(tries)).write.mode("append").parquet(source)
        return spark.range(1)

    never = snapshot.ExtractSnapshot(spark, str(tmp_path / "never"), lambda: [spark.read.parquet(source)], restless)
    with pytest.raises(snapshot.SourcesChanging):
        never.get()
    assert never.state() is None


# --- all slider stops ------------------------------------------------------------------------------


def test_the_grid_equals_the_figures_of_every_choice(spark, joined):
    totals = dashboard.totals_from_extract(dashboard.clean_extract(joined))
    steps = dashboard.kpi_steps(dashboard.sku_metrics(totals))
    for categories in (None, ("Laptops",), (), ("NONE",)):
        grid = {(r.overstock_ratio, r.lead_time_days, r.service_level): r for r in dashboard.kpi_grid(steps, categories).collect()}
        assert set(grid) == set(itertools.product(OVERSTOCK_RATIOS, LEAD_TIMES, SERVICE_LEVELS)) and len(grid) == 1170
        for choice in ((0.2, 1, "90%"), (0.5, 7, "95%"), (0.55, 30, "99%"), (0.8, 14, "95%")):
            params = Params(categories, overstock_ratio=choice[0], lead_time_days=choice[1], service_level=choice[2])
            kept = totals if categories is None else totals.where(F.col("product_category").isin(list(categories)))
            want = dashboard.kpis(dashboard.sku_metrics(kept, params), params).first()
            assert all(grid[choice][name] == want[name] for name in want.asDict()), choice


def test_the_stops_of_the_sliders():
    assert len(OVERSTOCK_RATIOS) == 13 and OVERSTOCK_RATIOS[6] == 0.5 and LEAD_TIMES == tuple(range(1, 31))


# --- estimates -------------------------------------------------------------------------------------


def test_sketches_merge_to_an_estimate_of_all_products(spark):
    rows = spark.range(60_000).select(
        (F.col("id") % 20_000).alias("product_id"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("product_category"),
        F.date_add(F.lit(date(2021, 1, 1)), (F.col("id") % 300).cast("int")).alias("sales_date"),
        F.lit(2).alias("inventory_quantity"),
        F.lit(1).cast("decimal(10,2)").alias("product_cost"),
    )
    by_month = rollups.sketched(rows, "product_category", F.trunc("sales_date", "MM").alias("month"))
    whole = rollups.sketched(rows, "product_category").select("product_category", rollups.distinct_products().alias("n"))
    merged = rollups.merge(by_month, "product_category").select("product_category", "units", rollups.distinct_products().alias("n"))
    exact = {r.product_category: r.n for r in rows.groupBy("product_category").agg(F.count_distinct("product_id").alias("n")).collect()}
    assert {r.product_category: r.n for r in merged.collect()} == {r.product_category: r.n for r in whole.collect()}
    assert all(abs(r.n - exact[r.product_category]) <= 0.03 * exact[r.product_category] for r in merged.collect())
    assert rollups.merge(rollups.rollup(rows, "product_category"), "product_category").columns.count(rollups.SKETCH) == 0


# --- one ordered file ------------------------------------------------------------------------------


def test_one_file_holds_the_list_in_its_order(spark, tmp_path):
    rows = spark.range(5000).select(
        "id", F.xxhash64("id").alias("key"), (F.col("id") % 2 == 0).alias("flag"), F.when(F.col("id") % 7 > 0, F.format_string('é, "%s"', "id")).alias("note")
    )
    ordered = rows.repartition(7).orderBy(F.desc("flag"), "key")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = sinks.export_csv(ordered, str(tmp_path / "list"), one_file=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [f for f in (tmp_path / "list").iterdir() if not f.name.startswith(".")]
    assert [f.name for f in files] == ["part-00000.csv"] and path == str(tmp_path / "list")
    assert [f.name for f in tmp_path.iterdir()] == ["list"]
    alone = str(tmp_path / "alone")
    sinks.with_text_flags(ordered).coalesce(1).write.option("encoding", "UTF-8").csv(alone, header=True)
    (only,) = [f for f in (tmp_path / "alone").iterdir() if f.name.startswith("part-")]
    assert files[0].read_bytes() == only.read_bytes() and files[0].read_text().startswith("id,key,flag,note\n")
    assert spark.read.csv(path, header=True).count() == 5000
    sinks.export_csv(ordered.where("false"), path, one_file=True)
    assert (tmp_path / "list" / "part-00000.csv").read_text() == "id,key,flag,note\n"
