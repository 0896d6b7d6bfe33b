"""The queries of the catalog as DuckDB SQL over the same tables."""

from __future__ import annotations

TABLES = """
WITH raw_products AS (
    SELECT l_partkey * 1000000 + l_suppkey AS product_id,
           p_type AS product_category,
           CASE WHEN l_returnflag = 'R' THEN 'Yes' ELSE 'No' END AS promotions
    FROM lineitem JOIN part ON l_partkey = p_partkey
),
raw_factors AS (
    SELECT CAST(o_orderdate AS DATE) AS sales_date,
           CAST(o_totalprice AS DECIMAL(18,2)) AS gdp,
           CAST((o_orderkey % 400) / 100.0 AS DECIMAL(5,2)) AS inflation_rate,
           CAST(((855 + 25 * month(o_orderdate)) // 10) / 100.0 AS DECIMAL(5,2)) AS seasonal_factor
    FROM orders
),
products AS (
    SELECT product_id,
           MAX(product_category) AS product_category,
           CASE WHEN MAX(CASE WHEN promotions = 'Yes' THEN 1 ELSE 0 END) = 1 THEN 'Yes' ELSE 'No' END AS promotions
    FROM raw_products GROUP BY product_id
),
sales AS (
    SELECT l_partkey * 1000000 + l_suppkey AS product_id,
           CAST(l_shipdate AS DATE) AS sales_date,
           CAST(l_quantity AS INTEGER) AS inventory_quantity,
           CAST(l_extendedprice AS DECIMAL(10,2)) AS product_cost
    FROM lineitem
),
numbered AS (
    SELECT ROW_NUMBER() OVER (ORDER BY product_id, sales_date, inventory_quantity, product_cost) AS sales_id, *
    FROM sales
),
factors AS (
    SELECT sales_date,
           CAST(ROUND(CAST(AVG(gdp) AS DECIMAL(24,8)), 2) AS DECIMAL(18,2)) AS gdp,
           CAST(ROUND(CAST(AVG(inflation_rate) AS DECIMAL(24,8)), 2) AS DECIMAL(5,2)) AS inflation_rate,
           CAST(ROUND(CAST(AVG(seasonal_factor) AS DECIMAL(24,8)), 2) AS DECIMAL(5,2)) AS seasonal_factor
    FROM raw_factors GROUP BY sales_date
),
summary AS (
    SELECT s.sales_id, s.product_id, p.product_category, p.promotions, s.sales_date, s.inventory_quantity,
           s.product_cost, e.gdp, e.inflation_rate, e.seasonal_factor
    FROM numbered s
    JOIN products p ON s.product_id = p.product_id
    LEFT JOIN factors e ON s.sales_date = e.sales_date
)
"""

SUMMARY_COLUMNS = """
    sales_id, product_id, product_category, promotions, sales_date, inventory_quantity,
    CAST(product_cost AS DOUBLE) AS product_cost, CAST(gdp AS DOUBLE) AS gdp,
    CAST(inflation_rate AS DOUBLE) AS inflation_rate, CAST(seasonal_factor AS DOUBLE) AS seasonal_factor
"""

FILTERED = "product_category IN ('ECONOMY', 'PROMO') AND lower(promotions) = 'yes'"
NOT_PROMOTED = "lower(promotions) = 'no'"
WHOLE_MEAN = "CAST(SUM(inventory_quantity) // COUNT(inventory_quantity) AS INTEGER)"
MEAN = "AVG(CAST(inventory_quantity AS DOUBLE))"


def rounded(value: str, places: int) -> str:
    return f"CAST(ROUND(CAST({value} AS DECIMAL(28,{places + 6})), {places}) AS DOUBLE)"


def rounded_mean(total: str, n: str, places: int) -> str:
    """``total / n``, both whole and not negative, rounded half up in whole numbers."""
    return f"CAST((CAST({total} AS HUGEINT) * {2 * 10**places} + {n}) // (2 * {n}) AS DOUBLE) / {10**places}"


def batch(query: str, ratio: float = 0.5, days: int = 7, z: float = 1.65) -> str:
    """``query`` over ``metrics``, the SKU figures of the batch analysis."""
    return f"""{TABLES},
category_stats AS (
    SELECT product_category, AVG(CAST(inventory_quantity AS DOUBLE)) AS category_avg, STDDEV_SAMP(inventory_quantity) AS category_stdev
    FROM sales JOIN products USING (product_id) GROUP BY product_category
),
skus AS (
    SELECT s.product_id, p.product_category, p.promotions,
           AVG(CAST(s.inventory_quantity AS DOUBLE)) AS demand,
           CAST(SUM(s.product_cost) AS DOUBLE) / COUNT(s.product_cost) AS cost
    FROM sales s JOIN products p ON s.product_id = p.product_id
    GROUP BY s.product_id, p.product_category, p.promotions
),
metrics AS (
    SELECT k.*, cs.category_avg, cs.category_stdev,
           demand * {days} AS lead_time_demand,
           CAST({z} AS DOUBLE) * COALESCE(category_stdev, 0) * SQRT({days}) AS safety_stock,
           demand * {days} + CAST({z} AS DOUBLE) * COALESCE(category_stdev, 0) * SQRT({days}) AS reorder_point,
           demand < category_avg * CAST({ratio} AS DOUBLE) AS is_overstock
    FROM skus k JOIN category_stats cs ON k.product_category = cs.product_category
)
{query}"""


def board(query: str, where: str = "TRUE", ratio: float = 0.5, days: int = 7, z: float = 1.65) -> str:
    """``query`` over ``extract``, ``cat_stats`` and ``sku``, the figures of the dashboard."""
    return f"""{TABLES},
all_rows AS (
    SELECT s.product_id, trim(p.product_category) AS product_category, trim(p.promotions) AS promotions,
           s.sales_date, s.inventory_quantity, s.product_cost, e.gdp, e.inflation_rate, e.seasonal_factor
    FROM sales s
    JOIN products p ON s.product_id = p.product_id
    LEFT JOIN factors e ON s.sales_date = e.sales_date
    WHERE s.product_id IS NOT NULL AND p.product_category IS NOT NULL
      AND s.sales_date IS NOT NULL AND s.inventory_quantity IS NOT NULL
),
extract AS (SELECT * FROM all_rows WHERE {where}),
cat_stats AS (
    SELECT product_category, AVG(inventory_quantity) AS avg_demand,
           COALESCE(STDDEV_SAMP(inventory_quantity), 0) AS category_stdev,
           CAST(SUM(inventory_quantity) AS BIGINT) AS total_units
    FROM extract GROUP BY product_category
),
sku_means AS (
    SELECT product_id, product_category, promotions, AVG(inventory_quantity) AS sku_demand,
           COALESCE(CAST(SUM(product_cost) AS DOUBLE) / COUNT(product_cost), 0) AS sku_cost
    FROM extract GROUP BY product_id, product_category, promotions
),
sku AS (
    SELECT m.*, avg_demand, category_stdev,
           sku_demand * sku_cost AS capital_tied_up,
           sku_demand < avg_demand * CAST({ratio} AS DOUBLE) AS is_overstock,
           sku_demand * {days} AS lead_time_demand,
           CAST({z} AS DOUBLE) * category_stdev * SQRT({days}) AS safety_stock,
           sku_demand * {days} + CAST({z} AS DOUBLE) * category_stdev * SQRT({days}) AS reorder_point
    FROM sku_means m LEFT JOIN cat_stats c ON m.product_category = c.product_category
)
{query}"""


def season(labels: tuple[str, str, str], mean: str) -> str:
    low, normal, high = labels
    return f"""{TABLES}
SELECT CASE WHEN e.seasonal_factor < 0.95 THEN '{low}'
            WHEN e.seasonal_factor BETWEEN 0.95 AND 1.05 THEN '{normal}'
            ELSE '{high}' END AS season_band,
       {mean} AS avg_units_per_sale, COUNT(*) AS num_records
FROM sales s JOIN factors e ON s.sales_date = e.sales_date GROUP BY 1"""


def kpis(where: str, ratio: float, days: int, z: float, level: str) -> str:
    return board(
        f"""SELECT {rounded("COALESCE(SUM(CAST(capital_tied_up AS DECIMAL(28,6))) FILTER (WHERE is_overstock), 0)", 2)} AS capital_at_risk,
       COUNT(*) FILTER (WHERE is_overstock) AS flagged_skus,
       (SELECT CAST(COALESCE(SUM(inventory_quantity), 0) AS DOUBLE) FROM extract) AS units_analyzed,
       '{level}' AS service_level, {days} AS lead_time_days
FROM sku""",
        where, ratio, days, z,
    )


def trend(where: str) -> str:
    return board(
        """SELECT product_category, CAST(last_day(sales_date) AS DATE) AS sales_date,
       CAST(SUM(inventory_quantity) AS BIGINT) AS inventory_quantity
FROM extract GROUP BY 1, 2""",
        where,
    )


def macro(where: str, form: str) -> str:
    one = " UNION ALL ".join(
        f"""SELECT '{name}' AS metric, {form.format(f"CAST(SUM({name}) AS DOUBLE) / COUNT({name})")} AS "Average",
       {form.format(f"CAST(MIN({name}) AS DOUBLE)")} AS "Minimum",
       {form.format(f"CAST(MAX({name}) AS DOUBLE)")} AS "Maximum"
FROM extract HAVING COUNT({name}) > 0"""
        for name in ("gdp", "inflation_rate", "seasonal_factor")
    )
    return board(one, where)


def sku_rows(where: str, ratio: float, days: int, z: float) -> str:
    return board(
        f"""SELECT product_id, product_category, promotions, sku_demand, sku_cost, avg_demand,
       {rounded("category_stdev", 6)} AS category_stdev, {rounded("capital_tied_up", 6)} AS capital_tied_up,
       is_overstock, lead_time_demand, {rounded("safety_stock", 6)} AS safety_stock,
       {rounded("reorder_point", 6)} AS reorder_point
FROM sku""",
        where, ratio, days, z,
    )


COUNTS = """
SELECT 'product_information' AS tbl, COUNT(*) AS row_count FROM {}
UNION ALL SELECT 'sales_data', COUNT(*) FROM sales
UNION ALL SELECT 'external_factors', COUNT(*) FROM {}
"""

FACTOR_COLUMNS = """sales_date, CAST(gdp AS DOUBLE) AS gdp, CAST(inflation_rate AS DOUBLE) AS inflation_rate,
       CAST(seasonal_factor AS DOUBLE) AS seasonal_factor"""

SALES_COLUMNS = "sales_id, product_id, sales_date, inventory_quantity, CAST(product_cost AS DOUBLE) AS product_cost"

MONTH = "CAST(date_trunc('month', sales_date) AS DATE)"

ACTION_LIST = f"""SELECT product_id AS "Product ID", product_category AS "Category", promotions AS "Promoted",
       sku_demand AS "Avg Daily Demand", lead_time_demand AS "Lead Time Demand",
       {rounded("safety_stock", 6)} AS "Safety Stock Buffer",
       {rounded("reorder_point", 6)} AS "Calculated Reorder Point",
       {rounded("capital_tied_up", 6)} AS "Capital Tied Up ($)",
       {{flag}} AS "Overstock Risk Flag"
FROM sku"""

KPI_CARDS = """, figures AS (
    SELECT CAST(SUM(CAST(capital_tied_up AS DECIMAL(28,6))) FILTER (WHERE is_overstock) AS DOUBLE) AS capital,
           COUNT(*) FILTER (WHERE is_overstock) AS flagged,
           (SELECT SUM(inventory_quantity) FROM extract) AS units
    FROM sku
)
SELECT 'Capital at Risk' AS label, format('${:,.2f}', capital) AS value, 'Demand < 50% of baseline' AS note FROM figures
UNION ALL SELECT 'Flagged Overstock SKUs', format('{:,} SKUs', flagged), 'Low-velocity target' FROM figures
UNION ALL SELECT 'Inventory Quantity Analyzed', format('{:,} Units', CAST(units AS BIGINT)), 'Filtered dataset' FROM figures
UNION ALL SELECT 'Target Service Level', '95%', 'Lead time: 7 days' FROM figures"""

CHECKS = """
SELECT "check", CAST(expected AS BIGINT) AS expected, CAST(actual AS BIGINT) AS actual, ok FROM (
    SELECT 'product_information: repeated product_id' AS "check", 0 AS expected,
           COUNT(product_id) - COUNT(DISTINCT product_id) AS actual, actual = 0 AS ok FROM products
    UNION ALL SELECT 'product_information: missing product_id', 0, COUNT(*) - COUNT(product_id) AS a, a = 0 FROM products
    UNION ALL SELECT 'external_factors: repeated sales_date', 0, COUNT(sales_date) - COUNT(DISTINCT sales_date) AS a, a = 0 FROM factors
    UNION ALL SELECT 'external_factors: missing sales_date', 0, COUNT(*) - COUNT(sales_date) AS a, a = 0 FROM factors
    UNION ALL SELECT 'sales_data: missing product_id', 0, COUNT(*) - COUNT(product_id) AS a, a = 0 FROM sales
    UNION ALL SELECT 'sales_data: missing sales_date', 0, COUNT(*) - COUNT(sales_date) AS a, a = 0 FROM sales
    UNION ALL SELECT 'sales_data: unknown product_id', 0, COUNT(*) AS a, a = 0 FROM sales ANTI JOIN products USING (product_id) WHERE product_id IS NOT NULL
    UNION ALL SELECT 'product_information: least rows', 1000, COUNT(*) AS a, a >= 1000 FROM products
    UNION ALL SELECT 'sales_data: least rows', 1000, COUNT(*) AS a, a >= 1000 FROM sales
    UNION ALL SELECT 'external_factors: least rows', 500, COUNT(*) AS a, a >= 500 FROM factors
    UNION ALL SELECT 'inventory_summary: missing product_category', 0, COUNT(*) AS a, a = 0
        FROM sales JOIN products USING (product_id) WHERE product_category IS NULL
    UNION ALL SELECT 'product_information: product_category over 50', 0, COUNT(*) FILTER (WHERE length(product_category) > 50) AS a, a = 0 FROM products
    UNION ALL SELECT 'product_information: promotions over 10', 0, COUNT(*) FILTER (WHERE length(promotions) > 10) AS a, a = 0 FROM products
)
"""

REPORT_SIZES = f""", months AS (SELECT DISTINCT product_category, {MONTH} AS month_start FROM sales JOIN products USING (product_id))
SELECT 'category_volatility' AS report, COUNT(DISTINCT product_category) AS row_count FROM metrics
UNION ALL SELECT 'overstock_capital', COUNT(DISTINCT product_category) FROM metrics WHERE is_overstock
UNION ALL SELECT 'demand_trend', COUNT(*) FROM months
UNION ALL SELECT 'top10_reorder', LEAST(COUNT(*), 10) FROM metrics
UNION ALL SELECT 'promotion_impact', COUNT(DISTINCT promotions) FROM metrics
UNION ALL SELECT 'seasonal_demand_bands',
    COUNT(DISTINCT CASE WHEN seasonal_factor < 0.95 THEN 0 WHEN seasonal_factor <= 1.05 THEN 1 ELSE 2 END)
    FROM sales JOIN factors USING (sales_date)
UNION ALL SELECT 'understocking_risk', LEAST(COUNT(*), 10) FROM metrics
UNION ALL SELECT 'turnover_by_category', COUNT(DISTINCT product_category) FROM metrics
UNION ALL SELECT 'inflation_demand', COUNT(DISTINCT {MONTH}) FROM sales JOIN factors USING (sales_date)"""

ORACLES: dict[str, str] = {
    # load
    "q01_load_products": f"{TABLES} SELECT * FROM products",
    "q02_load_sales": f"{TABLES} SELECT {SALES_COLUMNS} FROM numbered",
    "q03_load_factors": f"{TABLES} SELECT {FACTOR_COLUMNS} FROM factors",
    "q04_staging_counts": TABLES + COUNTS.format("raw_products", "raw_factors"),
    "q05_table_counts": TABLES + COUNTS.format("products", "factors"),
    "q05_preview_products": f"{TABLES} SELECT * FROM products ORDER BY product_id LIMIT 5",
    "q05_preview_sales": f"{TABLES} SELECT {SALES_COLUMNS} FROM numbered ORDER BY sales_id LIMIT 5",
    "q05_preview_factors": f"{TABLES} SELECT {FACTOR_COLUMNS} FROM factors ORDER BY sales_date LIMIT 5",
    "s01_csv_load": f"""{TABLES}
SELECT 'product_information' AS tbl, COUNT(*) AS row_count, CAST(NULL AS BIGINT) AS units, CAST(NULL AS DOUBLE) AS cost FROM products
UNION ALL SELECT 'sales_data', COUNT(*), CAST(SUM(inventory_quantity) AS BIGINT), CAST(SUM(product_cost) AS DOUBLE) FROM sales
UNION ALL SELECT 'external_factors', COUNT(*), NULL, NULL FROM factors""",
    "s06_scan_order_ids": f"""{TABLES}
SELECT COUNT(*) AS sales, CAST(1 AS BIGINT) AS first_id, COUNT(*) AS last_id, COUNT(*) AS distinct_ids FROM sales""",
    # joined rows
    "q06_inventory_summary": f"{TABLES} SELECT {SUMMARY_COLUMNS} FROM summary",
    "q07_coverage_gap": f"{TABLES} SELECT COUNT(*) AS sales_without_gdp FROM summary WHERE gdp IS NULL",
    "q07_uncovered_dates": f"""{TABLES}
SELECT sales_date, COUNT(*) AS num_sales FROM sales ANTI JOIN factors USING (sales_date) GROUP BY sales_date""",
    # batch analysis
    "q08_demand_profile": f"""{TABLES}
SELECT product_id, COUNT(*) AS num_sales_records, {WHOLE_MEAN} AS avg_units_per_sale,
       MIN(inventory_quantity) AS min_units, MAX(inventory_quantity) AS max_units,
       {rounded("STDDEV_SAMP(inventory_quantity)", 6)} AS demand_volatility
FROM sales GROUP BY product_id""",
    "q09_category_velocity": f"""{TABLES}
SELECT product_category, COUNT(*) AS total_records, CAST(SUM(inventory_quantity) AS BIGINT) AS total_units_moved,
       {WHOLE_MEAN} AS avg_units_per_sale, {rounded("AVG(product_cost)", 6)} AS avg_unit_cost
FROM sales JOIN products USING (product_id) GROUP BY product_category""",
    "q10_product_reorder_points": f"""{TABLES}, stats AS (
    SELECT product_id, {WHOLE_MEAN} AS avg_demand, STDDEV_SAMP(inventory_quantity) AS sd FROM sales GROUP BY product_id
)
SELECT product_id, avg_demand, {rounded("sd", 6)} AS demand_stdev, avg_demand * 7 AS lead_time_demand,
       {rounded("CAST(1.65 AS DOUBLE) * COALESCE(sd, 0) * SQRT(7)", 6)} AS safety_stock,
       {rounded("avg_demand * 7 + CAST(1.65 AS DOUBLE) * COALESCE(sd, 0) * SQRT(7)", 6)} AS reorder_point
FROM stats""",
    "q11_promotion_impact_whole": f"""{TABLES}
SELECT promotions, {WHOLE_MEAN} AS avg_units_per_sale, COUNT(*) AS num_records
FROM sales JOIN products USING (product_id) GROUP BY promotions""",
    "q12_promotion_impact": f"""{TABLES}
SELECT promotions, {MEAN} AS avg_units_per_sale, COUNT(*) AS num_records
FROM sales JOIN products USING (product_id) GROUP BY promotions""",
    "q13_season_impact_whole": season(("Low season", "Normal", "High season"), WHOLE_MEAN),
    "q14_season_impact": season(("Low season", "Normal", "High season"), MEAN),
    "q15_season_chart": season(("Low Season", "Normal", "High Season"), MEAN),
    "q16_observations_per_product": f"{TABLES} SELECT product_id, COUNT(*) AS num_records FROM sales GROUP BY product_id",
    "q17_observation_histogram": f"""{TABLES}
SELECT num_records, COUNT(*) AS how_many_products
FROM (SELECT product_id, COUNT(*) AS num_records FROM sales GROUP BY product_id) GROUP BY num_records""",
    "q17_single_observation_share": f"""{TABLES}
SELECT COUNT(*) AS products, COUNT(*) FILTER (WHERE n = 1) AS single,
       {rounded_mean("COUNT(*) FILTER (WHERE n = 1) * 100", "COUNT(*)", 1)} AS single_share_pct
FROM (SELECT product_id, COUNT(*) AS n FROM sales GROUP BY product_id)""",
    "q18_reorder_points": batch(
        f"""SELECT product_id, product_category, demand AS product_avg_demand, {rounded("category_stdev", 6)} AS category_stdev,
       lead_time_demand, {rounded("safety_stock", 6)} AS safety_stock, {rounded("reorder_point", 6)} AS reorder_point
FROM metrics"""
    ),
    "q19_top_reorder": batch(
        f"""SELECT product_id, product_category, promotions, {rounded("demand", 1)} AS avg_demand,
       {rounded("reorder_point", 1)} AS reorder_point
FROM metrics ORDER BY 5 DESC, product_id LIMIT 10"""
    ),
    "q20_top_reorder_chart": batch(
        f"""SELECT product_id, product_category, {rounded("reorder_point", 1)} AS reorder_point,
       product_id || ' (' || product_category || ')' AS label
FROM metrics ORDER BY 3 DESC, product_id LIMIT 10"""
    ),
    "q21_overstock_register": batch(
        f"""SELECT product_id, product_category, {rounded("demand", 1)} AS product_avg_demand,
       {rounded("category_avg", 1)} AS category_avg_demand, {rounded("cost", 2)} AS avg_unit_cost,
       {rounded("demand * cost", 2)} AS capital_tied_up_estimate,
       CASE WHEN is_overstock THEN 'Overstock risk — low velocity' ELSE 'Normal' END AS risk_flag
FROM metrics WHERE is_overstock"""
    ),
    "q22_capital_by_category": batch(
        f"""SELECT product_category, {rounded("SUM(CAST(demand * cost AS DECIMAL(28,6)))", 2)} AS total_capital_tied_up
FROM metrics WHERE is_overstock GROUP BY product_category"""
    ),
    "q23_monthly_trend": f"""{TABLES}
SELECT product_category, {MONTH} AS month_start, COUNT(*) AS num_transactions,
       {rounded_mean("SUM(inventory_quantity)", "COUNT(inventory_quantity)", 1)} AS avg_units_per_sale, CAST(SUM(inventory_quantity) AS BIGINT) AS total_units_moved
FROM sales JOIN products USING (product_id) GROUP BY 1, 2""",
    "q24_monthly_trend_chart": f"""{TABLES}
SELECT product_category, {MONTH} AS month_start, CAST(SUM(inventory_quantity) AS BIGINT) AS total_units_moved
FROM sales JOIN products USING (product_id) GROUP BY 1, 2""",
    "q25_category_volatility": f"""{TABLES}
SELECT product_category, {rounded("STDDEV_SAMP(inventory_quantity)", 6)} AS category_stdev
FROM sales JOIN products USING (product_id) GROUP BY product_category""",
    "q26_stockout_risk": batch(
        f"""SELECT product_id, product_category, {rounded("demand", 1)} AS avg_demand,
       {rounded("reorder_point", 1)} AS reorder_point,
       'ID ' || product_id || ' (' || left(product_category, 4) || ')' AS label
FROM metrics ORDER BY 3 DESC, product_id LIMIT 10"""
    ),
    "q27_turnover_by_category": f"""{TABLES}
SELECT product_category,
       {rounded_mean("SUM(inventory_quantity)", "COUNT(DISTINCT product_id)", 1)} AS avg_units_per_product,
       {rounded("AVG(product_cost)", 2)} AS avg_unit_cost
FROM sales JOIN products USING (product_id) GROUP BY product_category""",
    "q28_inflation_by_month": f"""{TABLES}
SELECT {MONTH} AS month_start, CAST(SUM(inflation_rate) AS DOUBLE) / COUNT(inflation_rate) AS avg_inflation,
       CAST(SUM(inventory_quantity) AS BIGINT) AS total_units_moved
FROM sales JOIN factors USING (sales_date) GROUP BY 1""",
    # dashboard
    "q29_clean_extract": f"{TABLES} SELECT {SUMMARY_COLUMNS} FROM summary",
    "q30_filtered_extract": f"{TABLES} SELECT {SUMMARY_COLUMNS} FROM summary WHERE {FILTERED}",
    "f01_filter_counts": board(
        f"""SELECT COUNT(*) AS everything,
       COUNT(*) FILTER (WHERE product_category IN ('ECONOMY', 'PROMO')) AS two_categories,
       CAST(0 AS BIGINT) AS no_category,
       COUNT(*) FILTER (WHERE product_category = 'NONE SUCH') AS unknown_category,
       COUNT(*) FILTER (WHERE lower(promotions) = 'yes') AS promoted,
       COUNT(*) FILTER (WHERE {NOT_PROMOTED}) AS not_promoted,
       COUNT(*) FILTER (WHERE {FILTERED}) AS combined,
       COUNT(*) AS unreadable_sku
FROM all_rows"""
    ),
    "f02_not_promoted": board(
        "SELECT product_id, product_category, promotions, COUNT(*) AS num_rows FROM extract GROUP BY 1, 2, 3", NOT_PROMOTED
    ),
    "f03_one_sku": f"{TABLES} SELECT {SUMMARY_COLUMNS} FROM summary WHERE product_id = 23000007",
    "q31_category_stats": board(
        f"SELECT product_category, avg_demand, {rounded('category_stdev', 6)} AS category_stdev, total_units FROM cat_stats"
    ),
    "q31_category_stats_filtered": board(
        f"SELECT product_category, avg_demand, {rounded('category_stdev', 6)} AS category_stdev, total_units FROM cat_stats",
        FILTERED,
    ),
    "q32_sku_metrics": sku_rows("TRUE", 0.5, 7, 1.65),
    "q32_sku_metrics_filtered": sku_rows(FILTERED, 0.65, 14, 2.33),
    "q33_overstock_list": board(
        f"""SELECT product_id AS "Product ID", product_category AS "Category", promotions AS "Promoted",
       sku_demand AS "Avg Daily Demand", sku_cost AS "Unit Cost ($)", {rounded("capital_tied_up", 6)} AS "Capital Tied Up ($)"
FROM sku WHERE is_overstock"""
    ),
    "q33_overstock_text": board(
        """SELECT product_id AS "Product ID", product_category AS "Category", promotions AS "Promoted",
       format('{:.1f}', sku_demand) AS "Avg Daily Demand", format('${:,.2f}', sku_cost) AS "Unit Cost ($)",
       format('${:,.2f}', capital_tied_up) AS "Capital Tied Up ($)"
FROM sku WHERE is_overstock"""
    ),
    "q34_kpis": kpis("TRUE", 0.5, 7, 1.65, "95%"),
    "q34_kpis_not_promoted": kpis(NOT_PROMOTED, 0.35, 3, 1.28, "90%"),
    "q34_kpi_cards": board(KPI_CARDS),
    "q35_data_summary": board(
        """SELECT COUNT(*) AS records, COUNT(DISTINCT product_id) AS skus,
       (SELECT MIN(sales_date) FROM extract) AS first_date, (SELECT MAX(sales_date) FROM extract) AS last_date
FROM all_rows""",
        FILTERED,
    ),
    "q35_summary_text": board(
        """SELECT format('Loaded {:,} records across {:,} SKUs.', COUNT(*), COUNT(DISTINCT product_id)) AS loaded,
       'Filtered period: ' || strftime((SELECT MIN(sales_date) FROM extract), '%b %Y') || ' – '
           || strftime((SELECT MAX(sales_date) FROM extract), '%b %Y') AS period
FROM all_rows""",
        FILTERED,
    ),
    "q36_capital_by_category": board(
        f"""SELECT product_category, {rounded("SUM(CAST(capital_tied_up AS DECIMAL(28,6)))", 2)} AS capital_tied_up,
       {rounded("CAST(SUM(CAST(capital_tied_up AS DECIMAL(28,6))) AS DOUBLE) / 1000", 4)} AS capital_k
FROM sku WHERE is_overstock GROUP BY product_category"""
    ),
    "q37_volatility_by_category": board(
        f"SELECT product_category, {rounded('category_stdev', 6)} AS category_stdev FROM cat_stats"
    ),
    "q38_top_reorder_targets": board(
        f"""SELECT product_id, product_category, promotions,
       'ID ' || product_id || ' (' || left(product_category, 4) || ')' AS product_label,
       sku_demand, {rounded("reorder_point", 6)} AS reorder_point
FROM sku ORDER BY 6 DESC, product_id, promotions LIMIT 10"""
    ),
    "q39_monthly_trend": trend("TRUE"),
    "q39_monthly_trend_filtered": trend(FILTERED),
    "q40_macro_snapshot": macro("TRUE", "{}"),
    "q40_macro_text": macro(FILTERED, "format('{{:.3f}}', {})"),
    "q41_action_list": board(ACTION_LIST.format(flag="is_overstock")),
    "q41_action_list_text": board(
        """SELECT product_id AS "Product ID", product_category AS "Category", promotions AS "Promoted",
       format('{:.1f}', sku_demand) AS "Avg Daily Demand", format('{:.1f}', lead_time_demand) AS "Lead Time Demand",
       format('{:.1f}', safety_stock) AS "Safety Stock Buffer", format('{:.1f}', reorder_point) AS "Calculated Reorder Point",
       format('${:,.2f}', capital_tied_up) AS "Capital Tied Up ($)", is_overstock AS "Overstock Risk Flag"
FROM sku"""
    ),
    "q42_action_list_export": board(ACTION_LIST.format(flag="CASE WHEN is_overstock THEN 'True' ELSE 'False' END")),
    "q43_categories": board("SELECT DISTINCT product_category FROM extract"),
    "s12_chart_reports": batch(REPORT_SIZES),
    # data quality
    "d01_table_checks": TABLES + CHECKS,
    "d08_rejects": f"""{TABLES}
SELECT 'sales_date' AS column_name, COUNT(product_cost) AS num_rejects, COUNT(DISTINCT product_cost) AS num_values FROM sales
UNION ALL SELECT 'product_cost', COUNT(sales_date), COUNT(DISTINCT sales_date) FROM sales""",
    "d09_conflicting_promotions": f"""{TABLES}
SELECT product_id, COUNT(*) AS num_rows, COUNT(*) FILTER (WHERE promotions = 'Yes') AS num_yes
FROM raw_products GROUP BY product_id HAVING COUNT(DISTINCT promotions) > 1""",
    "d09_repeated_dates": f"{TABLES} SELECT sales_date, COUNT(*) AS num_rows FROM raw_factors GROUP BY sales_date HAVING COUNT(*) > 1",
}


def with_quantity(sql: str, quantity: str) -> str:
    """The same question about sales whose quantities are ``quantity``, which need not be whole or small."""
    other = sql.replace("CAST(l_quantity AS INTEGER) AS inventory_quantity", f"{quantity} AS inventory_quantity")
    other = other.replace(WHOLE_MEAN, "CAST(TRUNC(SUM(inventory_quantity) / COUNT(inventory_quantity)) AS INTEGER)")
    return other.replace("CAST(SUM(inventory_quantity) AS BIGINT)", "SUM(inventory_quantity)")


EIGHTHS = "CAST(l_quantity AS DOUBLE) / 8"
LARGE = "CAST(l_quantity AS BIGINT) * 100000000"
for _name in ("q08_demand_profile", "q10_product_reorder_points", "q12_promotion_impact", "q25_category_volatility", "q28_inflation_by_month"):
    ORACLES[f"{_name}_eighths"] = with_quantity(ORACLES[_name], EIGHTHS)
ORACLES["q12_promotion_impact_large"] = with_quantity(ORACLES["q12_promotion_impact"], LARGE)
ORACLES["q25_category_volatility_large"] = with_quantity(
    f"""{TABLES}
SELECT product_category, {rounded("STDDEV_SAMP(inventory_quantity)", 0)} AS category_stdev
FROM sales JOIN products USING (product_id) GROUP BY product_category""",
    LARGE,
)

ORACLES["q23_monthly_trend_eighths"] = f"""{TABLES}
SELECT product_category, {MONTH} AS month_start, COUNT(*) AS num_transactions,
       {rounded_mean("SUM(inventory_quantity)", "(8 * COUNT(inventory_quantity))", 1)} AS avg_units_per_sale,
       CAST(SUM(inventory_quantity) AS DOUBLE) / 8 AS total_units_moved
FROM sales JOIN products USING (product_id) GROUP BY 1, 2"""
ORACLES["q23_monthly_trend_places"] = f"""{TABLES}
SELECT ROW_NUMBER() OVER (ORDER BY product_category, month_start) AS place, product_category, month_start
FROM (SELECT DISTINCT product_category, {MONTH} AS month_start FROM sales JOIN products USING (product_id))"""
ORACLES["q41_action_list_places"] = board(
    """SELECT ROW_NUMBER() OVER (ORDER BY is_overstock DESC, capital_tied_up DESC, product_id) AS place,
       product_id AS "Product ID", is_overstock AS "Overstock Risk Flag" FROM sku"""
)
for _name in ("q31_category_stats", "q32_sku_metrics"):
    ORACLES[f"{_name}_extract"] = ORACLES[_name]
ORACLES["q31_category_stats_extract_filtered"] = ORACLES["q31_category_stats_filtered"]
ORACLES["s08_view_by_sql"] = f"""{TABLES}
SELECT product_category, promotions, COUNT(*) AS num_sales, CAST(SUM(inventory_quantity) AS BIGINT) AS units, COUNT(gdp) AS with_gdp
FROM summary GROUP BY 1, 2"""

DIRTY = f"""{TABLES}, dirty AS (
    SELECT product_id, product_category, CASE WHEN product_id % 3 <> 0 THEN promotions END AS promotions, sales_date,
           CAST(inventory_quantity AS DOUBLE) AS inventory_quantity,
           CASE WHEN product_id % 17 <> 4 THEN CAST(product_cost AS DOUBLE) END AS product_cost, CAST(NULL AS DOUBLE) AS gdp,
           CAST(inflation_rate AS DOUBLE) AS inflation_rate, CAST(seasonal_factor AS DOUBLE) AS seasonal_factor
    FROM summary
    WHERE product_id % 7 <> 1 AND product_id % 13 <> 3 AND product_id % 11 <> 2
)
"""
ORACLES["q29_clean_extract_dirty"] = DIRTY + "SELECT * FROM dirty"
ORACLES["q32_totals_dirty"] = DIRTY + """SELECT product_id, product_category, promotions, COUNT(*) AS num_rows,
       SUM(inventory_quantity) AS units, COUNT(product_cost) AS num_costs FROM dirty GROUP BY 1, 2, 3"""
ORACLES["q40_macro_dirty"] = DIRTY + " UNION ALL ".join(
    f"""SELECT '{name}' AS metric, {rounded(f"AVG({name})", 6)} AS "Average", MIN({name}) AS "Minimum", MAX({name}) AS "Maximum" FROM dirty"""
    for name in ("inflation_rate", "seasonal_factor")
)

DIRTY_CHECKS = CHECKS
for _name in ("products", "sales", "factors"):
    for _word in ("FROM", "JOIN"):
        DIRTY_CHECKS = DIRTY_CHECKS.replace(f"{_word} {_name}", f"{_word} poor_{_name}")
ORACLES["d01_table_checks_dirty"] = f"""{TABLES}, marked AS (
    SELECT product_id, CASE WHEN product_id % 10 <> 5 THEN product_category END AS product_category,
           CASE WHEN product_id % 10 = 6 THEN 'promoted twice' ELSE promotions END AS promotions
    FROM products
),
poor_products AS (SELECT * FROM marked UNION ALL SELECT * FROM marked WHERE product_id % 10 = 4),
poor_sales AS (
    SELECT CASE WHEN product_id % 4 <> 0 THEN product_id END AS sales_id,
           CASE WHEN product_id % 10 = 2 THEN -product_id WHEN product_id % 10 <> 1 THEN product_id END AS product_id,
           CASE WHEN product_id % 10 <> 3 THEN sales_date END AS sales_date
    FROM sales
),
poor_factors AS (
    SELECT CASE WHEN month(sales_date) <> 3 THEN sales_date END AS sales_date FROM factors
    UNION ALL SELECT sales_date FROM factors WHERE month(sales_date) = 2
)
{DIRTY_CHECKS}
UNION ALL SELECT 'sales_data: repeated sales_id', 0, COUNT(*) AS a, a = 0
    FROM (SELECT sales_id FROM poor_sales WHERE sales_id IS NOT NULL GROUP BY sales_id HAVING COUNT(*) > 1)
UNION ALL SELECT 'sales_data: missing sales_id', 0, COUNT(*) - COUNT(sales_id) AS a, a = 0 FROM poor_sales"""

# --- the versioned store ---

ORACLES["s04_rebuilt_twice"] = f"""{TABLES}
SELECT 'product_information' AS tbl, COUNT(*) AS row_count, CAST(NULL AS BIGINT) AS units, CAST(NULL AS BIGINT) AS last_id, 2 AS version FROM products
UNION ALL SELECT 'sales_data', COUNT(*), CAST(SUM(inventory_quantity) AS BIGINT), COUNT(*), 2 FROM sales
UNION ALL SELECT 'external_factors', COUNT(*), NULL, NULL, 2 FROM factors"""
IN_TWO_LOADS = TABLES.replace(
    "ORDER BY product_id, sales_date", "ORDER BY sales_date >= DATE '1996-01-01', product_id, sales_date"
)
ORACLES["d01_checks_of_loads"] = f"""{TABLES}{CHECKS}
UNION ALL SELECT 'sales_data: repeated sales_id', 0, 0, TRUE UNION ALL SELECT 'sales_data: missing sales_id', 0, 0, TRUE"""
ORACLES["s06_ids_go_on"] = f"{IN_TWO_LOADS} SELECT {SALES_COLUMNS} FROM numbered"
ORACLES["q06_summary_of_months"] = f"""{IN_TWO_LOADS}
SELECT {SUMMARY_COLUMNS} FROM summary WHERE sales_date BETWEEN DATE '1995-12-01' AND DATE '1996-02-29'"""
for _name in ("q18_reorder_points", "q23_monthly_trend", "q39_monthly_trend"):
    ORACLES[f"{_name}_refreshed"] = ORACLES[_name]

# --- files with bad lines, a written extract, approximate counts, all sliders ---

ORACLES["d08_nine_bad_lines"] = f"""{TABLES}, few AS (SELECT n_nationkey AS key, n_name FROM nation WHERE n_nationkey < 4)
SELECT 'product_information' AS tbl, CAST(NULL AS VARCHAR) AS fault, CAST(NULL AS VARCHAR) AS line, COUNT(*) AS num_rows FROM products
UNION ALL SELECT 'sales_data', NULL, NULL, COUNT(*) FROM sales
UNION ALL SELECT 'external_factors', NULL, NULL, COUNT(*) FROM factors
UNION ALL SELECT 'products', 'product_id', 'P' || key || ',' || n_name || ',No', 1 FROM few WHERE key % 2 = 0
UNION ALL SELECT 'sales', 'sales_date, inventory_quantity', r_regionkey || ',30/02/2021,x,1.5', 1 FROM region
UNION ALL SELECT 'factors', 'fields', key || ',' || n_name, 1 FROM few WHERE key % 2 = 1"""
ORACLES["d08_eleven_bad_lines"] = """
SELECT (SELECT COUNT(*) FROM lineitem) AS rows_offered, (SELECT COUNT(*) FROM region) + COUNT(*) AS bad_lines, 0 AS versions
FROM nation WHERE n_nationkey < 6"""
ORACLES["s10_extract_snapshot"] = f"""{TABLES}
SELECT COUNT(*) AS row_count, CAST(SUM(inventory_quantity) AS BIGINT) AS units, COUNT(gdp) AS with_gdp,
       COUNT(*) > 0 AS has_rows, COUNT(*) FILTER (WHERE product_category = 'NONE SUCH') = 0 AS none_left, '1-1-2' AS versions
FROM summary"""
ORACLES["q27_turnover_estimate"] = f"SELECT *, TRUE AS is_near, TRUE AS same_cost FROM ({ORACLES['q27_turnover_by_category']})"
ORACLES["q35_data_summary_estimate"] = f"SELECT *, TRUE AS same_rest, TRUE AS is_near FROM ({ORACLES['q35_data_summary']})"


def kpi_grid(where: str, categories: str) -> str:
    """Every stop of the three sliders; ``where`` moves the baselines, ``categories`` only chooses among them."""
    return board(
        f""", ratios AS (SELECT unnest(range(20, 81, 5)) / 100 AS overstock_ratio),
steps AS (
    SELECT overstock_ratio,
           {rounded("COALESCE(SUM(CAST(capital_tied_up AS DECIMAL(28,6))) FILTER (WHERE sku_demand < avg_demand * overstock_ratio), 0)", 2)} AS capital_at_risk,
           COUNT(*) FILTER (WHERE sku_demand < avg_demand * overstock_ratio) AS flagged_skus
    FROM sku CROSS JOIN ratios WHERE {categories} GROUP BY overstock_ratio
)
SELECT overstock_ratio, capital_at_risk, flagged_skus,
       (SELECT CAST(COALESCE(SUM(inventory_quantity), 0) AS DOUBLE) FROM extract WHERE {categories}) AS units_analyzed, service_level, lead_time_days
FROM steps CROSS JOIN (VALUES ('90%'), ('95%'), ('99%')) AS l(service_level)
CROSS JOIN (SELECT CAST(unnest(range(1, 31)) AS INTEGER) AS lead_time_days)""",
        where,
    )


ORACLES["q34_kpi_grid"] = kpi_grid("TRUE", "TRUE")
ORACLES["q34_kpi_grid_filtered"] = kpi_grid("lower(promotions) = 'yes'", "product_category IN ('ECONOMY', 'PROMO')")

# --- what leaves no rows otherwise ---

ORACLES["q15_season_places"] = f"""WITH bands AS ({ORACLES["q15_season_chart"]})
SELECT ROW_NUMBER() OVER (ORDER BY CASE season_band WHEN 'Low Season' THEN 0 WHEN 'Normal' THEN 1 ELSE 2 END) AS place, season_band, num_records
FROM bands"""
ORACLES["s09_views_after_load"] = f"""{TABLES}
SELECT 'product_information' AS view_name, COUNT(*) AS row_count FROM products
UNION ALL SELECT 'sales_data', COUNT(*) FROM sales
UNION ALL SELECT 'external_factors', COUNT(*) FROM factors
UNION ALL SELECT 'inventory_summary', COUNT(*) FROM summary"""
ORACLES["d05_required_columns"] = f"""{TABLES}
SELECT "check", CAST(0 AS BIGINT) AS expected, CAST(actual AS BIGINT) AS actual, actual = 0 AS ok, (SELECT COUNT(*) FROM summary) AS row_count
FROM (VALUES ('extract: missing columns', 0), ('poor_extract: missing columns', 2)) AS t("check", actual)"""
_CHOICES = (("everything", "TRUE", 0.5), ("combined", FILTERED, 0.65), ("unknown_category", "FALSE", 0.5), ("no_category", "FALSE", 0.5))
ORACLES["d10_rows_left"] = " UNION ALL ".join(
    "SELECT * FROM (" + board(
        f"""SELECT '{name}' AS choice, COUNT(*) > 0 AS has_rows, COUNT(*) FILTER (WHERE is_overstock) AS flagged_skus,
       (SELECT CAST(COALESCE(SUM(inventory_quantity), 0) AS DOUBLE) FROM extract) AS units_analyzed FROM sku""", where, ratio,
    ) + ")"
    for name, where, ratio in _CHOICES
)
