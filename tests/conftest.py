from __future__ import annotations

import sys
from datetime import date
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from shelfwise.session import build_session  # noqa: E402

# The eight rows on which the hand-checked results rest.
JOINED_ROWS = [
    (1, 101, "Laptops", "Yes", date(2022, 1, 15), 5.0, 800.0, 1.5, 5.2, 1.0),
    (2, 101, "Laptops", "Yes", date(2022, 2, 20), 7.0, 800.0, 1.6, 5.3, 1.1),
    (3, 102, "Laptops", "No", date(2022, 1, 10), 50.0, 600.0, 1.5, 5.2, 1.0),
    (4, 102, "Laptops", "No", date(2022, 3, 5), 55.0, 600.0, 1.7, 5.4, 1.2),
    (5, 103, "SmartPhones", "Yes", date(2022, 2, 14), 20.0, 400.0, 1.6, 5.3, 1.1),
    (6, 103, "SmartPhones", "No", date(2022, 4, 1), 22.0, 400.0, 1.5, 5.2, 1.0),
    (7, 104, "SmartPhones", "No", date(2022, 1, 22), 2.0, 350.0, 1.4, 5.1, 0.9),
    (8, 104, "SmartPhones", "No", date(2022, 5, 10), 3.0, 350.0, 1.6, 5.3, 1.1),
]
JOINED_SCHEMA = (
    "sales_id int, product_id int, product_category string, promotions string, sales_date date, "
    "inventory_quantity double, product_cost double, gdp double, inflation_rate double, seasonal_factor double"
)


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def joined(spark):
    return spark.createDataFrame(JOINED_ROWS, JOINED_SCHEMA)


def rows_of(df, *columns):
    """Rows as a sorted list of tuples."""
    picked = df.select(*(f"`{c}`" for c in columns)) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


@pytest.fixture
def rows():
    return rows_of
