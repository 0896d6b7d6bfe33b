"""The text queries that SQL expresses, on whole given tables."""

from __future__ import annotations

import pytest

from check_oracle import connect, difference
from shelfwise.llm.queries import ORACLES, QUERIES
from shelfwise.llm.sql import QUALITY_RULES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, name):
    assert difference(QUERIES[name](spark, FOLDER).toPandas(), connect(FOLDER).execute(ORACLES[name]).df()) is None


def test_base_of_quality_rules(spark):
    expected = connect(FOLDER).execute(QUALITY_RULES).df()
    found = QUERIES["op9_quality_rules"](spark, FOLDER).select(*expected.columns).toPandas()
    assert difference(found, expected) is None
