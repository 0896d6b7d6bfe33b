"""Tables or queries of a database, read in parallel slices of a numeric key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def slice_options(
    url: str, table: str, *, key: str, low: int, high: int, slices: int, fetch_size: int = 10_000, **extra: str
) -> dict[str, str]:
    """Reader options. ``table`` is a name or a query; rows outside ``low``..``high`` are read as well."""
    if slices < 1 or high < low:
        raise ValueError("slices must be positive and the key range not empty")
    text = table.strip().rstrip(";")
    source = f"({text}) AS source" if text.lower().startswith(("select", "with")) else text
    return {
        "url": url,
        "dbtable": source,
        "partitionColumn": key,
        "lowerBound": str(low),
        "upperBound": str(high),
        "numPartitions": str(slices),
        "fetchsize": str(fetch_size),
        **extra,
    }


def read_database(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()
