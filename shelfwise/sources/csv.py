"""Raw comma-separated files, read as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

BAD_LINE = "bad_line"

# UTF-8, one header row, comma; quotation marks are ordinary characters.
LAYOUT = {"header": "true", "sep": ",", "quote": "", "encoding": "UTF-8"}


def read_staging(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Text columns by position. A line with more or fewer fields stops the query."""
    return spark.read.schema(schema).options(**LAYOUT, mode="FAILFAST").csv(path)


def read_staging_with_bad_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The same, keeping lines that do not fit in the column ``bad_line`` for inspection."""
    wide = T.StructType([*schema.fields, T.StructField(BAD_LINE, T.StringType())])
    options = {**LAYOUT, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE}
    return spark.read.schema(wide).options(**options).csv(path)


# --- rows with their place -------------------------------------------------------------------------

#: Where a row comes from: its file, the block of it that one task reads, and its number within the task.
PLACE = ("file", "block", "place")


def read_staging_with_places(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``read_staging_with_bad_lines`` with the columns of PLACE."""
    rows = read_staging_with_bad_lines(spark, path, schema)
    return rows.select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )


def raw_line(schema: T.StructType) -> Column:
    """The line as it stands in its file: quotation marks are ordinary, so that the fields make it up again."""
    fields = F.concat_ws(",", *(F.coalesce(F.col(name), F.lit("")) for name in schema.names))
    return F.coalesce(F.col(BAD_LINE), fields)


def with_row_numbers(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """``rows``, some of ``placed``, with ``row_number``: the number of the row in its file, from 1, headings and blank lines not counted.

    One row per block says how many rows the blocks before it hold.
    """
    blocks = placed.groupBy("file", "block").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file", "block", (before - F.col("first") + 1).alias("start"))
    return rows.join(starts, ["file", "block"]).withColumn("row_number", F.col("start") + F.col("place")).drop("block", "place", "start")
