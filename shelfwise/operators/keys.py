"""Gap-free row numbers without a single-task sort."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.workspace import materialise

# Layout of monotonically_increasing_id: the row's place within its partition sits in the low 33 bits.
PLACE_BITS = 33


def _source_row(df: DataFrame) -> Column | None:
    """A hash of the file and the row within it that each row was read from; None unless ``df`` comes from one Parquet scan."""
    offered = df._jdf.queryExecution().analyzed().metadataOutput()
    if "_metadata" not in {offered.apply(i).name() for i in range(offered.size())}:
        return None
    known = df.select("_metadata").schema["_metadata"].dataType.names
    return F.xxhash64("_metadata.file_path", "_metadata.row_index") if "row_index" in known else None


def dense_key(df: DataFrame, name: str, order_by: list[str] | None = None, first: int = 1) -> DataFrame:
    """Add ``name`` = ``first``, ``first`` + 1 and so on, without a gap.

    With ``order_by`` numbers follow a range-partitioned sort and are the same on each run. Equal rows may
    be many, so a last sort key spreads them over partitions. It must be the same when it is made anew after the loss of an
    executor, or a row could go to two partitions: it is the row's place in its Parquet file, and only rows from elsewhere are
    numbered and written before the sort. Without ``order_by`` numbers follow the scan and nothing is shuffled.

    Rows are written once with their partition and place; the driver only sees one count per partition.
    """
    rows = df
    if order_by:
        tie = _source_row(df)
        rows = df.withColumn("_tie", F.monotonically_increasing_id() if tie is None else tie)
        rows = materialise(rows, f"{name}-input") if tie is None else rows
        rows = rows.orderBy(*order_by, "_tie").drop("_tie")
    place = F.monotonically_increasing_id().bitwiseAND((1 << PLACE_BITS) - 1)
    placed = materialise(rows.withColumns({"_part": F.spark_partition_id(), "_place": place}), name)

    counts = sorted(placed.groupBy("_part").count().collect())
    before = accumulate((row["count"] for row in counts), initial=first)
    starts = [(row["_part"], start) for row, start in zip(counts, before)]
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start bigint")
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_start") + F.col("_place"))
        .select(name, *df.columns)
    )
