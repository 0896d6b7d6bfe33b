"""Written intermediate tables in the folder that all executors share.

A table that a query reads more than once is written here once and read back. The copy is columnar, so
each reader fetches only its columns, and it outlives any executor.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_KEY, None) or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shelfwise-"))
        folder = context.getCheckpointDir()
    return f"{folder.rstrip('/')}/shelfwise/{context.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other table uses."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the written table."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_workspace(spark: SparkSession) -> bool:
    """Delete the tables this application wrote; call it once their results have been used."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.delete(path, True)
