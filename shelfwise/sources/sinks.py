"""Files for other people and programs."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import UnsupportedOperationException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

ACTION_LIST_NAME = "Reorder_Action_List"
COPY_BUFFER = 1 << 20


def with_text_flags(df: DataFrame) -> DataFrame:
    """Booleans as the words True and False."""
    flags = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    return df.withColumns({name: F.initcap(F.col(f"`{name}`").cast("string")) for name in flags})


def export_csv(df: DataFrame, path: str, one_file: bool = False) -> str:
    """Write UTF-8 text with headings to the folder ``path``, in place of what was there. ``one_file`` makes one file of it, in the order of ``df``."""
    rows = with_text_flags(df)
    if one_file:
        return _export_joined(rows, path)
    rows.write.mode("overwrite").option("encoding", "UTF-8").csv(path, header=True)
    return path


def _export_joined(rows: DataFrame, path: str) -> str:
    """Write numbered parts, each by a task of its own, and let the file system join them behind one heading.

    A sorted frame is written in parts of its order. Where the file system cannot join files (HDFS can), their bytes are copied
    one after another through a buffer; no task and no memory ever holds the list. The finished file is moved into place last.
    """
    spark = rows.sparkSession
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    folder = hadoop.fs.Path(path)
    files = folder.getFileSystem(conf)
    draft = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    rows.limit(0).coalesce(1).write.option("encoding", "UTF-8").csv(f"{draft}/0", header=True)
    rows.write.option("encoding", "UTF-8").csv(f"{draft}/1", header=False)
    parts = []
    for step in (0, 1):
        listed = [status.getPath() for status in files.listStatus(hadoop.fs.Path(f"{draft}/{step}"))]
        parts += sorted((part for part in listed if part.getName().startswith("part-")), key=lambda part: part.getName())
    whole = _joined(spark, files, parts, hadoop.fs.Path(f"{draft}/whole.csv"))
    files.delete(folder, True)
    files.mkdirs(folder)
    files.rename(whole, hadoop.fs.Path(f"{path.rstrip('/')}/part-00000.csv"))
    files.delete(hadoop.fs.Path(draft), True)
    return path


def _joined(spark: SparkSession, files, parts: list, target):
    """``parts`` as one file, in their order."""
    head, *rest = parts
    if rest:
        sources = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, len(rest))
        for i, part in enumerate(rest):
            sources[i] = part
        try:
            files.concat(head, sources)
        except UnsupportedOperationException:
            out = files.create(target, False)
            try:
                for part in parts:
                    stream = files.open(part)
                    spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, COPY_BUFFER, False)
                    stream.close()
            finally:
                out.close()
            return target
    files.rename(head, target)
    return target


def write_reports(reports: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    """One directory per report, in place of an earlier one. Returns their paths."""
    paths = {}
    for name, df in reports.items():
        paths[name] = f"{folder}/{name}"
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer = writer.option("header", True).option("encoding", "UTF-8")
        writer.format(fmt).save(paths[name])
    return paths
