"""Line dedup: levelled sorted runs of line hashes, and the lines that they say must go."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfwise.llm.common import BLANKS, BROADCAST_BYTES, fold, free_name, join_measured, rows_of, whole
from shelfwise.workspace import materialise, new_path

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 2

KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line stripped of blanks at both ends, A-Z lower-cased."""
    return fold(F.btrim(line, F.lit(BLANKS)))


def lines_of(text: Column) -> Column:
    """The lines of a text, parted at each line feed; the empty text and null are one empty line."""
    return F.split(whole(text), "\n", -1)


def line_table(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each line whose key is long enough: doc_id, th (hash of the text), pos, h1, h2.

    Two independent 64-bit hashes stand for a key. ``th`` tells rows that share a doc_id apart.
    """
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("pos", "key"))
    return lines.where(F.length("key") >= min_chars).select(
        "doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2")
    )


@dataclass
class LineRuns:
    """Levelled runs of (h1, h2, n, keeper): how many documents hold a line, and the largest of them.

    A run is a table bucketed by the hashes and sorted within its buckets, so that runs meet each other and a batch without
    being shuffled again. Batches come in falling order of doc_id. A batch is merge-anti-joined with the
    runs: a line that a run has already found in ``min_docs`` documents is settled, and so is its keeper, as
    later documents are smaller; the rest of the batch becomes a run of level 0. When a level has ``fanout``
    runs, they are merged into one run of the next level.
    """

    spark: SparkSession
    min_docs: int = MIN_DOCS
    fanout: int = FANOUT
    levels: list[list[DataFrame]] = field(default_factory=list)
    names: list[str] = field(default_factory=list)

    def add(self, batch: DataFrame) -> None:
        """``batch`` holds lines (doc_id, h1, h2). A null doc_id is one document, below all others."""
        in_doc = batch.select(*KEY, "doc_id").distinct()
        found = in_doc.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
        for run in self.runs():
            found = found.join(run.where(F.col("n") >= self.min_docs).select(*KEY), KEY, "left_anti")
        self._put(0, self._write(found))

    def close(self) -> None:
        """Take the runs out of the session's catalogue; their files stay until the workspace is cleared."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def merged(self) -> DataFrame:
        """All runs as one table."""
        first, *others = self.runs()
        for run in others:
            first = self._merge(first, run)
        return first

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            first, *others = self.levels[level]
            for run in others:
                first = self._merge(first, run)
            self.levels[level] = []
            self._put(level + 1, self._write(first))

    def _merge(self, a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(*KEY, F.col("n").alias("_n"), F.col("keeper").alias("_keeper"))
        n = F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))
        return a.join(b, KEY, "full_outer").select(*KEY, n.alias("n"), F.greatest("keeper", "_keeper").alias("keeper"))

    def _write(self, run: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        writer = run.repartition(buckets, *KEY).write.format("parquet").bucketBy(buckets, *KEY).sortBy(*KEY)
        writer.option("path", new_path(self.spark, name)).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)


def _batches(docs: DataFrame, batches: int) -> Column:
    """Number of a document's batch, 0 for the largest ids; the bounds are quantiles of doc_id over all documents."""
    shares = [i / batches for i in range(1, batches)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, 1000).alias("b")).first()[0] or []
    number = F.lit(0)
    for bound in bounds:
        number = number + F.coalesce((F.col("doc_id") <= F.lit(bound)).cast("int"), F.lit(1))
    return number


def dropped_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """Documents that lose lines: doc_id, th, and the positions of those lines in order."""
    spark = docs.sparkSession
    number = _batches(docs, batches)
    path = new_path(spark, "lines")
    line_table(docs, min_chars).withColumn("batch", number).write.partitionBy("batch").parquet(path)
    schema = "doc_id long, th long, pos int, h1 long, h2 long, batch int"
    lines = spark.read.schema(schema).parquet(path)
    runs = LineRuns(spark, min_docs)
    for i in range(batches):
        runs.add(lines.where(F.col("batch") == i))
    repeated = materialise(runs.merged().where(F.col("n") >= min_docs).select(*KEY, "keeper"), "repeated-lines")
    runs.close()
    hits = join_measured(lines, repeated, KEY, "inner", row_bytes=64, spread=F.col("th"))
    gone = hits.where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def _without(lines: Column, gone: Column) -> Column:
    """``lines`` without the positions in ``gone``: both are sorted into one row of marks, so that long texts stay cheap."""
    at = F.transform(lines, lambda x, i: F.struct(i.alias("p"), F.lit(1).alias("k"), x.alias("line")))
    marks = F.transform(gone, lambda p: F.struct(p.alias("p"), F.lit(0).alias("k"), F.lit(None).cast("string").alias("line")))
    row = F.array_sort(F.concat(marks, at))
    behind = F.concat(F.array(F.lit(-1)), F.transform(row, lambda s: F.when(s["k"] == 0, s["p"]).otherwise(-1)))
    both = F.arrays_zip(row.alias("s"), behind.alias("b"))
    kept = F.filter(both, lambda z: (z["s"]["k"] == 1) & (z["s"]["p"] != z["b"]))
    return F.transform(kept, lambda z: z["s"]["line"])


def dedup_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """``docs`` (doc_id, text and more) with n_lines, n_dropped, and ``text`` less the lines that go.

    Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents lose all their lines but those
    of the largest doc_id. The other lines stay, joined by line feeds.

    Ids are whole numbers. Null and empty texts are one empty line and become the empty text. Rows with one doc_id count as one
    document. Null ids are one document, below all others. An empty table gives an empty table. Other
    columns are kept, whatever their names; ``n_lines`` and ``n_dropped`` replace columns of those names.
    """
    gone = materialise(dropped_lines(docs, min_chars=min_chars, min_docs=min_docs, batches=batches), "dropped-lines")
    size = gone.agg(F.coalesce(F.sum(64 + 4 * F.size("gone")), F.lit(0))).first()[0]
    places = free_name(docs, "_gone")
    lines = lines_of(F.col("text"))
    kept = F.when(F.col(places).isNull(), whole("text")).otherwise(F.array_join(_without(lines, F.col(places)), "\n"))
    more = {
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.coalesce(F.size(places), F.lit(0)).cast("long"),
    }
    joined = rows_of(docs.drop(*more), gone.withColumnRenamed("gone", places), "left", small=size <= BROADCAST_BYTES)
    return joined.withColumns({**more, "text": kept}).drop(places)
