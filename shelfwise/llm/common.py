"""Helpers the text operators share: text expressions, written tables, measured joins, components."""

from __future__ import annotations

import string
import tempfile
import zipfile
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfwise.workspace import materialise

#: Characters that part words: space and the five controls from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: A side is broadcast up to this many bytes, as counted from its rows; beyond it the join is dealt by key.
BROADCAST_BYTES = 24 * 1024 * 1024
SALTS = 16


def fold(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other letter left as it is."""
    slow = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(slow)


def whole(text: Column | str) -> Column:
    """A text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def in_training(doc_id: Column | str, folds: int, held_out: int) -> Column:
    """Whether a document belongs to the training folds; a null id counts as the empty text."""
    key = F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(None)).cast("string")
    return F.pmod(F.crc32(F.coalesce(key, F.lit("")).cast("binary")), F.lit(folds)) != held_out


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def rows_in(table: DataFrame) -> int:
    return table.count()


def join_measured(big: DataFrame, small: DataFrame, keys: list[str], how: str, *, row_bytes: int, spread: Column) -> DataFrame:
    """Join rows, a few keys of which may be hot, to a written table that holds each key once.

    ``small`` is counted. Up to BROADCAST_BYTES it is broadcast. Beyond that each key of ``small`` is
    repeated over SALTS and the rows of ``big`` are dealt over them by ``spread``, so that a key with a third of all
    rows meets its partner in many tasks. Both ways give the same rows. Null keys never match.
    """
    if rows_in(small) * row_bytes <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), keys, how)
    salted = small.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [*keys, "_salt"], how).drop("_salt")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): one row (node, component) for each node.

    ``component`` is the least node reachable. Each round links every node's greater neighbours, then its lesser ones,
    to the least of its neighbourhood (alternating stars), which leaves a forest of stars after a
    number of rounds that grows with the logarithm of the nodes. Every round is a written table. The least neighbour comes from an
    aggregate that combines before the shuffle, and the rows of a hub, which may be a third of all, stay where they are: join_weighed
    broadcasts the few nodes that have so many.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = materialise(pairs, label)
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n")), label)
        up = join_weighed(both.where("b > a"), least, ["a"], "n")
        large = materialise(up.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), label)
        small_least = materialise(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), label)
        down = join_weighed(large, small_least, ["a"], "n")
        small = down.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.unionByName(small_least.select("a", F.col("m").alias("b"))).distinct()
        pairs = materialise(small, label)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = pairs.select(F.col("b").alias("a"), "b").distinct()
    return pairs.unionByName(roots).select(F.col("a").alias("node"), F.col("b").alias("component"))


def words_of(text: Column) -> Column:
    """Words of a text, parted by the ASCII blanks, A-Z lower-cased; no words for null and blank texts."""
    trimmed = F.btrim(fold(whole(text)), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def shingles(words: Column, size: int, join: Callable[..., Column]) -> Column:
    """``join`` of the words of each run of ``size`` words, repeats included. Fewer words make one run, no words none.

    ``words`` must be a column of its own, not an expression: each run refers to it.
    """
    n = F.size(words)
    firsts = F.slice(words, F.lit(1), F.when(n >= size, n - (size - 1)).otherwise(F.least(n, F.lit(1))))
    return F.transform(firsts, lambda word, i: join(word, *(F.get(words, i + k) for k in range(1, size))))


def free_name(rows: DataFrame, stem: str) -> str:
    """``stem``, or the first of ``stem_``, ``stem__`` and so on that is no column of ``rows`` (in any case)."""
    taken = {c.lower() for c in rows.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def rows_of(docs: DataFrame, marked: DataFrame, how: str, row_bytes: int = 48, *, small: bool | None = None) -> DataFrame:
    """Rows of ``docs`` joined (anti, left, inner) to a written table on doc_id and th, the hash of the text.

    ``marked`` has each pair once; it is broadcast up to BROADCAST_BYTES, by its number of rows or as ``small`` says. Null ids match
    null ids. ``docs`` may have any other columns; those of ``marked`` other than its keys must have names that ``docs`` does not have.
    """
    doc_id, th = free_name(docs, "_id"), free_name(docs, "_th")
    marked = marked.withColumnsRenamed({"doc_id": doc_id, "th": th})
    if rows_in(marked) * row_bytes <= BROADCAST_BYTES if small is None else small:
        marked = F.broadcast(marked)
    on = F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.xxhash64("text") == F.col(th))
    return docs.join(marked, on, how).drop(doc_id, th)


#: Rows in an Arrow batch, and in a batch of the Parquet reader. Texts are long, so that the defaults of ten and four thousand
#: would take much memory.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """What the operators in Python need: this package on the workers, sent once, and batches of ARROW_ROWS."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", ARROW_ROWS)
    context = spark.sparkContext
    if getattr(context, "_shelfwise_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="shelfwise-")) / "shelfwise.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._shelfwise_shipped = True


HOT_SHARE = 1000


def join_weighed(big: DataFrame, small: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join of rows to a written table that holds each key once, with the number of its rows in ``weight``.

    Keys with over one in HOT_SHARE of all rows, of which there are fewer than HOT_SHARE, are broadcast, so that their rows stay
    where they are; the rows of all other keys are dealt by key, and no key there is hot.
    """
    total = small.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    is_hot = F.col(weight) > F.lit(total // HOT_SHARE)
    hot = F.broadcast(small.where(is_hot))
    rest = big.join(F.broadcast(small.where(is_hot).select(*keys)), keys, "left_anti").join(small.where(~is_hot), keys)
    return big.join(hot, keys).unionByName(rest)
