"""One query for each text operator, over its whole table, and the same in SQL where SQL can express it."""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfwise.llm import (
    decontaminate, lexical_search, license_scan, line_dedup, mixing, pieces, quality_trees, recurrent_lm, repetition, simhash, spelling,
    substring_dedup, url_filter,
)
from shelfwise.llm.common import prepare
from shelfwise.llm.sql import ORACLES  # noqa: F401
from shelfwise.llm.url_filter import Rule

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
PIECE_SEED = 20
URL_RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]
#: Urls of hosts with one of these labels make up the list of unwanted urls.
UNWANTED_LABELS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


@lru_cache(maxsize=2)
def piece_model(path: str = PIECE_MODEL) -> bytes:
    """The model file; it travels with the tasks, so only the driver needs the path."""
    return Path(path).read_bytes()


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{table}.parquet")


def url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages").select("page_id", "url")
    labels = F.split(url_filter.url_host(F.col("url")), r"\.")
    listed = pages.where(F.arrays_overlap(labels, F.array(*map(F.lit, UNWANTED_LABELS))))
    return url_filter.filter_urls(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


def piece_rows(docs: DataFrame) -> DataFrame:
    """doc_id, ids, n_pieces, decoded_sha256 and lossless (the decoded ids are the text) for each document."""
    prepare(docs.sparkSession)
    both = pieces.coded(F.col("doc_id"), F.col("text"), piece_model(), seed=PIECE_SEED)
    rows = docs.select("doc_id", "text", both.alias("c"))
    lossless = F.col("c.decoded") == F.coalesce("text", F.lit(""))
    return rows.select(
        "doc_id", F.col("c.ids").alias("ids"), F.size("c.ids").cast("long").alias("n_pieces"),
        F.sha2("c.decoded", 256).alias("decoded_sha256"), lossless.alias("lossless"),
    )


def pieces_query(spark: SparkSession, folder: str) -> DataFrame:
    return piece_rows(read(spark, folder, "documents"))


def line_digests(spark: SparkSession, folder: str) -> DataFrame:
    docs = line_dedup.dedup_lines(read(spark, folder, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.repeated_spans(read(spark, folder, "documents"), by_reach=True).drop("th")


def licenses(spark: SparkSession, folder: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", "doc_id")
    return license_scan.scan_licenses(read(spark, folder, "documents").select("doc_id", path.alias("path"), "text"))


def quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return quality_trees.classify(docs, read(spark, folder, "labels")).select("doc_id", "held_out", "score", "predicted")


def near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_components(read(spark, folder, "documents"))


def lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return recurrent_lm.score_documents(read(spark, folder, "documents"))


def repetition_rules(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.apply_rules(read(spark, folder, "documents").select("doc_id", "text")).drop("text")


def leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark")).drop("th")


def mix(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document: the copies of a unit's rows are dealt over them."""
    units = mixing.mixture(read(spark, folder, "documents").select("doc_id", "source", "text"))
    each = units.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    copies = F.expr("copies div rows") + (F.col("row") <= F.col("copies") % F.col("rows")).cast("long")
    return each.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"))


def ranked_documents(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.group_variants(read(spark, folder, "documents"))


QUERIES = {
    "op1_url_filters": url_verdicts,
    "op2_sentencepiece": pieces_query,
    "op3_line_dedup": line_digests,
    "op4_substring_dedup": repeated_passages,
    "op5_license_scans": licenses,
    "op6_quality_classifier": quality,
    "op7_simhash_near_dedup": near_copies,
    "op8_lm_scoring": lm_scores,
    "op9_quality_rules": repetition_rules,
    "op10_benchmark_decontamination": leaks,
    "op11_source_mixing": mix,
    "op12_lexical_search": ranked_documents,
    "op13_spelling_variants": spelling_variants,
}
