from __future__ import annotations

import pytest

from shelfwise.llm.common import prepare

LONG = " ".join(f"word{i % 97} of{i % 13}" for i in range(400))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards quietly judge my vow to hide amber boxes tonight."
LINE = "This very line stands in many documents."
ROWS = [
    (1, PASSAGE + "\n" + LINE),
    (2, "Something else first. " + PASSAGE + " And more after it.\n " + LINE.upper() + " "),
    (3, LONG + "\n" + LINE + "\n" + LINE),
    (4, None),
    (5, ""),
    (6, " \t \n"),
    (7, LONG + "\n" + LINE),
    (7, LONG + "\n" + LINE),
    (8, "Größe ▁x  🎉 É\n\nRELEASED UNDER THE MIT LICENSE. " * 3),
    (9, "short"),
    (None, LINE + "\nnull id"),
    (None, None),
]
CLASHES = ["h1", "h2", "pos", "n", "th", "key", "keeper", "batch", "kept", "score", "start", "unit", "words", "fp", "f", "row", "first"]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and repeated rows, and extra columns named like the operators' own."""
    prepare(spark)
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(*r, *CLASHES) for r in ROWS], schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def tables(spark):
    """Documents and their companions of the smallest folder, whole."""
    prepare(spark)
    folder = "/root/testdata/sf0.001"
    return {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels", "benchmark", "pages")} | {"folder": folder}
