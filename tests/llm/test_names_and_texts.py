"""Tables whose columns are named like the operators' own, very long texts, and licence files as they are found."""

from __future__ import annotations

import re
import textwrap
import time

import pytest
from pyspark.sql import functions as F

from shelfwise.llm import common, decontaminate, license_scan, line_dedup, quality_trees, repetition, simhash, substring_dedup, url_filter
from shelfwise.llm.common import prepare

NAMES = ["_id", "_TH", "_gone", "_key", "_block", "_bits", "_host", "_path", "_w0", "_maybe", "_rule", "_figures", "_stays", "_hash", "_spots", "_salt", "c0", "item", "th", "n"]
LINE = "This very line stands in three documents."
PASSAGE = "Seven wizards quietly judge my vow to hide twelve amber boxes below the old town hall until the last guest has gone home tonight."
TEXTS = [f"{LINE}\nalpha beta gamma delta", f"{LINE}\nepsilon zeta eta theta", f"{LINE}\n{PASSAGE}", f"iota kappa {PASSAGE}", f"{LINE}\nalpha beta gamma delta", None, ""]


@pytest.fixture(scope="module")
def rows(spark):
    prepare(spark)
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in NAMES)
    return spark.createDataFrame([(i, t, *NAMES) for i, t in enumerate(TEXTS)], schema).coalesce(2)


def kept(found, ids):
    """The rows of these ids, with every given column as it was."""
    table = found.toPandas()
    assert sorted(table.doc_id) == ids
    for name in NAMES:
        assert (table[name] == name).all()


def test_columns_named_like_those_of_url_filters(spark, rows):
    pages = rows.withColumn("url", F.concat(F.lit("http://www.Bad.com/"), "doc_id", F.lit("/")))
    listed = spark.createDataFrame([("https://bad.com/1",), ("http://bad.com/1?utm_x=2",), (None,)], "url string")  # repeated listed urls
    found = url_filter.filter_urls(pages, listed, [])
    assert found.columns == [*pages.columns, "host", "path", "rule", "verdict", "listed"]
    kept(found, list(range(7)))
    assert [r.doc_id for r in found.where("listed").collect()] == [1]


def test_columns_named_like_those_of_line_dedup(spark, rows):
    before = {t.name for t in spark.catalog.listTables()}
    found = line_dedup.dedup_lines(rows)
    assert found.columns == [*rows.columns, "n_lines", "n_dropped"]
    kept(found, list(range(7)))
    assert {r.doc_id for r in found.where("n_dropped = 1").collect()} == {0, 1, 2}
    assert {t.name for t in spark.catalog.listTables()} == before


def test_columns_named_like_those_of_substring_dedup(rows):
    found = substring_dedup.dedup_substrings(rows, min_words=5)
    assert found.columns == [*rows.columns, "removed"]
    kept(found, list(range(7)))
    assert {r.doc_id for r in found.where("removed is not null").collect()} == {1, 2, 4}


def test_columns_named_like_those_of_simhash(rows):
    found = simhash.keep_one_of_each(rows.unionByName(rows.where("doc_id = 0")))
    assert found.columns == rows.columns
    kept(found, [0, 1, 2, 3, 5])


def test_columns_named_like_those_of_decontamination(spark, rows):
    bench = spark.createDataFrame([(1, PASSAGE, "x"), (None, "epsilon zeta ETA theta", "x"), (2, None, "x")], "item_id long, text string, item string")
    found = decontaminate.decontaminate(rows, bench)
    assert found.columns == rows.columns
    kept(found, [0, 4, 5, 6])
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(rows, bench).collect()} == {(2, 1), (3, 1), (1, None)}


def test_columns_named_like_those_of_quality_rules(rows):
    short = rows.drop("n")
    found = repetition.apply_rules(rows)
    assert set(short.columns) <= set(found.columns)
    kept(found, list(range(7)))


def test_columns_named_like_those_of_the_classifier(spark, rows):
    labels = spark.createDataFrame([(0, 1, "x"), (1, 0, "x"), (2, 1, "x")], "doc_id long, quality int, _id string")
    found = quality_trees.classify(rows, labels)
    assert found.columns == [*rows.columns, "held_out", "score", "predicted"]
    kept(found, list(range(7)))


def test_one_of_several_texts_with_an_id_is_learnt_from_whatever_their_order(spark):
    texts = ["one two three.", "Quite another text, with commas, and words.", "x"]
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    seen = []
    for order in (texts, texts[::-1]):
        docs = spark.createDataFrame([(1, t) for t in order], "doc_id long, text string")
        sample = quality_trees.labelled_sample(docs, labels)
        assert sample.count() == 3
        seen.append(sorted(r.score for r in quality_trees.classify(docs, labels).collect()))
    assert seen[0] == seen[1]


def test_a_hub_of_most_links_gives_the_same_components(spark, monkeypatch):
    """One node linked to two thousand, from above and from below, beside a chain; every node counts as hot, or none does."""
    star = [(0, i) for i in range(1, 1000)] + [(5000, i) for i in range(1000, 2000)]
    chain = [(i, i + 1) for i in range(6000, 6012)]
    edges = spark.createDataFrame(star + chain, "a long, b long")
    for share in (1, 1000):
        monkeypatch.setattr(common, "HOT_SHARE", share)
        found = {r.node: r.component for r in common.components(edges).collect()}
        assert found == {i: 0 for i in range(1000)} | {i: 1000 for i in [*range(1000, 2000), 5000]} | {i: 6000 for i in range(6000, 6013)}


# --- very long texts --------------------------------------------------------------------------------


OLD_UNIT = re.compile(r"[^\n]*?(?:[.!?]+(?=[ \t\x0b\x0c\r\n])|\n|$)[ \t\x0b\x0c\r\n]*")


def test_units_end_at_sentences_and_lines():
    text = "  \n A first. Second one!? third\n\n. Dots...  e.g. this\r\n v1.2 . end\t\n"
    found = [(m.start(), m.start() + len(m.group().rstrip()), m.group().lower().split()) for m in OLD_UNIT.finditer(text) if m.group().split()]
    assert substring_dedup.units_of(text) == found and len(found) > 6


@pytest.mark.parametrize("text", ["." * 1_000_000, " " * 1_000_000, "a." * 500_000, "?\n" * 500_000, "\n" * 1_000_000 + "x"])
def test_units_of_a_long_text_take_time_in_proportion(text):
    start = time.time()
    units = substring_dedup.units_of(text)
    assert time.time() - start < 20 and sum(len(w) for _, _, w in units) == len(text.split())


# --- licence files ----------------------------------------------------------------------------------


def wrapped(text, mark="", width=72):
    return "\n".join((mark + line).rstrip() for line in textwrap.wrap(text, width))


def template(license, start):
    return next(text for name, text in license_scan.TEMPLATES if name == license and text.startswith(start))


def test_licence_files_and_wrapped_headers(spark):
    mit = [template("MIT", s) for s in ("Permission", "The above", "THE SOFTWARE")]
    bsd = template("BSD-3-Clause", "Redistribution and use")
    gpl = template("GPL-3.0", "This program is free software")
    apache = [template("Apache-2.0", s) for s in ('Licensed under the Apache License, Version 2.0 (the', "Unless required")]
    mpl = [template("MPL-2.0", s) for s in ("This Source", "If a copy")]
    code = "".join(f"int field{i} = compute{i}(argument{i});\n" for i in range(60))
    files = [
        ("mit/LICENSE", "MIT License\n\nCopyright (c) 2019 Ada Bo\n\n" + "\n\n".join(map(wrapped, mit)) + "\n", "MIT"),
        ("mit/src/deep/a.c", "int main() { return 0; }", "MIT"),
        ("bsd/COPYING", "Copyright 2020, Ada Bo. All rights reserved.\n\n" + wrapped(bsd), "BSD-3-Clause"),
        ("bsd/a.py", "print('x')", "BSD-3-Clause"),
        ("bsd/gpl.py", "#!/usr/bin/env python\n#\n" + wrapped(gpl, "# ") + "\nimport os\nprint(os.name)\n", "GPL-3.0"),
        ("gpl/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy.\n", "GPL-3.0"),
        ("gpl/x/b.c", "void f();", "GPL-3.0"),
        ("apache/a.java", "/*\n * Copyright 2021 The Authors\n *\n" + wrapped(" ".join(apache), " * ", 60) + "\n */\npackage a;\n" + code, "Apache-2.0"),
        ("apache/b.java", "package b;", None),
        ("mpl/a.js", wrapped(" ".join(mpl), "// ", 64) + "\nlet x = 1;\n", "MPL-2.0"),
        ("two/LICENSE.txt", "BSD 2-Clause License", "BSD-2-Clause"),
        ("two/LICENSE.zz", "MIT License", "MIT"),
        ("two/c.c", "first file of a directory counts", "BSD-2-Clause"),
        ("none/a.txt", "The committee granted the public a free license to hope.", None),
    ]
    docs = spark.createDataFrame([(i, path, text) for i, (path, text, _) in enumerate(files)], "doc_id long, path string, text string")
    got = {r.path: r.license for r in license_scan.scan_licenses(docs).collect()}
    assert got == {path: license for path, _, license in files}
