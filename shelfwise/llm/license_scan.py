"""License scan: TF-IDF cosine of notices and licence files to templates, and inheritance from directories."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.llm.common import all_of, join_measured, rows_of, whole
from shelfwise.workspace import materialise

SIMILARITY = 0.75
#: A file is its directory's licence file if its name says so or its whole text is this close to a template.
FILE_SIMILARITY = 0.6
LICENCE_NAME = r"(?i)^(un)?(license|licence|copying|copyright|notice)([.\-_].*)?$"

#: The licence that counts only where no other is named: most notices of other licences reserve all rights as well.
RESERVED = "proprietary"

#: Parts of the public licence texts that several templates share.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:"
)
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
)
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    "above copyright notice and this permission notice appear in all copies."
)

#: Licence and text of the short notices, the titles and opening paragraphs of the licence files, the headers that the
#: licences prescribe for source files, and the short licences as a whole.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ),
    (
        "Apache-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "MIT License"),
    ("MIT", _MIT_GRANT),
    ("MIT", _MIT_NOTICE),
    ("MIT", _MIT_WARRANTY),
    ("MIT", f"MIT License {_MIT_GRANT} {_MIT_NOTICE} {_MIT_WARRANTY}"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", _BSD_NAMES),
    ("BSD-3-Clause", f"{_BSD_GRANT} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_NAMES} {_BSD_WARRANTY}"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", _BSD_GRANT),
    ("BSD-2-Clause", f"{_BSD_GRANT} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_WARRANTY}"),
    ("ISC", "ISC License"),
    ("ISC", _ISC_GRANT),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it."),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "Unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (RESERVED, "All rights reserved."),
)


def terms_of(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits; empty for null."""
    return F.array_remove(F.split(F.lower(whole(text)), r"[^a-z0-9]+"), "")


def units_of(text: Column) -> Column:
    """What may be a notice: sentences and lines of a text, its paragraphs, and the sentences of those that are wrapped over several lines.
    Paragraphs are parted by a line without ASCII letters or digits; marks of comments at the beginning of a line are no terms."""
    text = whole(text)
    paragraphs = F.split(text, r"\n[^a-zA-Z0-9]*\n")
    wrapped = F.filter(paragraphs, lambda p: F.contains(p, F.lit("\n")))
    sentences = F.flatten(F.transform(wrapped, lambda p: F.split(p, r"(?<=[.!?])[ \t\r\n]+")))
    return F.concat(F.split(text, r"\n|(?<=[.!?])[ \t\r]+"), paragraphs, sentences)


class Templates:
    """Templates as unit vectors of tf * idf, with the terms that any text similar enough must share: of each template the rarest,
    as many as leave a rest that is too short by itself."""

    def __init__(self, texts: Sequence[tuple[str, str]], documents: int, found_in: dict[str, int], similarity: float):
        counts = [(name, _counts(text)) for name, text in texts]
        self.unknown = math.log(1 + documents) + 1
        self.idf = {t: math.log((1 + documents) / (1 + found_in.get(t, 0))) + 1 for _, c in counts for t in c}
        self.weights: list[tuple[int, str, str, float]] = []
        anchors = set()
        for number, (name, terms) in enumerate(counts):
            weight = {t: n * self.idf[t] for t, n in terms.items()}
            norm = math.sqrt(sum(w * w for w in weight.values()))
            self.weights += [(number, name, t, w / norm) for t, w in weight.items()]
            rest = norm * norm
            for t in sorted(weight, key=lambda t: (-self.idf[t], t)):
                if math.sqrt(max(rest, 0) / (norm * norm)) < similarity:
                    break
                anchors.add(t)
                rest -= weight[t] ** 2
        self.anchors = sorted(anchors)


def _counts(text: str) -> dict[str, int]:
    terms = [t for t in re.split(r"[^a-z0-9]+", text.lower()) if t]
    return {t: terms.count(t) for t in terms}


def fit_templates(files: DataFrame, texts: Sequence[tuple[str, str]], similarity: float) -> Templates:
    """Templates weighted by how many of all files hold each of their terms. Terms outside the templates take
    the largest weight that any term could have; they only lengthen a vector. The driver gets one row for each template term."""
    vocabulary = sorted({t for _, text in texts for t in _counts(text)})
    known = F.array(*map(F.lit, vocabulary))
    split = files.select(terms_of(F.col("text")).alias("terms"))
    found = split.select(F.explode(F.array_intersect("terms", known)).alias("term")).groupBy("term").count().collect()
    return Templates(texts, files.count(), {r["term"]: r["count"] for r in found}, similarity)


def similar_units(units: DataFrame, keys: list[str], templates: Templates, similarity: float) -> DataFrame:
    """``keys``, license and similarity of the best template for each unit (a column ``terms``) that is close enough.

    Only units with an anchor are weighed: without one, the shared part of every template is too short to reach ``similarity``.
    """
    spark = units.sparkSession
    # both tables are bounded by the templates
    idf = F.broadcast(spark.createDataFrame(sorted(templates.idf.items()), "term string, idf double"))
    weights = F.broadcast(spark.createDataFrame(templates.weights, "template int, license string, term string, weight double"))
    near = units.where(F.arrays_overlap("terms", F.array(*map(F.lit, templates.anchors))))
    counts = near.select(*keys, F.explode("terms").alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    weighed = counts.join(idf, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(templates.unknown)))
    weighed = materialise(weighed.select(*keys, "term", "w"), "license-terms")
    norms = weighed.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(weights, "term").groupBy(*keys, "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    same = all_of([F.col(f"d.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    both = dots.alias("d").join(norms.alias("n"), same).select(*(F.col(f"d.{k}") for k in keys), "license", F.round(F.col("dot") / F.col("norm"), 9).alias("similarity"))
    ranked = both.where(F.col("similarity") >= similarity).groupBy(*keys).agg(F.max(F.struct("similarity", "license")).alias("best"))
    return ranked.select(*keys, F.col("best.license").alias("license"), F.col("best.similarity").alias("similarity"))


def _rank() -> Column:
    """By which the best of several licences is chosen: any before RESERVED, then the similarity, then the name."""
    return F.struct((F.col("license") != RESERVED).alias("grants"), "similarity", "license")


def directory(path: Column) -> Column:
    """The directory of a path, empty at the top."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/+$", "")


def inherited(directories: DataFrame, licensed: DataFrame) -> DataFrame:
    """dir, licence_dir and dir_license: the nearest directory, itself or above, with a licence, for each of ``directories`` (dir).

    Each distinct directory goes to its ancestors and joins the licensed ones by path; the longest path wins.
    """
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rows = directories.select("dir", F.explode(F.array_distinct(above)).alias("licence_dir"))
    found = rows.join(licensed, "licence_dir")
    nearest = found.groupBy("dir").agg(F.max(F.struct(F.length("licence_dir").alias("n"), "licence_dir", "dir_license")).alias("best"))
    return nearest.select("dir", F.col("best.licence_dir").alias("licence_dir"), F.col("best.dir_license").alias("dir_license"))


def scan_licenses(files: DataFrame, *, texts: Sequence[tuple[str, str]] = TEMPLATES, similarity: float = SIMILARITY, file_similarity: float = FILE_SIMILARITY) -> DataFrame:
    """``files`` (doc_id, path, text) as doc_id, path, license, origin, similarity and licence_dir.

    Every sentence, line and paragraph of every whole text, and the text itself, is compared with the templates (licence and text) by the
    cosine of tf-idf vectors, so that a header wrapped over several lines is found whatever stands next to it. ``origin`` is "own" where a unit
    reaches ``similarity``; the best one names the licence, RESERVED only where there is no other. Other files inherit the licence of
    the nearest ancestor directory that has a licence file ("inherited"), or have none (null). A licence file has such a name and a licence of
    its own, or is as a whole within ``file_similarity`` of a template (so is a source file that holds little but a header). Of several in a directory, the first path counts.

    Null and empty texts have no licence of their own; null paths lie at the top. Ties between templates go to the last name.
    Rows with one doc_id and text are compared once. An empty table gives an empty one. Other columns are left out.
    """
    rows = files.select("doc_id", F.coalesce("path", F.lit("")).alias("path"), "text")
    templates = fit_templates(rows, texts, min(similarity, file_similarity))
    anchors = F.array(*map(F.lit, templates.anchors))
    split = rows.select("doc_id", "text", terms_of(F.col("text")).alias("terms"))
    candidates = split.where(F.arrays_overlap("terms", anchors)).select("doc_id", F.xxhash64("text").alias("th"), "text", "terms")
    candidates = materialise(candidates.dropDuplicates(["doc_id", "th"]), "license-candidates")
    keys = ["doc_id", "th", "unit"]
    units = candidates.select("doc_id", "th", F.posexplode(units_of(F.col("text"))).alias("unit", "line")).select(*keys, terms_of(F.col("line")).alias("terms"))
    texts_ = candidates.select("doc_id", "th", F.lit(-1).alias("unit"), "terms")
    close = materialise(similar_units(units.unionByName(texts_), keys, templates, min(similarity, file_similarity)), "license-units")
    own = close.where(F.col("similarity") >= similarity).groupBy("doc_id", "th").agg(F.max(_rank()).alias("own"))
    files_ = close.where((F.col("unit") == -1) & (F.col("similarity") >= file_similarity)).groupBy("doc_id", "th").agg(F.max(_rank()).getField("license").alias("whole"))
    same = all_of([F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("doc_id", "th")])
    marked = own.alias("a").join(files_.alias("b"), same, "full_outer").select(
        F.coalesce("a.doc_id", "b.doc_id").alias("doc_id"), F.coalesce("a.th", "b.th").alias("th"), "own", "whole"
    )
    marked = rows_of(rows, materialise(marked, "license-marks"), "left", row_bytes=120)
    marked = marked.select("doc_id", "path", directory(F.col("path")).alias("dir"), "own", "whole")
    marked = materialise(marked, "license-files")
    named = F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENCE_NAME)
    is_file = (named & F.col("own").isNotNull()) | F.col("whole").isNotNull()
    licensed = marked.where(is_file).groupBy(F.col("dir").alias("licence_dir")).agg(
        F.min(F.struct("path", F.coalesce("whole", "own.license").alias("license"))).alias("first")
    )
    licensed = materialise(licensed.select("licence_dir", F.col("first.license").alias("dir_license")), "licence-dirs")
    nearest = materialise(inherited(marked.select("dir").distinct(), licensed), "nearest-licences")
    found = join_measured(marked, nearest, ["dir"], "left", row_bytes=200, spread=F.col("path"))
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("dir_license").isNotNull(), "inherited")
    return found.select(
        "doc_id", "path", F.coalesce("own.license", "dir_license").alias("license"), origin.alias("origin"),
        F.col("own.similarity").alias("similarity"), F.when(F.col("own").isNull(), F.col("licence_dir")).alias("licence_dir"),
    )
