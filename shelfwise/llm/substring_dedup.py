"""Substring dedup: digests of normalised sentence and line units, grouped over all documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfwise.llm.common import join_weighed, rows_of
from shelfwise.workspace import materialise

#: Repeated units in a row go if they have this many words together; shorter repeats are common speech and stay.
MIN_WORDS = 20
#: A unit is a stretch of a line up to the end of a sentence, with the blanks behind it. This is what parts units: the blanks behind
#: a sentence, or the end of a line. It takes time in proportion to the text, whatever stands in it.
GAP = re.compile(r"(?:(?<=[.!?])[ \t\x0b\x0c\r]|\n)[ \t\x0b\x0c\r\n]*")
DIGEST = ["d1", "d2"]
LAST = (1 << 63) - 1
_COLUMNS = "doc_id long, th long, unit int, start int, stop int, words int, d1 long, d2 long, before array<tinyint>, after array<tinyint>"


def units_of(text: str) -> list[tuple[int, int, list[str]]]:
    """Start, end and words (lower-cased) of each unit with words; offsets count code points of the text as it is."""
    found = []
    starts = [0, *(gap.end() for gap in GAP.finditer(text)), len(text)]
    for start, stop in pairwise(starts):
        unit = text[start:stop]
        words = unit.lower().split()
        if words:
            found.append((start, start + len(unit.rstrip()), words))
    return found


def unit_table(docs: DataFrame, around: int = 0) -> DataFrame:
    """One row for each unit of each text: its place, its words and a digest of 128 bits of its normalised text; also a byte of
    hash for each word before it (the nearest first) and after it, as many on each side as the unit has fewer words than ``around``."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                yield _rows(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), around)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return materialise(rows.mapInArrow(split, _COLUMNS), "units")


def _rows(ids: list[int | None], hashes: list[int], texts: list[str | None], around: int) -> pa.RecordBatch:
    units = [units_of(text or "") for text in texts]
    sizes = [len(u) for u in units]
    flat = [x for u in units for x in u]
    digests = b"".join(xxhash.xxh3_128_digest(" ".join(words).encode()) for _, _, words in flat)
    halves = np.frombuffer(digests, ">i8").reshape(-1, 2).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    columns = [
        pa.array(ids, pa.int64()).take(pa.array(owner)),
        pa.array(np.array(hashes, np.int64)[owner]),
        pa.array(np.array([i for n in sizes for i in range(n)], np.int32)),
        *(pa.array(np.array([x[k] for x in flat], np.int32)) for k in (0, 1)),
        pa.array(np.array([len(x[2]) for x in flat], np.int32)),
        *(pa.array(np.ascontiguousarray(halves[:, k])) for k in (0, 1)),
        *_borders([x[2] for x in flat], owner, around),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "unit", "start", "stop", "words", *DIGEST, "before", "after"])


def _borders(units: list[list[str]], owner: np.ndarray, around: int) -> Iterator[pa.ListArray]:
    """The hashed words before each unit, the nearest first, and after it, within its text; ``owner`` is the text of each unit."""
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    ends = np.cumsum(sizes)
    hashed = np.fromiter((xxhash.xxh32_intdigest(w) & 255 for words in units for w in words) if around else (), np.uint8).view(np.int8)
    wanted = np.maximum(0, around - sizes)
    text_ends = ends[np.searchsorted(owner, owner, "right") - 1] if len(units) else ends
    text_begins = (ends - sizes)[np.searchsorted(owner, owner, "left")] if len(units) else ends
    for first, room, way in ((ends - sizes - 1, ends - sizes - text_begins, -1), (ends, text_ends - ends, 1)):
        counts = np.minimum(wanted, room)
        cuts = np.r_[0, np.cumsum(counts)]
        places = np.repeat(first - way * cuts[:-1], counts) + way * np.arange(cuts[-1])
        yield pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(hashed[places]))


def _shared(one: str, other: str) -> Column:
    """With how many equal elements two arrays begin."""
    same = F.zip_with(one, other, lambda x, y: x.eqNullSafe(y))
    unlike = F.array_position(same, F.lit(False))
    return F.when(unlike > 0, unlike - 1).otherwise(F.size(same))


def repeated_spans(docs: DataFrame, *, min_words: int = MIN_WORDS, by_reach: bool = False) -> DataFrame:
    """Passages to remove: doc_id, th, start, stop, n_words, first_doc_id, first_start.

    Lines are cut into units at the ends of sentences, so that a passage pasted into a line is found by its inner sentences. Units
    are normalised (lower case, blanks as one space) and grouped by digest over all documents. The earliest occurrence by doc_id
    and offset stays; the others are repeats. Repeats that follow each other in a text make a span, which goes if it has
    ``min_words`` words. With ``by_reach`` the equal words in a row on both sides of its units count as well, as a pasted passage loses its first
    and last sentence to the unit cut; words are compared by a byte of hash, with those around the occurrence that stays. The span itself
    is made of whole units. ``start`` and ``stop`` are code points of the text as it is; ``first_*`` is where the first unit of a span stays.

    Ids are whole numbers. Null and empty texts have no units, and an empty table no passages. Null ids rank last. Rows with the same id and text are one document. Nothing
    is dropped from long texts or large groups: a group only gives its size and least occurrence, combined before the shuffle.
    """
    units = unit_table(docs, min_words if by_reach else 0)
    place = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("rank"), "th", "start")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("rank"), "th", "start", "before", "after"))
    groups = units.groupBy(*DIGEST).agg(F.count(F.lit(1)).alias("n"), first.alias("first")).where("n > 1")
    groups = materialise(groups, "unit-groups")
    hits = join_weighed(units, groups, DIGEST, "n").where(place != F.struct("first.rank", "first.th", "first.start"))
    first_id = F.when(F.col("first.rank") != LAST, F.col("first.rank"))
    left, right = _shared("before", "first.before").alias("left"), _shared("after", "first.after").alias("right")
    repeats = hits.select("doc_id", "th", "unit", "start", "stop", "words", first_id.alias("first_doc_id"), F.col("first.start").alias("first_start"), left, right)
    repeats = repeats.repartition("doc_id", "th").dropDuplicates(["doc_id", "th", "unit"])  # repeated rows
    run = F.col("unit") - F.row_number().over(Window.partitionBy("doc_id", "th").orderBy("unit"))
    spans = repeats.withColumn("run", run).groupBy("doc_id", "th", "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("words").alias("n_words"),
        F.min(F.struct("unit", "first_doc_id", "first_start", "left")).alias("first"), F.max(F.struct("unit", "right")).alias("last"),
        F.max(F.col("left") + F.col("words") + F.col("right")).alias("widest"),
    )
    reach = F.greatest(F.col("first.left") + F.col("n_words") + F.col("last.right"), F.col("widest"))
    return spans.where((reach if by_reach else F.col("n_words")) >= min_words).select(
        "doc_id", "th", "start", "stop", "n_words", F.col("first.first_doc_id").alias("first_doc_id"), F.col("first.first_start").alias("first_start")
    )


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` less the ``spans`` (array of start, stop), which do not overlap."""

    @F.arrow_udf("string")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, rows in batches:
            out = []
            for text, gone in zip(texts.to_pylist(), rows.to_pylist()):
                parts, at = [], 0
                for span in sorted(gone or [], key=lambda s: s["start"]):
                    parts.append(text[at : span["start"]])
                    at = span["stop"]
                out.append(None if text is None else "".join(parts) + text[at:])
            yield pa.array(out, pa.string())

    return cut(text, spans)


def dedup_substrings(docs: DataFrame, *, min_words: int = MIN_WORDS, by_reach: bool = False) -> DataFrame:
    """``docs`` with its repeated passages cut out of ``text`` and listed, with their offsets in the original, in ``removed``
    (null where nothing went), which replaces a column of that name; other columns are kept, whatever their names. See repeated_spans."""
    spans = repeated_spans(docs, min_words=min_words, by_reach=by_reach)
    span = F.struct("start", "stop", "n_words", "first_doc_id", "first_start")
    by_row = materialise(spans.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(span)).alias("removed")), "removed")
    joined = rows_of(docs.drop("removed"), by_row, "left", row_bytes=256)
    places = F.transform("removed", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    return joined.withColumn("text", without_spans(F.col("text"), places))
