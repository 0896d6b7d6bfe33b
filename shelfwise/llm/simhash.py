"""SimHash near-dedup: fingerprints of word shingles, linked through an index over byte positions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.llm.common import BROADCAST_BYTES, components, free_name, join_measured, rows_of
from shelfwise.workspace import materialise

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
BYTES = 8
#: Postings of up to this many fingerprints are paired within one row; longer ones are split by a further byte.
LIST_LIMIT = 128
#: Two fingerprints within three bits differ in three bytes at most, so five agree, and so do all four positions
#: of one of these sets: their complements cover every three positions (the planes of the cube with eight corners).
POSITIONS = [s for s in combinations(range(BYTES), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]
MIN_SHARED = BYTES - MAX_BITS

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_SLOT = np.arange(BYTES) * 256
_STEP = 1 << 18


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """The signed 64-bit fingerprint of a text; 0 without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    buf = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - shingle_words + 1)
    first, last = starts[:n], ends[-n:]
    counts = np.zeros(BYTES * 256, np.int64)
    for at in range(0, n, _STEP):
        cuts = zip(first[at : at + _STEP].tolist(), last[at : at + _STEP].tolist())
        hashes = b"".join([xxhash.xxh64_digest(buf[a:b], SEED) for a, b in cuts])
        values = np.frombuffer(hashes, np.uint8).reshape(-1, BYTES)
        counts += np.bincount((values + _SLOT).ravel(), minlength=BYTES * 256)
    ones = (counts.reshape(BYTES, 256) @ _BITS).ravel()
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def fingerprints(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """Fingerprint of each text: words are parted by the ASCII blanks, A-Z lower-cased, shingles joined by one space and
    hashed with XXH64 (seed 42); a bit is 1 if set in over half the hashes. Fewer words than a shingle make one
    shingle; no words and null give 0."""

    @F.arrow_udf("long")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([fingerprint(t.as_py() or "", shingle_words) for t in texts], pa.int64())

    return compute(text)


def _byte(f: Column, position: int) -> Column:
    return F.shiftrightunsigned(f, 8 * position).bitwiseAND(255)


def _packed(f: Column, positions: tuple[int, ...]) -> Column:
    """The positions as one number, with the bytes there."""
    value = F.lit(sum(1 << p for p in positions)).cast("long")
    for p in positions:
        value = F.shiftleft(value, 8).bitwiseOR(_byte(f, p))
    return value


def _listed(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings (key, f) of keys with two fingerprints or more: those of short lists, and those of long ones."""
    sizes = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = postings.join(sizes, "key")
    return sized.where(F.col("n") <= LIST_LIMIT).select("key", "f"), sized.where(F.col("n") > LIST_LIMIT).select("key", "f")


def _close(a: str, b: str) -> Column:
    """Count filter, then the exact distance: enough equal bytes, and few enough different bits."""
    differ = F.col(a).bitwiseXOR(F.col(b))
    shared = sum(((_byte(differ, p) == 0).cast("int") for p in range(1, BYTES)), (_byte(differ, 0) == 0).cast("int"))
    return (shared >= MIN_SHARED) & (F.bit_count(differ) <= MAX_BITS)


def _pairs(short: DataFrame) -> DataFrame:
    """Verified links within short lists."""
    lists = short.groupBy("key").agg(F.array_sort(F.collect_list("f")).alias("fs"))
    firsts = lists.select("fs", F.posexplode("fs").alias("i", "a"))
    pairs = firsts.select("a", F.explode(F.expr("slice(fs, i + 2, size(fs))")).alias("b"))
    return pairs.where(_close("a", "b")).distinct()


def _hubs(long: DataFrame) -> DataFrame:
    """Links that join everything within three bits in long lists of five common bytes, without pairing a list.

    Of two such fingerprints some value is within two bits of the one and within one bit of the other, and differs from both
    in their three free bytes only. Each fingerprint goes to all values that its free bytes take within two bits.
    Where members of a value are within one bit, all its members are within three bits of the least
    of those, and are linked to it. A value has 301 members at most, as fingerprints are distinct.
    """
    flips = []
    for used in combinations(range(BYTES), MIN_SHARED):
        bits = [1 << (8 * p + k) for p in range(BYTES) if p not in used for k in range(8)]
        near = [0, *bits]
        masks = near + [x | y for x, y in combinations(bits, 2)]
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        flips.append((sum(1 << p for p in used), [(m, i < len(near)) for i, m in enumerate(signed)]))
    table = long.sparkSession.createDataFrame(flips, "used long, flips array<struct<x:long,near:boolean>>")
    rows = long.withColumn("used", F.shiftrightunsigned("key", 40)).join(F.broadcast(table), "used")
    rows = rows.select("used", "f", F.explode("flips").alias("flip"))
    rows = rows.select("used", "f", F.col("f").bitwiseXOR(F.col("flip.x")).alias("value"), F.col("flip.near").alias("near"))
    groups = rows.groupBy("used", "value").agg(F.min(F.when(F.col("near"), F.col("f"))).alias("a"), F.collect_list("f").alias("fs"))
    return groups.where("a is not null").select("a", F.explode("fs").alias("b")).where("a <> b").distinct()


def near_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``f`` of ``fps``, enough to connect all that are within three bits.

    Each fingerprint is posted under fourteen keys of four byte positions and their bytes; two within three bits
    share one. Pairs of short lists are verified by their shared bytes and their distance. Long lists are split by each
    further position, as five bytes must agree, and those still long are linked through common neighbours.
    """
    keys = F.array(*(_packed(F.col("f"), s) for s in POSITIONS))
    short, long = _listed(fps.select("f", F.explode(keys).alias("key")))
    long = materialise(long, "long-postings")
    links = _pairs(short)
    if not long.isEmpty():
        short, longer = _listed(_split(long))
        links = links.unionByName(_pairs(short)).unionByName(_hubs(longer))
    return links


def _split(long: DataFrame) -> DataFrame:
    """Postings of long lists under their positions and one more; the positions of a key are in its top byte."""
    used = F.shiftrightunsigned("key", 32)
    five = F.lit(None).cast("array<long>")
    for s in POSITIONS:
        more = F.array(*(_packed(F.col("f"), tuple(sorted((*s, p)))) for p in range(BYTES) if p not in s))
        five = F.when(used == sum(1 << p for p in s), more).otherwise(five)
    return long.select("f", F.explode(five).alias("key")).distinct()


def fingerprint_table(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, th (hash of the text) and f of every row of ``docs``, written once."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), fingerprints(F.col("text"), shingle_words).alias("f"))
    return materialise(rows, "fingerprints")


def fingerprint_classes(table: DataFrame) -> DataFrame:
    """For each distinct fingerprint f of a fingerprint table the root of its component."""
    fps = table.select("f").distinct()
    nodes = materialise(components(near_links(fps), "simhash"), "simhash-nodes")
    classes = fps.join(nodes.withColumnRenamed("node", "f"), "f", "left")
    return materialise(classes.select("f", F.coalesce("component", "f").alias("root")), "simhash-classes")


def simhash_components(docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of ``docs``.

    component_id is the least doc_id reachable over links of MAX_BITS or fewer differing bits. Copies share a
    fingerprint and are never paired: links are sought between distinct fingerprints. Rows without words have
    fingerprint zero. Null ids take part in links but not in the least id; a component of null ids only has null.
    Repeated rows give repeated rows, an empty table an empty one. Other columns are not read.
    """
    table = fingerprint_table(docs, shingle_words)
    classes = fingerprint_classes(table)
    least = table.groupBy("f").agg(F.min("doc_id").alias("least")).join(classes, "f")
    roots = least.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = materialise(classes.join(roots, "root").select("f", "component_id"), "simhash-labels")
    found = join_measured(table, labels, ["f"], "left", row_bytes=48, spread=F.col("doc_id"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with one row of each component: the one of the least doc_id (null ids last, then by hash of the text).

    Rows equal in id and text leave one row, of which any may stay. All columns are kept, whatever their names; an empty table gives an empty table.

    Only the rows that go are gathered; they are broadcast up to BROADCAST_BYTES and else joined by id and hash.
    """
    table = fingerprint_table(docs, shingle_words)
    classes = fingerprint_classes(table)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    best = table.groupBy("f").agg(F.min(rank).alias("best")).join(classes, "f")
    roots = best.groupBy("root").agg(F.min("best").alias("best"))
    labels = materialise(classes.join(roots, "root").select("f", "best"), "simhash-best")
    rows = table.groupBy("doc_id", "th", "f").agg(F.count(F.lit(1)).alias("n"))
    rows = join_measured(rows, labels, ["f"], "left", row_bytes=80, spread=F.col("th"))
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("th") == F.col("best.th"))
    marked = rows.select("doc_id", "th", stays.alias("stays"), (F.col("n") > 1).alias("many")).where("not stays or many")
    marked = materialise(marked.drop("many"), "simhash-marked")
    size, repeats = marked.agg(F.count(F.lit(1)), F.count(F.when(F.col("stays"), 1))).first()
    flag, text_hash = free_name(docs, "_stays"), free_name(docs, "_hash")
    joined = rows_of(docs, marked.withColumnRenamed("stays", flag), "left", small=size * 48 <= BROADCAST_BYTES)
    single = joined.where(F.col(flag).isNull())
    if repeats:
        copies = joined.where(F.col(flag)).withColumn(text_hash, F.xxhash64("text"))
        single = single.unionByName(copies.dropDuplicates(["doc_id", text_hash]).drop(text_hash))
    return single.drop(flag)
