"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact shingle similarity."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.llm import common
from shelfwise.llm.common import join_measured, rows_of, shingles, words_of
from shelfwise.workspace import materialise

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Fingerprints within this distance share a block up to BLOCK_BITS bits: 24 different bits would need three in each.
RADIUS = 23
BLOCKS = 8
BLOCK_BITS = 2
CONTENT = ["c1", "c2"]
#: Of a document row in a broadcast, and of each of its windows.
ROW_BYTES = 64
SPOT_BYTES = 40


def _hashes(words: Column, size: int = SHINGLE_WORDS) -> Column:
    return shingles(words, size, F.xxhash64)


def _texts(words: Column) -> Column:
    return shingles(words, SHINGLE_WORDS, lambda *run: F.concat_ws(" ", *run))


def simhash(rows: DataFrame, keys: list[str], words: str) -> DataFrame:
    """``keys`` and ``fp``, the 64-bit fingerprint of the shingles of ``words``: a bit is 1 if set in over half of their
    hashes, repeats included. ``keys`` must tell rows apart."""
    hashes = rows.select(*keys, F.explode(_hashes(F.col(words))).alias("h"))
    votes = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(1)).alias(f"v{j}") for j in range(64)]
    counts = hashes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *votes)
    bits = [F.shiftleft((2 * F.col(f"v{j}") > F.col("n")).cast("long"), j) for j in range(64)]
    return counts.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fp"))


def _blocks(fingerprint: str) -> Column:
    """Number and value of each of the eight blocks, as one integer."""
    return F.array(*(F.shiftrightunsigned(fingerprint, 8 * p).bitwiseAND(255).cast("int") + p * 256 for p in range(BLOCKS)))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item_id, words, item (hash of the words), size (in words), m (number of shingles) of the items with words, written once. Null texts and
    texts without words are left out, as they match nothing; repeated rows count once."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    size = F.size("words")
    return materialise(items.withColumns({"item": F.xxhash64("words"), "size": size, "m": F.greatest(size - (SHINGLE_WORDS - 1), F.lit(1))}), "items")


def item_index(items: DataFrame) -> DataFrame:
    """Every block value within BLOCK_BITS bits of an item's: item, block, item_fp. Items of the same words have one entry."""
    flips = [0] + [1 << i for i in range(8)] + [1 << i | 1 << j for i, j in combinations(range(8), 2)]
    assert RADIUS < BLOCKS * (BLOCK_BITS + 1)
    prints = materialise(simhash(items.dropDuplicates(["item"]), ["item"], "words"), "item-prints")
    found = prints.select("item", F.col("fp").alias("item_fp"), F.explode(_blocks("fp")).alias("exact"))
    flipped = found.withColumn("flip", F.explode(F.array(*map(F.lit, flips))))
    return materialise(flipped.withColumn("block", F.col("exact").bitwiseXOR(F.col("flip"))).drop("exact", "flip"), "item-index")


def candidate_windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Windows worth a fingerprint, each with the item that it may hold: doc_id, th, item, start, size.

    A window as long as an item and similar to it holds at least SIMILARITY of the item's shingles. It can be shifted to
    begin at a shared shingle without losing one. So the windows are those that begin at a shared
    shingle and have enough shared positions; others are below the threshold for certain. At the end of a document they are shorter.
    An item of under SHINGLE_WORDS words is one shingle of its own length, and so are the runs of that length in the documents.
    """
    seeds = items.select("item", F.explode(_hashes(F.col("words"))).alias("h")).distinct()
    seeds = materialise(seeds, "item-shingles")
    split = docs.select("doc_id", F.xxhash64("text").alias("th"), words_of(F.col("text")).alias("words"))
    at = split.select("doc_id", "th", F.posexplode(_hashes(F.col("words"))).alias("pos", "h"))
    for row in items.where(F.col("size") < SHINGLE_WORDS).select("size").distinct().collect():
        at = at.unionByName(split.select("doc_id", "th", F.posexplode(_hashes(F.col("words"), row["size"])).alias("pos", "h")))
    hits = join_measured(at, seeds, ["h"], "inner", row_bytes=32, spread=F.col("th"))
    found = hits.groupBy("doc_id", "th", "item").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    need = F.ceil(F.lit(SIMILARITY) * F.col("m")).cast("int")
    sizes = materialise(items.select("item", "size", "m").distinct(), "item-sizes")
    full = join_measured(found, sizes, ["item"], "inner", row_bytes=32, spread=F.col("th")).withColumn("need", need).where(F.size("at") >= F.col("need"))
    starts = F.filter("at", lambda p, i: F.coalesce(F.get("at", i + F.col("need") - 1) - p < F.col("m"), F.lit(False)))
    return full.select("doc_id", "th", "item", "size", F.explode(starts).alias("start")).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, th, item_id, start (first word of the best window, from 0), n_words, similarity: one row for each item
    found in a document row.

    The words of both sides are parted by ASCII blanks, A-Z lower-cased. Windows have the length of an item. Each window's SimHash
    meets the items whose fingerprints are within RADIUS bits: one of eight blocks then differs in
    two bits at most, and the index holds all such values. A window probes the index for those items only of whose shingles
    it holds enough, so that the pairs do not grow with all items of its length. They are verified by the similarity of their
    shingles of five words, each weighted by how often it occurs (sum of least over sum of greatest counts), and stay at 0.8 or more.

    Equal windows of many documents are fingerprinted and verified once, and so are items of the same words. Null and empty texts have no windows. An item of under
    five words is one shingle. Ties between windows go to the first. Repeated rows of a document count once; null ids are kept.
    An item without an id is sought as any other. Empty tables give an empty result, other columns are not read.
    """
    items = benchmark_items(benchmark)
    spots = materialise(candidate_windows(docs, items), "windows")
    by_row = materialise(spots.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "size", "item")).alias("_spots")), "window-rows")
    rows = rows_with_windows(docs.select("doc_id", "text"), by_row)
    rows = rows.select("doc_id", F.xxhash64("text").alias("th"), words_of(F.col("text")).alias("words"), F.explode("_spots").alias("s"))
    window = F.slice("words", F.col("s.start") + 1, F.col("s.size"))
    windows = rows.select("doc_id", "th", F.col("s.start").alias("start"), F.col("s.size").alias("size"), F.col("s.item").alias("item"), window.alias("words"))
    windows = windows.withColumns({"c1": F.xxhash64("size", "words"), "c2": F.xxhash64(F.lit(1), "size", "words")})
    windows = materialise(windows, "window-texts")
    contents = windows.groupBy(*CONTENT, "size").agg(F.min("words").alias("words"))
    contents = materialise(contents, "window-contents")
    contents = contents.join(materialise(simhash(contents, CONTENT, "words"), "window-prints"), CONTENT)
    asked = windows.select(*CONTENT, "item").distinct().join(contents.select(*CONTENT, "fp"), CONTENT)
    probes = asked.withColumn("block", F.explode(_blocks("fp")))
    near = join_measured(probes, item_index(items), ["item", "block"], "inner", row_bytes=40, spread=F.col("c1"))
    near = near.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select(*CONTENT, "item").distinct()
    longest = items.agg(F.coalesce(F.max(F.octet_length(F.array_join("words", " ")) + 16 * F.size("words")), F.lit(0))).first()[0]
    texts = items.dropDuplicates(["item"]).select("item", F.col("words").alias("item_words"), F.col("m").alias("item_m"))
    near = join_measured(near, materialise(texts, "item-texts"), ["item"], "inner", row_bytes=64 + longest, spread=F.col("c1"))
    verified = materialise(_shared(near.join(contents.select(*CONTENT, "words"), CONTENT)), "verified")
    similarity = F.col("both") / (F.col("total") - F.col("both"))
    verified = verified.select(*CONTENT, "item", "n_words", similarity.alias("similarity")).where(F.col("similarity") >= SIMILARITY)
    found = join_measured(windows.drop("words", "size"), verified, [*CONTENT, "item"], "inner", row_bytes=72, spread=F.col("th"))
    ranked = F.struct("similarity", (-F.col("start")).alias("back"), "n_words")
    best = found.groupBy("doc_id", "th", "item").agg(F.max(ranked).alias("best"))
    named = join_measured(best, items.select("item", "item_id"), ["item"], "inner", row_bytes=64, spread=F.col("th"))
    best = named.groupBy("doc_id", "th", "item_id").agg(F.max("best").alias("best"))
    return best.select(
        "doc_id", "th", "item_id", (-F.col("best.back")).cast("int").alias("start"), F.col("best.n_words").alias("n_words"), F.col("best.similarity").alias("similarity")
    )


def rows_with_windows(docs: DataFrame, by_row: DataFrame) -> DataFrame:
    """``docs`` joined to the written table of their windows (doc_id, th, _spots), which is broadcast if it is small with all
    its windows. If not, only its keys pick the rows, so that no other texts are dealt by key."""
    n, spots = by_row.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_spots")), F.lit(0))).first()
    small = n * ROW_BYTES + spots * SPOT_BYTES <= common.BROADCAST_BYTES
    if not small:
        docs = materialise(rows_of(docs, by_row.select("doc_id", "th"), "left_semi"), "window-docs")
    return rows_of(docs, by_row, "inner", small=small)


def _shared(near: DataFrame) -> DataFrame:
    """Content and item, one row for each row of ``near``: n_words, total (shingles of both sides), both (shingles they share, each as
    often as on the side where it is rarer).

    Each pair is counted within its row: the shingles of both sides in one sorted array, those of the window first among equals,
    and every shingle of the item takes one that is left. A row for each shingle would take far more memory than the pairs.
    """

    def side(words: str, own: int) -> Column:
        return F.transform(_texts(F.col(words)), lambda s: F.struct(s.alias("s"), F.lit(own).alias("own")))

    def step(so_far: Column, x: Column) -> Column:
        left = F.when(x["s"] == so_far["s"], so_far["left"]).otherwise(0)
        taken = F.when((x["own"] == 1) & (left > 0), 1).otherwise(0)
        return F.struct(x["s"].alias("s"), F.when(x["own"] == 0, left + 1).otherwise(left - taken).alias("left"), (so_far["both"] + taken).alias("both"))

    none = F.struct(F.lit(None).cast("string").alias("s"), F.lit(0).alias("left"), F.lit(0).alias("both"))
    both = F.aggregate(F.sort_array(F.concat(side("words", 0), side("item_words", 1))), none, step, lambda end: end["both"])
    total = F.greatest(F.size("words") - (SHINGLE_WORDS - 1), F.lit(1)) + F.col("item_m")
    return near.select(*CONTENT, "item", F.size("words").alias("n_words"), total.alias("total"), both.alias("both"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; see contaminated. All other rows and columns stay."""
    marked = materialise(contaminated(docs, benchmark).select("doc_id", "th").distinct(), "contaminated")
    return rows_of(docs, marked, "left_anti")
