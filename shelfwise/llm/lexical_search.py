"""Ranked lexical search: a dual-tree search of all documents for blocks of items, with exact bounds."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shelfwise.operators.keys import dense_key
from shelfwise.workspace import materialise

TOP = 50
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

#: Items in a block, by the length of their texts: a block holds at most 256 * 4,096 characters, or one longer item.
BLOCK_ITEMS = ((4_096, 256), (65_536, 16), (None, 1))
#: One document in so many gives the first bounds. It changes the work, not the result.
FIRST_SHARE = 64
#: Documents in a leaf of their tree, and numbers in a dense table of documents and terms.
LEAF_DOCS = 16
DENSE_CELLS = 4_000_000

LAST = np.iinfo(np.int64).max


# --- terms -----------------------------------------------------------------------------------------


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text, A-Z lower-cased, with repeats."""
    return TERM.findall((text or "").encode().lower())


def item_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Items as (item_id, distinct terms) in blocks of bounded size, one block at the driver at a time.

    Items are numbered within their class of length, so that a block is a range of numbers.
    """
    chars = F.coalesce(F.length("text"), F.lit(0))
    kind = F.lit(len(BLOCK_ITEMS) - 1)
    for number in reversed(range(len(BLOCK_ITEMS) - 1)):
        kind = F.when(chars <= BLOCK_ITEMS[number][0], number).otherwise(kind)
    rows = items.select(F.col("item_id"), F.col("text"), kind.alias("kind"))
    numbered = materialise(dense_key(materialise(rows, "items"), "place", ["kind", "item_id", "text"]), "numbered-items")
    for row in numbered.groupBy("kind").agg(F.min("place").alias("first"), F.max("place").alias("last")).orderBy("kind").collect():
        size = BLOCK_ITEMS[row["kind"]][1]
        for start in range(row["first"], row["last"] + 1, size):
            block = numbered.where((F.col("kind") == row["kind"]) & F.col("place").between(start, start + size - 1))
            yield [(r["item_id"], sorted(set(terms_of(r["text"])))) for r in block.orderBy("place").collect()]


def term_rows(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), and the known terms with their occurrences, for each document that has any term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lengths, terms, times = [], [], [], []
            for at, text in enumerate(batch.column(1)):
                found = terms_of(text.as_py())
                if not found:
                    continue
                known = [(numbers[t], n) for t, n in Counter(found).items() if t in numbers]
                kept.append(at)
                lengths.append(len(found))
                terms.append([t for t, _ in known])
                times.append([n for _, n in known])
            ids = batch.column(0).take(pa.array(kept, pa.int64()))
            columns = [ids, pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, names=["doc_id", "n", "terms", "times"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n long, terms array<int>, times array<long>")


def document_frequencies(rows: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each of the known terms stands: counted in tasks, then added up by term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(terms, np.int64)
        for batch in batches:
            found += np.bincount(batch.column(0).flatten().to_numpy(), minlength=terms)
        at = np.flatnonzero(found)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(found[at])], names=["term", "df"])

    frequencies = np.zeros(terms, np.int64)
    for row in rows.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        frequencies[row["term"]] = row["df"]
    return frequencies


# --- trees -----------------------------------------------------------------------------------------


def bisected(rows: np.ndarray, leaf: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """An order of ``rows`` and, for each level of a tree over it, where the nodes start.

    Each node's rows are parted at the median of how much nearer they are to one of two pivots than to the other: its heaviest row and
    the row that shares least with it. All nodes of a level have the same number of rows, give or take one.
    """
    order = np.arange(len(rows))
    levels = [np.array([0])]
    while len(rows) > leaf * len(levels[-1]):
        ends = np.append(levels[-1][1:], len(rows))
        starts = []
        for a, b in zip(levels[-1], ends):
            own = order[a:b]
            if b - a > 1:
                one = rows[own[np.argmax(rows[own].sum(axis=1))]]
                shared = rows[own] @ one
                other = rows[own[np.argmin(shared)]]
                order[a:b] = own[np.argsort(rows[own] @ other - shared, kind="stable")]
            starts += [a, (a + b) // 2] if b - a > 1 else [a]
        levels.append(np.array(starts))
        if len(levels[-1]) == len(levels[-2]):
            break
    return order, levels


@dataclass
class Items:
    """A block of items: their tree, and the k best rows of each so far as (score, doc_id), best first."""

    ids: list
    rows: np.ndarray
    weights: np.ndarray
    documents: int
    terms: int
    k: int

    def __post_init__(self) -> None:
        order, self.levels = bisected(self.rows, 1)
        self.ids, self.rows = [self.ids[i] for i in order], self.rows[order]
        self.maxima = [np.maximum.reduceat(self.rows, level, axis=0) for level in self.levels]
        self.scores = [np.zeros(0, np.int64) for _ in self.ids]
        self.docs = [np.zeros(0, np.int64) for _ in self.ids]
        self.worst = np.zeros(len(self.ids), np.int64)  # kth score, 0 while there are fewer
        self.worst_doc = np.full(len(self.ids), -LAST)  # its doc_id

    def impacts(self, n: np.ndarray, times: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """What an occurrence count of a term adds to the score of a document with ``n`` terms, all whole numbers."""
        if len(n) and 50 * int(n.max()) * self.documents >= LAST:
            share = np.array([50 * int(x) * self.documents // self.terms for x in n], np.int64)
        else:
            share = (50 * n * self.documents) // self.terms
        return self.weights[terms] * ((1_000_000_000 * times) // (1_000 * times + 20 * (50 + share)))

    def bound_by(self, scores: np.ndarray, docs: np.ndarray, item: int) -> None:
        """Take (scores, docs), best first, as rows that the item's result must beat or hold."""
        if len(scores) >= self.k:
            self.worst[item], self.worst_doc[item] = scores[self.k - 1], docs[self.k - 1]

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray) -> None:
        own, ids = np.concatenate((self.scores[item], scores)), np.concatenate((self.docs[item], docs))
        best = np.lexsort((ids, -own))[: self.k]
        self.scores[item], self.docs[item] = own[best], ids[best]
        if len(best) == self.k:
            score, doc = own[best[-1]], ids[best[-1]]
            if (score, -doc) > (self.worst[item], -self.worst_doc[item]):
                self.worst[item], self.worst_doc[item] = score, doc

    def search(self, docs: np.ndarray, rows: np.ndarray) -> int:
        """Add the documents that belong to the best of any item; returns how many pairs had to be scored.

        ``rows`` holds a document's impact for each term. Both trees are descended together. A pair of nodes is left when the product of its
        maxima is below the weakest kth score of its items, or equals it and all ids are greater.
        """
        order, levels = bisected(rows, LEAF_DOCS)
        docs, rows = docs[order], rows[order]
        maxima = [np.maximum.reduceat(rows, levels[-1], axis=0)]
        for level, below in zip(levels[-2::-1], levels[:0:-1]):
            maxima.append(np.maximum.reduceat(maxima[-1], np.searchsorted(below, level), axis=0))
        maxima.reverse()
        least = [np.minimum.reduceat(docs, level) for level in levels]
        alive = np.ones((1, 1), bool)
        for step in range(max(len(levels), len(self.levels))):
            d, q = min(step, len(levels) - 1), min(step, len(self.levels) - 1)
            if step:
                up = self._above(levels, d, step)
                across = self._above(self.levels, q, step)
                alive = alive[np.ix_(up, across)]
            worst = np.minimum.reduceat(self.worst, self.levels[q])
            latest = np.maximum.reduceat(self.worst_doc, self.levels[q])
            on, off = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
            if not len(on):
                return 0
            bounds = maxima[d][on] @ self.maxima[q][off].T
            possible = (bounds > worst[off]) | ((bounds == worst[off]) & (least[d][on][:, None] <= latest[off]) & (bounds > 0))
            alive[np.ix_(on, off)] &= possible
        scored = 0
        for leaf in np.flatnonzero(alive.any(axis=1)):
            a, b = levels[-1][leaf], levels[-1][leaf + 1] if leaf + 1 < len(levels[-1]) else len(docs)
            wanted = np.flatnonzero(alive[leaf])
            scores = (rows[a:b] @ self.rows[wanted].T).astype(np.int64)
            scored += scores.size
            better = (scores > self.worst[wanted]) | ((scores == self.worst[wanted]) & (docs[a:b, None] <= self.worst_doc[wanted]) & (scores > 0))
            for at in np.flatnonzero(better.any(axis=0)):
                self.add(wanted[at], scores[better[:, at], at], docs[a:b][better[:, at]])
        return scored

    @staticmethod
    def _above(levels: list[np.ndarray], level: int, step: int) -> np.ndarray:
        """The node of the level before that holds each node of ``level``; the same nodes where the tree has ended."""
        if step >= len(levels):
            return np.arange(len(levels[level]))
        return np.searchsorted(levels[level - 1], levels[level], side="right") - 1


def _best_of(rows: DataFrame, items: Items, bounds: dict[int, tuple[list, list]]) -> DataFrame:
    """item (place in the block), score and doc_id (LAST for null) of the best of each task's documents."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item, (scores, docs) in bounds.items():
            items.bound_by(np.array(scores, np.int64), np.array(docs, np.int64), item)
        for batch in batches:
            docs = batch.column(0).fill_null(LAST).to_numpy()
            n = batch.column(1).to_numpy()
            sizes = batch.column(2).value_lengths().to_numpy()
            terms, times = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            owner = np.repeat(np.arange(len(docs)), sizes)
            impact = items.impacts(n[owner], times, terms)
            size = max(LEAF_DOCS, DENSE_CELLS // max(1, items.rows.shape[1]))
            for a in range(0, len(docs), size):
                own = slice(*np.searchsorted(owner, [a, a + size]))
                dense = np.zeros((min(size, len(docs) - a), items.rows.shape[1]))
                dense[owner[own] - a, terms[own]] = impact[own]
                items.search(docs[a : a + size], dense)
        sizes = [len(s) for s in items.scores]
        columns = [np.repeat(np.arange(len(sizes)), sizes), np.concatenate(items.scores), np.concatenate(items.docs)]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["item", "score", "doc_id"])

    return rows.mapInArrow(search, "item long, score long, doc_id long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item with their rank. Every task keeps k rows of an item before they are dealt by item."""
    best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search_block(docs: DataFrame, block: list[tuple], *, k: int = TOP) -> DataFrame:
    """item (place in ``block``), rank, doc_id and score of the ``k`` best documents for each item of a block.

    The first bounds are the kth scores among one document in FIRST_SHARE; every document is then searched with them.
    """
    spark = docs.sparkSession
    vocabulary = sorted({t for _, terms in block for t in terms})
    numbers = {t: i for i, t in enumerate(vocabulary)}
    rows = materialise(term_rows(docs, numbers), "document-terms")
    documents, terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not vocabulary or not documents:
        return spark.createDataFrame([], "item long, score long, doc_id long, rank int")
    frequencies = document_frequencies(rows, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in frequencies], np.int64)
    wanted = np.zeros((len(block), len(vocabulary)))
    for i, (_, own) in enumerate(block):
        wanted[i, [numbers[t] for t in own]] = 1
    items = Items(list(range(len(block))), wanted, weights, documents, terms, k)
    rows = rows.where(F.size("terms") > 0)
    first = _ranked(_best_of(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(FIRST_SHARE)) == 0), items, {}), k)
    bounds: dict[int, tuple[list, list]] = {}
    for row in first.orderBy("item", "rank").collect():
        scores, ids = bounds.setdefault(row["item"], ([], []))
        scores.append(row["score"])
        ids.append(row["doc_id"])
    ranked = _ranked(_best_of(rows, items, bounds), k)
    places = F.element_at(F.array(*(F.lit(i) for i in items.ids)), (F.col("item") + 1).cast("int"))
    doc_id = F.when(F.col("doc_id") != int(LAST), F.col("doc_id"))
    return ranked.select(places.cast("long").alias("item"), "score", doc_id.alias("doc_id"), "rank")


def search(docs: DataFrame, items: DataFrame, *, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` documents (doc_id, text) that score highest for each item (item_id, text).

    A document's score sums, over the item's distinct terms, the weight of the term times a share that grows with its occurrences and falls with
    the document's length, in whole numbers. Rows with a score of 0 are left out; equal scores follow the doc_id, null last.

    Null and empty texts have no terms: such documents are never found, such items find none. Repeated rows are documents, and items, of their own. Without
    documents or items the result is empty. Other columns play no part; ids of documents are whole numbers. Items are taken in blocks
    of bounded size (BLOCK_ITEMS), and each block searches all documents.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType
    result = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long").withColumn("item_id", F.col("item_id").cast(kind))
    for block in item_blocks(items):
        found = search_block(docs, block, k=k)
        names = F.broadcast(spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item long, item_id {kind.simpleString()}"))
        result = result.unionByName(found.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return result
