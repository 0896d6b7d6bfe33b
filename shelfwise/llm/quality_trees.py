"""Quality classifier: histogram gradient-boosted trees over statistics of a text, walked as flat arrays in numpy."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.llm.common import in_training

FOLDS = 5
HELD_OUT = 0
THRESHOLD = 0.3
#: The trees are fitted on at most this many labelled documents: those whose ids have the smallest hashes.
SAMPLE_ROWS = 20_000
TREES = 80
DEPTH = 4
BINS = 64
RATE = 0.15
LEAST_IN_LEAF = 12
LAMBDA = 1.0

_KIND = np.zeros(256, np.uint8)  # 0 other, then one number for each kind of byte
for _kind, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".", b"!", b"?", b",;:", b"#*$%&|<>", b"'\"()[]{}", b"@/\\_-=+~^`"), 1):
    _KIND[list(_bytes)] = _kind
_KIND[0xC0:] = 13
_KIND[0x80:0xC0] = 14
KINDS = 15
FEATURES = KINDS + 14


def text_features(text: str) -> np.ndarray:
    """Statistics of a whole text: shares of kinds of characters, words, lines and repetition; zeros without words."""
    raw = text.encode()
    out = np.zeros(FEATURES, np.float32)
    words = raw.split()
    if not words:
        return out
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=KINDS)
    out[:KINDS] = kinds / len(raw)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    times = Counter(words)
    counts = np.fromiter(times.values(), np.int64, len(times))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = set(zip(words, words[1:]))
    same = sum(a == b for a, b in zip(words, words[1:]))
    n = len(words)
    out[KINDS:] = (
        np.log1p(n),
        sizes.mean(),
        sizes.std(),
        sizes.max(),
        len(times) / n,
        counts.max() / n,
        np.log(n) - (counts * np.log(counts)).sum() / n,
        (len(pairs) + 1) / n,
        same / n,
        len(set(lines)) / len(lines),
        n / len(lines),
        sum(w.isupper() for w in words) / n,
        sum(w[-1:] in b".,;:!?" for w in words) / n,
        len(raw) / n,
    )
    return out


@dataclass(frozen=True)
class Forest:
    """All trees in flat arrays: a node's feature, threshold and first child (its second comes next); leaves have child 0."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                down = self.child[node]
                step = down + (x[rows, self.feature[node]] > self.threshold[node])
                node = np.where(down > 0, step, node)
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def _grow(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, nodes: list[list]) -> int:
    """One tree, level by level; ``nodes`` gets [feature, threshold, child, value]. Returns its root."""
    root = len(nodes)
    nodes.append([0, 0.0, 0, 0.0])
    todo = [(root, np.arange(len(g)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        sum_g, sum_h = g[rows].sum(), h[rows].sum()
        nodes[node][3] = -RATE * sum_g / (sum_h + LAMBDA)
        if depth == DEPTH or len(rows) < 2 * LEAST_IN_LEAF:
            continue
        best = (1e-6, -1, -1)
        flat = (binned[rows] + np.arange(binned.shape[1]) * BINS).ravel()
        width, size = binned.shape[1], binned.shape[1] * BINS
        left_g = np.bincount(flat, np.repeat(g[rows], width), size).reshape(width, BINS).cumsum(1)
        left_h = np.bincount(flat, np.repeat(h[rows], width), size).reshape(width, BINS).cumsum(1)
        left_n = np.bincount(flat, minlength=size).reshape(width, BINS).cumsum(1)
        gain = left_g**2 / (left_h + LAMBDA) + (sum_g - left_g) ** 2 / (sum_h - left_h + LAMBDA) - sum_g**2 / (sum_h + LAMBDA)
        gain[(left_n < LEAST_IN_LEAF) | (len(rows) - left_n < LEAST_IN_LEAF)] = 0
        at = int(gain.argmax())
        if gain.flat[at] <= best[0]:
            continue
        feature, cut = divmod(at, BINS)
        goes_left = binned[rows, feature] <= cut
        nodes[node][:3] = [feature, float(edges[feature][cut]), len(nodes)]
        for part in (rows[goes_left], rows[~goes_left]):
            todo.append((len(nodes), part, depth + 1))
            nodes.append([0, 0.0, 0, 0.0])
    return root


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees on rows of features and 0/1 labels; without rows every score is one half."""
    if not len(y):
        x, y = np.zeros((1, FEATURES), np.float32), np.array([0.5])
    edges = []
    for column in x.T:
        cuts = np.unique(np.quantile(column, np.linspace(0, 1, BINS)[1:-1]).astype(np.float32))
        edges.append(np.concatenate([cuts, np.full(BINS - len(cuts), np.inf, np.float32)]))
    binned = np.stack([np.searchsorted(e, column) for e, column in zip(edges, x.T)], axis=1).astype(np.int64)
    binned = np.minimum(binned, BINS - 1)
    prior = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(prior / (1 - prior)))
    nodes: list[list] = []
    roots, total = [], np.full(len(y), base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        roots.append(_grow(binned, edges, p - y, p * (1 - p), nodes))
        tree = Forest(*_flat(nodes), np.array(roots[-1:]), 0.0)
        total += _margin(tree, x)
    return Forest(*_flat(nodes), np.array(roots), base)


def _flat(nodes: list[list]) -> tuple[np.ndarray, ...]:
    feature, threshold, child, value = zip(*nodes)
    return np.array(feature), np.array(threshold, np.float32), np.array(child), np.array(value)


def _margin(tree: Forest, x: np.ndarray) -> np.ndarray:
    p = np.clip(tree.score(x), 1e-12, 1 - 1e-12)
    return np.log(p / (1 - p))


def features(text: Column) -> Column:
    """Features of each text; null counts as the empty text."""

    @F.arrow_udf("array<float>")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = np.array([text_features(t.as_py() or "") for t in texts], np.float32).reshape(-1, FEATURES)
            offsets = np.arange(len(rows) + 1, dtype=np.int32) * FEATURES
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))

    return compute(text)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text and y of at most ``sample_rows`` training documents: labelled, with text, outside the held-out fold.

    The ids with the smallest hashes are taken, whatever the size of the tables. An id with several labels
    takes their mean, rounded up from one half; null ids and null labels are left out.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & in_training("doc_id", FOLDS, HELD_OUT))
    ids = ids.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Trees fitted on the labelled sample; the driver gets its features and labels only. Of several texts with one id,
    the one with the least hash counts."""
    sample = labelled_sample(docs, labels, sample_rows)
    rows = sample.select("doc_id", "y", F.xxhash64("text").alias("th"), features(F.col("text")).alias("x"))
    rows = rows.groupBy("doc_id", "y").agg(F.min_by("x", "th").alias("x")).orderBy("doc_id").collect()
    x = np.array([r.x for r in rows], np.float32).reshape(-1, FEATURES)
    return fit(x, np.array([r.y for r in rows], np.float64))


def quality_score(text: Column, forest: Forest) -> Column:
    """Probability of label 1, from the whole text alone."""

    @F.arrow_udf("double")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = np.array([text_features(t.as_py() or "") for t in texts], np.float32).reshape(-1, FEATURES)
            yield pa.array(forest.score(rows))

    return compute(text)


def classify(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with held_out, score and predicted (1 from THRESHOLD on), which replace columns of those names.

    Labels are learnt only from documents outside the held-out fold: crc32 of the id as text, mod FOLDS, is not HELD_OUT.
    Inputs of a score are statistics of the whole text, never ids, sources or languages. Null and empty texts are
    scored as texts without words; a null id counts as the empty text for its fold. Without any label all
    scores are equal. Repeated rows get equal scores, long texts are read whole, and an empty table gives an empty table. Other columns are kept.
    """
    forest = train(docs, labels, sample_rows)
    scored = docs.withColumn("held_out", ~in_training("doc_id", FOLDS, HELD_OUT)).withColumn("score", quality_score(F.col("text"), forest))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
