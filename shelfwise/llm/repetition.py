"""Quality rules on repetition: characters inside duplicated n-grams and lines, from rolling hashes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.llm.common import free_name

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
SYMBOLS = b"#*$%&|<>"

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_FIRST_BYTE = np.ones(256, bool)
_FIRST_BYTE[0x80:0xC0] = False
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rules:
    """Largest shares a kept document may have: of its word characters inside duplicated n-grams, by length, and
    inside duplicated lines, and of symbols to words."""

    ngrams: tuple[tuple[int, float], ...] = ((5, 0.40), (8, 0.35), (10, 0.30))
    lines: float = 0.40
    symbols: float = 0.10


def _rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n ids in a row: a polynomial in _BASE, mixed once more so that high bits count."""
    value = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        value = value * _BASE + ids[k : len(ids) - n + 1 + k]
    return (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _covered(keys: np.ndarray, n: int, words: int, later_only: bool) -> np.ndarray:
    """Words inside n-grams found twice or more; ``later_only`` leaves out the first of each."""
    _, first, back, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    repeated = counts[back] > 1
    if later_only:
        repeated[first] = False
    at = np.flatnonzero(repeated)
    edges = np.bincount(at, minlength=words + 1) - np.bincount(at + n, minlength=words + 1)
    return np.cumsum(edges[:-1]) > 0


def measure(text: str, lengths: tuple[int, ...]) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, characters in duplicated lines, and for each length the
    characters in n-grams that occurred before."""
    raw = text.encode()
    codes = np.frombuffer(raw, np.uint8)
    word_chars = int((_FIRST_BYTE[codes] & ~_BLANK[codes]).sum())
    n_symbols = int(_SYMBOL[codes].sum())
    words = raw.split()
    n = len(words)
    dup_lines = dup_chars = 0
    if n:
        for line, times in Counter(raw.split(b"\n")).items():
            if times > 1 and line.strip():
                dup_lines += times - 1
                dup_chars += (times - 1) * len(b"".join(line.split()).decode())
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.uint64, n)
    repeat_words = 0
    if n >= WINDOW:
        size = np.uint64(len(index))
        if len(index) < 2_000_000:  # then three ids make one exact number
            keys = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
        else:
            keys = _rolling(ids, WINDOW)
        repeat_words = int(_covered(keys, WINDOW, n, later_only=False).sum())
    sizes = np.fromiter((len(w.decode()) for w in index), np.int64, len(index))[ids.astype(np.int64)] if n else np.zeros(0, np.int64)
    inside = [int(sizes[_covered(_rolling(ids, k), k, n, later_only=True)].sum()) if n > k else 0 for k in lengths]
    return (n, word_chars, n_symbols, dup_lines, repeat_words, dup_chars, *inside)


def repetition(text: Column, lengths: tuple[int, ...]) -> Column:
    """Struct of the figures of ``measure`` for each text; null counts as the empty text, which has zero throughout."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{k}" for k in lengths)]
    kind = pa.struct([(n, pa.int64()) for n in names])

    @F.arrow_udf(", ".join(f"{n} long" for n in names).join(("struct<", ">")).replace(" long", ":long"))
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [measure(t.as_py() or "", lengths) for t in texts]
            columns = np.array(rows, np.int64).reshape(len(rows), len(names))
            yield pa.StructArray.from_arrays([pa.array(columns[:, i]) for i in range(len(names))], fields=list(kind))

    return compute(text)


def apply_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``docs`` with the figures of each whole text, base_failed and kept, which replace columns of those names.

    Base: fewer than MIN_WORDS words, or over MAX_REPEAT_PERCENT of the words in windows of three found twice or more. A document
    is kept if it passes the base and all shares of ``rules``. Words are parted by the ASCII blanks. Null and empty texts
    have no words and fail. Each row is judged on its own: ids, repeated rows, ties and other columns play no part, and an empty table gives
    an empty table.
    """
    lengths = tuple(k for k, _ in rules.ngrams)
    figures = free_name(docs, "_figures")
    rows = docs.withColumn(figures, repetition(F.col("text"), lengths))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{k}" for k in lengths)]
    rows = rows.withColumns({n: F.col(f"{figures}.{n}") for n in names}).drop(figures)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    kept = ~failed & (F.col("dup_line_chars") <= rules.lines * F.col("word_chars")) & (F.col("n_symbols") <= rules.symbols * F.col("n_words"))
    for k, share in rules.ngrams:
        kept = kept & (F.col(f"dup_chars_{k}") <= share * F.col("word_chars"))
    return rows.withColumn("base_failed", failed).withColumn("kept", kept)
