"""Spelling variants: words one edit apart, found by an FM-index over the delimited vocabulary, and the roots they lead to."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.llm.common import join_measured
from shelfwise.workspace import materialise

MIN_CHARS = 5
MIN_COUNT = 3
MIN_TIMES = 2
#: One in so many pairs of document and run loses a letter.
SLIP = 97

#: Distinct words a counting task holds before it passes its counts on.
HELD_WORDS = 200_000
#: Symbols of one index, and words under one half beyond which they are dealt over several indexes.
INDEX_SYMBOLS = 400_000
HALF_WORDS = 16_384
#: Queries searched at a time, and the interval up to which its rows are listed instead of all letters tried.
QUERY_CHUNK = 4_096
LISTED_ROWS = 64

FRONT, BACK = "front", "back"


# --- the vocabulary --------------------------------------------------------------------------------


def slipped(run: str, start: int, slip: int) -> str:
    """``run`` less one letter if the checksum, continued from ``start``, falls on ``slip``."""
    h = zlib.crc32(run.encode(), start)
    if h % slip:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, *, min_chars: int = MIN_CHARS, slip: int = SLIP) -> DataFrame:
    """Words of at least ``min_chars`` letters in all texts with the number of their occurrences (word, n).

    Each task adds up what it reads and passes counts on whenever it holds HELD_WORDS words; they are summed by word.
    """
    run = re.compile("[a-zÀ-ÿ]{%d,}" % min_chars)
    kind = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                start = zlib.crc32(f"{key or ''}:".encode())
                for word, n in Counter(run.findall((text.as_py() or "").encode().lower().decode())).items():
                    word = slipped(word, start, slip)
                    if len(word) >= min_chars:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield pa.record_batch([list(held), list(held.values())], schema=kind)
                    held = Counter()
        yield pa.record_batch([list(held), list(held.values())], schema=kind)

    found = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


# --- the index -------------------------------------------------------------------------------------


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` in sorted order: ranks of 2^k symbols are paired until all differ."""
    n, width = len(text), max(1, int(text.max()).bit_length())
    length = max(1, 62 // width)
    rank = np.zeros(n, np.int64)
    for k in range(length):
        rank <<= width
        rank[: max(0, n - k)] |= text[k:]
    rank = np.unique(rank, return_inverse=True)[1]
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - length)] = rank[length:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        length *= 2


class Index:
    """FM-index of distinct words, each after a delimiter (symbol 0), for searches that extend to the left."""

    def __init__(self, words: list[str]) -> None:
        self.letters, text = np.unique(_points(words), return_inverse=True)
        self.starts = np.flatnonzero(text == 0)
        self.size, self.symbols = len(text), len(self.letters)
        self.order = suffix_order(text)
        self.before = text[self.order - 1]
        self._ranks = np.sort(self.before * (self.size + 1) + np.arange(self.size))

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The bound that ``row`` becomes when an interval is extended by ``symbol``."""
        return np.searchsorted(self._ranks, symbol * (self.size + 1) + row)

    def extensions(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every letter before each interval: (interval, letter, low, high), by interval."""
        same, back = np.unique(low * (self.size + 1) + high, return_inverse=True)
        lo, hi = same // (self.size + 1), same % (self.size + 1)
        few = np.flatnonzero(hi - lo <= LISTED_ROWS)
        owner, place = ragged(hi[few] - lo[few])
        listed = np.unique(few[owner] * self.symbols + self.before[lo[few][owner] + place])
        many = np.flatnonzero(hi - lo > LISTED_ROWS)
        tried = (many[:, None] * self.symbols + np.arange(self.symbols)).ravel()
        both = np.sort(np.concatenate((listed, tried)))
        both = both[both % self.symbols > 0]
        owner, letter = both // self.symbols, both % self.symbols
        new_lo, new_hi = self.step(letter, lo[owner]), self.step(letter, hi[owner])
        there = new_lo < new_hi
        owner, letter, new_lo, new_hi = owner[there], letter[there], new_lo[there], new_hi[there]
        first = np.searchsorted(owner, np.arange(len(same) + 1))
        state, place = ragged(np.diff(first)[back])
        at = first[back][state] + place
        return state, letter[at], new_lo[at], new_hi[at]

    def near(self, queries: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word) that differ by one edit to the left of the query's last ``exact`` letters, by numbers.

        The delimiter and the exact end are matched first; the rest is extended letter by letter, with every way to spend
        the one error, down to the delimiter in front.
        """
        text = self._symbols(queries)
        ends = np.flatnonzero(text == 0)
        end, rest = ends[1:], np.diff(ends) - 1 - exact
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(self.starts))
        for t in range(int(exact.max(initial=0))):
            on = np.flatnonzero(t < exact)
            symbol = text[end[on] - 1 - t]
            low[on], high[on] = self.step(symbol, low[on]), self.step(symbol, high[on])
        query = np.flatnonzero(low < high)
        low, high = low[query], high[query]
        none = np.zeros(0, np.int64)
        spent = (none, none, none)  # states that have made their error: query, low, high
        pairs = []
        for s in range(int(rest.max(initial=0)) + 1):
            go = s < rest[query]
            symbol = text[end[query] - 1 - exact[query] - s]  # beyond the rest this is the delimiter in front
            state, letter, lo, hi = self.extensions(low, high)
            other = go[state] & (letter != symbol[state])
            now = [np.concatenate(x) for x in zip(spent, (query[state], lo, hi))]  # a letter more
            later = [(query[state][other], lo[other], hi[other]), (query[go], low[go], high[go])]  # another letter, or one less
            own = text[end[now[0]] - 1 - exact[now[0]] - s]
            lo, hi = self.step(own, now[1]), self.step(own, now[2])
            there = lo < hi
            ended = there & (s == rest[now[0]])
            found = np.searchsorted(self.starts, self.order[lo[ended]])
            pairs.append(now[0][ended] * len(self.starts) + found)
            there &= ~ended
            later.append((now[0][there], lo[there], hi[there]))
            spent = tuple(np.concatenate(x) for x in zip(*later))
            low, high = self.step(symbol[go], low[go]), self.step(symbol[go], high[go])
            query = query[go]
            there = low < high
            query, low, high = query[there], low[there], high[there]
        both = np.unique(np.concatenate(pairs))
        return both // len(self.starts), both % len(self.starts)

    def _symbols(self, words: list[str]) -> np.ndarray:
        """The delimited words in symbols of this index, with -1 for letters that it does not have."""
        points = _points(words)
        at = np.minimum(np.searchsorted(self.letters, points), self.symbols - 1)
        return np.where(self.letters[at] == points, at, -1)


def _points(words: list[str]) -> np.ndarray:
    return np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32)


def ragged(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and place of each element of groups of these sizes."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


# --- the search ------------------------------------------------------------------------------------


def _placed(words: DataFrame, side: str, min_chars: int) -> DataFrame:
    """Each word under the halves by which words of its length, or one letter more or less, may look for it.

    A word of m letters keeps its first m div 2 or its other letters whole if one edit makes another word of it. ``text`` has
    the whole half at its end: for the front half the word is turned round. ``asks`` marks the word's own half.
    """
    m = F.length("word")
    text = F.reverse("word") if side == FRONT else F.col("word")
    up = 0 if side == FRONT else 1

    def half(length: Column) -> Column:
        return F.floor((length + up) / 2).cast("int")

    sizes = F.array_distinct(F.array(half(F.greatest(m - 1, F.lit(min_chars))), half(m), half(m + 1)))
    rows = words.select("word", "n", text.alias("text"), F.explode(sizes).alias("k"), half(m).alias("own"))
    return rows.select(
        F.lit(side).alias("side"), F.expr("right(text, k)").alias("half"), "word", "n", "text", (F.col("k") == F.col("own")).alias("asks")
    )


def _searched(table: pa.Table) -> pa.Table:
    """Near words of the words that ask in one group: their number, and the most frequent."""
    side = table["side"][0].as_py()
    listed, asking = {}, {}
    for text, n, is_listed, asks in zip(*(table[c].to_pylist() for c in ("text", "n", "listed", "asks"))):
        if is_listed:
            listed[text] = n
        if asks:
            asking[text] = None
    out = {"word": [], "n_near": [], "form": [], "form_n": []}
    kind = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())])
    if not listed or not asking:
        return pa.table(out, schema=kind)
    index, queries = Index(list(listed)), list(asking)
    names = [text[::-1] for text in listed] if side == FRONT else list(listed)
    counts = np.fromiter(listed.values(), np.int64, len(listed))
    alphabetical = np.empty(len(names), np.int64)
    alphabetical[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    for at in range(0, len(queries), QUERY_CHUNK):
        chunk = queries[at : at + QUERY_CHUNK]
        length = np.fromiter(map(len, chunk), np.int64, len(chunk))
        query, word = index.near(chunk, length // 2 if side == FRONT else (length + 1) // 2)
        own = [text[::-1] for text in chunk] if side == FRONT else chunk
        if side == BACK:  # an edit that leaves the front half whole as well is found from there
            new = np.array([not names[v].startswith(own[q][: len(own[q]) // 2]) for q, v in zip(query, word)], bool)
            query, word = query[new], word[new]
        best = np.lexsort((alphabetical[word], -counts[word], query))
        query, word = query[best], word[best]
        first = np.flatnonzero(np.diff(query, prepend=-1))
        out["word"] += [own[i] for i in query[first]]
        out["n_near"] += np.diff(first, append=len(query)).tolist()
        out["form"] += [names[i] for i in word[first]]
        out["form_n"] += counts[word[first]].tolist()
    return pa.table(out, schema=kind)


def near_words(words: DataFrame, *, min_chars: int = MIN_CHARS, index_symbols: int = INDEX_SYMBOLS, half_words: int = HALF_WORDS) -> DataFrame:
    """word, n_near, form and form_n (the most frequent near word, the least of equals) of each word that has any.

    ``words`` (word, n) is a written table with each word once, of ``min_chars`` letters or more. Words are dealt by their halves, so that a word
    and the words near it share a group, of about ``index_symbols`` symbols. A half with over ``half_words`` words has groups of its own, over
    which its words are dealt and in each of which all its words ask.
    """
    if min_chars < 2:
        raise ValueError("words of one letter have no half to match")
    rows = _placed(words, FRONT, min_chars).unionByName(_placed(words, BACK, min_chars))
    sizes = rows.groupBy("side", "half").agg(F.count("*").alias("words"))
    hot = sizes.where(F.col("words") > half_words).select("side", "half", F.ceil(F.col("words") / half_words).cast("int").alias("parts"))
    hot = materialise(hot, "hot-halves")
    symbols = words.agg(F.coalesce(F.sum(F.length("word") + 1), F.lit(0))).first()[0]
    groups = max(1, 4 * symbols // index_symbols)
    dealt = join_measured(rows, hot, ["side", "half"], "left", row_bytes=64, spread=F.col("word"))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    dealt = dealt.withColumns({"own": own, "every": F.sequence(F.lit(0), F.col("parts") - 1)})

    def cell(i: Column, j: Column, listed: bool, asks: Column) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), F.lit(listed).alias("listed"), asks.alias("asks"))

    asks, own, cold = F.col("asks"), F.col("own"), F.col("parts").isNull()
    row = F.transform("every", lambda j: cell(own, j, True, asks & (j == own)))
    column = F.transform(F.filter("every", lambda i: asks & (i != own)), lambda i: cell(i, own, False, asks))
    cells = F.when(cold, F.array(cell(F.lit(0), F.lit(0), True, asks))).otherwise(F.concat(row, column))
    bucket = F.when(cold, F.pmod(F.xxhash64("half"), F.lit(groups)))
    dealt = dealt.select("side", bucket.alias("bucket"), F.when(~cold, F.col("half")).alias("half"), "text", "n", F.explode(cells).alias("cell"))
    dealt = dealt.select("side", "bucket", "half", "text", "n", "cell.*")
    found = dealt.groupBy("side", "bucket", "half", "i", "j").applyInArrow(_searched, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    both = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return both.select("word", "n_near", "best.form", (-F.col("best.less")).alias("form_n"))


def rooted(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form) with ``root``, the end of the way from form to form; words without a form are left out.

    A form occurs twice as often as its word or more, so that ways are short and have no rings. Each round, a written
    table, doubles the steps taken.
    """
    links = materialise(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        longer = materialise(longer, "roots")
        links = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return links


def group_variants(
    docs: DataFrame,
    *,
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
    min_times: int = MIN_TIMES,
    slip: int = SLIP,
    index_symbols: int = INDEX_SYMBOLS,
    half_words: int = HALF_WORDS,
) -> DataFrame:
    """word, n, form, root, n_near and form_n for each word found ``min_count`` times or more in the texts of ``docs`` (doc_id, text).

    Words are runs of the letters A-Z, a-z and those from U+00C0 to U+00FF, A-Z lower-cased, of ``min_chars`` letters or more after slips: where the checksum of
    document id and run is divisible by ``slip``, the run loses one letter. Words are near that one inserted, deleted or replaced
    letter makes equal. The form of a word is its most frequent near word (of equals the least by code point) if that is found ``min_times``
    times as often or more, else null. The root is where forms lead, the word itself if it has none.

    Null and empty texts have no words; a null id counts as the empty text. Repeated rows count as often as they stand. An empty
    table gives an empty table. Other columns play no part. Texts and words may have any length.
    """
    if min_times < 2:
        raise ValueError("forms need a multiple of two or more, or their ways could form rings")
    words = materialise(word_counts(docs, min_chars=min_chars, slip=slip).where(F.col("n") >= min_count), "words")
    near = near_words(words, min_chars=min_chars, index_symbols=index_symbols, half_words=half_words)
    is_form = F.col("form_n") >= min_times * F.col("n")
    found = words.join(near, "word", "left").withColumns({"form": F.when(is_form, F.col("form")), "form_n": F.when(is_form, F.col("form_n"))})
    found = materialise(found.withColumn("n_near", F.coalesce("n_near", F.lit(0))), "near-words")
    both = found.join(rooted(found), "word", "left")
    return both.select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
