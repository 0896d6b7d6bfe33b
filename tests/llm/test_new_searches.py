"""Mixing, ranked search and spelling variants against plain versions."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shelfwise.llm import lexical_search, mixing, queries, spelling

FOLDER = "/root/testdata/sf0.001"
EXTRA = ["key", "draw", "p", "group", "last", "rows", "copies", "unit", "row", "place", "weight", "item", "score", "rank", "n", "half", "side", "bucket", "cell", "i", "j"]


@pytest.fixture(scope="module")
def crowded(docs):
    """The awkward documents with a source, and extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    source = F.expr("case when doc_id % 3 = 0 then 'b' when doc_id % 3 = 1 then 'a' end")
    return docs.select("doc_id", "text", source.alias("source"), *(F.lit(c).alias(c) for c in EXTRA))


# --- 11 ---------------------------------------------------------------------------------------------


def plain_targets(sizes: dict, total: int) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    stopped: set = set()
    while True:
        left = total - sum(3 * sizes[s] for s in stopped)
        shared = sum(weight[s] for s in order if s not in stopped)
        target = {s: 3.0 * sizes[s] if s in stopped else left * weight[s] / shared for s in order}
        above = {s for s in order if target[s] > 3 * sizes[s]}
        if not above:
            return target
        stopped |= above


def test_mix_of_a_whole_table(spark, tables):
    rows = queries.mix(spark, FOLDER).collect()
    texts = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in tables["documents"].collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    sizes: Counter = Counter()
    for source, size in texts.values():
        sizes[source] += size
    target = plain_targets(sizes, sum(sizes.values()))
    taken: Counter = Counter()
    for r in rows:
        source, size = texts[r.doc_id]
        assert (r["size"], r.source_size) == (size, sizes[source]) and r.target == pytest.approx(target[source])
        assert r.taken % max(size, 1) == 0 and r.taken <= 3 * size
        taken[source] += r.taken
    for source in sizes:
        smallest = sorted(s for x, s in texts.values() if x == source)[:3]
        assert abs(taken[source] - target[source]) <= max(smallest[-1], 0.02 * target[source]), source
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.mix(spark, FOLDER).collect()))


def test_targets_stop_at_three_times_and_the_excess_is_shared(spark):
    rows = [(i, s, "w " * n) for i, (s, n) in enumerate([("a", 3), ("b", 100), ("c", 1), (None, 400), ("e", 7), ("f", 50), ("g", 0)])]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sizes = {s: len(t.split()) for _, s, t in rows}
    found = {r.source: (r.source_size, r.target) for r in mixing.mixture(docs).collect()}
    want = plain_targets(sizes, sum(sizes.values()))
    assert found == {s: (sizes[s], pytest.approx(want[s])) for s in sizes}
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_a_flight_keeps_both_totals_and_every_expected_probability():
    rng = np.random.default_rng(3)
    size = np.sort(rng.integers(1, 2000, 300))[::-1].astype(float)
    p = rng.uniform(0.05, 0.95, 300)
    out = mixing.fly(p.copy(), size, rng.integers(0, 1 << 62, 300))
    assert ((out > 0) & (out < 1)).sum() <= 2 and out.min() >= 0 and out.max() <= 1
    assert out @ size == pytest.approx(p @ size) and out.sum() == pytest.approx(p.sum())
    few, sizes = np.array([0.2, 0.4, 0.6, 0.5]), np.array([9.0, 5.0, 4.0, 1.0])
    mean = np.mean([mixing.fly(few.copy(), sizes, rng.integers(0, 1 << 62, 4)) for _ in range(4000)], axis=0)
    assert np.abs(mean - few).max() < 0.04


def test_the_landing_is_the_nearest_outcome():
    p, size = np.array([0.5, 0.0, 0.3, 1.0, 0.7]), np.array([8.0, 3.0, 5.0, 2.0, 4.0])
    out = mixing.land(p.copy(), size)
    goal = p @ size
    best = min(abs(goal - (2 + 8 * a + 5 * b + 4 * c)) for a in (0, 1) for b in (0, 1) for c in (0, 1) if abs(a + b + c - 1.5) < 2)
    assert abs(out @ size - goal) <= best + 1e-9 and set(out) <= {0.0, 1.0}


@pytest.mark.parametrize("block", [16, 64])
def test_levels_of_flights_balance_a_hot_source(spark, block):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", "w " * int(rng.paretovariate(2) * 5)) for i in range(900)]
    found = mixing.mixture(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5), block=block).collect()
    for source in {r.source for r in found}:
        own = [r for r in found if r.source == source]
        assert abs(sum(r.copies * r["size"] for r in own) - own[0].target) <= max(6, 0.01 * own[0].target)
        ratio = own[0].target / own[0].source_size
        assert abs(sum(r.copies for r in own) - ratio * len(own)) < 3
    assert len(found) == 900


def test_repeated_rows_share_their_copies(spark):
    rows = [(1, "a", "one two")] * 200 + [(2, "a", "one two three"), (3, "b", "x " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = {r.doc_id: r for r in mixing.mixture(docs).collect()}
    ratio = found[1].target / found[1].source_size
    assert found[1].rows == 200 and abs(found[1].copies - 200 * ratio) <= 1
    taken = mixing.mixed(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in taken} == {i: r.copies for i, r in found.items() if r.copies}


def test_mix_of_awkward_rows(crowded, no_docs):
    found = mixing.mixture(crowded).collect()
    assert sum(r.rows for r in found) == crowded.count() and all(r["size"] == 0 or r.copies <= 3 * r.rows for r in found)
    assert {r.source for r in found} == {"a", "b", None}
    texts = mixing.mixed(crowded)
    assert texts.columns == crowded.columns and texts.count() == sum(r.copies for r in found)
    assert mixing.mixture(crowded.where("false")).count() == 0 and mixing.mixed(crowded.where("false")).count() == 0


# --- 12 ---------------------------------------------------------------------------------------------


def plain_search(docs: list, items: list, k: int) -> list:
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    counted = [(i, Counter(t)) for i, text in docs if (t := terms(text))]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in counted:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def ranked(frame) -> list:
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("k", [3, 50])
def test_search_equals_scoring_every_pair(spark, k):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(60)] + ["Größe", "É", "x1", "ﬁn"]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=rng.choice([1, 3, 30, 200]))) for _ in range(260)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[0]) for i in range(150)] + [(7, texts[7]), (None, texts[0]), (None, texts[3]), (5000, None), (5001, ""), (5002, "-- !")]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 40])))) for i in range(40)] + [(90, texts[0]), (90, texts[0]), (91, None), (92, "nowhere"), (None, "w1 W1!w1")]
    found = lexical_search.search(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), k=k
    )
    assert ranked(found) == plain_search(docs, items, k)


def test_search_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", ((12, 3), (40, 2), (None, 1)))
    docs = [(i, " ".join(f"t{j}" for j in range(i % 7, i % 7 + 4))) for i in range(30)]
    items = [(i, " ".join(f"t{j}" for j in range(i, i + i))) for i in range(12)]
    found = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=4)
    assert ranked(found) == plain_search(docs, items, 4)


def test_bounds_never_lose_a_pair_and_spare_work():
    rng = np.random.default_rng(1)
    rows = np.zeros((600, 80))
    for i in range(600):
        rows[i, rng.choice(20, 8) + 20 * (i % 4)] = rng.integers(1, 1000, 8)
    wanted = np.zeros((24, 80))
    for i in range(24):
        wanted[i, rng.choice(20, 6) + 20 * (i % 4)] = 1
    items = lexical_search.Items(list(range(24)), wanted, np.ones(80, np.int64), 600, 6000, 5)
    scored = sum(items.search(np.arange(a, a + 200), rows[a : a + 200]) for a in range(0, 600, 200))
    assert scored < 0.6 * 600 * 24
    for at, item in enumerate(items.ids):
        scores = (rows @ wanted[item]).astype(int)
        best = sorted((-s, i) for i, s in enumerate(scores) if s > 0)[:5]
        assert list(zip((-items.scores[at]).tolist(), items.docs[at].tolist())) == best


def test_search_of_awkward_rows(spark, crowded):
    items = spark.createDataFrame([(1, "lazy dog fox", "x"), (2, "short", "y"), (3, None, None)], "item_id long, text string, score string")
    docs = [(r.doc_id, r.text) for r in crowded.collect()]
    assert ranked(lexical_search.search(crowded, items)) == plain_search(docs, [(r.item_id, r.text) for r in items.collect()], 50)
    assert lexical_search.search(crowded.where("false"), items).count() == 0
    assert lexical_search.search(crowded, items.where("false")).count() == 0
    long = spark.createDataFrame([(1, "dog " * 300_000 + "cat"), (2, "cat")], "doc_id long, text string")
    asked = [(1, "cat dog " + " ".join(f"z{i}" for i in range(9000)))]
    assert ranked(lexical_search.search(long, spark.createDataFrame(asked, "item_id long, text string"))) == plain_search([tuple(r) for r in long.collect()], asked, 50)


# --- 13 ---------------------------------------------------------------------------------------------


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows: list, min_chars: int = 5, min_count: int = 3) -> list:
    counts: Counter = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, n, form[w] or "", root(w), len(near[w]), words.get(form[w], 0)) for w, n in words.items())


def variants(frame) -> list:
    return sorted((r.word, r.n, r.form or "", r.root, r.n_near, r.form_n or 0) for r in frame.collect())


def spelled(seed: int, words: int = 700) -> list:
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abcé", k=rng.randint(4, 9))) for _ in range(words)] + ["anhang" + c for c in "abcdefÿ"] + ["aaaaa", "aaaaaa", "aaaaaaa"]
    return [(i, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(pool, [1 / (j + 3) for j in range(len(pool))], k=300))) for i in range(40)]


@pytest.mark.parametrize("limits", [{}, {"half_words": 8, "index_symbols": 900}, {"half_words": 60, "index_symbols": 100}])
def test_variants_equal_comparing_every_pair(spark, limits):
    rows = spelled(4)
    found = variants(spelling.group_variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **limits))
    want = plain_variants(rows)
    assert found == want and sum(r[4] > 0 for r in want) > 100 and any(r[2] and r[3] != r[2] for r in want)


def test_variants_of_a_whole_table_in_part(spark, tables):
    """Near words of every word of a real table, by deleting letters of both."""
    rows = [(r.doc_id, r.text) for r in tables["documents"].collect()]
    assert variants(queries.spelling_variants(spark, FOLDER)) == plain_variants(rows)


def test_an_index_finds_every_edit_on_the_far_side():
    words = sorted({"".join(random.Random(i).choices("ab", k=5 + i % 3)) for i in range(60)})
    index = spelling.Index(words)
    for exact in (0, 2, 3):
        asked = np.full(len(words), exact)
        query, word = index.near(words, asked)
        found = set(zip(query.tolist(), word.tolist()))
        want = set()
        for i, a in enumerate(words):
            for j, b in enumerate(words):
                head, tail = a[: len(a) - exact], a[len(a) - exact :]
                if b.endswith(tail) and one_edit(head, b[: len(b) - exact]):
                    want.add((i, j))
        assert found == want
    assert index.near(["zzzzz", "abxab"], np.array([2, 2]))[0].tolist().count(0) == 0


def test_variants_of_awkward_rows(spark, crowded):
    rows = [(r.doc_id, r.text) for r in crowded.collect()]
    assert variants(spelling.group_variants(crowded)) == plain_variants(rows)
    assert variants(spelling.group_variants(crowded.where("false"))) == []
    long = "ab" * 6_000
    odd = [(1, f"{long} {long}c {long}c×÷ " * 2), (2, long + " " + long), (None, "×÷×÷× " * 3 + long), (3, None)]
    assert variants(spelling.group_variants(spark.createDataFrame(odd, "doc_id long, text string"))) == plain_variants(odd)


def test_limits_of_variants(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    with pytest.raises(ValueError):
        spelling.group_variants(none, min_times=1)
    with pytest.raises(ValueError):
        spelling.group_variants(none, min_chars=1)
