"""Every text operator on awkward rows, on an empty table, and against a plain version."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfwise.llm import (
    common, decontaminate, license_scan, line_dedup, pieces, quality_trees, queries, recurrent_lm, repetition, simhash, substring_dedup, url_filter,
)
from shelfwise.llm.url_filter import Rule

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


# --- 1 ----------------------------------------------------------------------------------------------


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://A.Org/es/1?x=1#y", "http://www.bad.com/p/?utm_source=f&b=2&a=1", "https://bad.com/p?a=1&b=2#z",
            "http://bad.com/p?a=1", "http://x.example.org/en/1", "http://notorg/", "http://bad.com:80/p?b=2&a=1"]
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)] * 2, "page_id long, url string, w0 string")
    listed = spark.createDataFrame([("ftp://bad.com/p?b=2&a=1",), (None,), ("",)], "url string")
    rules = [Rule("allow", "org", "/"), Rule("block", "example.org", "/en/1")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, listed, rules).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.org", "/es/1", "org/", "allow")
    assert got[4] == ("www.bad.com", "/p/", None, "block")
    assert got[5][3] == got[9][3] == "block" and got[6][3] == "allow"
    assert got[7][2:] == ("example.org/en/1", "block")
    assert got[8] == ("notorg", "/", None, "allow")
    assert url_filter.filter_urls(pages, listed.where("false"), []).where("verdict = 'block'").count() == 0
    assert url_filter.filter_urls(pages.where("false"), listed, rules).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("u"), "id").alias("_key"))
    blocks, n = url_filter.bloom_filter(keys, "_key", 5000)
    rows = url_filter._hashed(spark.range(10000).select(F.concat(F.lit("u"), "id").alias("_key"), "id"), "_key", n)
    hit = common.all_of([F.col(f"_w{i}").bitwiseAND(url_filter._bit(i)) != 0 for i in range(url_filter.WORDS)])
    passed = rows.join(blocks, "_block").where(hit)
    assert passed.where("id < 5000").count() == 5000
    assert passed.where("id >= 5000").count() < 250


# --- 2 ----------------------------------------------------------------------------------------------


def test_pieces_round_trip_and_agenda(docs, no_docs):
    rows = queries.piece_rows(docs).collect()
    assert len(rows) == docs.count() and all(r.lossless for r in rows)
    assert queries.piece_rows(no_docs).count() == 0
    model = pieces.load(queries.piece_model())
    texts = dict(pairs(docs.where("doc_id is not null")))
    encoder = pieces.Encoder(model, queries.PIECE_SEED, pieces.DROPOUT, pieces.VARIANTS)
    for r in rows:
        if r.doc_id is not None:
            units = pieces.units_of(texts[r.doc_id] or "")
            variants = encoder._variants(r.doc_id, len(units))
            assert r.ids == [x for u, v in zip(units, variants) for x in model.agenda(u, int(v), queries.PIECE_SEED, pieces.DROPOUT)]


def test_pieces_without_dropout_are_the_librarys(tables):
    import sentencepiece

    plain = sentencepiece.SentencePieceProcessor(model_proto=queries.piece_model())
    texts = [t for _, t in pairs(tables["documents"])][:60] + ["a" * 300, "  two  blanks ", "日本 🎉"]
    ids, widths = pieces.Encoder(pieces.load(queries.piece_model()), 1, 0.0, 4).encode(list(range(len(texts))), texts)
    ends = np.cumsum(widths)
    assert all(ids[e - w : e].tolist() == plain.encode(t) for t, e, w in zip(texts, ends, widths))
    model = pieces.load(queries.piece_model())
    dropped, _ = pieces.Encoder(model, 1, 0.1, 4).encode([0, 1], [texts[0], texts[0]])
    other, _ = pieces.Encoder(model, 2, 0.1, 4).encode([0, 1], [texts[0], texts[0]])
    assert dropped.tolist() != other.tolist() and len(dropped) > 2 * widths[0]


# --- 3 ----------------------------------------------------------------------------------------------


def plain_line_dedup(rows):
    def name(line):
        return line.strip(BLANKS).translate(LOWER)

    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[name(line)].add(-1 if doc is None else doc)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if gone.get(name(x), -1 if doc is None else doc) == (-1 if doc is None else doc)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("source", ["docs", "tables"])
def test_line_dedup(source, request):
    given = request.getfixturevalue(source)
    given = given if source == "docs" else given["documents"]
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(given).collect()]
    assert sorted(got, key=key) == sorted(plain_line_dedup(pairs(given)), key=key)


def test_line_dedup_runs_are_compacted(docs, no_docs, spark):
    runs = line_dedup.LineRuns(spark, 3)
    lines = line_dedup.line_table(docs)
    for _ in range(4):
        runs.add(lines)
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    result = line_dedup.dedup_lines(no_docs)
    assert result.count() == 0 and set(docs.columns) <= set(result.columns)


# --- 4 ----------------------------------------------------------------------------------------------


def plain_spans(rows, least=substring_dedup.MIN_WORDS):
    rows = sorted({(2**63 - 1 if d is None else d, xxhash.xxh64_intdigest((t or "").encode(), 42), d, t or "") for d, t in rows if t}, key=lambda r: (r[0], r[1] - (2**64 if r[1] >> 63 else 0)))
    first, spans = {}, []
    for rank, th, doc, text in rows:
        run = []
        for start, stop, words in [*substring_dedup.units_of(text), (0, 0, None)]:
            name = words and " ".join(words)
            if words and name in first:
                run.append((start, stop, len(words), first[name]))
                continue
            if sum(r[2] for r in run) >= least:
                spans.append((doc, run[0][0], run[-1][1], sum(r[2] for r in run), *run[0][3]))
            run = []
            if words:
                first[name] = (doc, start)
    return spans


@pytest.mark.parametrize("source", ["docs", "tables"])
def test_repeated_spans(source, request):
    given = request.getfixturevalue(source)
    given = given if source == "docs" else given["documents"]
    found = substring_dedup.repeated_spans(given)
    got = [(r.doc_id, r.start, r.stop, r.n_words, r.first_doc_id, r.first_start) for r in found.collect()]
    assert sorted(got, key=key) == sorted(plain_spans(pairs(given)), key=key)


def test_cut_passages(docs, no_docs):
    cleaned = {r.doc_id: r for r in substring_dedup.dedup_substrings(docs).collect()}
    text = dict(pairs(docs))[3]
    assert cleaned[1].removed is None and cleaned[4].text is None
    assert cleaned[7].text == "" and cleaned[3].text == text
    assert substring_dedup.dedup_substrings(no_docs).count() == 0


# --- 5 ----------------------------------------------------------------------------------------------


def test_licenses(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/c/x.py", "nothing here"),
        (3, "a/b/y.py", "Some words. Licensed under CC BY-NC 4.0.\n" + "More words here that say much else. " * 5),
        (4, "z/w.py", None),
        (5, None, ""),
        (5, None, ""),
        (6, "ab/w.py", "the work of the public version is under review"),
        (7, "a/b/d/NOTICE.txt", "x y z. All rights reserved."),
        (8, "a/b/d/e/f.c", "code"),
        (None, "a/q.c", "code"),
    ]
    files = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, path string, text string, license string")
    got = {(r.doc_id, r.path): (r.license, r.origin, r.licence_dir) for r in license_scan.scan_licenses(files).collect()}
    assert got[1, "a/LICENSE"] == ("MIT", "own", None)
    assert got[2, "a/b/c/x.py"] == ("MIT", "inherited", "a") == got[None, "a/q.c"]
    assert got[3, "a/b/y.py"] == ("CC-BY-NC-4.0", "own", None)
    assert got[4, "z/w.py"] == got[5, ""] == got[6, "ab/w.py"] == (None, None, None)
    assert got[7, "a/b/d/NOTICE.txt"] == ("proprietary", "own", None)
    assert got[8, "a/b/d/e/f.c"] == ("proprietary", "inherited", "a/b/d")
    assert license_scan.scan_licenses(files).count() == len(rows)
    assert license_scan.scan_licenses(files.where("false")).count() == 0


# --- 6 ----------------------------------------------------------------------------------------------


def test_quality(docs, no_docs, tables, spark):
    labels = tables["labels"]
    scored = quality_trees.classify(tables["documents"], labels).join(labels, "doc_id").where("held_out").collect()
    assert len(scored) > 5 and sum(r.predicted == r.quality for r in scored) >= 0.9 * len(scored)
    awkward = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, None), (3, None, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality_trees.classify(docs, awkward).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in rows)
    assert quality_trees.classify(no_docs, awkward.where("false")).count() == 0


# --- 7 ----------------------------------------------------------------------------------------------


def plain_fingerprint(text, k=3):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    runs = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Fingerprint -> set of fingerprints reachable."""
    groups = [{p} for p in set(prints)]
    merged = True
    while merged:
        merged = False
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                if any((a ^ b).bit_count() <= 3 for a in groups[i] for b in groups[j]):
                    groups[i] |= groups.pop(j)
                    merged = True
                    break
            if merged:
                break
    return {p: g for g in groups for p in g}


def test_simhash_components(docs, no_docs):
    rows = pairs(docs)
    prints = [plain_fingerprint(t) for _, t in rows]
    groups = plain_components(prints)
    least = {p: min((d for (d, _), q in zip(rows, prints) if q in g and d is not None), default=None) for p, g in groups.items()}
    want = [(d, f"{p:016x}", least[p]) for (d, _), p in zip(rows, prints)]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len({frozenset(g) for g in groups.values()})
    assert simhash.simhash_components(no_docs).count() == 0 and simhash.keep_one_of_each(no_docs).count() == 0


@pytest.mark.parametrize("limit", [2, 128])
def test_links_connect_all_within_three_bits(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "LIST_LIMIT", limit)
    rng = np.random.default_rng(3)
    centre = [int(x) for x in rng.integers(0, 2**63, 4)]
    near = {c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for c in centre for _ in range(12)}
    prints = [p - (1 << 64) if p >> 63 else p for p in near]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in prints], "f long"))
    pairs_ = [(r.a, r.b) for r in links.collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in pairs_)
    nodes = {r.node: r.component for r in common.components(links).collect()}
    groups = plain_components([p & (2**64 - 1) for p in prints])
    for p in prints:
        members = {q - (1 << 64) if q >> 63 else q for q in groups[p & (2**64 - 1)]}
        assert {nodes.get(q, q) for q in members} == {min(members)}


# --- 8 ----------------------------------------------------------------------------------------------


def test_lm_base_and_score(docs, no_docs, monkeypatch):
    monkeypatch.setattr(recurrent_lm, "KNOWN_WORDS", 20)
    monkeypatch.setattr(recurrent_lm, "FIT_ONE_IN", 1)
    rows = pairs(docs)
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in rows}
    counts = Counter(w for d, t in rows if not held[d] for w in [*WORD.findall((t or "").translate(LOWER)), "<end>"])
    total, distinct = sum(counts.values()), len(counts)
    got = recurrent_lm.score_documents(docs).collect()
    assert len(got) == len(rows)
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append([*WORD.findall((t or "").translate(LOWER)), "<end>"])
    for r in got:
        sums = [(len(w), sum(counts[x] > 0 for x in w), sum(np.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)) for w in texts[r.doc_id]]
        assert r.train_tokens == total and r.held_out == held[r.doc_id] and r.score < 0
        assert any((r.n_tokens, r.n_known) == s[:2] and abs(r.base_score - s[2]) < 1e-6 for s in sums)
    assert recurrent_lm.score_documents(no_docs).count() == 0


def test_network_is_a_distribution_and_carries_its_state():
    counts = np.arange(9000, 0, -1)
    known = recurrent_lm.Vocabulary([str(i).encode() for i in range(9000)], counts, int(counts.sum()) + 10, 9001, 10)
    net = recurrent_lm.Network.start(known)
    size = known.size
    assert size == recurrent_lm.OUTCOMES
    state = np.random.default_rng(0).standard_normal((1, recurrent_lm.HIDDEN)).astype(np.float32)
    assert abs(np.exp(net.log_probability(np.repeat(state, size, 0), np.arange(size))).sum() - 1) < 1e-3
    texts = [np.random.default_rng(i).integers(1, known.size, n).astype(np.int32) for i, n in enumerate((200, 0, 3, 77, 1))]
    before = net.score(texts).sum()
    for _ in range(3):
        net.learn(texts * 5)
    assert net.score(texts).sum() > before
    state, total, last = np.zeros((1, recurrent_lm.HIDDEN), np.float32), 0.0, recurrent_lm.END
    for word in [*texts[0], recurrent_lm.END]:
        state = net.step(np.array([last]), state)[0]
        total += net.log_probability(state, np.array([word]))[0]
        last = word
    assert abs(net.score(texts)[0] - total) < 0.05


# --- 9 ----------------------------------------------------------------------------------------------


def plain_repetition(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_repetition_rules(docs, no_docs):
    got = repetition.apply_rules(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        figures = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert figures == plain_repetition(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert repetition.apply_rules(no_docs).count() == 0
    assert repetition.measure("a b c d e f a b c d e f", (5,))[6] == 6  # the second round only


# --- 10 ---------------------------------------------------------------------------------------------


def plain_leaks(rows, items, least=decontaminate.SIMILARITY):
    def runs(words):
        return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()

    found = {}
    for doc, text in rows:
        words = WORD.findall((text or "").translate(LOWER))
        for item, wanted in items:
            want = WORD.findall((wanted or "").translate(LOWER))
            if not want:
                continue
            b, best = runs(want), 0.0
            for start in range(len(words)):
                a = runs(words[start : start + len(want)])
                both = sum((a & b).values())
                best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
            if best >= least:
                found[doc, item] = round(best, 9)
    return found


def test_leaks(docs, no_docs, spark):
    passage = docs.where("doc_id = 1").first().text.split("\n")[0]
    words = passage.split()
    items = [(1, passage.upper()), (2, None), (3, ""), (4, "short"), (5, " ".join(["of", *words[1:]])), (6, "wholly unrelated words that nobody wrote down here"), (1, passage.upper())]
    bench = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, size string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == plain_leaks(pairs(docs), items) and (2, 1) in got and (9, 4) in got and (1, 5) in got
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(pairs(left), key=key) == sorted([p for p in pairs(docs) if p[0] not in (1, 2, 9)], key=key)
    assert decontaminate.contaminated(no_docs, bench).count() == 0 and decontaminate.contaminated(docs, bench.where("false")).count() == 0


# --- helpers and the pipeline -----------------------------------------------------------------------


def test_joins_beyond_their_limits_give_the_same_rows(spark, monkeypatch):
    big = spark.range(2000).select((F.col("id") % 7).alias("k"), "id")
    small = big.groupBy("k").agg(F.count("*").alias("n")).where("k < 5")
    near = sorted(map(tuple, common.join_measured(big, small, ["k"], "left", row_bytes=32, spread=F.col("id")).collect()), key=str)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    far = sorted(map(tuple, common.join_measured(big, small, ["k"], "left", row_bytes=32, spread=F.col("id")).collect()), key=str)
    assert near == far
    want = sorted((r.id, r.n) for r in big.join(small, "k").collect())
    for share in (1, 5, 1000):
        monkeypatch.setattr(common, "HOT_SHARE", share)
        assert sorted((r.id, r.n) for r in common.join_weighed(big, small, ["k"], "n").collect()) == want


def test_pipeline(spark, tables):
    import corpus_pipeline

    rows = pairs(tables["documents"])
    folder = tables["folder"]
    kept = {r.doc_id for r in quality_trees.classify(tables["documents"], tables["labels"]).where("predicted = 1").collect()}
    cleaned = [(d, t) for d, _, _, t in plain_line_dedup([(d, t) for d, t in rows if d in kept])]
    prints = {d: plain_fingerprint(t) for d, t in cleaned}
    groups = plain_components(prints.values())
    least = {p: min(d for d, q in prints.items() if q in g) for p, g in groups.items()}
    cleaned = [(d, t) for d, t in cleaned if least[prints[d]] == d]
    items = [(r.item_id, r.text) for r in tables["benchmark"].collect()]
    leaky = {d for d, _ in plain_leaks([(d, t) for d, t in cleaned if len(t) < 3000], items)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert {d for d in got if len(dict(cleaned)[d]) < 3000} == {d for d, t in cleaned if len(t) < 3000} - leaky
    assert all(r.lossless for r in got.values())


def test_network_learns_and_averages_in_tasks(tables, monkeypatch):
    """The network gains on its start. The weights of many tasks are averaged in blocks of any size, to the same weights, and so again."""
    docs = tables["documents"].select("doc_id", "text")
    known = recurrent_lm.vocabulary(docs, recurrent_lm.word_counts(docs))
    texts = [recurrent_lm._ids(recurrent_lm.words(r.text), known) for r in docs.orderBy("doc_id").limit(40).collect()]
    before = recurrent_lm.Network.start(known).score(texts).sum()
    assert before < recurrent_lm.fit(docs, known, one_in=2).score(texts).sum() < 0

    task_chars = docs.agg(F.sum(F.length("text"))).first()[0] // 30
    found = []
    for block in (16_384, 1_000, 16_384):
        monkeypatch.setattr(recurrent_lm, "BLOCK", block)
        found.append(recurrent_lm.fit(docs, known, one_in=2, rounds=1, task_chars=task_chars).weights())
    for name, weights in found[0].items():
        np.testing.assert_allclose(weights, found[1][name], atol=1e-6)
        np.testing.assert_allclose(weights, found[2][name], atol=1e-6)
