"""The text operators do their whole job: cases that an earlier, smaller one left out."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from shelfwise.llm import common, decontaminate, pieces, queries, recurrent_lm, substring_dedup

# --- 2 ----------------------------------------------------------------------------------------------


def test_a_unit_is_segmented_apart_at_every_place():
    model = pieces.load(queries.piece_model())
    unit = pieces.units_of("consideration")[0]
    encoder = pieces.Encoder(model, queries.PIECE_SEED, pieces.DROPOUT, pieces.VARIANTS)
    texts = [" ".join(["consideration"] * 1000)] * 2
    ids, widths = encoder.encode([1, 2], texts)
    places = [[model.agenda(unit, int(v), queries.PIECE_SEED, pieces.DROPOUT) for v in encoder._variants(d, 1000)] for d in (1, 2)]
    assert ids.tolist() == [x for rows in places for row in rows for x in row]
    plain = model.agenda(unit, 0, queries.PIECE_SEED, 0)
    assert len({tuple(row) for rows in places for row in rows}) > 4 and places[0] != places[1]
    long = pieces.units_of("consideration " + "ofthesum" * 40)
    for text, units in (("consideration " + "ofthesum" * 40, long), ("ofthesum" * 40, long[1:])):
        want = [x for u, v in zip(units, encoder._variants(3, len(units))) for x in model.agenda(u, int(v), queries.PIECE_SEED, pieces.DROPOUT)]
        assert pieces.Encoder(model, queries.PIECE_SEED, pieces.DROPOUT, pieces.VARIANTS).encode([3], [text])[0].tolist() == want
    assert 0.2 < np.mean([row == plain for rows in places for row in rows]) < 0.9


# --- 4 ----------------------------------------------------------------------------------------------


def test_a_passage_pasted_into_a_line_is_found_by_its_reach(spark):
    words = [f"w{i}" for i in range(58)]
    passage = " ".join(words[:24]) + ". Two words. " + " ".join(words[24:30]) + ". Odd. " + " ".join(words[30:]) + "."
    rows = [
        (0, "Yes. Odd. So it begins and so it ends."),
        (1, "Before it stands " + passage),
        (2, "Quite another start and then " + passage[:-1] + " goes on otherwise."),
        (3, "I wonder whether anybody at all will come here tonight? Yes. Nobody ever came before, as far as anyone can tell."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert substring_dedup.repeated_spans(docs).count() == 0
    found = substring_dedup.repeated_spans(docs, by_reach=True).collect()
    assert [(r.doc_id, rows[2][1][r.start : r.stop], r.n_words, r.first_doc_id) for r in found] == [(2, "Two words. " + " ".join(words[24:30]) + ". Odd.", 9, 1)]


# --- 8 ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("doc_id", [2, 4, 6])
def test_every_training_document_fits_the_network(spark, doc_id):
    docs = spark.createDataFrame([(doc_id, "one two three two one " * 9)], "doc_id long, text string")
    known = recurrent_lm.vocabulary(docs, recurrent_lm.word_counts(docs))
    assert known.documents == 1
    start, fitted = recurrent_lm.Network.start(known), recurrent_lm.fit(docs, known)
    assert not np.array_equal(start.class_bias, fitted.class_bias)


def test_what_the_network_knows_grows_with_the_vocabulary():
    shares = []
    for distinct in (9_000, 90_000, 900_000):
        counts = 1_000_000 // np.arange(1, distinct)
        known = recurrent_lm.Vocabulary([b"%d" % i for i in range(100_000)][: distinct - 1], counts[:100_000], int(counts.sum()) + 10, distinct, 10)
        shares.append(known.size)
    assert shares[0] <= 4_096 < 2 * 4_096 < shares[1] and 3 * shares[1] < shares[2] < 100_000
    net = recurrent_lm.Network.start(known)
    state = np.random.default_rng(0).standard_normal((1, recurrent_lm.HIDDEN)).astype(np.float32)
    chances = np.exp(net.log_probability(np.repeat(state, known.size, 0), np.arange(known.size)))
    assert abs(chances.sum() - 1) < 1e-3
    text = [np.array([known.size - 1, known.size - 2] * 50, np.int32)]  # words that were outside before
    before = net.score(text)[0]
    net.learn(text)
    assert net.score(text)[0] > before


def window_of(net, texts, width, longest=None):
    steps = recurrent_lm.Streams(texts, width, longest)
    state, trace = np.zeros((steps.width, recurrent_lm.HIDDEN), np.float32), []
    for inputs, goals, _, fresh in steps.window(0, steps.length):
        before = np.where(fresh[:, None], np.float32(0), state[: len(inputs)])
        state, *rest = net.step(inputs, before)
        trace.append((inputs, goals, fresh, before, *rest, state))
    return trace


def test_gradients_equal_finite_differences():
    counts = np.arange(300, 0, -1)
    known = recurrent_lm.Vocabulary([b"%d" % i for i in range(300)], counts, int(counts.sum()) + 10, 301, 10)
    net = recurrent_lm.Network.start(known)
    texts = [np.random.default_rng(i).integers(1, known.size, n).astype(np.int32) for i, n in enumerate((9, 4, 1))]

    def loss():
        trace = window_of(net, texts, 2)
        return -net.log_probability(np.concatenate([x[-1] for x in trace]), np.concatenate([x[1] for x in trace])).sum()

    grads, seen = net._gradients(window_of(net, texts, 2))
    assert seen == 17
    for name, (rows, grad) in grads.items():
        dense = np.zeros(getattr(net, name).shape)
        dense[rows] = grad
        raw = []
        for place in np.argsort(-np.abs(dense), axis=None)[:3]:
            at, eps = np.unravel_index(place, dense.shape), np.float32(0.02)
            weights, value = getattr(net, name), getattr(net, name)[at]
            weights[at] = value + eps
            above = loss()
            weights[at] = value - eps
            raw.append(((above - loss()) / (2 * float(eps)), dense[at]))
            weights[at] = value
        scale = raw[0][1] / raw[0][0]  # gradients are divided by the square root of the tokens, and cut to a norm of 5
        assert 0 < scale <= 1.03 / seen**0.5, name
        assert all(abs(found - scale * plain) <= 0.03 * abs(found) + 1e-3 for plain, found in raw), name


@pytest.mark.parametrize("shape", [(5,), (4, 3)])
@pytest.mark.parametrize("rows", [range(40), [3], [0, 2, 4, *range(10, 33), 36, 38, 39], range(0, 40, 2)])
def test_an_adam_step_changes_the_rows_met_alone(monkeypatch, shape, rows):
    """The same as the step on all rows at once, to the bit, whether they stand together or not and however few are taken together."""
    monkeypatch.setattr(recurrent_lm, "CACHED", 36)
    rng, rows = np.random.default_rng(7), np.array(rows)
    weights, first, g = (rng.standard_normal((n, *shape)).astype(np.float32) for n in (40, 40, len(rows)))
    second, rate = rng.random((40, *shape)).astype(np.float32), np.float32(0.01)
    one = first[rows] + np.float32(0.1) * (g - first[rows])
    two = second[rows] + np.float32(0.01) * (g * g - second[rows])
    wanted = [weights.copy(), first.copy(), second.copy()]
    wanted[0][rows] -= rate * one / (np.sqrt(two) + np.float32(1e-7))
    wanted[1][rows], wanted[2][rows] = one, two
    recurrent_lm._descend(weights, first, second, rows, g, rate)
    assert all(np.array_equal(a, b) for a, b in zip((weights, first, second), wanted))


def test_rows_are_added_up_by_word():
    """To the bit as numpy adds up the sorted rows."""
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.4, 600), 90_000).astype(np.int32)
    times = np.bincount(ids)
    assert times.max() > 16 * recurrent_lm.OFTEN and {1, 2, 3, recurrent_lm.OFTEN, recurrent_lm.OFTEN + 1} <= set(times.tolist())
    assert np.array_equal(recurrent_lm._order(ids), np.argsort(ids, kind="stable")) and not len(recurrent_lm._order(ids[:0]))
    for found in (ids, ids[:1], np.unique(ids), ids * 0):
        rows = rng.standard_normal((len(found), 6)).astype(np.float32)
        met, cuts = np.unique(found[np.argsort(found, kind="stable")], return_index=True)
        got = recurrent_lm._word_sums(found, rows)
        assert np.array_equal(got[0], met)
        assert np.array_equal(got[1], np.add.reduceat(rows[np.argsort(found, kind="stable")], cuts))


def test_long_documents_are_learnt_whole_in_pieces():
    text = np.arange(2, 27, dtype=np.int32)
    steps = recurrent_lm.Streams([text, text[:3]], 3, 7)
    assert sorted(steps.targets.tolist()) == sorted([*text, *text[:3], recurrent_lm.END, recurrent_lm.END])
    follows = {(int(a), int(b)) for a, b in zip(steps.inputs, steps.targets)}
    assert follows == {(recurrent_lm.END, 2), *((i, i + 1) for i in range(2, 26)), (26, recurrent_lm.END), (4, recurrent_lm.END)}
    assert steps.fresh.sum() == 5 and max(np.bincount(steps.owner)) == 26


def test_words_outside_the_network_cost_their_share(spark, monkeypatch):
    """The whole score against a plain walk: the network's probability for every token, and a share of the counts for those outside."""
    monkeypatch.setattr(recurrent_lm, "KNOWN_WORDS", 12)
    monkeypatch.setattr(recurrent_lm, "OUTCOMES", 10)
    monkeypatch.setattr(recurrent_lm, "GROWTH", 1)
    monkeypatch.setattr(recurrent_lm, "fit", lambda docs, known: recurrent_lm.Network.start(known))
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{int(k)}" for k in rng.zipf(1.3, 30) if k < 60)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = recurrent_lm.word_counts(docs)
    known, times = recurrent_lm.vocabulary(docs, counts), {bytes(r.word): r.c for r in counts.collect()}
    net = recurrent_lm.Network.start(known)
    inside = set(known.names[: known.size - 2])
    assert len(inside) == 8 and len(known.names) == 12 < len(times)
    mass = sum(c + 0.5 for w, c in times.items() if w not in inside) + 0.5
    got = {r.doc_id: r.score for r in recurrent_lm.score_documents(docs).collect()}
    for doc_id, text in rows:
        state, last, total = np.zeros((1, recurrent_lm.HIDDEN), np.float32), recurrent_lm.END, 0.0
        for word in [*(w.encode() for w in text.split()), None]:
            state = net.step(np.array([last]), state)[0]
            last = recurrent_lm.END if word is None else known.index[word] if word in inside else recurrent_lm.OTHER
            total += net.log_probability(state, np.array([last]))[0] / np.log(10)
            if last == recurrent_lm.OTHER:
                total += np.log10((times.get(word, 0) + 0.5) / mass)
        assert abs(got[doc_id] - total) < 1e-3


# --- 10 ---------------------------------------------------------------------------------------------


def test_short_items_are_found_inside_longer_texts(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "none of them stands in here"), (3, "Three FOUR")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "three four"), (2, "six"), (3, "four five six seven"), (4, "five four")], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.start) for r in decontaminate.contaminated(docs, items).collect()}
    assert found == {(1, 1, 2), (1, 2, 5), (1, 3, 3), (3, 1, 0)}


def test_shingles_shared_by_a_pair_are_counted_within_its_row(spark):
    rng = random.Random(5)
    sides = [[rng.choices("ab", k=rng.randrange(1, 30)) for _ in range(2)] for _ in range(60)] + [[["a"] * 3, ["a"] * 3], [["a", "b"], ["b", "a"]], [["a"] * 9, ["a"] * 7]]
    rows = [(i, i, 7, a, b, max(len(b) - 4, 1)) for i, (a, b) in enumerate(sides)]
    near = spark.createDataFrame(rows, "c1 long, c2 long, item long, words array<string>, item_words array<string>, item_m int")
    shared = decontaminate._shared(near)
    runs = [[Counter(tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))) for x in pair] for pair in sides]
    want = {(i, len(sides[i][0]), sum((a & b).values()), a.total() + b.total()) for i, (a, b) in enumerate(runs)}
    assert {(r.c1, r.n_words, r.both, r.total) for r in shared.collect()} == want
    assert "Generate" not in shared._jdf.queryExecution().executedPlan().toString()


def written(monkeypatch):
    """Rows of each table that decontamination writes, by its label."""
    rows, write = {}, decontaminate.materialise

    def counted(df, label):
        table = write(df, label)
        rows[label] = table.count()
        return table

    monkeypatch.setattr(decontaminate, "materialise", counted)
    return rows


def test_items_of_the_same_words_are_verified_once(spark, monkeypatch):
    passage = "every item of a benchmark may be listed under many numbers but its words are compared with a window only once"
    docs = spark.createDataFrame([(1, f"before it {passage} and after"), (None, passage.upper()), (2, "nothing of it here")], "doc_id long, text string")
    rows = written(monkeypatch)
    seen = []
    for ids in ([1], [*range(1, 31), 30, None]):
        items = spark.createDataFrame([*((i, passage) for i in ids), (1, passage + " and"), (1, "an item of other words altogether")], "item_id long, text string")
        got = decontaminate.contaminated(docs, items).collect()
        assert len(got) == 2 * len(set(ids))
        found = {(r.doc_id, r.item_id): (r.start, r.n_words, r.similarity) for r in got}
        assert found == {(d, i): (2 if d else 0, 21, 1.0) if not d or i != 1 else (2, 22, 1.0) for d in (1, None) for i in ids}
        seen.append(rows["verified"])
    assert seen[0] == seen[1] > 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_rows_of_many_windows_count_with_all_their_windows(spark, monkeypatch, broadcast):
    passage = "a document may hold the words of an item so often that its windows take more room than its text does"
    docs = spark.createDataFrame([(1, " ".join([passage] * 40)), (None, passage), (None, passage), (2, "nothing of it here")], "doc_id long, text string")
    items = spark.createDataFrame([(1, passage), (2, passage + " a")], "item_id long, text string")
    rows = written(monkeypatch)
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_BYTES", 2000)
    got = {tuple(r)[0:1] + tuple(r)[2:] for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 1, 0, 21, 1.0), (1, 2, 0, 22, 1.0), (None, 1, 0, 21, 1.0), (None, 2, 0, 21, 17 / 18)}
    assert rows["windows"] > 80 and rows["window-rows"] == 2 and rows.get("window-docs") == (None if broadcast else 3)
