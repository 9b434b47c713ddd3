"""Gradients against differences, windows, edge cases, and accuracy on held-out rows."""

import random

import numpy as np
import pytest

from tierlens.llm import gru, tokens, toxicity


def test_gradients():
    rng = np.random.default_rng(3)
    p = {k: v.astype(np.float64) for k, v in gru.init(5, 3).items()}
    gates = {d: rng.normal(0, 1, (12, 3 * gru.HIDDEN)) for d in "fb"}
    start, length = np.array([0, 3, 8]), np.array([3, 5, 4])
    weights = np.array([0.7, -1.2, 0.4])
    loss = lambda: float(gru.forward(p, gates, start, length, 5) @ weights)
    tape = {}
    gru.forward(p, gates, start, length, 5, tape)
    g, d_gates = gru.backward(p, tape, weights, 12)

    def slope(array, at):
        old, e = array[at], 1e-3
        array[at] = old + e
        up = loss()
        array[at] = old - e
        down = loss()
        array[at] = old
        return (up - down) / (2 * e)

    for name, got in {**{k: (p[k], v) for k, v in g.items()}, **{f"gates_{d}": (gates[d], d_gates[d]) for d in "fb"}}.items():
        array, grad = got
        for _ in range(6):
            at = tuple(int(rng.integers(s)) for s in array.shape)
            assert abs(slope(array, at) - grad[at]) < 2e-3, name


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 96, 97, 1000])
def test_windows_cover_every_word(n):
    text, start, length = toxicity.window_starts(np.array([n, 5]))
    mine = text == 0
    assert {w for s, k in zip(start[mine], length[mine]) for w in range(s, s + k)} == set(range(n))
    assert all(b - a <= toxicity.STRIDE for a, b in zip(start[mine], start[mine][1:]))


def corpus(n, seed):
    rng = random.Random(seed)
    clean = ["".join(rng.choice(["an", "er", "on", "th", "re"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    rude = [s + e for s in ("zork", "blix") for e in ("", "an", "er", "on", "ly")]
    rows = []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randrange(1, 150))]
        toxic = int(rng.random() < 0.3)
        for _ in range(toxic * rng.randrange(1, 4)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(rude).upper() if rng.random() < 0.2 else rng.choice(rude))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(700, 1)
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t, _ in rows] + [(None, None, None, None), (10_000, "", None, None), (10_000, "", None, None)],
                                 "doc_id bigint, text string, score double, worst_word string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(5000, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 703
    right = {i: y for i, _, y in rows}
    wrong = [r["doc_id"] for r in got if r["doc_id"] in right and r["predicted"] != right[r["doc_id"]]]
    assert len(wrong) < 0.04 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert len({r["score"] for r in got if not r["text"]}) == 1


def test_one_kind_of_label_or_none(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    for rows, want in (([], 0.0), ([(1, 0)], 0.0), ([(1, 1)], 1.0)):
        labels = spark.createDataFrame(rows, "doc_id bigint, toxic int")
        got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
        assert [r["score"] for r in got] == [want, want]
    assert toxicity.score(docs.where("false"), toxicity.fit(docs, labels)).collect() == []


def test_block_size_does_not_matter():
    rows = corpus(60, 2)
    texts, y = [t.encode() for _, t, _ in rows], np.array([y for *_, y in rows])
    model = toxicity.train(texts, y)
    whole, _ = toxicity.text_scores(texts, model)
    one, _ = zip(*(toxicity.text_scores([t], model) for t in texts))
    assert np.allclose(whole, np.concatenate(one), atol=1e-4)
    assert tokens.Block(texts, tokens.LETTER).texts == 60


def plain_score(text: str, model) -> tuple[float, int]:
    """One text by the definition: every word of every window in a loop of its own."""
    p = {k: v.astype(np.float64) for k, v in model.params.items()}
    words = tokens.Block([text.encode()], tokens.LETTER)
    spelled = words.words(np.arange(words.count))
    hashes, n, size = words.hashes(), words.count, gru.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))

    def vector(i):
        k = np.flatnonzero(model.hashes == hashes[i])
        bucket, _ = gru.char_buckets([spelled[i]])
        chars = p["char"][bucket].mean(axis=0) if len(bucket) else np.zeros(gru.CHAR_DIM)
        return np.concatenate([p["word"][k[0] + 1 if len(k) else 0], chars])

    def states(xs, d):
        h, out = np.zeros(size), []
        for x in xs:
            g = x @ p[f"in_{d}"] + p[f"bias_{d}"] if x is not None else np.zeros(3 * size)
            r = h @ p[f"rec_{d}"]
            z, s = sig(g[:size] + r[:size]), sig(g[size : 2 * size] + r[size : 2 * size])
            c = np.tanh(g[2 * size :] + s * r[2 * size :])
            h = c + z * (h - c)
            out.append(h)
        return out

    starts = [0]
    while starts[-1] + toxicity.WINDOW < n:
        starts.append(min(starts[-1] + toxicity.STRIDE, n - toxicity.WINDOW))
    logits = []
    for s in starts:
        xs = [vector(i) for i in range(s, min(s + toxicity.WINDOW, n))] or [None]
        both = [np.concatenate(x) for x in zip(states(xs, "f"), states(xs[::-1], "b")[::-1])]
        e = np.array([np.tanh(h @ p["att"]) @ p["att_v"] for h in both])
        a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        logits.append(sum(w * h for w, h in zip(a, both)) @ p["out"] + p["out_b"][0])
    worst = int(np.argmax(logits))
    return float(sig(model.slope * logits[worst] + model.offset)), starts[worst]


def test_scores_against_plain_loops():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["an", "er", "on", "th", "é"]) for _ in range(rng.randrange(1, 5)))
    line = lambda n, bad: " ".join("zorkan" if bad and rng.random() < 0.1 else word() for _ in range(n))
    learn = [line(rng.randrange(5, 90), i % 3 == 0) for i in range(120)]
    model = toxicity.train([t.encode() for t in learn], np.array([int(i % 3 == 0) for i in range(120)]))
    texts = ["", "1 2", "one", line(63, True), line(64, False), line(65, True), line(200, True), line(96, False) + " zorkan", "x" * 300]
    got, worst = toxicity.text_scores([t.encode() for t in texts], model)
    for t, score, at in zip(texts, got, worst):
        want, place = plain_score(t, model)
        assert abs(score - want) < 1e-3, t
        assert at == place or abs(score - want) < 1e-5
