"""Keywords found by the automaton against plain searches."""

import random
import time

import pytest

from tierlens.operators import automaton, curate, spans


def plain(texts, keywords):
    return sorted((i, at, k) for i, t in enumerate(texts) for k, w in enumerate(keywords) for at in range(len(t)) if t.startswith(w, at))


def found(keywords, texts, cells=automaton.CELLS):
    return sorted((int(i + at), int(s), int(w)) for at, owner, start, word in automaton.Keywords(keywords, cells).places(texts)
                  for i, s, w in zip(owner, start, word))


@pytest.mark.parametrize("seed", range(5))
def test_all_places(monkeypatch, seed):
    monkeypatch.setattr(automaton, "PIECE", 7)
    monkeypatch.setattr(automaton, "TOGETHER", 60)
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abé😀 ") for _ in range(rng.randint(1, n)))
    keywords = sorted({word(9) for _ in range(40)})
    texts = ["", *(word(90) for _ in range(40)), "", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "no hit? zz"]
    assert found(keywords, texts) == plain(texts, keywords)
    assert found(keywords, texts, cells=30) == plain(texts, keywords)
    assert len(automaton.Keywords(keywords, 30).parts) > 3


def test_a_hundred_thousand_keywords(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 10)))
    keywords = list({word(): None for _ in range(100_000)})
    texts = [" ".join(rng.choice(keywords) if rng.random() < 0.3 else word() for _ in range(12)) for _ in range(300)]
    sentences = spark.createDataFrame(list(enumerate(texts)), "sentence_id int, sentence string").repartition(4)
    table = spark.createDataFrame([(f"a{i % 50}", w, i % 50) for i, w in enumerate(keywords)], "aspect string, keyword string, priority int")
    began = time.time()
    got = {(r[0], r[1]): r[2] for r in spans.taxonomy_table_aspects(sentences, table).collect()}
    assert time.time() - began < 60
    known = {w: i % 50 for i, w in enumerate(keywords)}
    want = {}
    for i, t in enumerate(texts):  # a plain loop over all substrings
        for at in range(len(t)):
            for n in range(4, 11):
                if (p := known.get(t[at : at + n])) is not None and at + n <= len(t):
                    want[i, f"a{p}"] = p
    assert got == want
    shares = {(r[0], r[1]): r[2] for r in spans.taxonomy_table_aspects(sentences, table, chars=400_000).collect()}
    assert shares == want


def test_no_keywords_and_no_texts(spark, rows):
    table = spark.createDataFrame([("a", "", 1)], "aspect string, keyword string, priority int")
    sentences = spark.createDataFrame([(1, "x"), (2, None)], "sentence_id int, sentence string")
    none = spans.taxonomy_table_aspects(sentences, table)
    assert none.columns == ["sentence_id", "aspect", "priority"] and none.count() == 0
    assert spans.taxonomy_table_aspects(sentences.limit(0), table.withColumn("keyword", table.aspect)).count() == 0


def plain_distance(text, start, end, cues):
    gaps = [0 if at <= end and at + len(c) >= start else min(abs(at - end), abs(start - at - len(c)))
            for c in cues for at in range(len(text)) if text.startswith(c, at)]
    return min(gaps, default=None), len(gaps)


def test_nearest_cue_from_a_table(spark):
    rng = random.Random(3)
    cues = sorted({"".join(rng.choice("xyz ") for _ in range(rng.randint(1, 3))) for _ in range(12)} | {"battery"})
    texts = ["".join(rng.choice(["x", "y", "z", " ", "battery", " price ", "lag"]) for _ in range(rng.randint(0, 14))) for _ in range(200)]
    sentences = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, sentence string")
    table = spark.createDataFrame([(c,) for c in [*cues, "", cues[0]]], "cue string")
    for chars in (automaton.KEYWORD_CHARS, 6):
        got = curate.table_cue_distance(sentences, table, chars=chars).select("sentence", "start", "span", "cue_dist", "cue_places").collect()
        assert len(got) > 50
        for t, start, span, dist, places in got:
            assert (dist, places) == plain_distance(t, start, start + len(span), cues)


def test_time_does_not_grow_with_cues():
    rng = random.Random(6)
    text = ["".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(2000)]

    def seconds(n):
        words = automaton.Keywords(sorted({"".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(n)}))
        began = time.perf_counter()
        list(words.places(text))
        return time.perf_counter() - began

    few = min(seconds(50) for _ in range(3))
    assert min(seconds(5000) for _ in range(3)) < 10 * few + 0.2
