"""Sums over segmentations against listing them, learning, edge cases and held-out accuracy."""

import math

import numpy as np
import pytest

from tierlens.llm import lang_id as li
from tierlens.llm import tokens


@pytest.fixture(scope="module")
def vocabulary():
    return li.pieces(li.VOCABULARY)


def segmentations(word, known):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in known or k == 1:
            for rest in segmentations(word[k:], known):
                yield [word[:k], *rest]


def names(vocabulary):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=li.VOCABULARY)
    all_ = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    dense = {c for c in map(chr, np.flatnonzero((vocabulary.chars > 0) & (vocabulary.chars < vocabulary.width)))}
    return {p for p in all_ if len(p) > 1 and p.removeprefix(li.MARK).isalpha() and p == p.lower() and set(p) <= dense}


@pytest.mark.parametrize("word", ["a", "the", "nation", "éta", "qqq", "x一y", "\U0001f600"])
def test_sum_over_segmentations(vocabulary, word):
    rng = np.random.default_rng(len(word))
    probs = rng.random((vocabulary.count, 2))
    known = names(vocabulary)
    number = {}

    def piece(p):
        if len(p) == 1:
            return int(vocabulary.chars[ord(p)])
        if p not in number:
            node = 0
            for c in p:
                node = vocabulary.next[node, vocabulary.chars[ord(c)]]
            number[p] = int(vocabulary.piece[node])
        return number[p]

    want = sum(np.prod([probs[piece(p)] for p in s], axis=0) for s in segmentations(li.MARK + word, known))
    got = li.forward(vocabulary, vocabulary.numbers([word]), probs)[0]
    assert np.allclose(got, np.log(want))
    uses = np.zeros(vocabulary.count)
    whole = 0.0
    for s in segmentations(li.MARK + word, known):
        w = math.prod(probs[piece(p), 0] for p in s)
        whole += w
        for p in s:
            uses[piece(p)] += 3 * w
    assert np.allclose(li.expected(vocabulary, vocabulary.numbers([word]), probs[:, 0], np.array([3.0])), uses / whole)


def test_very_long_word(vocabulary):
    probs = np.full((vocabulary.count, 2), 1e-5)
    got = li.forward(vocabulary, vocabulary.numbers(["ab" * 4000]), probs)
    assert np.isfinite(got).all() and (got < -10_000).all()


def test_edge_cases(spark):
    schema = "doc_id bigint, text string, lang string, score string, lang_pred int"
    rows = [(i, "the house and the garden of that man " * 3, "en", "x", 1) for i in range(12)]
    rows += [(20 + i, "das Haus und der Garten von diesem Mann " * 3, "de", "x", 1) for i in range(12)]
    rows += [(50, None, "en", None, None), (51, "", None, None, None), (52, "123 -- …", "de", None, None),
             (None, "GARTEN und Haus", None, None, None), (0, "Das Haus", "en", "x", 1), (53, "the " * 5000 + "x" * 9000, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    got = li.predict(docs, li.fit(docs)).collect()
    assert [r["lang_pred"] for r in got] == ["en"] * 12 + ["de"] * 12 + ["und"] * 3 + ["de", "de", "en"]
    assert all(0 <= r["score"] <= 1 and (r["score"] == 0) == (r["lang_pred"] == "und") for r in got)
    none = li.predict(docs, li.fit(docs.where("lang IS NULL")))
    assert {(r["lang_pred"], r["score"]) for r in none.collect()} == {("und", 0.0)}
    assert li.predict(docs.where("false"), li.fit(docs)).collect() == []


def test_long_words_and_texts_teach(spark):
    """A language without blanks, and one of long texts alone."""
    en, de = "the house and the garden of that man ", "das Haus und der Garten von diesem Mann "
    zh = "\u6211\u4eec\u7684\u623f\u5b50\u548c\u82b1\u56ed\u5728\u8fd9\u91cc\uff0c\u4ed6\u5f88\u597d\u3002"
    rows = [(i, en * 3, "en") for i in range(12)] + [(20 + i, zh * 9, "zh") for i in range(12)]
    rows += [(40 + i, de * 600, "de") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = li.fit(docs)
    assert model.languages == ["de", "en", "zh"]
    new = spark.createDataFrame([(1, en), (2, zh), (3, de)], "doc_id bigint, text string")
    assert [r["lang_pred"] for r in li.predict(new, model).orderBy("doc_id").collect()] == ["en", "zh", "de"]


def test_runs():
    assert li.runs("Aé，".encode() * 2 + b"x" * 7, 3) == ["aé", "aé", "xxx", "xxx", "x"]
    assert li.runs("，。".encode(), 3) == []


def test_cache_does_not_matter(vocabulary, monkeypatch):
    rng = np.random.default_rng(2)
    model = li.Model(["a", "b"], rng.random((vocabulary.count, 2)) / 100, li.VOCABULARY)
    texts = [" ".join("".join(rng.choice(list("abcé1"), 4)) for _ in range(30)).encode() for _ in range(40)]
    whole = li.text_languages(texts, li.Scorer(model))
    monkeypatch.setattr(li, "CACHE", 20)
    monkeypatch.setattr(li, "BLOCK_BYTES", 300)
    small = li.text_languages(texts, li.Scorer(model))
    assert whole[0] == small[0] and np.allclose(whole[1], small[1])
    assert tokens.LETTER[ord("a")]


def test_held_out_accuracy(spark):
    from tierlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in QUERIES["op2_lang_id"](spark, sf).collect() if r["held_out"]]
    assert len(got) > 200
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got]) > 0.95
