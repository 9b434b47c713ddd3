"""Components and link counts against all pairs, in lists of every length."""

import random
import re

import numpy as np
import pytest

from tierlens.llm import ngram_join as j
from tierlens.llm import tokens


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width, 0) + 1)} if w else set()


def brute(docs, share=75):
    sets = [shingles(t) for _, t in docs]
    near = [
        [k != i and bool(a) and bool(b) and 100 * len(a & b) >= share * len(a | b) for k, b in enumerate(sets)]
        for i, a in enumerate(sets)
    ]
    out = []
    for i, (doc, _) in enumerate(docs):
        seen, stack = {i}, [i]
        while stack:
            for k in np.flatnonzero(near[stack.pop()]):
                if k not in seen:
                    seen.add(int(k))
                    stack.append(int(k))
        ids = [docs[k][0] for k in seen if docs[k][0] is not None]
        out.append((doc, len(sets[i]), min(ids, default=None), sum(near[i])))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(400)
    passage = [word() for _ in range(30)]
    docs = []
    for _ in range(25):
        docs.append([word() for _ in range(rng.choice([1, 3, 4, 5, 8, 40, 90]))])
    for base in ([word() for _ in range(80)], [word() for _ in range(30)]):
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = word()
            docs.append(copy + [word() for _ in range(rng.randrange(3))])
    docs += [passage + [word() for _ in range(rng.randrange(30))] for _ in range(25)]
    docs += [docs[0], docs[30], docs[30][::-1]]
    texts = [rng.choice([" ", "\n", " \t"]).join(w.upper() if rng.random() < 0.1 else w for w in d) for d in docs]
    return [*enumerate(texts), (900, None), (901, ""), (902, " \n"), (None, texts[1]), (5, texts[5]), (3, texts[40])]


@pytest.mark.parametrize("short, block, common", [(64, 512, 100_000), (3, 4, 100_000), (6, 512, 10)])
def test_join(spark, monkeypatch, short, block, common):
    monkeypatch.setattr(j, "SHORT", short)
    monkeypatch.setattr(j, "BLOCK", block)
    if common == 10:  # common n-grams are sent on while rows gather
        count = j._count
        monkeypatch.setattr(j, "_count", lambda buckets: count(buckets, 200, 10))
    docs = corpus(short)
    frame = spark.createDataFrame([(t, i, 7, "c") for i, t in docs], "text string, doc_id bigint, n int, cls string")
    got = sorted((tuple(r) for r in j.ngram_join(frame.repartition(3)).collect()), key=str)
    assert got == brute(docs)
    assert max(r[3] for r in got) > 20


def test_empty_table(spark):
    assert j.ngram_join(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_word_hash_does_not_depend_on_place():
    a = tokens.Block([b"One two", b"", b"TWO  one\0x"], tokens.SPACE)
    h = a.hashes()
    assert a.words(np.arange(a.count)) == [b"one", b"two", b"two", b"one\0x"]
    assert h[0] != h[1] and h[1] == h[2] and h[3] != h[0]
    assert tokens.word_hash(["two", "one"]).tolist() == [h[1], h[0]]
