"""The index against plain search, and whole results against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from tierlens.llm import decontaminate as d
from tierlens.llm import tokens

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=10):
    wanted = {}
    for item, t in items:
        w = words(t)
        for i in range(max(len(w) - width, 0) + 1 if w else 0):
            wanted.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    lengths = {len(k) for k in wanted}
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (items_ := wanted.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= items_
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array(seed):
    rng = random.Random(seed)
    body = [rng.randrange(1, 4) for _ in range(rng.randrange(0, 200))] * rng.randrange(1, 4)
    s = np.array([*body, 0])
    order = d.suffix_array(s)
    assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_wavelet_rank():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 11, 300)
    w = d.Wavelet(values, 4)
    upto, symbol = rng.integers(0, 301, 500), rng.integers(0, 11, 500)
    assert w.rank(symbol, upto).tolist() == [int((values[:u] == s).sum()) for u, s in zip(upto, symbol)]


@pytest.mark.parametrize("seed", range(8))
def test_hits_in_shards(seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "C1", "é", "dd"] + (["x%d" % i for i in range(40)] if seed % 2 else [])
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 14, 30]))) for i in range(8)]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(30)]
    docs += [(100 + i, text(5) + ", " + items[i][1].upper() + "!\n" + text(4)) for i in range(8)]
    docs += [(200, None), (201, ""), (202, "..."), (203, docs[0][1]), (204, text(3000))]
    want = brute(docs, items)
    part = d.Phrases(d.phrases_of([(str(i), t) for i, t in items]))
    for size in (200, 1 << 20):
        for at, block in tokens.blocks([(t or "").encode() for _, t in docs], tokens.ALNUM, size):
            hit, found = d.hits(block, part)
            for t in range(block.texts):
                got = (int(block.per_text[t]), int(hit[block.first[t] : block.last[t]].sum()), len(found[t]), d.items_digest(sorted(found[t])))
                assert got == want[docs[at + t][0]], docs[at + t]


DOCS = [
    (1, "one two three four five six seven eight nine ten eleven", "n1"),
    (2, "Start. One TWO three four, five six seven eight nine ten end", "n2"),
    (2, "short item here", None), (3, None, "n3"), (4, "", None), (None, "nothing at all", "x"),
]
ITEMS = [(7, "one two three four five six seven eight nine ten"), (8, "Short item"), (9, None), (9, "!"), (None, "nothing at all")]


@pytest.mark.parametrize("phrases", [1, 100])
def test_spans_and_removal(spark, phrases):
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(DOCS)], "doc_id bigint, text string, items string, place int")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = d.find_leaks(docs, items, phrases=phrases, remove=True).orderBy("place").collect()
    assert [r["text"] for r in got] == ["eleven", "Start. end", "here", None, "", ""]
    assert [r["items"] for r in got] == [["7"], ["7"], ["8"], [], [], []]
    assert [r["n_hit"] for r in got] == [10, 10, 2, 0, 0, 3]  # the last by an item without an id
    assert [tuple(s) for s in got[1]["spans"]] == [(7, 56)]


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string, items string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert d.find_leaks(docs.where("false"), items).collect() == []
    assert {r["n_hit"] for r in d.find_leaks(docs, items.where("false")).collect()} == {0}


def test_query(spark):
    from tierlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in QUERIES["op10_decontamination"](spark, sf).collect()}
    assert got == brute(docs, items)
    assert any(n for _, n, _, _ in got.values())


@pytest.mark.parametrize("size", [1, 40, 300, 10_000])
def test_a_long_text_in_pieces(size):
    rng = random.Random(size)
    vocab = ["a", "B", "c1", "é", "x" * 70]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n"]) for _ in range(n))
    items = [(str(i), text(rng.choice([1, 3, 9, 10, 14]))) for i in range(5)]
    part = d.Phrases(d.phrases_of(items))
    for n in (0, 1, 8, 9, 10, 40, 400):
        t = text(n) + items[2][1] + text(n)
        block = tokens.Block([t.encode()], tokens.ALNUM)
        hit, seen = d.hits(block, part)
        want = (block.count, int(hit.sum()), seen[0], d.spans(block, hit, 0))
        assert d.long_text(t.encode(), part, size=size) == want
        half = [{"start": s, "end": e} for s, e in want[3][:1]]
        assert d.long_text(t.encode(), d.Phrases([]), half, size)[3] == want[3][:1]


def test_texts_longer_than_a_shard(spark, monkeypatch):
    monkeypatch.setattr(d, "SHARD_BYTES", 100)
    rng = random.Random(2)
    words_ = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(words_) for _ in range(n))
    items = [(i, text(12)) for i in range(6)] + [(None, text(11))]
    docs = [(i, text(rng.randrange(0, 90)) + " " + items[i % 7][1] + " " + text(20)) for i in range(20)]
    search = d._search(["doc_id", "text"], d.Phrases(d.phrases_of([(None if i is None else str(i), t) for i, t in items])), False, False)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], names=["doc_id", "text"])
    want = brute(docs, [(i if i is not None else "none", t) for i, t in items])
    for r in next(search(iter([batch]))).to_pylist():
        assert (r["n_words"], r["n_hit"]) == want[r["doc_id"]][:2]
        assert (r["items"] == [] or r["doc_id"] % 7 < 6) and (str(r["doc_id"] % 7) in r["items"]) == (r["doc_id"] % 7 < 6)


def test_windows_are_made_in_tasks_and_in_shares(spark):
    items = spark.createDataFrame([(1, "a b c d"), (2, "b c d"), (3, "B, c d!"), (None, "z"), (4, None), (5, "")], "item_id bigint, text string")
    got = sorted((r["phrase"], r["item"] or "") for r in d.windows(items, 3).collect())
    assert got == [("a b c", "1"), ("b c d", "1"), ("b c d", "2"), ("b c d", "3"), ("z", "")]
    parts = list(d._slices(items, 3, 1))
    assert sum(len(p.lengths) for p in parts) == 3 and len(parts) == 3
