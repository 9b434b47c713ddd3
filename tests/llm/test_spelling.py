"""Spelling variants against comparing every two words."""

import random
import re
import zlib
from collections import Counter

from tierlens.llm import spelling


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def every_two(words: dict[str, int]):
    form, near = {}, {}
    for w, n in words.items():
        others = [v for v in words if one_edit(w, v)]
        near[w] = len(others)
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, near[w], form[w], words.get(form[w]), root))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def test_variants_against_all_pairs(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("aaabé") for _ in range(rng.randint(2, 6))): rng.choice([2, 3, 30, 400, 5000]) for _ in range(250)}
    words |= {"aaaaaaaa": 7, "aaaaaaa": 70, "aaaaaa": 700, "aaaaa": 7000, "alone": 9}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    assert result(spelling.variants(df)) == every_two(words)


def plain_words(doc_id, text):
    out = Counter()
    for run in re.findall("[A-Za-zÀ-ÿ]+", text):
        run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        if h % 31 == 0:
            run = "".join(c for i, c in enumerate(run) if i != h % len(run))
        if len(run) >= 7:
            out[run.encode()] += 1
    return out


def test_words_of_a_text():
    rng = random.Random(1)
    text = "".join(rng.choice("abcÉéÀß×  ,1Z") for _ in range(40_000))
    assert len(plain_words(7, text)) > 100
    assert spelling.text_words(7, text) == plain_words(7, text)
    assert spelling.text_words(None, "abcdefgh") == plain_words("", "abcdefgh")


def test_long_texts_are_read_in_pieces():
    text = "abcdefgh, Ijklmnopq " * 200 + "x" * 5000
    assert "".join(spelling.pieces(text, 64)) == text
    assert all(len(p) <= 64 + 10 for p in list(spelling.pieces(text, 64))[:-1])
    assert sum(map(len, spelling.pieces("", 64))) == 0


def test_counts_nulls_and_repeats(spark):
    long = "ordinary " * 150_000
    rows = [(1, "Spelling spelling", 0), (1, "Spelling spelling", 0), (2, None, 0), (None, "", 0), (3, long, 0), (None, "loneword", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    want = sum((plain_words("" if i is None else i, t or "") for i, t, _ in rows), Counter())
    want = {w.decode(): n for w, n in want.items() if n >= 2}
    assert {r["word"]: r["n"] for r in spelling.count_words(df).collect()} == want
    assert spelling.variants(spelling.count_words(df.where("doc_id > 9"))).count() == 0
