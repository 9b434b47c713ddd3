"""Token counts against a public tokenizer and a plain merge loop."""

import os
import random

import pytest

from tierlens.operators import prompts, tokens
from tierlens.plans.bridge import VOCABULARY

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def ranks():
    return tokens.read_ranks(VOCABULARY)


def texts():
    rng = random.Random(4)
    bits = ["the", " quick", "  ", "\n", "\n\n ", "né", "Übergröße", "12345", "!?", "'s", " don't", "\t", "😀", "中文", " x", "aaaa", "."]
    return ["", " ", "\n\n", "It's  spaced\n\n  out ", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(300))]


def test_against_a_tokenizer(spark, ranks):
    tiktoken = pytest.importorskip("tiktoken")
    plain = tiktoken.Encoding("own", pat_str=tokens.PIECES.removeprefix("(?U)"), mergeable_ranks=ranks, special_tokens={})
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([*rows, (9999, None), (9998, rows[5][1]), (9998, rows[6][1])], "i int, t string").repartition(4)
    got = {r["i"]: r["tokens"] for r in tokens.count_tokens(df, "t", ["i"], ranks).collect()}
    want = {i: len(plain.encode_ordinary(t)) for i, t in rows}
    assert got == want | {9999: 0, 9998: want[5] + want[6]}


def test_long_pieces_as_short_ones(ranks):
    rng = random.Random(1)
    for n in (257, 400, 1000):
        for letters in ("a", "ab", "aeinrst ", "xyzq\xc3\xa9"):
            piece = "".join(rng.choice(letters) for _ in range(n)).encode()
            assert tokens.n_tokens(piece, ranks) == len(tokens.merged(piece, ranks))
    assert tokens.n_tokens(b"word" * 100_000, ranks) > 0


def test_request_sizes(spark, ranks):
    df = spark.createDataFrame([("You sum up.", "List them."), ("You sum up.", None)], "system string, prompt string")
    sizes = prompts.request_sizes(prompts.typed(df, "summary", "summary"), ranks).collect()
    n = lambda s: sum(len(tokens.merged(p.encode(), ranks)) for p in s)
    assert sorted(r["in_tok"] for r in sizes) == sorted([n(["You", " sum", " up", "."]), n(["You", " sum", " up", ".", "List", " them", "."])])
    assert [r["in_tok"] for r in prompts.request_sizes(prompts.typed(df.limit(1), "summary", "summary")).collect()] == [6]


def test_a_vocabulary_has_a_size_limit(tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "VOCABULARY_BYTES", 3)
    (tmp_path / "v").write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError):
        tokens.read_ranks(str(tmp_path / "v"))


def test_pieces_stay_in_their_task(spark, ranks, monkeypatch):
    """Only counts are shuffled and nothing is written, also when a task forgets pieces between batches."""
    tiktoken = pytest.importorskip("tiktoken")
    monkeypatch.setattr(tokens, "KNOWN", 3)
    written = []
    monkeypatch.setattr("pyspark.sql.DataFrameWriter.parquet", lambda *_, **__: written.append(1))
    rows = [(i % 40 or None, t) for i, t in enumerate([*texts(), None])]
    df = spark.createDataFrame(rows, "i int, t string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = tokens.count_tokens(df, "t", ["i"], ranks)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {r["i"]: r["tokens"] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = tiktoken.Encoding("own", pat_str=tokens.PIECES.removeprefix("(?U)"), mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in rows:
        want[i] = want.get(i, 0) + len(plain.encode_ordinary(t or ""))
    assert got == want and not written
    assert "hashpartitioning(_of" in plan and "piece#" not in plan
