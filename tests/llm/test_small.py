"""Token histogram, mixing, line dedup and top-k on small tables with edge cases."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tierlens.llm import line_dedup, mixing, token_counts, topk
from tierlens.llm.queries import ORACLES, QUERIES
from tools.check import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    msg, _, _, ok = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert ok, msg


def test_histogram_gives_every_total(spark):
    rng = random.Random(8)
    texts = [None, "", " ", "one", "ünï 123 !!"] + ["word " * rng.randrange(60) for _ in range(200)]
    docs = spark.createDataFrame([(t, 1) for t in texts], "text string, n_tokens int")
    encode = token_counts.encoder(token_counts.VOCABULARY).encode_ordinary
    lengths = sorted(len(encode(t or "")) for t in texts)
    counts = token_counts.histogram(docs)
    assert {r.n_tokens: r.n_docs for r in counts.collect()} == {n: lengths.count(n) for n in lengths}
    for r in token_counts.totals(counts).collect():
        upto = [n for n in lengths if n <= r.n_tokens]
        assert (r.docs_up_to, r.tokens_up_to, r.docs_over) == (len(upto), sum(upto), len(lengths) - len(upto))
        assert r.truncated_total == sum(min(n, r.n_tokens) for n in lengths)
        assert r.quantile == len(upto) / len(lengths)
    got = {r.limit: r.total for r in token_counts.truncated_total(counts, [0, 7, 10_000]).collect()}
    assert got == {x: sum(min(n, x) for n in lengths) for x in (0, 7, 10_000)}
    assert token_counts.totals(token_counts.histogram(docs.where("false"))).collect() == []


def test_token_counts_query(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    encode = token_counts.encoder(token_counts.VOCABULARY).encode_ordinary
    lengths = [len(encode(t or "")) for t in texts]
    got = {r.n_tokens: (r.n_docs, r.truncated_total) for r in QUERIES["op5_token_counts"](spark, SF).collect()}
    assert got == {n: (lengths.count(n), sum(min(x, n) for x in lengths)) for n in set(lengths)}


def test_lines(spark):
    rows = [
        (3, "The same long line\nown line of three", "k"), (1, "  THE SAME LONG LINE\t\nshort\nshort", None),
        (2, "short\nthe same long line \nÉtale ÉTALE!", "k"), (None, "the same long line\nétale étale!", "k"),
        (4, None, None), (5, "", None), (6, "twice in here\ntwice in here", None), (2, "short", "r"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string").withColumn("n_lines", F.lit("old"))
    got = {(r.doc_id, r.key): (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {
        (3, "k"): ("own line of three", 2, 1), (1, None): ("  THE SAME LONG LINE\t\nshort\nshort", 3, 0),
        (2, "k"): ("short\nÉtale ÉTALE!", 3, 1), (None, "k"): ("étale étale!", 2, 1), (4, None): (None, 1, 0),
        (5, None): ("", 1, 0), (6, None): ("twice in here\ntwice in here", 2, 0), (2, "r"): ("short", 1, 0),
    }
    three = {(r.doc_id, r.key): r.n_dropped for r in line_dedup.dedup_lines(docs, min_docs=5).collect()}
    assert sum(three.values()) == 0
    assert line_dedup.dedup_lines(docs.where("false")).collect() == []


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1), ("c", 50), (None, 0)], "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(sizes, (1, 2, 3), 3).collect()}
    assert got["b"] == 3.0 and got[None] == 0.0
    assert got["c"] == pytest.approx(148 * 3 / 4) and got["a"] == pytest.approx(148 / 4)


def test_mix_edge_cases(spark):
    rows = [(i, "w " * (i % 9), "a", "old") for i in range(300)] + [(5, "w w", "a", "x")] * 3
    rows += [(None, "w w w", None, None), (None, None, None, None), (900, "", "z", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies string")
    got = mixing.mix(mixing.measured(docs)).collect()
    assert len(got) == len(rows)
    for source in ("a", None, "z"):
        mine = [r for r in got if r.source == source]
        taken, target = sum(r.taken for r in mine), mine[0].target
        assert abs(taken - target) <= max(r.size for r in mine) * 4
        assert all(r.taken == r.size * r.copies <= 3 * r.size for r in mine)
    assert len({r.copies for r in got if r.doc_id == 5}) == 1
    assert mixing.mix(mixing.measured(docs.where("false"))).collect() == []
    empty = mixing.mix(mixing.measured(docs.where("doc_id = 900"))).collect()
    assert [(r.target, r.taken) for r in empty] == [(0.0, 0)]


def test_top_k_of_large_components(spark):
    rows = [(0, [3e12, 1.0]), (1, [2e12, -4e12]), (2, [-1e3, 5.0]), (3, [0.0, 1e13]), (4, [1.0, None]), (5, [float("inf"), 0.0])]
    vectors = topk.whole_numbers(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), scale=1)
    whole = {r.vec_id: r.v for r in vectors.collect()}
    assert sorted(whole) == [0, 1, 2, 3]
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(vectors, F.col("vec_id") == 0, 2).collect()
    less = vectors.where("vec_id <> 1")
    want = sorted((-sum(a * b for a, b in zip(whole[0], whole[i])), i) for i in (2, 3))
    got = topk.top_k(less, F.col("vec_id") == 0, 2).collect()
    assert [tuple(r) for r in sorted(got, key=lambda r: r["rank"])] == [(0, n + 1, i, -s) for n, (s, i) in enumerate(want)]
    with pytest.raises(Exception, match="does not fit a long"):
        topk.whole_numbers(spark.createDataFrame([(1, [1e30])], "vec_id bigint, embedding array<double>")).collect()


@pytest.mark.parametrize("k", [1, 3, 50])
def test_top_k(spark, k):
    rng = random.Random(k)
    vec = lambda: [round(rng.uniform(-1, 1), 1) for _ in range(4)]
    rows = [(i, vec()) for i in range(60)] + [(100 + i, [0.5, -0.5, 0.25, 1.0]) for i in range(30)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (203, [float("inf"), 0.0, 0.0, 0.0]),
             (204, [1.0, 2.0]), (220, [3.0, 1.0]), (3, rows[3][1]), (None, [1.0] * 4), (240, [])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    vectors = topk.whole_numbers(frame)
    got = topk.top_k(vectors, F.col("vec_id") % 20 == 0, k, candidates=16, queries=2).collect()
    whole = {}
    for r in vectors.collect():
        whole.setdefault(r.vec_id, []).append(r.v)
    want = set()
    for q in [i for i in whole if i % 20 == 0]:
        v = min(whole[q])
        scored = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, cs in whole.items() if i != q for c in cs if len(c) == len(v))
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert {204, 220} <= {r.vec_id for r in got} | {r.query_id for r in got}
    assert topk.top_k(vectors.where("false"), F.col("vec_id") % 20 == 0, k).collect() == []
