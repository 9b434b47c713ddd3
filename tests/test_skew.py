import random

import pytest
from pyspark.sql import functions as F

from tierlens.operators import skew


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows under one key, some keys null."""
    rng = random.Random(5)
    data = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else rng.choice([None, *"abcdefgh"])
        data.append((key, i * 7 + 1, rng.randint(0, 5), rng.choice("xyz")))
    return data, spark.createDataFrame(data, "k string, ord bigint, v int, s string").repartition(4)


def grouped(data):
    out = {}
    for row in sorted(data, key=lambda r: r[1]):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize("bits", [2, 8, 40])
def test_running_total(hot, bits):
    data, df = hot
    got = {r.ord: r.t for r in skew.running_total(df, ["k"], "ord", F.col("v"), "t", bits).collect()}
    want = {}
    for group in grouped(data).values():
        total = 0
        for _, o, v, _ in group:
            want[o] = total
            total += v
    assert got == want


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_rank_by_hash(hot, keys):
    data, df = hot
    hashed = df.withColumn("h", skew.rank_hash(1, "ord"))
    ranked = skew.rank_by_hash(hashed, keys, "h", ["ord"], "r", digits=2).collect()
    groups = {}
    for r in ranked:
        groups.setdefault(r.k if keys else 0, []).append((r.h, r.ord, r.r))
    for rows in groups.values():
        assert [x[2] for x in sorted(rows)] == list(range(len(rows)))


@pytest.mark.parametrize("bits", [2, 40])
def test_next_value(hot, bits):
    data, df = hot
    got = {r.ord: r.n for r in skew.next_value(df, ["k"], "ord", "s", "n", bits).collect()}
    want = {}
    for group in grouped(data).values():
        for a, b in zip(group, group[1:] + [None]):
            want[a[1]] = b[3] if b else None
    assert got == want


def test_lookup_semi_anti(spark, hot):
    data, df = hot
    right = spark.createDataFrame([("hot", 1), ("a", 2), (None, 3), ("zz", 4)], "k string, w int")
    weights = {"hot": 1, "a": 2, None: 3}
    left = {r.ord: r.w for r in skew.lookup(df, right, ["k"]).collect()}
    assert left == {o: weights.get(k) for k, o, _, _ in data}
    inner = {r.ord for r in skew.semi(df, right.unionByName(right), ["k"]).collect()}
    outer = {r.ord for r in skew.anti(df, right, ["k"]).collect()}
    assert inner == {o for k, o, _, _ in data if k in weights}
    assert outer == {o for k, o, _, _ in data if k not in weights}


def test_with_group_min_and_keep_first(hot):
    data, df = hot
    value = F.when(F.col("v") > 2, F.col("ord"))
    got = {r.ord: r.m for r in skew.with_group_min(df, ["k"], value, "m").collect()}
    least = {k: min((r[1] for r in rows if r[2] > 2), default=None) for k, rows in grouped(data).items()}
    assert got == {o: least[k] for k, o, _, _ in data}
    first = {r.k: r.ord for r in skew.keep_first(df, ["k"], ["ord"]).collect()}
    assert first == {k: rows[0][1] for k, rows in grouped(data).items()}
    for k in (3, 1200):  # more than Spark cuts before a shuffle by itself
        top = sorted(r.ord for r in skew.top_k(df, ["k"], ["ord"], k).collect())
        assert top == sorted(r[1] for rows in grouped(data).values() for r in rows[:k])


def test_first_rows_are_cut_before_the_shuffle(hot):
    plan = skew.keep_first(hot[1], ["k"], ["ord"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
