"""Required trigrams by hand, and the indexed search against the plain one."""

import random

import pytest

from tierlens.operators import marts, search

CASES = {
    "abcd": [["abc", "bcd"]],
    "ABC": [["abc"]],
    "(hot|old) r": [["hot", "ot ", "t r"], ["ld ", "d r", "old"]],
    "ab.cd": None,
    "ab+cde": [["cde"]],
    "abc?def": [["def"]],
    "abc?": None,
    "(abc)*x": None,
    "(abc)+": [["abc"]],
    "^abc$": [["abc"]],
    "abc|d": None,
    "abc|def": [["abc"], ["def"]],
    "[abc]def": [["def"]],
    r"a\.bc": [["a.b", ".bc"]],
    "(unclosed": None,
    "": None,
    "(aaa|bbb)(ccc|ddd)(eee|fff)(ggg|hhh)(iii|jjj)(kkk|lll)": None,  # more alternatives than are followed up
}


def test_required_trigrams():
    got = {p: search.required_grams(p) for p in CASES}
    assert {p: g and [sorted(x) for x in g] for p, g in got.items()} == {p: g and [sorted(x) for x in g] for p, g in CASES.items()}


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    rng, path = random.Random(2), str(tmp_path_factory.mktemp("names"))
    words = ["hot", "Old", "bolt", "ROD", "é", "a", "widget", "5\" x", ".*"]
    rows = [(f"p{i}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) if i % 9 else None) for i in range(400)]
    products = spark.createDataFrame([*rows, ("p1", rows[1][1])], "product_id string, product_name string")
    search.write_index(products, path)
    return products, spark.read.parquet(path)


def test_same_rows_as_the_plain_search(shop, rows):
    products, postings = shop
    for pattern in [*[c for c in CASES if c != "(unclosed"], "bolt (hot|rod)", "old.*widget", "É", r"5\" x hot", None]:
        assert rows(search.indexed_search(products, postings, pattern)) == rows(marts.product_search(products, pattern)), pattern


def test_few_candidates(shop):
    products, postings = shop
    share = search.search_share(products, postings, "widget bolt").first()
    assert share["matches"] <= share["candidates"] < share["names"] / 3
    plan = postings.where("gram IN ('bol', 'wid')")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan
