"""Word values and rules: cases worked by hand, and properties."""

import pytest

from tierlens.functions.lexicon import Rules, lexicon_rules_score, lexicon_rules_sum

LEXICON = {"good": 2.0, "bad": -2.0, "fine": 1.0}
CASES = {
    "good": 2.0,
    "(good).": 2.0,
    "not good": -1.5,
    "not a very good": (2.0 + 0.25) * -0.75,
    "not one two three good": 2.0,          # the fourth token is out of reach
    "not one two good": -1.5,
    "very bad": -2.25,
    "very slightly bad": -1.75,             # the last degree word counts
    "GOOD stuff": 2.75,
    "GOOD STUFF": 2.0,                      # all capitals say nothing
    "GOOD A bad b": 0.75,
    "good but bad": 2.0 * 0.5 - 2.0 * 1.5,
    "bad but good but fine": (-2.0 + 2.0) * 0.5 + 1.0 * 1.5,
    "good!": 2.25,
    "bad!!!": -2.75,
    "good!!!!!!!!!": 3.0,
    "not bad!": 1.5 + 0.25,
    "so!": 0.0,
    "": 0.0,
    "  \n ": 0.0,
    "goods": 0.0,
    "can't be bad, but isn't really good": 1.5 * 0.5 + (2.25 * -0.75) * 1.5,
}


@pytest.fixture(scope="module")
def sums(spark):
    def of(texts, rules=Rules(), lexicon=LEXICON):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        return [r[1] for r in sorted(df.select("i", lexicon_rules_sum("t", lexicon, rules)).collect())]

    return of


def test_cases(sums):
    assert dict(zip(CASES, sums(list(CASES)))) == CASES
    assert sums([None]) == [None]


def test_without_rules_it_is_a_plain_sum(sums):
    none = Rules(negations=(), degrees=(), contrast=(), capitals=0.0, marks=0)
    texts = ["not good but VERY bad and fine!", "good good FINE", "x"]
    assert sums(texts, none) == [1.0, 5.0, 0.0]
    assert sums(texts, none, {}) == [0.0, 0.0, 0.0]


def test_a_long_text_and_the_score(spark, sums):
    assert sums(["fine " * 50_000 + "but bad"]) == [50_000 * 0.5 - 3.0]
    df = spark.createDataFrame([("good",), ("bad",), ("x",)], "t string")
    got = [r[0] for r in df.select(lexicon_rules_score("t", LEXICON)).collect()]
    assert got == [pytest.approx(2 / 19**0.5), pytest.approx(-2 / 19**0.5), 0.0]
