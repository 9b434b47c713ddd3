"""Tokens worked by hand, and spans that begin and end with them."""

import pytest
from pyspark.sql import functions as F

from tierlens.functions import tokens as tk

CASES = {
    "I don't know, can't say.": "I do n't know , ca n't say .",
    "It's fine; we're here and they'll stay": "It 's fine ; we 're here and they 'll stay",
    "Rock'n'roll o'clock O'Clock": "Rock ' n ' roll o'clock O'Clock",
    "10km for $5.50, at 10:30 or 1,000.5kg": "10 km for $ 5.50 , at 10:30 or 1,000.5 kg",
    "5. Then v2.0.": "5 . Then v 2.0 .",
    "a well-known wi-fi set-up": "a well - known wi-fi set - up",
    "e.g. this, i.e. that etc. the.g.": "e.g. this , i.e. that etc. the . g .",
    "wait... what?! (yes)": "wait ... what ? ! ( yes )",
    "Größe 4½ é": "Größe 4½ é",
    "n't won't WON'T": "n't wo n't WO N'T",
    "'s": "'s",
    "the dogs' bowl": "the dogs ' bowl",
    "": "",
    " \n ": "",
}


def test_tokens_and_places(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "t string")
    for text, found, joined in df.select("t", tk.tokens("t"), F.array_join(tk.pieces("t"), "")).collect():
        assert " ".join(x["token"] for x in found) == CASES[text]
        assert joined == text
        assert all(text[x["start"] : x["end"]] == x["token"] for x in found)


SPANS = [
    ("the batteries and the battery", "battery", 0),   # the first place is inside no other word: "batteries" has no "battery"
    ("batterycase, battery", "battery", 1),
    ("I don't like it", "do", 0), ("I don't like it", "n't", 0), ("I don't like it", "don", None), ("I don't", "don't", 0),
    ("a 10km run", "km", 0), ("a 10km run", "10", 0), ("a 10km run", "0km", None), ("110km 10km", "10km", 1),
    ("well-known", "known", 0), ("wi-fi", "fi", None), ("wi-fi", "wi-fi", 0), ("1,000.5", "000", None),
    ("aaa a", "a", 3), ("x", "", None), ("x", "y", None), (None, "x", None), ("x", None, None), ("it's", "'s", 0), ("a  b", "a  b", 0), ("a b", "a ", None),
]


def test_ordinals(spark):
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(SPANS)], "i int, t string, s string, want int")
    got = {r["i"]: r["got"] for r in df.select("i", tk.token_ordinal("t", "s").alias("got")).collect()}
    assert got == {i: s[2] for i, s in enumerate(SPANS)}


def test_own_rules(spark):
    rules = tk.TokenRules(whole=("c++",), endings=("'em",), joiners=".")
    df = spark.createDataFrame([("C++ got'em 1,5 2.5",)], "t string")
    assert [x["token"] for x in df.select(tk.tokens("t", rules)).first()[0]] == ["C++", "got", "'em", "1", ",", "5", "2.5"]


def test_a_long_text(spark):
    df = spark.createDataFrame([("don't stop " * 2000,)], "t string")
    assert df.select(F.size(tk.tokens("t"))).first()[0] == 6000
