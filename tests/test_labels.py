import random

import pytest
from pyspark.sql import functions as F

from tierlens import constants as k
from tierlens.operators import curate, evaluate, skew
from tierlens.sources import io

ORDER = k.LABEL_ORDER


SENTENCES = [
    ("p1", 0, 0, "the battery is bad and it died fast"),
    ("p2", 1, 0, "the battery is bad and it died fast"),  # the same again
    ("p2", 1, 1, "short bad sound"),
    ("p2", 1, 2, "the sound is lovely and pleasant to hear"),  # no cue
    ("p3", 2, 0, "a poor delivery came, so poor"),
    ("p3", 2, 1, "the price is a total waste for me"),  # labelled already
    ("p4", 3, 0, "charge it " + "and so on " * 7 + "then broken"),  # the first keyword is 79 away from the cue
    ("p5", 4, 0, "worst charging cable i ever had"),
]
#: Aspect, span, distance, cues, product, worked out by hand.
MINED = {
    ("battery", "battery", 4, "bad|died", "p1"), ("performance", "fast", 1, "bad|died", "p1"),
    ("delivery", "delivery", 1, "poor", "p3"), ("durability", "broken", 0, "broke|broken", "p4"),
    ("battery", "charging", 1, "worst", "p5"),
}


@pytest.mark.parametrize("cap", [None, 1])
def test_mining(spark, cap):
    rows = spark.createDataFrame(SENTENCES, "product_id string, row_ord int, pos int, sentence string").repartition(3)
    labelled = spark.createDataFrame([("THE price is a total waste for me ",), (None,)], "text string")
    got = curate.mine_candidates(rows, labelled, cap=cap).collect()
    want = {r for r in MINED if cap is None or r[1] != "battery"}
    assert {(r.aspect, r.span, r.cue_dist, r.cue_hits, r.product_id) for r in got} == want and len(got) == len(want)
    assert all(r.n_cues == len(r.cue_hits.split("|")) and r.polarity == "negative" and r.ordinal == 0 for r in got)


#: Text, span, polarity of a reviewed candidate, and what is wrong with it, worked out by hand.
REVIEWED = [
    ("the battery died", "battery", "negative", None),
    ("The Battery died", "Battery", " Positive", "duplicate"),              # the first one in other letters
    ("the battery died", "the", "neutral", None),                           # another span of that text
    ("power cut", "owe", "negative", "span not aligned"),
    ("power cut", "owe", "negative", "span not aligned"),                   # what was not kept is no first one
    ("power cut", "power", "oops", "invalid polarity"),
    ("power cut", "power", None, "invalid polarity"),
    ("power cut", "Power", "negative", "span not in text"),                 # case counts inside a text
    ("power cut", "power", "negative", None),                               # the first that is right
    ("power cut", "power", "negative", "duplicate"),
    ("cheap stuff", "cheap", "negative", "already labelled"),
    ("cheap stuff", "cheap", "bad", "invalid polarity"),                    # of two faults the first rule's
    ("cheap stuff", "heap", "negative", "span not aligned"),
    ("it is dead", "zz", "positive", "span not in text"),
    ("batteries, battery", "battery", "negative", None),
]
LABELLED = [("CHEAP stuff ", "cheap"), ("it is dead", "dead"), (None, "battery")]
COLUMNS = "cand_id int, text string, span string, polarity string, aspect string, ordinal int"


def validated(spark, candidates, labelled=LABELLED):
    rows = [(i, t, s, p, "a", 0) for i, (t, s, p) in enumerate(candidates)]
    return curate.validate_candidates(
        spark.createDataFrame(rows, COLUMNS).repartition(3), spark.createDataFrame(labelled, "text string, span string"))


def test_validation_worked_by_hand(spark):
    got = {r.cand_id: r.reason for r in validated(spark, [r[:3] for r in REVIEWED]).collect()}
    assert [got[i] for i in range(len(REVIEWED))] == [r[3] for r in REVIEWED]


def test_validation_properties(spark):
    """What holds of any batch: kept pairs are new, apart from each other and the first that could be kept."""
    rng = random.Random(2)
    some = [(rng.choice(["battery bad", "Battery bad", "sound was poor", "it is dead"]), rng.choice(["battery", "Battery", "poor", "oo", "dead"]),
             rng.choice(["negative", "neutral", "oops"])) for _ in range(250)]
    out = validated(spark, some)
    rows = out.collect()
    pair = lambda r: (r.text.lower(), r.span.lower())
    kept = [r for r in rows if r.reason is None]
    assert len(rows) == 250 and len({pair(r) for r in kept}) == len(kept) >= 2
    assert not {pair(r) for r in kept} & {("it is dead", "dead"), ("cheap stuff", "cheap")}
    assert all(r.span in r.text and r.polarity in k.POLARITIES for r in kept)
    first = {pair(r): r.cand_id for r in kept}
    repeated = [r for r in rows if r.reason == "duplicate"]
    assert repeated and all(first[pair(r)] < r.cand_id for r in repeated)
    base = curate.normal_labels(spark.createDataFrame([("t", "s", "Negative")], "text string, span string, polarity string"))
    report = {r.polarity: (r.before, r.after, r.added) for r in curate.merge_report(curate.merge_labels(base, out)).collect()}
    assert report["negative"][0] == 1 and sum(v[2] for v in report.values()) == len(kept)


def labels(spark, n=500):
    rng = random.Random(9)
    data = [
        (i, f"text {i % 350}", "span", rng.choice(["positive"] * 6 + ["negative", "neutral"]), None,
         rng.choice(["sound", "value", "battery"]), 0) for i in range(n)
    ]
    return spark.createDataFrame(data, "label_id int, text string, span string, polarity string, polarity_predicted string, aspect string, ordinal int")


def test_held_out_size_and_determinism(spark, rows):
    df = labels(spark)
    split = curate.with_held_out(df, "label_id")
    assert split.where("held_out").count() == 500 - int(500 * 0.8)
    again = curate.with_held_out(df.repartition(5), "label_id")
    assert rows(split.select("label_id", "held_out")) == rows(again.select("label_id", "held_out"))
    assert curate.with_held_out(df.limit(1), "label_id").where("held_out").count() == 0
    for n in (0, 7, 499, 1000):
        capped = curate.train_cap(df, "label_id", n)
        assert rows(capped) == rows(curate.seeded_sample(df, "label_id", n))
    share = curate.with_held_out_by_threshold(df, "label_id").where("held_out").count()
    assert 60 < share < 140


@pytest.mark.parametrize("need", [0, 1, 7, 33, 61, 62, 500])
def test_stratified_sample_is_exact(spark, need):
    pool = labels(spark).where("polarity = 'negative'").select("label_id", "aspect")
    pool = pool.withColumn("aspect", F.when(F.col("label_id") % 10 != 0, F.col("aspect")))
    available = pool.count()
    table = spark.createDataFrame([(need, available)], "need bigint, available bigint")
    got = curate.stratified_sample(pool, "aspect", "label_id", table)
    assert got.count() == min(need, available) == got.select("label_id").distinct().count()


def test_build_split_contract(spark):
    base = labels(spark)
    mined = labels(spark, 300).withColumn("label_id", -F.col("label_id") - 1).withColumn("text", F.concat("text", F.lit("m")))
    mined = mined.withColumn("polarity", F.when(F.col("label_id") % 3 != 0, "negative").otherwise("neutral"))
    merged = base.withColumn("source", F.lit("base")).unionByName(mined.withColumn("source", F.lit("mined")))
    train, test = curate.build_split(base, merged, "label_id", ratio=2.5)
    assert test.count() == 100
    assert curate.leak_count(train, test).first()[0] == 0
    assert curate.leak_rows(train, test).count() == 0
    gold = curate.with_held_out(base, "label_id").where("not held_out")
    need = curate.negative_quota(gold, mined, 2.5).first()
    assert need.target == round(need.train_pos / 2.5) and need.need == max(0, need.target - need.gold_neg)
    assert train.where("label_id < 0 and polarity = 'negative'").count() == min(need.need, need.available)
    assert train.where("label_id < 0 and polarity <> 'negative'").count() == mined.where("polarity <> 'negative'").count()
    report = {(r.side, r.polarity): r.rows for r in curate.split_report(train, test).collect()}
    assert sum(n for (side, _), n in report.items() if side == "test") == 100


def test_leaks_count_pairs_and_match_missing(spark):
    a = spark.createDataFrame([(1, "t", "s", 0), (2, "t", "s", 0), (3, "u", None, 0)], "id int, text string, span string, ordinal int")
    b = spark.createDataFrame([("t", "s", 0), ("t", "s", 0), ("u", None, 0)], "text string, span string, ordinal int")
    assert tuple(curate.leak_count(a, b).first()) == (5, 2)
    assert curate.drop_leaks(a, b).count() == 0 and curate.leak_rows(a, b).count() == 3


def test_training_labels(spark):
    df = spark.createDataFrame(
        [("t", "s", " Positive ", None), (None, "s", "x", 1.0)], "text string, span string, polarity string, ordinal double"
    )
    assert tuple(curate.training_labels(df).select("polarity", "ordinal").first()) == ("positive", 0)
    with pytest.raises(Exception, match="missing required columns"):
        curate.training_labels(df.drop("ordinal"))


# Golden confusion counts, rows gold and columns predicted, and what they must give.
GOLDEN = [
    ([[3, 0, 2], [0, 2, 2], [0, 0, 38]], 0.915, 0.789, 0.905),
    ([[24, 0, 7], [2, 25, 16], [0, 3, 156]], 0.880, 0.823, 0.872),
    ([[0, 0, 5], [0, 0, 4], [0, 0, 38]], 0.809, 0.298, 0.723),
    ([[0, 0, 31], [0, 0, 43], [0, 0, 159]], 0.682, 0.270, 0.554),
]


def cells(spark, matrix):
    data = [(ORDER[i], ORDER[j], n) for i, r in enumerate(matrix) for j, n in enumerate(r) if n]
    return spark.createDataFrame(data, "g string, p string, n bigint")


@pytest.mark.parametrize("matrix,accuracy,macro,weighted", GOLDEN)
def test_golden_scores(spark, matrix, accuracy, macro, weighted):
    cell = cells(spark, matrix)
    got = evaluate.summary_scores(cell).first()
    assert [round(x, 3) for x in (got.accuracy, got.macro_f1, got.weighted_f1)] == [accuracy, macro, weighted]
    table = {r.gold: [r.negative, r.neutral, r.positive] for r in evaluate.confusion(cell).collect()}
    assert [table[x] for x in ORDER] == matrix
    report = {r.label: r for r in evaluate.class_report(cell).collect()}
    assert round(report["macro avg"].f1, 3) == macro and report["weighted avg"].support == sum(map(sum, matrix))


def test_negative_probe_and_gates(spark):
    cell = cells(spark, [[147, 26, 38], [0, 0, 0], [0, 0, 0]])
    got = evaluate.class_recall(cell).first()
    assert (got.hits, got.total, round(got.recall, 3)) == (147, 211, 0.697)
    gate = evaluate.gates(cell).first()
    assert tuple(gate) == (211, 0.697, "FAIL", 0.697, "PASS")
    assert evaluate.class_recall(cell, "positive").first().recall == 0.0


def test_normalising_errors_and_systems(spark, rows):
    df = spark.createDataFrame(
        [(" Positive", "negative", "positive"), ("nan", "x", "x"), ("negative", None, "negative"), ("neutral", "None", "positive")],
        "g string, a string, b string",
    ).withColumns({"aspect": F.lit("sound"), "span": F.lit("s"), "text": F.lit("t"), "held_out": F.lit(True)})
    assert tuple(evaluate.skipped_count(df, "g", "a").first()) == (4, 1, 3)
    assert rows(evaluate.flagged_errors(df, "g", "b").select("error_pair")) == [("neutral -> positive",)]
    assert "error_pair" not in evaluate.flagged_errors(df, "g", "b", pair=False).columns
    cell = evaluate.cells(evaluate.system_rows(df, "g", {"A": "a", "B": "b"}), "gold", "pred", ["system"])
    assert rows(evaluate.error_pairs(cell, ["A", "B"])) == [("neutral -> positive", 0, 1), ("positive -> negative", 1, 0)]
    assert rows(evaluate.error_totals(cell)) == [("A", 1, 1), ("B", 1, 3)]
    assert evaluate.scored_rows(df, "g", "a", "b").count() == 1
    scores = evaluate.system_comparison(df, "g", {"A": "a", "B": "b"})
    assert {(r.system, r.subset, r.n) for r in scores.collect()} == {("A", "full", 1), ("A", "held_out", 1), ("B", "full", 3), ("B", "held_out", 3)}
    assert {r.m for r in evaluate.majority_baseline(df.where("g <> 'nan'"), "g", "m").collect()} == {" Positive"}


def test_candidates_meet_labels_by_a_short_key(spark, monkeypatch):
    """No text is written or shuffled as a key; missing and empty values, and other cuts of the same letters, stay apart."""
    tables = []
    for module in (curate, skew):
        monkeypatch.setattr(module, "written", lambda df, name, w=io.written: tables.append(df) or w(df, name))
    base = spark.createDataFrame([("abc", "c"), (None, "x"), ("", "y"), ("z", None), (" Twice ", "twice")], "text string, span string")
    rows = [("abc", "c"), ("ab", "c"), ("a bc", "bc"), ("", "x"), (None, "x"), (None, "y"), ("", "y"), ("z", ""), ("z", None), ("twice", "twice"),
            ("new one", "one"), ("NEW one ", "one"), ("new one", "new")]
    cands = spark.createDataFrame([(i, t, s, "negative", 0) for i, (t, s) in enumerate(rows)],
                                  "cand_id int, text string, span string, polarity string, ordinal int")
    got = curate.validate_candidates(cands, base)
    pairs = [tuple(v.strip().lower() if v is not None else None for v in p) for p in rows]
    labelled = {("abc", "c"), (None, "x"), ("", "y"), ("z", None), ("twice", "twice")}
    kept = set()
    for r, (text, span) in zip(got.orderBy("cand_id").collect(), rows):
        pair = pairs[r["cand_id"]]
        if text is None or span is None or span not in text:
            want = "span not in text"
        elif pair in labelled:
            want = "already labelled"
        elif span == "" or pair in kept:
            want = r["reason"] if span == "" else "duplicate"
        else:
            want = kept.add(pair)
        assert r["reason"] == want, r
    assert got.columns == cands.columns + ["reason"]
    assert len(tables) == 2 and not any(kind == "string" for t in tables for _, kind in t.dtypes)
