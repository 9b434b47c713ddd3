import pytest
from pyspark.sql import functions as F

from tierlens import constants as k
from tierlens.operators import checks, cube, marts, profile, prompts, reviews, spans

RAW = "row_ord bigint, product_id string, product_name string, category string, discounted_price string, " \
    "actual_price string, discount_percentage string, rating string, rating_count string, review_title string, review_content string"


@pytest.fixture(scope="module")
def clean(spark):
    def row(i, pid, category="Electronics|Audio|Ear", pct="20%", rating="4.1", count="1,000", content="Bad sound. Ok price!"):
        return (i, pid, f"name {pid}", category, "₹800", "₹1,000", pct, rating, count, "t", content)

    data = [
        row(0, "p1"), row(1, "p2", content=None), row(2, "p1", content="  One. Two.  Three "),
        row(3, "p3", category="Home|Kitchen|Pan"), row(4, "p4", rating="|"), row(5, "p5", count=None),
        row(6, "p6", category="Electronics|Audio"), row(7, "p7", pct="101%"), row(8, "p1", content="Last one."),
    ]
    return reviews.clean_reviews(spark.createDataFrame(data, RAW).repartition(3))


def test_clean_reviews(clean, rows):
    got = rows(clean.select("row_ord", "discount_amount", "discount_group", "sub_category_2"))
    assert got == [
        (0, 200.0, "15-30%", "Ear"), (1, 200.0, "15-30%", "Ear"), (2, 200.0, "15-30%", "Ear"),
        (6, 200.0, "15-30%", None), (7, 200.0, None, "Ear"), (8, 200.0, "15-30%", "Ear"),
    ]
    assert clean.where("row_ord = 1").first().review_sentences == []
    assert [r.row_ord for r in reviews.first_rows(clean, 2).collect()] == [0, 1]


def test_sentence_index_runs_over_all_reviews_of_a_product(clean, rows):
    got = rows(reviews.explode_sentences(clean).where("product_id = 'p1'").select("sentence_idx", "sentence"))
    assert got == [(0, "bad sound."), (1, "ok price!"), (2, "one."), (3, "two."), (4, "three"), (5, "last one.")]
    plain = reviews.explode_sentences(clean, index=False)
    assert plain.count() == reviews.explode_sentences(clean).count() and "sentence_idx" not in plain.columns


def test_product_dimension_keeps_the_first_row(clean, rows):
    got = rows(reviews.product_dimension(clean).select("product_id", "review_content"))
    assert got[0] == ("p1", "Bad sound. Ok price!") and [r[0] for r in got] == ["p1", "p2", "p6", "p7"]


@pytest.fixture(scope="module")
def facts(spark):
    base = ("p1", "n1", "M", "S", "T", "0-15%", "sound")
    data = [(*base, p) for p in ("positive", "positive", "negative", "conflict")]
    data += [("p2", "n2", "M", "S", "T", "50%+", "value", "conflict")]
    data += [("p3", "n3", "M", "S", None, "50%+", "value", "negative")]
    data += [("p4", "n4", "M", "S", "U", "30-50%", "battery", p) for p in ("negative", "negative", "neutral")]
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in (*k.CUBE_KEYS, "polarity")))


def test_cube_traps(facts, rows):
    got = {r.product_id: r for r in cube.results_cube(facts).collect()}
    assert set(got) == {"p1", "p2", "p4"}
    assert (got["p1"].positive, got["p1"].total, got["p1"].positive_share) == (2, 3, 2 / 3)
    assert (got["p2"].total, got["p2"].positive_share) == (0, None)
    assert cube.results_cube(facts, keep_null_keys=True).count() == 4
    weighted = facts.groupBy(*facts.columns).agg(F.count("*").alias("n"))
    assert rows(cube.results_cube(weighted, "n")) == rows(cube.results_cube(facts))
    finer = cube.polarity_counts(facts, [*k.CUBE_KEYS])
    assert rows(cube.results_cube_from_counts(finer)) == rows(cube.results_cube(facts))
    assert rows(cube.top_complaints(facts, 1)) == [("battery", 2)]


def test_marts_on_the_cube(facts, rows):
    c = cube.results_cube(facts)
    split = marts.overall_split(c).first()
    shares = split.positive_share + split.negative_share + split.neutral_share
    assert split.total == 6 and shares == pytest.approx(1.0)
    empty = marts.overall_split(c.where("false")).first()
    assert (empty.total, empty.positive_share) == (0, 0.0)
    bands = {r.band: r for r in marts.band_summary(c).collect()}
    assert (bands["High"].total, bands["High"].products, bands["High"].top_neg_aspect) == (3, 2, "battery")
    gap = marts.band_gap(marts.band_summary(c)).first()
    assert gap.verdict == "more negative" and gap.gap == (2 / 3 - 1 / 3) * 100
    assert marts.band_gap(marts.band_summary(c.where("product_id = 'p1'"))).count() == 0
    assert marts.band_summary(c.where("product_id = 'p2'")).count() == 0
    assert marts.tier_filter(c, []).count() == c.count() and marts.tier_filter(c, ["50%+"]).count() == 1
    assert rows(marts.cascade_options(c, "M", "S")) == [("T",), ("U",)]
    nulls = cube.results_cube(facts, keep_null_keys=True)
    assert marts.cascade_filter(nulls, "M").count() == 3
    assert marts.cascade_filter(nulls, "M", all_drops_null=False).count() == 4
    assert [r.discount_group for r in marts.by_tier(c).collect()] == ["0-15%", "30-50%", "50%+"]
    shape = marts.sentiment_shape(c, ("Positive", "Negative", "Neutral")).orderBy("rank").collect()
    assert [(r.Sentiment, r.Mentions) for r in shape] == [("Positive", 2), ("Negative", 3), ("Neutral", 1)]
    assert marts.products_in_scope(c).first()[0] == 3
    assert marts.product_row(c, "p1").count() == 1


def test_scope_rollup_adds_up(facts):
    c = cube.results_cube(facts)
    levels = {}
    for r in cube.scope_rollup(c).collect():
        levels[r.scope_level] = levels.get(r.scope_level, 0) + r.total
    assert levels == {0: 6, 1: 6, 2: 6, 3: 6}
    kept = cube.scope_rollup(cube.results_cube(facts, keep_null_keys=True), all_drops_null=False)
    assert kept.where("scope_level = 2").agg(F.sum("total")).first()[0] == 7
    assert kept.where("scope_level = 3").agg(F.sum("total")).first()[0] == 6


def test_search_and_picker(spark, rows):
    products = spark.createDataFrame(
        [("1", "USB Cable"), ("2", None), ("3", "x" * 95 + "b"), ("3", "x" * 95 + "a")], "product_id string, product_name string"
    )
    assert rows(marts.product_search(products, "usb.*cab").select("product_id")) == [("1",)]
    assert marts.product_search(products, None).count() == 4
    picked = {r.label: r.product_name for r in marts.product_picker(products.na.drop()).collect()}
    assert len(picked) == 2 and picked["x" * 90 + " — 3"].endswith("b")


def test_taxonomy_table(spark, rows):
    texts = [(1, "flagship phone, cheap é price"), (2, "nothing"), (3, ""), (4, "é"), (1, "a slow q, twice")]
    sentences = spark.createDataFrame([*texts, (5, None)], "sentence_id int, sentence string")
    data = [(a, w, i) for i, (a, kws) in enumerate(k.ASPECT_KEYWORDS.items()) for w in kws]
    data += [("accent", "é p", 9), ("letter", "q", 7), ("letter", "gs", 8), ("none", "", 0), ("letter", "q", 9)]
    want = {}
    for i, s in texts:
        for aspect, word, priority in data:
            if word and word in s:
                want[i, aspect] = min(priority, want.get((i, aspect), 99))
    taxonomy = spark.createDataFrame(data, "aspect string, keyword string, priority int")
    for chars in (20, 10_000):
        got = spans.taxonomy_table_aspects(sentences, taxonomy, chars=chars)
        assert rows(got) == sorted((*key, p) for key, p in want.items())
    assert {a for _, a in want} == {"performance", "quality", "value", "accent", "letter"}


def test_attach_predictions(spark, rows):
    df = spark.createDataFrame(
        [(1, [("battery pack", "negative"), ("case", "positive")]), (2, []), (3, None)],
        "id int, predictions array<struct<span:string,polarity:string>>",
    )
    assert rows(spans.attach_predictions(df)) == [(1, "battery pack", "negative", "battery")]


def test_profiles(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "i int, c string")
    assert rows(profile.value_counts(df, "c")) == [("a", 2), ("b", 1)]
    assert rows(profile.value_counts(df, "c", ("a", "z"))) == [("a", 2), ("z", 0)]
    assert rows(profile.percent_of_total(df, "c")) == [("a", 2, 66.67), ("b", 1, 33.33)]
    assert rows(profile.null_counts(df)) == [("c", "string", 1, 4), ("i", "int", 0, 4)]


def test_review_prompts_keep_the_whole_text(spark):
    text_ = "".join(chr(97 + i % 26) for i in range(15_000))
    products = spark.createDataFrame([("p", None, "t", text_), ("q", "n", None, None)], "product_id string, product_name string, review_title string, review_content string")
    got = prompts.review_prompts(products, task="T", size=6000).orderBy("product_id", "part").collect()
    pieces = [r.prompt.removeprefix("Product: \n\n").removesuffix("\n\nT") for r in got if r.product_id == "p"]
    assert "".join(pieces) == f"Review titles: t\n\nReview text: {text_}" and [len(x) for x in pieces][:2] == [6000, 6000]
    assert [(r.product_id, r.part) for r in got] == [("p", 0), ("p", 1), ("p", 2), ("q", 0)]


def test_quartiles_are_exact(spark):
    values = [None, 1.0, 2.0, 2.0, 7.0, 100.0, 3.0]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "a double, b int")
    got = {r["column"]: r for r in profile.describe(df, ["a", "b"]).collect()}
    assert (got["a"]["count"], got["a"].q25, got["a"].q50, got["a"].q75, got["a"].max) == (6, 2.0, 2.5, 6.0, 100.0)
    assert (got["b"].q25, got["b"].q50, got["b"].q75) == (1.5, 3.0, 4.5)


def test_contexts(facts):
    c = cube.results_cube(facts)
    got = prompts.build_context(c.where("product_id = 'p1'"), "All categories | tiers: none").first()[0]
    assert got == (
        "Scope: All categories | tiers: none\nProducts in scope: 1; total aspect mentions: 3\n"
        "Discount tiers PRESENT here: 0-15%.\n"
        "Discount tiers ABSENT here (leave them out of every comparison): 15-30%, 30-50%, 50%+.\n\n"
        "Sentiment by aspect:\n- sound: 3 mentions, 67% positive, 0% neutral, 33% negative\n\n"
        "Sentiment by discount tier:\n- 0-15%: 3 mentions, 67% positive, 0% neutral, 33% negative"
    )
    assert prompts.build_context(c.where("false"), "x").first()[0] == "No data in the current filter."
    zero = prompts.build_context(c.where("product_id = 'p2'"), "x").first()[0]
    assert "- value: 0 mentions, n/a positive, n/a neutral, n/a negative" in zero
    assert prompts.scope_contexts(c).count() == 1 + 1 + 1 + 2


def test_chat_requests(spark, rows):
    turns = spark.createDataFrame(
        [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "user", "d"), (2, 0, "user", "e")],
        "conv_id bigint, turn bigint, role string, text string",
    )
    got = prompts.chat_requests(turns, F.lit("S"))
    first, second = [(1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "user", "d")], [(2, 0, "user", "e")]
    assert rows(got) == [(1, -1, "system", "S"), *first, (2, -1, "system", "S"), *second]  # open questions stay
    packed = prompts.pack_messages(got, size=2).orderBy("conv_id", "part").collect()
    assert [(r.conv_id, r.part, [m.turn for m in r.messages]) for r in packed] == [
        (1, 0, [-1]), (1, 1, [1, 2]), (1, 2, [3]), (2, 0, [-1, 0])]


def test_costs(spark):
    requests = spark.createDataFrame(
        [("summary", "s", 1000, 220, 350, 3.0, 6.0), ("product", "long", 2000, 260, 400, 1.0, 1.0),
         ("product", "long", 100, 260, 400, 1.0, 1.0), ("product", "mid", 400, 260, 400, 1.0, 1.0)],
        "kind string, query_type string, in_tok int, out_typ int, out_cap int, prep_ms_mean double, prep_ms_max double",
    )
    part, *got = prompts.with_cost(requests).orderBy("in_tok").collect()
    assert got[1].cost == pytest.approx(1000 / 1e6 * 0.15 + 220 / 1e6 * 0.60)
    assert got[1].seconds == pytest.approx(0.003 + 0.5 + 220 / 80)
    assert got[1].seconds_worst == pytest.approx(0.006 + 0.5 + 350 / 80)
    monthly = prompts.cost_projection(prompts.with_cost(requests)).collect()
    product = (got[0].cost + got[2].cost + part.cost) / 2  # a long review in two parts costs both
    assert monthly[0].blended == pytest.approx((got[1].cost + product) / 2)
    assert [r.queries_per_month for r in monthly] == [100, 1000, 10000]


def test_checks(spark):
    df = spark.createDataFrame([("x", "positive"), ("y", "good")], "text string, polarity string")
    with pytest.raises(checks.MissingInput):
        checks.require_columns(df, ["span"])
    with pytest.raises(checks.MissingInput):
        checks.require_data(df, None)
    with pytest.raises(checks.InvalidLabels, match="good"):
        checks.require_values(df, "polarity")
    many = spark.range(30).selectExpr("cast(id as string) as polarity")
    with pytest.raises(checks.InvalidLabels, match="and 10 more"):
        checks.require_values(many, "polarity")
    assert checks.or_none(df.where("false")) is None and checks.or_none(df) is df


def test_searches_of_sentences_and_spans_are_compiled(spark):
    rows = spark.createDataFrame([(1, "bad sound, no bass"), (2, "slow but worth it"), (3, None), (4, "none")], "i int, sentence string")
    out = spans.attach_predictions(spans.keyword_predictions(rows, {"bad": -2.0, "worth": 1.5}))
    got = out.select("i", "span", "polarity", "aspect").collect()
    assert sorted(map(tuple, got)) == [
        (1, "sound", "negative", "sound"), (2, "slow", "positive", "performance"), (2, "worth", "positive", "value")]
    assert out.columns == ["i", "sentence", "span", "polarity", "aspect"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    # Inside a lambda function Spark would interpret them, and `split` compiles its pattern for every text.
    assert "RLIKE(" in plan and "RLIKE(lambda" not in plan and "Contains(lambda" not in plan and "split(" not in plan
