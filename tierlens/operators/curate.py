"""Hand-labelled data: mining candidates, validating, merging, sampling, splitting.

Label tables carry a unique id column. Where a rule says "first", it means first by `order`.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    ASPECT_KEYWORDS, COMPLAINT_CUES, LABEL_COLS, MAX_CUE_DISTANCE, MAX_SENTENCE, MIN_SENTENCE,
    POLARITIES, SEED, TEST_SIZE,
)
from ..functions import matching, text
from ..sources.io import written
from . import automaton
from .checks import require_columns, require_values
from .skew import anti, hash_ranks, keep_first, lookup, rank_hash, semi, top_k, with_group_min

PAIR = ("_pair",)


def _normal(c) -> Column:
    return F.lower(text.strip(c))


def _pair() -> Column:
    """A label's text and span as 128 bits, missing ones told from empty ones: rows meet by these, not by their text."""
    words, span = _normal("text"), _normal("span")
    size = F.coalesce(F.octet_length(words).cast("string"), F.lit("-"))
    whole = F.concat(size, F.lit(":"), F.coalesce(words, F.lit("")), F.coalesce(F.concat(F.lit("+"), span), F.lit("-")))
    return F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)


def normal_labels(df: DataFrame, keep=LABEL_COLS) -> DataFrame:
    """Labels with text, span and polarity present, polarity in lower case, ordinal 0 by default."""
    missing = {c: F.lit(None).cast("string") for c in keep if c not in df.columns}
    df = df.withColumns(missing) if missing else df
    rows = df.na.drop(subset=["text", "span", "polarity"]).withColumns(
        {"polarity": _normal("polarity"), "ordinal": F.coalesce("ordinal", F.lit(0)).cast("int")}
    )
    if "polarity_predicted" in rows.columns:
        rows = rows.withColumn("polarity_predicted", _normal("polarity_predicted"))
    return rows


def training_labels(df: DataFrame, allowed=POLARITIES) -> DataFrame:
    """Labels fit for training: required columns there, every polarity allowed, or an error."""
    require_columns(df, ("text", "span", "polarity", "ordinal"))
    return require_values(normal_labels(df, ()), "polarity", allowed)


# Mining


def sentence_cues(sentences: DataFrame, cues=COMPLAINT_CUES) -> DataFrame:
    """Sentences that carry a cue, with the cues and their number."""
    rows = sentences.withColumn("_cues", matching.cue_hits("sentence", cues)).where(F.size("_cues") > 0)
    return rows.withColumn("cue_hits", F.array_join("_cues", "|")).withColumn(
        "n_cues", F.size("_cues")
    ).drop("_cues")


def keyword_cue_distance(sentences: DataFrame, cues=COMPLAINT_CUES, taxonomy=ASPECT_KEYWORDS) -> DataFrame:
    """One row per sentence and aspect keyword: span, ordinal, and distance to the nearest cue."""
    rows = sentences.select("*", F.inline_outer(matching.word_spans("sentence", taxonomy)))
    rows = rows.where("start is not null")
    end = F.col("start") + F.length("span")
    return rows.withColumns(
        {
            "ordinal": matching.count_before("sentence", "span", "start"),
            "cue_dist": matching.nearest_cue("sentence", "start", end, cues),
        }
    )


def table_cue_distance(sentences: DataFrame, cues: DataFrame, taxonomy=ASPECT_KEYWORDS, chars: int = automaton.KEYWORD_CHARS) -> DataFrame:
    """The same, and the number of cue places, for a table of cues (`cue`), of any size.

    All places of all cues in a sentence are found in one pass, whatever the number of cues.
    """
    rows = sentences.withColumn("_cues", F.array().cast("array<struct<start:int,size:int>>"))
    for share in automaton.passes(cues.where(F.length("cue") > 0), "cue", chars):
        rows = automaton.positions(rows, "sentence", share, "cue", "_more")
        rows = rows.withColumn("_cues", F.array_sort(F.concat("_cues", "_more"))).drop("_more")
    rows = rows.select("*", F.inline_outer(matching.word_spans("sentence", taxonomy))).where("start is not null")
    return rows.withColumns({
        "ordinal": matching.count_before("sentence", "span", "start"),
        "cue_dist": automaton.nearest(F.col("_cues"), F.col("start"), F.col("start") + F.length("span")),
        "cue_places": F.size("_cues"),
    }).drop("_cues")


def mine_candidates(
    sentences: DataFrame,
    labelled: DataFrame | None = None,
    order=("row_ord", "pos"),
    cues=COMPLAINT_CUES,
    taxonomy=ASPECT_KEYWORDS,
    length=(MIN_SENTENCE, MAX_SENTENCE),
    max_distance: int = MAX_CUE_DISTANCE,
    cap: int | None = None,
) -> DataFrame:
    """Sentences that mention an aspect close to a complaint cue, as negative label candidates.

    A sentence and span count once, for the first product and aspect that bring them. A caller who wants
    a short list names its `cap`: the closest candidates per aspect, then those with more cues, then source order.
    Everything a row can tell by itself is tested before rows meet the `labelled` table.
    """
    order = list(order)
    rows = sentences.where(F.length("sentence").between(*length))
    rows = keyword_cue_distance(sentence_cues(rows, cues), cues, taxonomy)
    rows = rows.where(F.col("cue_dist") <= max_distance)
    if labelled is not None:
        known = labelled.where("text is not null").select(_normal("text").alias("_text"))
        rows = rows.withColumn("_text", F.lower("sentence"))
        rows = anti(rows, known, ["_text"]).drop("_text")
    rows = keep_first(rows, ["sentence", "span"], order + ["priority"])
    if cap is not None:
        by = ["cue_dist", F.desc("n_cues"), *order, "priority"]
        rows = top_k(rows, ["aspect"], by, cap)
    return rows.select(
        F.col("sentence").alias("text"), "span", F.lit("negative").alias("polarity"), "ordinal",
        "aspect", "cue_hits", "cue_dist", "product_id", "n_cues", *order,
    )


# Validating and merging


def validate_candidates(candidates: DataFrame, base: DataFrame, order: str = "cand_id") -> DataFrame:
    """Each candidate with `reason`, the first rule it breaks, or null when it is kept.

    Rules in order: polarity allowed, span inside the text, pair not labelled yet, pair not kept
    earlier, span aligned to words. Kept rows get the ordinal of their first aligned place.
    """
    rows = candidates.withColumns({"polarity": _normal("polarity"), "_pair": _pair()})
    known = base.select(_pair().alias("_pair")).distinct()
    known = written(known.withColumn("_known", F.lit(True)), "known")
    rows = lookup(rows, known, PAIR)
    rows = rows.withColumn("_place", matching.aligned_ordinal("text", "span")).withColumn(
        "reason",
        F.when(~F.coalesce(F.col("polarity").isin(*POLARITIES), F.lit(False)), "invalid polarity")
        .when(~F.coalesce(F.contains("text", F.col("span")), F.lit(False)), "span not in text")
        .when(F.col("_known"), "already labelled"),
    )
    fit = F.col("reason").isNull() & F.col("_place").isNotNull()
    rows = with_group_min(rows, PAIR, F.when(fit, F.col(order)), "_first")
    rows = rows.withColumn(
        "reason",
        F.coalesce(
            "reason",
            F.when(F.col("_first") < F.col(order), "duplicate"),
            F.when(F.col("_place").isNull(), "span not aligned"),
        ),
    )
    return rows.withColumn(
        "ordinal", F.when(F.col("reason").isNull(), F.col("_place")).otherwise(F.col("ordinal"))
    ).drop("_pair", "_known", "_place", "_first")


def kept(validated: DataFrame, extra=()) -> DataFrame:
    """Rows that passed, in label columns; `extra` names more to keep, such as an id."""
    return validated.where("reason is null").withColumn(
        "polarity_predicted", F.lit(None).cast("string")
    ).select(*extra, *LABEL_COLS)


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where("reason is not null").select("span", "reason")


def merge_labels(base: DataFrame, validated: DataFrame, extra=()) -> DataFrame:
    """Base labels and kept candidates; `source` tells them apart."""
    mined = kept(validated, extra).withColumn("source", F.lit("mined"))
    return base.select(*extra, *LABEL_COLS).withColumn("source", F.lit("base")).unionByName(mined)


def merge_report(merged: DataFrame) -> DataFrame:
    """Per polarity the count before and after merging, and the difference."""
    before = F.count_if(F.col("source") == "base")
    return merged.groupBy(F.lower("polarity").alias("polarity")).agg(
        before.alias("before"), F.count("*").alias("after"), (F.count("*") - before).alias("added")
    )


def added_rows(merged: DataFrame, base: DataFrame, keys) -> DataFrame:
    """Rows of a merged label table that the base table does not have, by key."""
    return anti(merged, base, keys)


def label_sheet(spans: DataFrame) -> DataFrame:
    """Predicted spans as a sheet to correct by hand."""
    return spans.select(
        F.col("sentence").alias("text"), "span", "polarity",
        F.col("polarity").alias("polarity_predicted"), "aspect", F.lit(0).alias("ordinal"),
    )


# Sampling and splitting


def seeded_sample(df: DataFrame, key: str, n: int, seed=SEED) -> DataFrame:
    """`n` rows in the order of a seeded hash of the key."""
    return df.orderBy(rank_hash(seed, key), key).limit(n)


def with_held_out(df: DataFrame, key: str, test_size: float = TEST_SIZE, seed=SEED) -> DataFrame:
    """`held_out` on every row: true for exactly the rows after `max(1, int(n * (1 - test_size)))`
    in seeded hash order. The rank comes from hash blocks, not from one global sort."""
    hashed = df.select(key, rank_hash(seed, key).alias("_hash"))
    ranks = hash_ranks(hashed, [], "_hash", [key], "_rank")
    n = hashed.agg(F.count("*")).scalar()
    cut = F.greatest(F.lit(1), F.floor(n * F.lit(1 - test_size)))
    return lookup(df, ranks.select(key, (F.col("_rank") >= cut).alias("held_out")), [key])


def with_held_out_by_threshold(df: DataFrame, key: str, test_size: float = TEST_SIZE, seed=SEED):
    """A split without any shuffle: about `test_size` of the rows, by hash threshold."""
    part = F.conv(F.substring(rank_hash(seed, key), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("held_out", part >= F.lit(int((1 - test_size) * 2**32)))


def train_cap(train: DataFrame, key: str, max_samples: int, seed=SEED) -> DataFrame:
    """At most `max_samples` training rows, the first in seeded hash order; ranks come from hash blocks."""
    hashed = train.select(key, rank_hash(seed, key).alias("_hash"))
    return semi(train, hash_ranks(hashed, [], "_hash", [key], "_rank").where(F.col("_rank") < max_samples), [key])


def negative_quota(train_gold: DataFrame, mined: DataFrame, ratio: float = 1.0) -> DataFrame:
    """One row: mined negatives needed for `ratio` positives per negative, and those available."""
    counts = lambda df, side: df.agg(
        F.lit(side).alias("side"),
        F.count_if(F.col("polarity") == "positive").alias("pos"),
        F.count_if(F.col("polarity") == "negative").alias("neg"),
    )
    both = counts(train_gold, "gold").unionByName(counts(mined, "mined"))
    gold_neg = F.sum(F.when(F.col("side") == "gold", F.col("neg")))
    mined_neg = F.sum(F.when(F.col("side") == "mined", F.col("neg")))
    out = both.agg(
        F.sum("pos").alias("train_pos"), gold_neg.alias("gold_neg"), mined_neg.alias("available")
    )
    target = F.bround(F.col("train_pos") / F.lit(float(ratio)), 0).cast("bigint")
    need = F.greatest(F.lit(0), F.col("target") - F.col("gold_neg"))
    return out.withColumn("target", target).withColumn("need", need)


def stratified_sample(df: DataFrame, strata: str, key: str, need: DataFrame, seed=SEED) -> DataFrame:
    """Exactly as many rows as `need` says (one row with `need` and `available`, read back at once),
    spread over the strata.

    Each stratum first gives its rounded share in hash order. What is missing comes from the rest
    in hash order, and what is too much goes by hash order. Rows without a stratum are part of
    the rest. With `need >= available` all rows stay.
    All three steps are ranks, so one sort order decides: share first, hash second.
    """
    total, available = need.select("need", "available").first()
    if total >= available:
        return df
    narrow = df.select(strata, key, rank_hash(seed, key).alias("_hash"))
    sizes = narrow.groupBy(strata).agg(F.count("*").alias("_size"))
    share = F.bround(F.lit(total / max(available, 1)) * F.col("_size"), 0).cast("bigint")
    sizes = written(sizes.withColumn("_share", F.when(F.col(strata).isNotNull(), share).otherwise(F.lit(0))), "shares")
    first = sizes.agg(F.sum(F.least("_share", "_size"))).scalar()
    ranks = lookup(hash_ranks(narrow, [strata], "_hash", [key], "_rank"), sizes, [strata], "inner")
    ranks = ranks.select(key, "_hash", (F.col("_rank") >= F.col("_share")).cast("int").alias("_second"))
    places = hash_ranks(ranks, ["_second"], "_hash", [key], "_place")
    place = F.col("_place") + F.when(F.col("_second") == 1, first).otherwise(F.lit(0))
    return semi(df, places.where(place < F.lit(total)), [key])


LEAK_KEY = ("text", "span", "ordinal")


def drop_leaks(train: DataFrame, test: DataFrame, on=LEAK_KEY) -> DataFrame:
    """Training rows whose text, span and ordinal are not in the test set; missing equals missing."""
    return anti(train, test, on)


def leak_rows(train: DataFrame, test: DataFrame, on=LEAK_KEY) -> DataFrame:
    """Training rows that are in the test set."""
    return semi(train, test, on)


def leak_count(train: DataFrame, test: DataFrame, on=LEAK_KEY) -> DataFrame:
    """One row: matching pairs (repeats multiply) and distinct shared keys.

    Missing equals missing, as in `drop_leaks`. Each side is counted per key before they meet, so no pair
    is ever written out.
    """
    a = train.groupBy(*on).agg(F.count("*").alias("_a"))
    b = test.groupBy(*on).agg(F.count("*").alias("_b"))
    pairs = F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0)).cast("bigint")
    return lookup(a, b, list(on), "inner").agg(pairs.alias("pairs"), F.count("*").alias("shared_keys"))


def build_split(
    base: DataFrame, merged: DataFrame, key: str, ratio: float = 1.0,
    test_size: float = TEST_SIZE, seed=SEED,
) -> tuple[DataFrame, DataFrame]:
    """(train, test) without leaks, training negatives capped to `ratio` positives per negative.

    Test is the held-out part of the base labels. Train is the other base rows, all mined rows
    that are not negative, and a stratified quota of the mined negatives. `merged` tells base
    rows from mined ones by `source`. Hash order stands in for a shuffle. Both label tables are
    read several times, so they are written to the work folder first.
    """
    columns = [key, *LABEL_COLS]
    split = written(with_held_out(base, key, test_size, seed).select(*columns, "held_out"), "split")
    merged = written(merged, "merged")
    test = split.where("held_out").select(*columns)
    gold = split.where("not held_out").select(*columns)
    mined = merged.where("source = 'mined'").select(*columns)
    need = negative_quota(gold, mined, ratio)
    negatives = mined.where("polarity = 'negative'")
    picked = stratified_sample(negatives, "aspect", key, need, seed)
    others = mined.where("polarity <> 'negative'")
    train = gold.unionByName(others).unionByName(picked.select(*columns))
    return drop_leaks(train, test), test


def split_report(train: DataFrame, test: DataFrame) -> DataFrame:
    """Rows per side and polarity."""
    both = train.select(F.lit("train").alias("side"), "polarity").unionByName(
        test.select(F.lit("test").alias("side"), "polarity")
    )
    return both.groupBy("side", "polarity").agg(F.count("*").alias("rows"))
