"""Raw review rows to clean rows, sentences and the product dimension."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (
    ALLOWED_MAIN_CATEGORIES, CARRY_COLS, CATEGORY_LEVELS, DISCOUNT_TIERS, KEEP_COLS, PRODUCT_COLS,
)
from ..functions import parsing, text
from ..sources.io import written
from .skew import keep_first, running_total


def pick(df: DataFrame, columns) -> DataFrame:
    """Those of the named columns that exist, in the named order."""
    return df.select(*[c for c in columns if c in df.columns])


def clean_reviews(
    raw: DataFrame,
    allowed=ALLOWED_MAIN_CATEGORIES,
    tiers=DISCOUNT_TIERS,
    strict: bool = False,
    order: str = "row_ord",
) -> DataFrame:
    """Typed, filtered, tiered rows with cleaned text and its sentences.

    Rows without a rating count, without a rating, or outside `allowed` main categories
    (None keeps all) are dropped before any text work. An `order` column is carried along.
    """
    rows = raw.withColumns(
        {
            "discounted_price": parsing.money("discounted_price", strict),
            "actual_price": parsing.money("actual_price", strict),
            "discount_percentage": parsing.percent("discount_percentage", strict),
            "rating": parsing.rating("rating", strict),
            "rating_count": parsing.money("rating_count", strict),
            **{c: parsing.category_level("category", i) for i, c in enumerate(CATEGORY_LEVELS)},
        }
    ).na.drop(subset=["rating_count", "rating"])
    if allowed is not None:
        rows = rows.where(F.col("main_category").isin(*allowed))
    return (
        pick(rows, KEEP_COLS + (order,))
        .withColumn("discount_amount", F.col("actual_price") - F.col("discounted_price"))
        .withColumn("discount_group", parsing.discount_tier("discount_percentage", tiers))
        .withColumn("clean_review", text.clean_text("review_content"))
        .withColumn("review_sentences", text.split_sentences("clean_review"))
    )


def first_rows(df: DataFrame, n: int, order: str = "row_ord") -> DataFrame:
    """The first `n` reviews in source order, for a smoke run."""
    return df.orderBy(order).limit(n)


def explode_sentences(
    df: DataFrame, sentences: str = "review_sentences", order: str = "row_ord", index: bool = True
) -> DataFrame:
    """One row per non-blank sentence.

    With `index`, `sentence_idx` counts a product's sentences from 0 over all its reviews in source
    order: the sentences of its earlier reviews, plus the place inside this one. Only the first
    part crosses rows, so it is a running total over reviews, not a sort of sentences.

    Here and elsewhere lists are exploded with their outer form and empty ones dropped after it: for
    the plain form Spark adds a filter on the list's size, which would clean the text a second time.
    """
    kept = F.filter(F.transform(sentences, text.strip), lambda s: F.length(s) > 0)
    rows = pick(df, CARRY_COLS + (order,) * index + (sentences,)).withColumn(sentences, kept)
    if not index:
        out = rows.select("*", F.explode_outer(sentences).alias("sentence"))
        return out.where("sentence is not null").drop(sentences)
    # Written once: the running total reads sizes alone and the text is not cleaned a second time for it.
    rows = written(rows, "sentences")
    rows = running_total(rows, ["product_id"], order, F.size(sentences), "_before")
    return (
        rows.select("*", F.posexplode_outer(sentences).alias("_pos", "sentence"))
        .where("sentence is not null")
        .withColumn("sentence_idx", F.col("_before") + F.col("_pos"))
        .drop("_before", "_pos", sentences)
    )


def product_dimension(df: DataFrame, order: str = "row_ord") -> DataFrame:
    """The first row per product in source order, in the dimension's columns."""
    rows = pick(df, PRODUCT_COLS + (order,))
    return keep_first(rows, ["product_id"], [order]).drop(order)
