"""Aspect spans with a polarity, per sentence."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ASPECT_KEYWORDS, LEXICON_ALPHA, SPAN_LIST, WORD_CHARS
from ..functions import matching
from . import automaton


def attach_predictions(
    sentences: DataFrame, predictions: str = "predictions", taxonomy=ASPECT_KEYWORDS
) -> DataFrame:
    """Span rows from a list of (span, polarity) on each sentence; untracked spans are dropped."""
    return (
        sentences.select("*", F.inline_outer(predictions))
        .drop(predictions)
        .withColumn("_lowered", F.lower("span"))
        .withColumn("aspect", matching.first_aspect_lowered("_lowered", taxonomy))
        .where("aspect is not null")
        .drop("_lowered")
    )


def attach_prediction_table(
    sentences: DataFrame, predictions: DataFrame, keys=("product_id", "sentence_idx"),
    taxonomy=ASPECT_KEYWORDS,
) -> DataFrame:
    """The same, from one row per predicted span that names its sentence by `keys`."""
    tracked = predictions.withColumn("aspect", matching.first_aspect("span", taxonomy)).where(
        "aspect is not null"
    )
    return sentences.join(tracked, list(keys))


def keyword_aspects(sentences: DataFrame, taxonomy=ASPECT_KEYWORDS) -> DataFrame:
    """One row per sentence and aspect found in it; sentiment is left open."""
    return sentences.select(
        "*",
        F.explode_outer(matching.all_aspects("sentence", taxonomy)).alias("aspect"),
        F.lit(None).cast("string").alias("aspect_sentiment"),
    ).where("aspect is not null")


def keyword_predictions(sentences: DataFrame, lexicon: dict, taxonomy=ASPECT_KEYWORDS) -> DataFrame:
    """The native predictor: whole-word keywords as spans, lexicon polarity of the sentence."""
    polarity = matching.lexicon_polarity(matching.lexicon_score("sentence", lexicon))
    # A column of its own and named twice, so Spark does not move it into the lambda functions, which it interprets.
    found = F.col("_found")
    named = lambda p: F.transform(found, lambda w: F.struct(w.alias("span"), p.alias("polarity")))
    pairs = F.when(F.size(found) > 0, matching.let(polarity, named)).otherwise(F.array().cast(SPAN_LIST))
    rows = sentences.withColumn("_found", matching.first_words("sentence", taxonomy))
    return rows.withColumn("predictions", pairs).drop("_found")


def taxonomy_table_aspects(
    sentences: DataFrame, taxonomy: DataFrame, sentence: str = "sentence", id_cols=("sentence_id",),
    chars: int = automaton.KEYWORD_CHARS,
) -> DataFrame:
    """Aspects by substring from a table of (aspect, keyword, priority), of any size.

    One row per id and aspect with its best priority; the least is the first match. Each sentence is read once
    by an automaton of all keywords, or once for every `chars` characters of keywords.
    """
    words = taxonomy.where(F.length("keyword") > 0).groupBy("aspect", "keyword").agg(F.min("priority").alias("priority"))
    columns = dict(words.select("aspect", "priority").dtypes)
    found = [automaton.matches(sentences, sentence, id_cols, share, "keyword", columns) for share in automaton.passes(words, "keyword", chars)]
    if not found:
        return sentences.select(*id_cols).limit(0).join(words.select("aspect", "priority").limit(0))
    return reduce(DataFrame.unionByName, found).groupBy(*id_cols, "aspect").agg(F.min("priority").alias("priority"))


def lexicon_table_scores(
    df: DataFrame, lexicon: DataFrame, text: str = "text", id_col: str = "doc_id",
    alpha: float = LEXICON_ALPHA,
) -> DataFrame:
    """(id, compound, polarity) from a lexicon table of (token, valence).

    Tokens meet the lexicon first, where adaptive execution broadcasts a small one and splits frequent
    tokens, so only hits are summed and shuffled.
    """
    words = F.split(F.lower(F.col(text)), f"[^{WORD_CHARS}]+")
    tokens = df.select(id_col, F.explode_outer(words).alias("token"))
    sums = tokens.join(lexicon, "token").groupBy(id_col).agg(F.sum("valence").alias("_total"))
    total = F.coalesce("_total", F.lit(0.0))
    compound = total / F.sqrt(total * total + F.lit(float(alpha)))
    scored = df.select(id_col).join(sums, id_col, "left").select(id_col, compound.alias("compound"))
    return scored.withColumn("polarity", matching.lexicon_polarity("compound"))
