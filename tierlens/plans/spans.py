"""Queries on aspect spans and the cube."""

from pyspark.sql import functions as F

from ..constants import ASPECT_KEYWORDS, CARRY_COLS, CUBE_KEYS
from ..functions import matching
from ..operators import cube, reviews, spans
from ..sources import io
from ..streaming import maintained
from . import bridge as b
from .registry import query


def _default_first(x):
    return b.sql_first_aspect(x, ASPECT_KEYWORDS)


@query(f"SELECT p_partkey, p_name AS span, {b.sql_first_aspect('p_name', b.NOUNS)} AS aspect FROM part")
def aspect_first_match(spark, sf_dir):
    return b.table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("span"), matching.first_aspect("p_name", b.NOUNS).alias("aspect")
    )


@query(b.ctes(b.SENTENCES) + f"""
SELECT row_ord, pos, aspect FROM (SELECT row_ord, pos, {_default_first('sentence')} AS aspect FROM sentences)
WHERE aspect IS NOT NULL""")
def aspect_first_match_default(spark, sf_dir):
    rows = b.sentences(spark, sf_dir).select("row_ord", "pos", matching.first_aspect("sentence").alias("aspect"))
    return rows.where("aspect is not null")


_MULTI = " UNION ALL ".join(
    f"SELECT row_ord, pos, '{a}' AS aspect, NULL::VARCHAR AS aspect_sentiment FROM sentences WHERE "
    + " OR ".join(f"contains(sentence, '{k}')" for k in kws)
    for a, kws in ASPECT_KEYWORDS.items()
)


@query(b.ctes(b.SENTENCES) + _MULTI)
def aspect_multi_label(spark, sf_dir):
    rows = spans.keyword_aspects(b.sentences(spark, sf_dir))
    return rows.select("row_ord", "pos", "aspect", "aspect_sentiment")


_TABLE_KEYWORDS = [(a, k, i) for i, (a, kws) in enumerate(b.WORDS.items()) for k in kws]
_TABLE_MATCH = " UNION ALL ".join(
    f"SELECT row_ord, pos, '{a}' AS aspect, {i} AS priority FROM sentences WHERE "
    + " OR ".join(f"contains(sentence, '{k}')" for k in kws)
    for i, (a, kws) in enumerate(b.WORDS.items())
)


@query(b.ctes(b.SENTENCES) + _TABLE_MATCH)
def aspect_taxonomy_table(spark, sf_dir):
    taxonomy = spark.createDataFrame(_TABLE_KEYWORDS, "aspect string, keyword string, priority int")
    return spans.taxonomy_table_aspects(b.sentences(spark, sf_dir), taxonomy, id_cols=("row_ord", "pos"))


@query(b.ctes(b.SENTENCES, b.WORD_SPANS) + f"""
SELECT row_ord, pos, priority, aspect, span, start, {b.ORDINAL} AS ordinal FROM word_spans""")
def aspect_word_span(spark, sf_dir):
    return b.word_rows(spark, sf_dir).select(
        "row_ord", "pos", "priority", "aspect", "span", "start",
        matching.count_before("sentence", "span", "start").alias("ordinal"),
    )


_PREDICTED = f"""predicted AS (
  SELECT row_ord, pos, span, {b.sql_polarity('compound')} AS polarity
  FROM (SELECT *, {b.sql_compound('sentence')} AS compound FROM word_spans))"""
_ATTACHED = f"""
SELECT row_ord, pos, span, polarity, aspect
FROM (SELECT *, {b.sql_first_aspect('span', b.WORDS)} AS aspect FROM predicted) WHERE aspect IS NOT NULL"""


@query(b.ctes(b.SENTENCES, b.WORD_SPANS, _PREDICTED) + _ATTACHED)
def attach_predictions(spark, sf_dir):
    rows = spans.keyword_predictions(b.sentences(spark, sf_dir), b.VALENCE, b.WORDS)
    return spans.attach_predictions(rows, taxonomy=b.WORDS).select("row_ord", "pos", "span", "polarity", "aspect")


@query(b.ctes(b.SENTENCES, b.WORD_SPANS, _PREDICTED) + _ATTACHED)
def attach_prediction_table(spark, sf_dir):
    rows = b.sentences(spark, sf_dir)
    predicted = spans.keyword_predictions(rows, b.VALENCE, b.WORDS).select(
        "row_ord", "pos", F.inline_outer("predictions")
    ).where("span is not null")
    out = spans.attach_prediction_table(rows, predicted, ("row_ord", "pos"), b.WORDS)
    return out.select("row_ord", "pos", "span", "polarity", "aspect")


@query(b.ctes(b.SPANS) + b.sql_counts("spans WHERE discount_group IS NOT NULL", "aspect, discount_group"))
def aspect_sentiment_by_tier(spark, sf_dir):
    return cube.aspect_sentiment_by(b.span_facts(spark, sf_dir), weight="n")


@query(b.ctes(b.SPANS, b.CUBE) + "SELECT * FROM cube")
def results_cube(spark, sf_dir):
    return b.span_cube(spark, sf_dir)


@query(b.ctes(b.SPANS) + b.sql_counts("spans", b.KEYS))
def results_cube_null_keys(spark, sf_dir):
    return b.span_cube(spark, sf_dir, keep_null_keys=True)


@query(b.ctes(b.SPANS) + """
SELECT aspect, count(*) AS count FROM spans WHERE polarity = 'negative'
GROUP BY aspect ORDER BY count DESC, aspect LIMIT 5""")
def top_complaints(spark, sf_dir):
    return cube.top_complaints(b.span_facts(spark, sf_dir), weight="n")


@query(b.ctes(b.SPANS, b.CUBE) + """
SELECT aspect, main_category, sub_category_1, sub_category_2,
  (3 - bit_count(GROUPING(main_category, sub_category_1, sub_category_2)::INTEGER))::INTEGER AS scope_level,
  sum(positive)::BIGINT AS positive, sum(negative)::BIGINT AS negative, sum(neutral)::BIGINT AS neutral,
  sum(total)::BIGINT AS total
FROM cube GROUP BY aspect, ROLLUP (main_category, sub_category_1, sub_category_2)""")
def scope_rollup_cube(spark, sf_dir):
    return cube.scope_rollup(b.span_cube(spark, sf_dir))


@query(b.ctes(b.SPANS, b.CUBE) + """
SELECT main_category, sub_category_1, sub_category_2,
  (3 - bit_count(GROUPING(main_category, sub_category_1, sub_category_2)::INTEGER))::INTEGER AS scope_level,
  count(DISTINCT product_id) AS products, sum(total)::BIGINT AS mentions
FROM cube GROUP BY ROLLUP (main_category, sub_category_1, sub_category_2)""")
def scope_products(spark, sf_dir):
    return cube.scope_products(b.span_cube(spark, sf_dir))


def review_spans(spark, sf_dir):
    """Reviews to spans with the native predictor; no sentence index, so no shuffle before the cube."""
    sentences = reviews.explode_sentences(b.clean(spark, sf_dir), index=False)
    predicted = spans.keyword_predictions(sentences, b.VALENCE, b.WORDS)
    return spans.attach_predictions(predicted, taxonomy=b.WORDS)


_REVIEW_SENTENCES = f"""sentences AS (
  SELECT * FROM (SELECT *, unnest({b.sql_sentences('clean_review')}) AS sentence FROM clean))"""
_REVIEW_SPANS = f"""review_spans AS (
  SELECT * FROM (SELECT * EXCLUDE (aspect), {b.sql_first_aspect('span', b.WORDS)} AS aspect,
    {b.sql_polarity('compound')} AS polarity
  FROM (SELECT *, {b.sql_compound('sentence')} AS compound FROM word_spans)) WHERE aspect IS NOT NULL)"""
_NOT_NULL = " AND ".join(f"{k} IS NOT NULL" for k in CUBE_KEYS)


@query(b.ctes(b.RAW, b.PARSED, b.CLEAN, _REVIEW_SENTENCES, b.WORD_SPANS, _REVIEW_SPANS)
       + b.sql_counts(f"review_spans WHERE {_NOT_NULL}", b.KEYS))
def review_cube(spark, sf_dir):
    """Raw review strings to the cube, end to end."""
    return cube.results_cube(review_spans(spark, sf_dir))


def _counted_reviews(rows):
    """Reviews to spans that keep the review's number."""
    cleaned = reviews.pick(reviews.clean_reviews(rows, b.MAINS), (*CARRY_COLS, "row_ord", "review_sentences"))
    sentences = cleaned.select("*", F.explode_outer("review_sentences").alias("sentence")).where("sentence is not null")
    return spans.attach_predictions(spans.keyword_predictions(sentences, b.VALENCE, b.WORDS), taxonomy=b.WORDS)


@query(b.ctes(b.RAW, b.PARSED, b.CLEAN, _REVIEW_SENTENCES, b.WORD_SPANS, _REVIEW_SPANS)
       + b.sql_counts(f"review_spans WHERE {_NOT_NULL}", b.KEYS))
def maintained_cube(spark, sf_dir):
    """The cube after four batches of a stream: a third of the reviews with the wrong text or none, all others, the
    first third as it should be, and the second batch once more. It equals the cube of all reviews built at once."""
    source, folder = io.work_folder(spark, "incoming"), io.work_folder(spark, "maintained")
    raw = io.written(b.raw_reviews(spark, sf_dir), "raw")
    early = F.col("row_ord") % 3 == 0
    even = F.col("row_ord") % 2 == 0
    wrong = F.when(even, F.concat("review_content", F.lit(" This rod is not from the ring.")))
    later, out = raw.where(~early), None
    for i, batch in enumerate([raw.where(early).withColumn("review_content", wrong), later, raw.where(early), later]):
        sent = batch.withColumn("sent", F.lit(i))
        sent.write.mode("append").parquet(source)
        out = maintained.maintain(spark, source, sent.schema, _counted_reviews, folder, "row_ord", "sent", files_per_batch=1 << 20)
    return out
