"""Queries on raw and cleaned reviews."""

from pyspark.sql import functions as F

from ..functions import parsing, text
from ..operators import reviews
from . import bridge as b
from .registry import query


def _typed(spark, sf_dir):
    raw = b.raw_reviews(spark, sf_dir)
    return raw.withColumns(
        {
            "discounted_price": parsing.money("discounted_price"),
            "actual_price": parsing.money("actual_price"),
            "discount_percentage": parsing.percent("discount_percentage"),
            "rating": parsing.rating("rating"),
            "rating_count": parsing.money("rating_count"),
        }
    )


@query(b.ctes(b.RAW, b.PARSED) + """
SELECT row_ord, discounted_price, actual_price, discount_percentage, rating, rating_count FROM parsed""")
def parse_currency_percent_rating(spark, sf_dir):
    return _typed(spark, sf_dir).select(
        "row_ord", "discounted_price", "actual_price", "discount_percentage", "rating", "rating_count"
    )


@query(b.ctes(b.RAW, b.PARSED) + "SELECT row_ord, main_category, sub_category_1, sub_category_2 FROM parsed")
def category_levels(spark, sf_dir):
    levels = {
        c: parsing.category_level("category", i)
        for i, c in enumerate(("main_category", "sub_category_1", "sub_category_2"))
    }
    return b.raw_reviews(spark, sf_dir).withColumns(levels).select("row_ord", *levels)


@query(b.ctes(b.RAW, b.PARSED) + f"""
SELECT row_ord, discount_percentage, actual_price - discounted_price AS discount_amount, discount_group,
  list_position(['0-15%', '15-30%', '30-50%', '50%+'], discount_group)::INTEGER AS tier_rank
FROM (SELECT *, {b.sql_tier('discount_percentage')} AS discount_group FROM parsed)""")
def discount_amount_tier(spark, sf_dir):
    return _typed(spark, sf_dir).select(
        "row_ord", "discount_percentage",
        (F.col("actual_price") - F.col("discounted_price")).alias("discount_amount"),
        parsing.discount_tier("discount_percentage").alias("discount_group"),
    ).withColumn("tier_rank", parsing.tier_rank("discount_group"))


@query(f"SELECT doc_id, {b.sql_clean('text')} AS clean_text FROM documents")
def clean_text(spark, sf_dir):
    return b.texts(spark, sf_dir).select("doc_id", text.clean_text("text").alias("clean_text"))


@query(f"SELECT page_id, {b.sql_clean(chr(39) + chr(39) + ' || url || ' + chr(39) + ' ' + chr(39) + ' || html')} AS clean_text FROM pages")
def html_clean(spark, sf_dir):
    joined = F.concat_ws(" ", "url", "html")
    return b.texts(spark, sf_dir, "pages", "page_id").select("page_id", text.clean_text(joined).alias("clean_text"))


@query(f"""
SELECT doc_id, len(s)::INTEGER AS sentences, array_to_string(s, chr(10)) AS joined
FROM (SELECT doc_id, {b.sql_sentences(b.sql_clean('text'))} AS s FROM documents)""")
def split_sentences(spark, sf_dir):
    parts = text.split_sentences(text.clean_text("text"))
    return b.texts(spark, sf_dir).select("doc_id", parts.alias("_s")).select(
        "doc_id", F.size("_s").alias("sentences"), F.array_join("_s", "\n").alias("joined")
    )


@query(b.ctes(b.RAW, b.PARSED, b.CLEAN) + f"""
SELECT product_id, product_name, main_category, sub_category_1, sub_category_2, discount_percentage,
  discount_group, rating, row_ord, s[i] AS sentence,
  row_number() OVER (PARTITION BY product_id ORDER BY row_ord, i) - 1 AS sentence_idx
FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i
  FROM (SELECT *, {b.sql_sentences('clean_review')} AS s FROM clean))""")
def explode_sentences_idx(spark, sf_dir):
    return reviews.explode_sentences(b.clean(spark, sf_dir))


@query(b.ctes(b.RAW, b.PARSED, b.sql_clean_reviews(b.FEWER_MAINS)) + """
SELECT row_ord, product_id, category, main_category, rating, rating_count, discount_amount, discount_group,
  clean_review FROM clean""")
def drop_null_allowlist(spark, sf_dir):
    return b.clean(spark, sf_dir, b.FEWER_MAINS).select(
        "row_ord", "product_id", "category", "main_category", "rating", "rating_count", "discount_amount",
        "discount_group", "clean_review",
    )


@query(b.ctes(b.RAW, b.PARSED, b.CLEAN) + """
SELECT product_id, product_name, category, main_category, sub_category_1, sub_category_2, actual_price,
  discounted_price, discount_percentage, discount_amount, discount_group, rating, rating_count, review_title,
  review_content
FROM clean QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY row_ord) = 1""")
def products_dim(spark, sf_dir):
    return reviews.product_dimension(b.clean(spark, sf_dir))
