"""Queries on the cube and the product page."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BANDS
from ..functions import text
from ..operators import bitmaps, marts, search
from ..sources.io import work_folder, written
from . import bridge as b
from .registry import query

CUBE = b.ctes(b.SPANS, b.CUBE)
_SUMS = (
    "sum(positive)::BIGINT AS positive, sum(negative)::BIGINT AS negative, "
    "sum(neutral)::BIGINT AS neutral, sum(total)::BIGINT AS total"
)
_LOW, _HIGH = (", ".join(f"'{t}'" for t in BANDS[k]) for k in ("Low", "High"))


def _half_even(x: str) -> str:
    return f"format('{{:.0f}}%', {x} * 100)"


@query(CUBE + """
SELECT DISTINCT 1 AS level, '' AS parent, main_category AS choice FROM cube
UNION ALL SELECT DISTINCT 2, main_category, sub_category_1 FROM cube
UNION ALL SELECT DISTINCT 3, main_category || '|' || sub_category_1, sub_category_2 FROM cube""")
def cascade_options(spark, sf_dir):
    return marts.all_cascade_options(b.span_cube(spark, sf_dir))


@query(CUBE + """
SELECT DISTINCT sub_category_1 FROM cube WHERE main_category = 'PROMO' AND sub_category_1 IS NOT NULL""")
def cascade_options_below(spark, sf_dir):
    return marts.cascade_options(b.span_cube(spark, sf_dir), "PROMO")


@query(CUBE + """
SELECT product_id, aspect, discount_group, total FROM cube
WHERE main_category = 'PROMO' AND sub_category_1 = 'Brand#4' AND sub_category_2 IS NOT NULL""")
def cascade_filter(spark, sf_dir):
    rows = marts.cascade_filter(b.span_cube(spark, sf_dir), "PROMO", "Brand#4")
    return rows.select("product_id", "aspect", "discount_group", "total")


@query(CUBE + f"""
SELECT 'none' AS picked, {_SUMS} FROM cube
UNION ALL SELECT 'high', {_SUMS} FROM cube WHERE discount_group IN ({_HIGH})""")
def tier_filter_empty(spark, sf_dir):
    cube = b.span_cube(spark, sf_dir)
    sums = [F.sum(c).cast("bigint").alias(c) for c in marts.COUNTS]
    picked = lambda name, tiers: marts.tier_filter(cube, tiers).agg(F.lit(name).alias("picked"), *sums)
    return picked("none", ()).unionByName(picked("high", BANDS["High"]))


@query(CUBE + f"""
SELECT *, positive / greatest(total, 1) AS positive_share, neutral / greatest(total, 1) AS neutral_share,
  negative / greatest(total, 1) AS negative_share FROM (SELECT {_SUMS} FROM cube)""")
def overall_split(spark, sf_dir):
    return marts.overall_split(b.span_cube(spark, sf_dir))


_BY_ASPECT = f"""
SELECT *, positive / greatest(total, 1) AS positive_share, neutral / greatest(total, 1) AS neutral_share,
  negative / greatest(total, 1) AS negative_share FROM (SELECT aspect, {_SUMS} FROM cube GROUP BY aspect)"""


@query(CUBE + _BY_ASPECT)
def by_aspect(spark, sf_dir):
    return marts.by_aspect(b.span_cube(spark, sf_dir))


_BY_TIER = f"""by_tier AS (
  SELECT *, positive / greatest(total, 1) * 100 AS "Positive%", neutral / greatest(total, 1) * 100 AS "Neutral%",
    negative / greatest(total, 1) * 100 AS "Negative%"
  FROM (SELECT discount_group, {_SUMS} FROM cube GROUP BY discount_group))"""


@query(b.ctes(b.SPANS, b.CUBE, _BY_TIER) + """
SELECT discount_group, total, 'Positive' AS "Sentiment", "Positive%" AS "Share" FROM by_tier
UNION ALL SELECT discount_group, total, 'Neutral', "Neutral%" FROM by_tier
UNION ALL SELECT discount_group, total, 'Negative', "Negative%" FROM by_tier""")
def by_tier_long(spark, sf_dir):
    return marts.by_tier_long(b.span_cube(spark, sf_dir))


@query(CUBE + "SELECT count(DISTINCT product_id) AS products FROM cube")
def products_in_scope(spark, sf_dir):
    return marts.products_in_scope(b.span_cube(spark, sf_dir))


_BANDED = f"""banded AS (
  SELECT *, CASE WHEN discount_group IN ({_LOW}) THEN 'Low' WHEN discount_group IN ({_HIGH}) THEN 'High' END AS band
  FROM cube)"""


def _summary(by: str) -> str:
    keys = f"{by}band"
    return f"""summary AS (
  WITH a AS (SELECT {keys}, aspect, sum(negative) / greatest(sum(total), 1) AS neg_share FROM banded GROUP BY {keys}, aspect),
  top AS (SELECT {keys}, aspect, neg_share FROM a
    QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY neg_share DESC, aspect) = 1),
  t AS (SELECT {keys}, sum(total)::BIGINT AS total, count(DISTINCT product_id) AS products,
    sum(positive)::BIGINT AS pos, sum(neutral)::BIGINT AS neu, sum(negative)::BIGINT AS neg
    FROM banded GROUP BY {keys} HAVING sum(total) > 0)
  SELECT t.*, pos / total AS pos_share, neu / total AS neu_share, neg / total AS neg_share,
    top.aspect AS top_neg_aspect, top.neg_share AS top_neg_aspect_share
  FROM t JOIN top USING ({keys}))"""


@query(b.ctes(b.SPANS, b.CUBE, _BANDED, _summary("")) + "SELECT * FROM summary")
def band_summary(spark, sf_dir):
    return marts.band_summary(b.span_cube(spark, sf_dir))


@query(b.ctes(b.SPANS, b.CUBE, _BANDED, _summary("main_category, ")) + "SELECT * FROM summary")
def band_summary_by_category(spark, sf_dir):
    return marts.band_summary(b.span_cube(spark, sf_dir), by=("main_category",))


def _stored_marts(spark, sf_dir) -> bitmaps.Marts:
    """Counts and bitmaps written beside the cube, as a dashboard would read them."""
    cube = written(b.span_cube(spark, sf_dir), "cube")
    made = bitmaps.build(cube, bitmaps.product_numbers(cube))
    return bitmaps.Marts(written(made.counts, "counts"), written(made.products, "products"))


@query(b.ctes(b.SPANS, b.CUBE, _BANDED, _summary("main_category, ")) + "SELECT * FROM summary")
def band_summary_bitmaps(spark, sf_dir):
    return bitmaps.band_summary(_stored_marts(spark, sf_dir), by=("main_category",))


@query(b.ctes(b.SPANS, b.CUBE) + """
SELECT main_category, sub_category_1, sub_category_2,
  (3 - bit_count(GROUPING(main_category, sub_category_1, sub_category_2)::INTEGER))::INTEGER AS scope_level,
  count(DISTINCT product_id) AS products, sum(total)::BIGINT AS mentions
FROM cube GROUP BY ROLLUP (main_category, sub_category_1, sub_category_2)""")
def scope_products_bitmaps(spark, sf_dir):
    return bitmaps.scope_products(_stored_marts(spark, sf_dir))


def _gap(by: str) -> str:
    on = " AND l.main_category = h.main_category" if by else ""
    return f"""
SELECT *, CASE WHEN gap > 1 THEN 'more negative' WHEN gap < -1 THEN 'less negative' ELSE 'about the same' END AS verdict
FROM (SELECT {'l.main_category, ' if by else ''}l.neg_share AS low_share, h.neg_share AS high_share,
    (h.neg_share - l.neg_share) * 100 AS gap
  FROM summary l JOIN summary h ON l.band = 'Low' AND h.band = 'High'{on})"""


@query(b.ctes(b.SPANS, b.CUBE, _BANDED, _summary("")) + _gap(""))
def band_gap_verdict(spark, sf_dir):
    return marts.band_gap(marts.band_summary(b.span_cube(spark, sf_dir)))


@query(b.ctes(b.SPANS, b.CUBE, _BANDED, _summary("main_category, ")) + _gap("main_category"))
def band_gap_by_category(spark, sf_dir):
    by = ("main_category",)
    return marts.band_gap(marts.band_summary(b.span_cube(spark, sf_dir), by=by), by)


@query(CUBE + f"""
SELECT aspect, sum(negative)::BIGINT AS negative, sum(negative) / greatest(sum(total), 1) AS negative_share
FROM cube WHERE discount_group IN ({_HIGH}) GROUP BY aspect ORDER BY negative_share DESC, aspect LIMIT 5""")
def discount_drivers(spark, sf_dir):
    return marts.discount_drivers(b.span_cube(spark, sf_dir))


@query(CUBE + """
SELECT aspect, sum(negative)::BIGINT AS negative, sum(negative) / greatest(sum(total), 1) AS negative_share
FROM cube GROUP BY aspect ORDER BY negative DESC, aspect LIMIT 5""")
def complaint_ranking(spark, sf_dir):
    return marts.complaint_ranking(b.span_cube(spark, sf_dir))


_SHAPE = " UNION ALL ".join(
    f"SELECT {i} AS rank, '{s}' AS \"Sentiment\", sum({s.lower()})::BIGINT AS \"Mentions\", "
    f"sum({s.lower()}) / greatest(sum(total), 1) AS \"Share\" FROM cube"
    for i, s in enumerate(("Positive", "Neutral", "Negative"))
)


@query(CUBE + _SHAPE)
def sentiment_shape(spark, sf_dir):
    return marts.sentiment_shape(b.span_cube(spark, sf_dir))


@query(CUBE + """,
a AS (SELECT main_category, aspect, sum(negative) / greatest(sum(total), 1) AS ns,
  sum(positive) / greatest(sum(total), 1) AS ps FROM cube GROUP BY ALL),
n AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY main_category ORDER BY ns DESC, aspect) = 1),
p AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY main_category ORDER BY ps DESC, aspect) = 1)
SELECT main_category, n.aspect AS top_negative_aspect, n.ns AS top_negative_share,
  p.aspect AS top_positive_aspect, p.ps AS top_positive_share FROM n JOIN p USING (main_category)""")
def top_aspects(spark, sf_dir):
    return marts.top_aspects(b.span_cube(spark, sf_dir), by=("main_category",))


def _catalog(spark, sf_dir):
    return b.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.when(F.col("p_size") % 9 != 0, F.col("p_name")).alias("product_name"),
    )


_CATALOG = """catalog AS (SELECT p_partkey::VARCHAR AS product_id,
  CASE WHEN p_size % 9 <> 0 THEN p_name END AS product_name FROM part)"""


@query(b.ctes(_CATALOG) + "SELECT * FROM catalog WHERE coalesce(regexp_matches(product_name, '(?i)(HOT|old) .*R'), false)")
def product_search(spark, sf_dir):
    return marts.product_search(_catalog(spark, sf_dir), "(HOT|old) .*R")


_PATTERNS = ("(HOT|old) .*R", "widget", "small.*b[io]|wid.et (ro|ri)", "a|bolt", "no such name")


@query(b.ctes(_CATALOG) + "SELECT * FROM catalog WHERE coalesce(regexp_matches(product_name, '(?i)(HOT|old) .*R'), false)")
def product_search_indexed(spark, sf_dir):
    products, folder = _catalog(spark, sf_dir), work_folder(spark, "names")
    search.write_index(products, folder)
    return search.indexed_search(products, spark.read.parquet(folder), _PATTERNS[0])


def _sql_share(pattern: str) -> str:
    wanted = search.required_grams(pattern)
    low = "lower(product_name)"
    has = "true" if wanted is None else " OR ".join("(" + " AND ".join(f"contains({low}, '{g}')" for g in way) + ")" for way in wanted)
    return (f"SELECT '{pattern}' AS pattern, count(*) AS names, count(*) FILTER ({has}) AS candidates, "
            f"count(*) FILTER (regexp_matches(product_name, '(?i){pattern}')) AS matches FROM catalog WHERE product_name IS NOT NULL")


@query(b.ctes(_CATALOG) + " UNION ALL ".join(_sql_share(p) for p in _PATTERNS))
def product_search_share(spark, sf_dir):
    """How many names several patterns are tried on, and how many fit."""
    products, folder = _catalog(spark, sf_dir), work_folder(spark, "names")
    search.write_index(products, folder)
    postings = spark.read.parquet(folder)
    return reduce(DataFrame.unionByName, [search.search_share(products, postings, p) for p in _PATTERNS])


@query(b.ctes(_CATALOG) + """
SELECT substring(product_name, 1, 90) || ' — ' || product_id AS label, product_name, product_id
FROM catalog WHERE product_name IS NOT NULL""")
def product_picker(spark, sf_dir):
    return marts.product_picker(_catalog(spark, sf_dir).where("product_name is not null"))


@query(CUBE + """
SELECT product_id, aspect, sum(total)::BIGINT AS mentions, sum(positive) / greatest(sum(total), 1) AS positive_share,
  sum(negative) / greatest(sum(total), 1) AS negative_share FROM cube GROUP BY product_id, aspect""")
def product_breakdown(spark, sf_dir):
    return marts.product_breakdown(b.span_cube(spark, sf_dir))


_SHORT = b.sql_strip("text")


@query(f"""
SELECT doc_id, CASE WHEN length(s) <= 70 THEN s
  ELSE regexp_replace(substring(s, 1, 70), ' [^ ]*$', '') || '…' END AS heading,
  array_to_string([x for x in string_split('a|' || source || '||z', '|') if x <> ''], ' › ') AS crumbs,
  array_to_string([{b.sql_strip('x')} for x in string_split(text, ',') if length({b.sql_strip('x')}) > 0], chr(10)) AS titles,
  length(s) > 0 AS has_text, {b.sql_strip(f"regexp_replace(text, 'https?://[^{b.WS}]+', '', 'g')")} AS content
FROM (SELECT *, {_SHORT} AS s FROM documents)""")
def product_titles(spark, sf_dir):
    path = F.concat(F.lit("a|"), "source", F.lit("||z"))
    return b.texts(spark, sf_dir).select(
        "doc_id", text.shorten("text").alias("heading"), text.category_crumbs(path).alias("crumbs"),
        F.array_join(text.split_titles("text"), "\n").alias("titles"), text.has_text("text").alias("has_text"),
        text.strip_urls("text").alias("content"),
    )


@query(b.ctes(b.RAW, b.PARSED, b.CLEAN) + f"""
SELECT row_ord::VARCHAR AS product_id,
  CASE WHEN length({b.sql_strip('product_name')}) <= 70 THEN {b.sql_strip('product_name')}
    ELSE regexp_replace(substring({b.sql_strip('product_name')}, 1, 70), ' [^ ]*$', '') || '…' END AS heading,
  NULL::VARCHAR AS full_name,
  array_to_string([x for x in string_split(category, '|') if x <> ''], ' › ') AS crumbs,
  length({b.sql_strip("coalesce(review_title, '')")}) > 0 AS has_titles,
  length({b.sql_strip("coalesce(review_content, '')")}) > 0 AS has_content,
  array_to_string([{b.sql_strip('x')} for x in string_split(review_title, ',') if length({b.sql_strip('x')}) > 0], chr(10)) AS titles,
  {b.sql_strip(f"regexp_replace(review_content, 'https?://[^{b.WS}]+', '', 'g')")} AS content
FROM clean""")
def product_cards(spark, sf_dir):
    rows = b.clean(spark, sf_dir).withColumn("product_id", F.col("row_ord").cast("string"))
    return marts.product_card(rows)


@query(b.ctes(b.RAW, b.PARSED, b.CLEAN) + """
SELECT row_ord::VARCHAR AS product_id, format('{:,.0f}', discounted_price) AS discounted,
  '-' || discount_percentage || '%' AS delta, format('{:,.0f}', actual_price) AS actual,
  format('{:.1f}', rating) || ' ★' AS stars, format('{:,}', rating_count::BIGINT) || ' ratings' AS ratings,
  coalesce(discount_group, 'nan') AS tier FROM clean""")
def product_metrics(spark, sf_dir):
    rows = b.clean(spark, sf_dir).withColumn("product_id", F.col("row_ord").cast("string"))
    return marts.product_metrics(rows)


@query(CUBE + f"""
SELECT format('{{:,}}', total) AS mentions,
  format('{{:,}} of {{:,}}', positive, total) AS positive_of_total, {_half_even('positive / greatest(total, 1)')} AS positive_percent,
  format('{{:,}} of {{:,}}', neutral, total) AS neutral_of_total, {_half_even('neutral / greatest(total, 1)')} AS neutral_percent,
  format('{{:,}} of {{:,}}', negative, total) AS negative_of_total, {_half_even('negative / greatest(total, 1)')} AS negative_percent
FROM (SELECT {_SUMS} FROM cube)""")
def format_metrics(spark, sf_dir):
    return marts.headline_metrics(b.span_cube(spark, sf_dir))


@query(CUBE + f"""
SELECT aspect, format('{{:,}}', total) AS mentions, {_half_even('positive_share')} AS positive,
  {_half_even('neutral_share')} AS neutral, {_half_even('negative_share')} AS negative
FROM ({_BY_ASPECT})""")
def aspect_display(spark, sf_dir):
    return marts.aspect_display(b.span_cube(spark, sf_dir))
