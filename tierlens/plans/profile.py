"""Queries that describe tables."""

from pyspark.sql import functions as F

from ..operators import profile
from . import bridge as b
from .registry import query


@query("SELECT p_type AS value, count(*) AS count FROM part GROUP BY p_type")
def value_counts(spark, sf_dir):
    return profile.value_counts(b.table(spark, sf_dir, "part"), "p_type").withColumnRenamed("p_type", "value")


@query("""
SELECT c AS l_returnflag, (SELECT count(*) FROM lineitem WHERE l_returnflag = c) AS count
FROM (VALUES ('A'), ('N'), ('R'), ('X')) t(c)""")
def value_counts_fixed(spark, sf_dir):
    return profile.value_counts(b.table(spark, sf_dir, "lineitem"), "l_returnflag", classes=("A", "N", "R", "X"))


@query(b.ctes(b.RAW, b.PARSED) + """
SELECT main_category, count(*) AS frequency,
  round_even(count(*) / sum(count(*)) OVER () * 100, 2) AS percent FROM parsed GROUP BY main_category""")
def category_percent(spark, sf_dir):
    raw = b.raw_reviews(spark, sf_dir)
    main = raw.select(F.substring_index("category", "|", 1).alias("main_category"))
    return profile.percent_of_total(main, "main_category")


_PROFILED = ("row_ord", "category", "rating", "rating_count", "review_title", "review_content")


@query(b.ctes(b.RAW) + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{'bigint' if c == 'row_ord' else 'string'}' AS type, "
    f"count(*) FILTER ({c} IS NULL) AS nulls, count(*) AS rows FROM raw" for c in _PROFILED))
def null_profile(spark, sf_dir):
    return profile.null_counts(b.raw_reviews(spark, sf_dir).select(*_PROFILED))


def _describe(table: str, columns, digits: int) -> str:
    at = ", ".join(f"round(quantile_cont({{c}}::DOUBLE, {q}), {digits}) AS {n}" for n, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)))
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c})::DOUBLE AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
        f"min({c})::DOUBLE AS min, {at.format(c=c)}, max({c})::DOUBLE AS max FROM {table}" for c in columns)


def _described(df, columns, digits: int):
    out = profile.describe(df, columns)
    return out.withColumns({c: F.round(c, 6 if c in ("mean", "std") else digits) for c in ("mean", "std", "q25", "q50", "q75")})


_ITEMS, _ORDERS = ("l_quantity", "l_linenumber", "l_partkey"), ("o_orderkey", "o_totalprice", "o_custkey")


@query(_describe("lineitem", _ITEMS, 9))
def describe_columns(spark, sf_dir):
    return _described(b.table(spark, sf_dir, "lineitem"), _ITEMS, 9)


@query(_describe("orders", _ORDERS, 6))
def describe_distinct(spark, sf_dir):
    """Columns whose values are all, or nearly all, distinct."""
    return _described(b.table(spark, sf_dir, "orders"), _ORDERS, 6)


@query(b.ctes(b.SPANS, b.CUBE) + """
SELECT main_category, sum(total)::BIGINT AS total FROM cube
GROUP BY main_category ORDER BY total DESC, main_category LIMIT 1""")
def largest_category(spark, sf_dir):
    return profile.largest_group(b.span_cube(spark, sf_dir), "main_category", "total")


@query("""
WITH d AS (SELECT doc_id, length(text)::INTEGER AS length FROM documents),
m AS (SELECT median(length) AS med FROM d)
(SELECT 'longest' AS pick, doc_id, length FROM d ORDER BY length DESC, doc_id LIMIT 1)
UNION ALL (SELECT 'median', doc_id, length FROM d, m ORDER BY abs(length - med), doc_id LIMIT 1)""")
def review_length_picks(spark, sf_dir):
    return profile.length_picks(b.table(spark, sf_dir, "documents"), "text", "doc_id")
