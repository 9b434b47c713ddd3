"""Distinct products from bitmaps against counting them."""

from pyspark.sql import functions as F

from tierlens.constants import CATEGORY_LEVELS, TIER_LABELS
from tierlens.operators import bitmaps, cube, marts


def a_cube(spark, n):
    """Products in several paths and tiers; some without a lower level, one path with most of them."""
    rows = spark.range(n).select(
        F.concat(F.lit("p"), F.col("id") % (n * 2 // 3)).alias("product_id"),
        F.when(F.col("id") % 3 == 0, "a").otherwise(F.when(F.col("id") % 7 == 0, "b").otherwise("c")).alias("main_category"),
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("s"), F.col("id") % 4)).alias("sub_category_1"),
        F.when(F.col("id") % 5 > 1, F.concat(F.lit("t"), F.col("id") % 3)).alias("sub_category_2"),
        F.element_at(F.array(*[F.lit(t) for t in TIER_LABELS], F.lit(None)), (F.col("id") % 5 + 1).cast("int")).alias("discount_group"),
        F.element_at(F.array(F.lit("sound"), F.lit("value")), (F.col("id") % 2 + 1).cast("int")).alias("aspect"),
        *[(F.col("id") % k).alias(c) for c, k in (("positive", 2), ("negative", 3), ("neutral", 4))],
    )
    return rows.withColumn("total", F.expr("positive + negative + neutral"))


def test_scopes_and_bands(spark, rows):
    for n in (200, 60_000):
        df = a_cube(spark, n)
        numbers = bitmaps.product_numbers(df)
        found = numbers.agg(F.count("*"), F.count_distinct("product_id"), F.count_distinct("number"), F.min("number"), F.max("number")).first()
        products = n * 2 // 3
        assert tuple(found) == (products, products, products, 1, products)
        made = bitmaps.build(df, numbers)
        for drops in (True, False):
            want = cube.scope_products(df, all_drops_null=drops)
            got = bitmaps.scope_products(made, all_drops_null=drops)
            assert rows(got.select(*want.columns)) == rows(want)
        for by in ((), ("main_category",), CATEGORY_LEVELS):
            want = marts.band_summary(df, by=by)
            assert rows(bitmaps.band_summary(made, by=by)) == rows(want)
        assert rows(bitmaps.distinct(made.products, ["discount_group"])) == rows(marts.products_in_scope(df, ["discount_group"]))
    buckets = made.products.select("bucket").distinct().count()
    assert buckets == 2  # 40,000 products


def test_empty_cube(spark):
    df = a_cube(spark, 20).limit(0)
    made = bitmaps.build(df, bitmaps.product_numbers(df))
    assert bitmaps.scope_products(made).count() == bitmaps.band_summary(made).count() == 0
