"""Distinct products that add up: each product has a number, and a scope's products are the set bits of bitmaps.

A bitmap covers the numbers of one bucket. Bitmaps of finer scopes are or-ed into those of wider ones, so every roll-up
comes from a stored mart of bitmaps and counts, without the products. Products are numbered category by category,
so a narrow scope has few buckets.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BANDS, CATEGORY_LEVELS
from ..sources.io import written
from . import marts
from .cube import COUNTS, _known_paths, _scope_sets
from .skew import hash_ranks, lookup

GRAIN = (*CATEGORY_LEVELS, "discount_group")


@dataclass
class Marts:
    """`counts` per category path, tier and aspect; `products` per path and tier as bitmaps by bucket."""

    counts: DataFrame
    products: DataFrame


def product_numbers(cube: DataFrame, levels=CATEGORY_LEVELS) -> DataFrame:
    """(product_id, number): whole numbers from 1 without gaps; a product has one, whatever its rows."""
    path = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in levels]))
    place = F.min(F.concat(F.substring(path, 1, 3), F.md5(F.col("product_id").cast("string")))).alias("_place")
    places = written(cube.where("product_id IS NOT NULL").groupBy("product_id").agg(place), "places")
    ranks = hash_ranks(places, [], "_place", ["product_id"], "number", digits=6)
    return ranks.select("product_id", (F.col("number") + 1).alias("number"))


def build(cube: DataFrame, numbers: DataFrame, levels=CATEGORY_LEVELS) -> Marts:
    """The marts of a cube, to be written beside it."""
    grain = [*levels, "discount_group"]
    counts = cube.groupBy(*grain, "aspect").agg(*[F.sum(c).cast("bigint").alias(c) for c in COUNTS])
    found = cube.select(*grain, "product_id").distinct().join(numbers, "product_id")
    bucket, bit = F.bitmap_bucket_number("number"), F.bitmap_bit_position("number")
    products = found.groupBy(*grain, bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    return Marts(counts, products)


def distinct(products: DataFrame, by) -> DataFrame:
    """(by, products): the set bits of all bitmaps of a group, or-ed bucket by bucket."""
    whole = products.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return whole.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).cast("bigint").alias("products"))


def scope_products(found: Marts, levels=CATEGORY_LEVELS, all_drops_null: bool = True) -> DataFrame:
    """Distinct products and mentions of every category scope, as `cube.scope_products` counts them."""
    def known(df: DataFrame) -> DataFrame:
        return df.na.drop(subset=list(levels)) if all_drops_null else df

    def rolled(df: DataFrame, extra: list[str], out: Column) -> DataFrame:
        sets = [[F.col(c) for c in s] for s in _scope_sets(levels, extra)]
        level = F.lit(len(levels)) - F.bit_count(F.grouping_id(*levels, *extra))
        return _known_paths(df.groupingSets(sets, *levels, *extra).agg(level.cast("int").alias("scope_level"), out), levels)

    keys = [*levels, "scope_level"]
    bits = rolled(known(found.products), ["bucket"], F.bitmap_or_agg("bits").alias("bits"))
    products = bits.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).cast("bigint").alias("products"))
    mentions = rolled(known(found.counts), [], F.sum("total").cast("bigint").alias("mentions"))
    out = lookup(mentions, written(products, "products"), keys)
    return out.withColumn("products", F.coalesce("products", F.lit(0)).cast("bigint"))


def band_summary(found: Marts, bands=BANDS, by=()) -> DataFrame:
    """The band summary of `marts.band_summary` from the stored marts."""
    keys = [*by, "band"]
    products = distinct(found.products.withColumn("band", marts.band(bands)).where("band IS NOT NULL"), keys)
    return marts.band_summary(found.counts, bands, by, products)
