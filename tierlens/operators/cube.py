"""Sentiment counts by product, aspect and discount tier.

`weight` names a count column for inputs that were pre-aggregated; without it each row counts once.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CATEGORY_LEVELS, CUBE_KEYS, POLARITIES

COUNTS = ("positive", "negative", "neutral", "total")


def polarity_counts(spans: DataFrame, keys, weight=None) -> DataFrame:
    """Positive, negative and neutral counts per `keys`. Rows without a polarity are left out;
    polarities off the list make a group appear but count nowhere."""
    n = F.col(weight) if weight else F.lit(1)
    counts = [
        F.sum(F.when(F.col("polarity") == p, n).otherwise(F.lit(0))).cast("bigint").alias(p) for p in POLARITIES
    ]
    return spans.where("polarity is not null").groupBy(*keys).agg(*counts)


def combine_counts(counts: DataFrame, keys) -> DataFrame:
    """Counts of a finer grain added up per `keys`."""
    return counts.groupBy(*keys).agg(*[F.sum(p).cast("bigint").alias(p) for p in POLARITIES])


def with_shares(counts: DataFrame) -> DataFrame:
    """Total and shares; a share of a zero total is null."""
    rows = counts.withColumn("total", F.col("positive") + F.col("negative") + F.col("neutral"))
    return rows.withColumn("positive_share", F.try_divide("positive", "total")).withColumn(
        "negative_share", F.try_divide("negative", "total")
    )


def sentiment_counts(spans: DataFrame, keys, weight=None, keep_null_keys: bool = False) -> DataFrame:
    """Polarity counts, total and shares per `keys` in one aggregation.

    Rows with a null key are left out unless `keep_null_keys`.
    """
    rows = spans if keep_null_keys else spans.na.drop(subset=list(keys))
    return with_shares(polarity_counts(rows, keys, weight))


def aspect_sentiment_by(spans: DataFrame, group: str = "discount_group", weight=None) -> DataFrame:
    return sentiment_counts(spans, ["aspect", group], weight)


def results_cube(spans: DataFrame, weight=None, keep_null_keys: bool = False) -> DataFrame:
    return sentiment_counts(spans, CUBE_KEYS, weight, keep_null_keys)


def results_cube_from_counts(counts: DataFrame, keep_null_keys: bool = False) -> DataFrame:
    """The cube from counts of a finer grain, such as facts counted before a dimension was joined."""
    rows = counts if keep_null_keys else counts.na.drop(subset=list(CUBE_KEYS))
    return with_shares(combine_counts(rows, CUBE_KEYS))


def top_complaints(spans: DataFrame, n: int = 5, weight=None) -> DataFrame:
    """Aspects with the most negative spans; ties by name."""
    count = (F.sum(weight) if weight else F.count("*")).cast("bigint").alias("count")
    return (
        spans.where("polarity = 'negative' and aspect is not null")
        .groupBy("aspect").agg(count).orderBy(F.desc("count"), "aspect").limit(n)
    )


def _scope_sets(levels, extra) -> list[list[str]]:
    return [list(levels[:i]) + list(extra) for i in range(len(levels) + 1)]


def scope_rollup(
    cube: DataFrame, by=("aspect",), levels=CATEGORY_LEVELS, all_drops_null: bool = True
) -> DataFrame:
    """Counts for every category scope at once: everything, each main category, each path below.

    `scope_level` says how many category levels a row fixes. With `all_drops_null` a level left
    at "All" still leaves out rows whose category ends above it.
    """
    sets = _scope_sets(levels, by)
    cube = cube.na.drop(subset=list(levels)) if all_drops_null else cube
    # grouping_id has one bit per grouping column; each level left out of a set is a set bit.
    level = F.lit(len(levels)) - F.bit_count(F.grouping_id(*levels, *by))
    rolled = cube.groupingSets([[F.col(c) for c in s] for s in sets], *levels, *by).agg(
        level.cast("int").alias("scope_level"), *[F.sum(c).cast("bigint").alias(c) for c in COUNTS]
    )
    return _known_paths(rolled, levels)


def _known_paths(rolled: DataFrame, levels) -> DataFrame:
    keep = F.lit(True)
    for i, c in enumerate(levels):
        keep = keep & ((F.col("scope_level") <= i) | F.col(c).isNotNull())
    return rolled.where(keep)


def scope_products(cube: DataFrame, levels=CATEGORY_LEVELS, all_drops_null: bool = True) -> DataFrame:
    """Distinct products and mentions per scope. Products do not add up, so each level counts anew."""
    cube = cube.na.drop(subset=list(levels)) if all_drops_null else cube
    per_product = cube.groupBy(*levels, "product_id").agg(F.sum("total").alias("total"))
    sets = _scope_sets(levels, ())
    level = F.lit(len(levels)) - F.bit_count(F.grouping_id(*levels))
    rolled = per_product.groupingSets([[F.col(c) for c in s] for s in sets], *levels).agg(
        level.cast("int").alias("scope_level"),
        F.count_distinct("product_id").alias("products"),
        F.sum("total").cast("bigint").alias("mentions"),
    )
    return _known_paths(rolled, levels)
