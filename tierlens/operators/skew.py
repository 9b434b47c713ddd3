"""Joins, ranks and running totals that stay split when one key holds a large share of the rows.

Ranks and running totals are found on the key and order columns alone and joined back to their rows once.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import written

BLOCK_BITS = 12
PARTS = 64


def keep_first(df: DataFrame, keys, order) -> DataFrame:
    """The first row per key. Each map task sends at most one row per key to the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_k(df: DataFrame, keys, order, k: int, parts: int = PARTS) -> DataFrame:
    """The first `k` rows per key: the first `k` of each of a key's `parts` shares, then of what is left.

    So a key's rows never meet in one task, however large `k` is.
    """
    rows = df.withColumn("_share", F.pmod(F.xxhash64(*df.columns), F.lit(parts)))
    for by in ([*keys, "_share"], keys):
        w = Window.partitionBy(*by).orderBy(*order)
        rows = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
    return rows.drop("_share")


def _on(left: DataFrame, right: DataFrame, keys, how: str) -> DataFrame:
    """Join by columns of the same names, missing equal to missing; `right` keeps its other columns."""
    named = right.withColumnsRenamed({c: f"_right_{c}" for c in keys})
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in keys])
    return left.join(named, same, how).drop(*[f"_right_{c}" for c in keys])


def lookup(left: DataFrame, right: DataFrame, keys, how: str = "left") -> DataFrame:
    """Join `left` to `right`, which has one row per key; null keys match null keys.

    A plain join: adaptive execution broadcasts a small `right` and splits a hot key's rows. For the
    latter both sides must be plain shuffles, so a `right` that is itself an aggregate is written first.
    """
    return _on(left, right, keys, how)


def semi(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Rows of `left` whose key occurs in `right`."""
    return _on(left, right.select(*keys), keys, "left_semi")


def anti(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Rows of `left` whose key does not occur in `right`."""
    return _on(left, right.select(*keys), keys, "left_anti")


def with_group_min(df: DataFrame, keys, value: Column, name: str) -> DataFrame:
    """Each row with the least `value` of its whole group; the minima are written, one row per group."""
    least = df.groupBy(*keys).agg(F.min(value).alias(name))
    return lookup(df, written(least, "minima"), keys)


def _key(*columns) -> Column:
    """Columns as one struct: never null, and equal where both hold null in the same field.

    Windows and joins by the same struct share one shuffle.
    """
    return F.struct(*[F.col(c) if isinstance(c, str) else c for c in columns])


def running_total(df: DataFrame, keys, order: str, value: Column, name: str, bits: int = BLOCK_BITS, levels: int = 2):
    """Sum of `value` over the rows of a key that come before this one.

    `order` is a whole-number column, unique within a key. Rows are summed inside blocks of
    `2**bits` consecutive order values, the block sums inside blocks of blocks, and so on `levels`
    times, so a task holds one block and never a whole key.
    """
    narrow = df.select(_key(*keys).alias("_of"), F.col(order).alias("_at"), value.cast("bigint").alias("_value"))
    return _back(df, _before(narrow, bits, levels).withColumnRenamed("_value", name), keys, order)


def _back(df: DataFrame, found: DataFrame, keys, order: str) -> DataFrame:
    """What was found for (`_of`, `_at`) on the rows that it belongs to."""
    out = df.withColumn("_mine", _key(*keys)).join(found, (F.col("_mine") == F.col("_of")) & (F.col(order) == F.col("_at")), "left")
    return out.drop("_mine", "_of", "_at")


def _before(rows: DataFrame, bits: int, levels: int) -> DataFrame:
    """(_of, _at, _value) with `_value` summed over earlier rows of `_of`."""
    earlier = lambda by: Window.partitionBy(by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda by: F.coalesce(F.sum("_value").over(earlier(by)), F.lit(0))
    if levels == 0:
        return rows.withColumn("_value", total("_of"))
    block = F.shiftright(F.col("_at").cast("bigint"), bits).alias("at")
    rows = rows.withColumn("_block", F.struct(F.col("_of").alias("of"), block))
    sums = rows.groupBy("_block").agg(F.sum("_value").alias("_value"))
    sums = sums.select(F.col("_block.of").alias("_of"), F.col("_block.at").alias("_at"), "_value")
    base = _before(sums, bits, levels - 1).select(
        F.struct(F.col("_of").alias("of"), F.col("_at").alias("at")).alias("_block"), F.col("_value").alias("_base"))
    out = rows.withColumn("_value", total("_block")).join(base, "_block", "left")
    return out.select("_of", "_at", (F.col("_value") + F.col("_base")).alias("_value"))


def next_value(df: DataFrame, keys, order: str, value: str, name: str, bits: int = BLOCK_BITS, levels: int = 2):
    """`value` of the following row of the key, null at its end. Blocks as in `running_total`."""
    narrow = df.select(_key(*keys).alias("_of"), F.col(order).alias("_at"), F.struct(F.col(value)).alias("_value"))
    after = _after(narrow, bits, levels).select("_of", "_at", F.col(f"_value.{value}").alias(name))
    return _back(df, after, keys, order)


def _after(rows: DataFrame, bits: int, levels: int) -> DataFrame:
    """(_of, _at, _value) with `_value` of the following row; null only at the end of `_of`."""
    lead = lambda by: F.lead("_value").over(Window.partitionBy(by).orderBy("_at"))
    if levels == 0:
        return rows.withColumn("_value", lead("_of"))
    block = F.shiftright(F.col("_at").cast("bigint"), bits).alias("at")
    rows = rows.withColumn("_block", F.struct(F.col("_of").alias("of"), block))
    firsts = rows.groupBy("_block").agg(F.min_by("_value", "_at").alias("_value"))
    firsts = firsts.select(F.col("_block.of").alias("_of"), F.col("_block.at").alias("_at"), "_value")
    beyond = _after(firsts, bits, levels - 1).select(
        F.struct(F.col("_of").alias("of"), F.col("_at").alias("at")).alias("_block"), F.col("_value").alias("_beyond"))
    out = rows.withColumn("_value", lead("_block")).join(beyond, "_block", "left")
    return out.select("_of", "_at", F.coalesce("_value", "_beyond").alias("_value"))


def hash_ranks(df: DataFrame, keys, hash_col: str, tie, name: str, digits: int = 4) -> DataFrame:
    """(keys, hash, tie, name): 0-based rank by a hexadecimal hash, inside `keys` or over the whole table.

    The leading digits of the hash are the blocks, so the rank needs no single sorted partition; there
    is one row per block when block sizes are added up.
    """
    keys = list(keys)
    block = _key(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], F.substring(hash_col, 1, digits).alias("at"))
    rows = df.select(*keys, hash_col, *tie).withColumn("_block", block)
    sizes = rows.groupBy("_block").agg(F.count("*").alias("_n"))
    of = [F.col(f"_block.k{i}") for i in range(len(keys))]
    earlier = Window.partitionBy(*of).orderBy("_block.at").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_block").orderBy(hash_col, *tie)
    out = rows.withColumn(name, F.row_number().over(inside) - 1).join(sizes, "_block", "left")
    return out.withColumn(name, F.col(name) + F.col("_base")).drop("_block", "_base")


def rank_by_hash(df: DataFrame, keys, hash_col: str, tie, name: str, digits: int = 4) -> DataFrame:
    """The rows with their rank as `hash_ranks` gives it; `tie` is unique."""
    ranks = hash_ranks(df, keys, hash_col, tie, name, digits).select(*tie, name)
    return _on(df, ranks, tie, "left")


def rank_hash(seed, *cols) -> Column:
    """A reproducible order: md5 over the key columns and a seed."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed))))
