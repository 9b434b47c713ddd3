"""Counts and summaries of a table's columns."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def value_counts(df: DataFrame, column: str, classes=None, weight=None) -> DataFrame:
    """Rows per value, most frequent first; with `classes` exactly those, zero-filled."""
    n = F.sum(weight) if weight else F.count("*")
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(n.cast("bigint").alias("count"))
    if classes is not None:
        wide = df.agg(
            *[
                F.coalesce(
                    F.sum(F.when(F.col(column) == c, F.col(weight) if weight else F.lit(1))), F.lit(0)
                ).cast("bigint").alias(c)
                for c in classes
            ]
        )
        counts = wide.unpivot([], list(classes), column, "count")
    return counts.orderBy(F.desc("count"), column)


def percent_of_total(df: DataFrame, column: str) -> DataFrame:
    """Frequency per value and its percent of all non-null rows, two decimals."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("frequency"))
    total = counts.agg(F.sum("frequency")).scalar()
    share = F.bround(F.col("frequency") / total * 100, 2)
    return counts.withColumn("percent", share).orderBy(F.desc("frequency"), column)


def null_counts(df: DataFrame) -> DataFrame:
    """(column, type, nulls, rows) in one pass."""
    nulls = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    one = df.agg(F.count("*").alias("_rows"), *nulls)
    types = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    return one.unpivot(["_rows"], df.columns, "column", "nulls").select(
        "column", F.element_at(types, F.col("column")).alias("type"), "nulls", F.col("_rows").alias("rows")
    )


def describe(df: DataFrame, columns) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of numeric columns."""
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    one = numbers.agg(*[f(c).cast("double").alias(f"{c}__{s}") for c in columns for s, f in stats.items()])
    at = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    found = exact_quantiles(df, columns, list(at.values()))
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{s}").alias(s) for s in stats],
                 *[F.lit(found[c, q]).cast("double").alias(k) for k, q in at.items()])
        for c in columns
    ]
    return one.select(F.inline(F.array(*rows))).select("column", "count", "mean", "std", "min", *at, "max")


def largest_group(df: DataFrame, by: str, value: str) -> DataFrame:
    """The group with the largest sum; ties to the least name."""
    sums = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.sum(value).alias("total"))
    pick = F.min(F.struct((-F.col("total")).alias("neg"), F.col(by).alias("key")))
    return sums.agg(pick.alias("_p")).select(
        F.col("_p.key").alias(by), (-F.col("_p.neg")).cast("bigint").alias("total")
    )


def length_picks(df: DataFrame, column: str, key: str) -> DataFrame:
    """The row with the longest text and the row nearest the median length; ties to the least key.

    Lengths are counted before the median, so the exact percentile works on few distinct values.
    """
    size = F.length(F.coalesce(F.col(column), F.lit("")))
    rows = df.select(F.col(key).alias("key"), size.alias("len"))
    sizes = rows.groupBy("len").agg(F.count("*").alias("n"))
    median = sizes.agg(F.percentile("len", F.lit(0.5), F.col("n"))).scalar()
    best = rows.agg(
        F.min(F.struct((-F.col("len")).alias("by"), "key", "len")).alias("longest"),
        F.min(F.struct(F.abs(F.col("len") - median).alias("by"), "key", "len")).alias("median"),
    )
    picks = [
        F.struct(F.lit(p).alias("pick"), F.col(f"{p}.key").alias(key), F.col(f"{p}.len").alias("length"))
        for p in ("longest", "median")
    ]
    return best.select(F.inline(F.array(*picks)))
