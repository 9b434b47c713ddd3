"""Exact quantiles of numeric columns of any size, by refining histograms.

A quantile lies between two order statistics. Each round counts the values of every column in equal parts of the
range that still holds one of them, and goes on inside that part, from its least to its greatest value, until it has
few rows or one value. Only counts come back, at most `BUCKETS` rows for each range, and the last parts are
ordered one by one, so no task holds more than a part.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024
#: A part of so many rows is ordered.
SMALL = 20_000


#: A range whose ends differ by more than this factor is cut by logarithms.
WIDE = 1000.0


def _scaled(value: Column, low: float, high: float) -> Column:
    """What is cut into equal parts: the value or, in a wide range, its logarithm, which keeps the order too."""
    if low > 0 and high / low > WIDE:
        return F.log(value)
    if high < 0 and low / high > WIDE:
        return -F.log(-value)
    if low < 0 < high and max(-low, high) > WIDE:
        return F.signum(value) * F.log1p(F.abs(value))
    return value


def _bucket(value: Column, low: float, high: float, buckets: int) -> Column:
    """The part of [low, high] that holds the value; a larger value never gets a smaller part."""
    inside, first, last = (_scaled(x, low, high) / 2 for x in (value, F.lit(low), F.lit(high)))  # halves, so no width overflows
    part = F.floor(F.try_divide(inside - first, last - first) * buckets)
    inner = F.greatest(F.least(F.coalesce(part, F.lit(0)), F.lit(buckets - 1)), F.lit(0))
    return F.when(value <= low, 0).when(value >= high, buckets - 1).otherwise(inner).cast("int")


def order_statistics(df: DataFrame, wanted: dict[str, set[int]], extremes: dict[str, tuple[float, float]], buckets: int = BUCKETS,
                     small: int = SMALL) -> dict[tuple[str, int], float]:
    """{(column, rank): value} for 0-based ranks among a column's values that are neither null nor NaN.

    `extremes` gives each column's least and greatest value.
    """
    # (column, low, high, rows below the range, rows in it or None if not known) to the ranks inside.
    ranges = {(c, *extremes[c], 0, None): sorted(r) for c, r in wanted.items() if r}
    done: dict[tuple[str, int], float] = {}
    while True:
        for key in [k for k in ranges if k[1] == k[2]]:
            done |= {(key[0], r): key[1] for r in ranges.pop(key)}
        left = {k: r for k, r in ranges.items() if k[4] is None or k[4] > small}
        if not left:
            break
        keys = list(left)
        parts = [F.when(_inside(k), F.struct(F.lit(i).alias("i"), _bucket(F.col(k[0]), k[1], k[2], buckets).alias("b"), F.col(k[0]).alias("v")))
                 for i, k in enumerate(keys)]
        found = df.select(F.explode(F.array_compact(F.array(*parts))).alias("x")).select("x.*")
        counts = found.groupBy("i", "b").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        rows: dict[int, list] = {}
        for row in counts.collect():  # at most `buckets` rows for each of a few ranges
            rows.setdefault(row["i"], []).append(row)
        for i, key in enumerate(keys):
            below, ranks = key[3], list(ranges.pop(key))
            for row in sorted(rows[i], key=lambda row: row["b"]):
                inside = [r for r in ranks if below <= r < below + row["n"]]
                if inside:
                    ranges[key[0], row["low"], row["high"], below, row["n"]] = inside
                below += row["n"]
    if ranges:
        keys = list(ranges)
        parts = [F.when(_inside(k), F.struct(F.lit(i).alias("i"), F.col(k[0]).alias("v"))) for i, k in enumerate(keys)]
        values = df.select(F.explode(F.array_compact(F.array(*parts))).alias("x")).groupBy("x.i", "x.v").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("i").orderBy("v"))  # one part of at most `small` rows
        spots = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r - k[3]).alias("at"), F.lit(r).alias("r")) for i, k in enumerate(keys) for r in ranges[k]])
        values = values.select("i", "v", (upto - F.col("n")).alias("from"), upto.alias("to"))
        hits = values.select("v", F.explode(F.filter(spots, lambda s: (s["i"] == F.col("i")) & (s["at"] >= F.col("from")) & (s["at"] < F.col("to")))).alias("s"))
        for v, i, r in hits.select("v", "s.i", "s.r").collect():  # one row for each rank
            done[keys[i][0], r] = v
    return done


def _inside(key) -> Column:
    value = F.col(key[0])
    return (value >= key[1]) & (value <= key[2])


def exact_quantiles(df: DataFrame, columns, at, buckets: int = BUCKETS, small: int = SMALL) -> dict[tuple[str, float], float | None]:
    """{(column, q): value}, between two order statistics in proportion. Null and NaN do not count; None without values."""
    numbers = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns])
    one = numbers.agg(*[f(c).alias(f"{c} {n}") for c in columns for n, f in (("n", F.count), ("low", F.min), ("high", F.max))]).first()
    place = {(c, q): q * (one[f"{c} n"] - 1) for c in columns for q in at if one[f"{c} n"]}
    wanted: dict[str, set[int]] = {}
    for (c, _), p in place.items():
        wanted.setdefault(c, set()).update((math.floor(p), math.ceil(p)))
    known = order_statistics(numbers, wanted, {c: (one[f"{c} low"], one[f"{c} high"]) for c in wanted}, buckets, small)
    out: dict[tuple[str, float], float | None] = {(c, q): None for c in columns for q in at}
    for (c, q), p in place.items():
        low, high = known[c, math.floor(p)], known[c, math.ceil(p)]
        out[c, q] = low if low == high else low + (high - low) * (p - math.floor(p))
    return out
