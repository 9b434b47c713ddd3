"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations alone.

Sizes are summed by source and leading hash digits. A running sum over those few rows finds the bucket
where a source's budget ends; only rows of that bucket are summed again by the next digits, until a
bucket holds one hash. A row is then taken if its hash lies below the threshold: nothing is sorted.
Thresholds are nested: a larger budget takes a superset.

Defined results: null text has size 0. A null source is a source of its own, after all others. Sources
without words have target 0. Rows with the same doc_id (null included) in one source share a hash and
are taken alike. Whole documents are taken `copies` times; a source whose target is q times its size
and some more has every document q times and those below the threshold once more. An empty table gives
an empty result. Columns named like the results are replaced.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import kept

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
DIGITS = 3
LEVELS = 10


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def doc_hash(seed: str = "mix") -> Column:
    """30 hexadecimal digits; the order of documents inside a source."""
    return F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed))), 1, 30)


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """`source`, `source_size`, `target` from one row per source (`source`, `source_size`).

    The total is shared by weight; a source above `most` times its size is held there, and the rest is
    shared again among the others. Sources are held in the order of size over weight, so the share of
    the free ones follows from running sums over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_place", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_place") % len(weights) + 1)
    everything = Window.partitionBy()
    ratio = Window.orderBy(F.col("source_size") / F.col("_w"), "_place")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    shared = (
        ranked.withColumn("_w", weight)
        .withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_all_w", F.sum("_w").over(everything))
        .withColumn("_held", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most)
        .withColumn("_held_w", F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        # Share of one weight if all sources before this one are held at their most.
        .withColumn("_share", (F.col("_total") - F.col("_held")) / (F.col("_all_w") - F.col("_held_w")))
        .withColumn("_free", F.col("_share") * F.col("_w") <= F.col("source_size") * most)
    )
    # From the first free source on all are free and the share no longer changes.
    shared = shared.withColumn(
        "_unit", F.first(F.when(F.col("_free"), F.col("_share")), ignorenulls=True).over(
            ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ).withColumn("_any", F.max(F.col("_free").cast("int")).over(ratio.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    target = F.when(F.col("_any"), F.col("_unit") * F.col("_w")).otherwise((F.col("source_size") * most).cast("double"))
    return shared.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame, digits: int = DIGITS) -> DataFrame:
    """`source`, `prefix`, `inclusive`: where the hashes of a source reach its budget.

    `rows` has `source`, `size`, `hash`; `budgets` has `source`, `budget` over 0. Each level sums the rows
    of one bucket per source by `digits` more digits, until that bucket is a single hash. The rows of that
    hash belong in (`inclusive`) if they bring the sum nearer to the budget.
    """
    left, done, width = budgets.select("source", "budget", F.lit("").alias("prefix")), None, 0
    while True:
        width += digits
        known = left.withColumnRenamed("source", "_of")
        inside = rows.join(known, F.col("source").eqNullSafe(F.col("_of")) & F.startswith("hash", "prefix"))
        sums = inside.groupBy("source", F.substring("hash", 1, width).alias("prefix")).agg(
            F.sum("size").alias("in_it"), F.first("budget").alias("budget"),
            (F.min("hash") == F.max("hash")).alias("single"),
        )
        upto = F.sum("in_it").over(Window.partitionBy("source").orderBy("prefix"))
        cut = sums.withColumn("rest", F.col("budget") - upto + F.col("in_it")).where("in_it >= rest")
        cut = cut.groupBy("source").agg(F.min(F.struct("prefix", "rest", "in_it", "single")).alias("c"))
        cut = kept(cut.select("source", "c.*"), "mixing")
        found = cut.where("single").select("source", "prefix", (2 * F.col("rest") > F.col("in_it")).alias("inclusive"))
        done = found if done is None else done.unionByName(found)
        left = cut.where("not single").select("source", F.col("rest").alias("budget"), "prefix")
        if left.isEmpty():
            return done


def measured(docs: DataFrame) -> DataFrame:
    """`docs` with the `size` of each text and the `hash` that orders it within its source."""
    return docs.drop("size", "hash").withColumn("size", n_words(F.col("text"))).withColumn("hash", doc_hash())


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Measured documents with `source_size`, `target`, `copies` and `taken` (size times copies)."""
    rows = kept(docs.select("source", "size", "hash"), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    fair = targets(sizes, weights, most).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    )
    fair = kept(fair.withColumn("budget", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("bigint")), "targets")
    cuts = thresholds(rows, fair.where("budget > 0")).withColumnRenamed("source", "_of")
    plan = fair.join(cuts, F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of", "budget")
    plan = kept(plan.withColumnRenamed("source", "_of"), "plan")
    head = F.expr("substring(hash, 1, length(prefix))")
    extra = (head < F.col("prefix")) | ((head == F.col("prefix")) & F.col("inclusive"))
    out = docs.drop("source_size", "target", "copies", "taken").join(
        plan, F.col("source").eqNullSafe(F.col("_of")), "left"
    )
    out = out.withColumn("copies", F.col("whole") + F.coalesce(extra, F.lit(False)).cast("int"))
    return out.withColumn("taken", F.col("size") * F.col("copies")).drop("_of", "whole", "prefix", "inclusive", "hash")
