"""Scores of predicted against gold labels.

Everything starts from `cells`: rows per (gold, pred) and whatever columns split the scores, such
as system or subset. That table has a handful of rows; only building it touches the data.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    ACCURACY_TARGET, LABEL_ORDER, LEXICON_ALPHA, NEGATIVE_RECALL_TARGET,
)
from ..functions import matching, text
from ..functions.lexicon import Rules, lexicon_rules_score


def norm_label(c) -> Column:
    """Lower-case and stripped; `nan`, `none` and missing become ''."""
    value = F.lower(text.strip(F.col(c) if isinstance(c, str) else c))
    return F.coalesce(matching.let(value, lambda v: F.when(~v.isin("nan", "none"), v)), F.lit(""))


def norm_labels(df: DataFrame, gold: str, pred: str) -> DataFrame:
    return df.withColumn("g", norm_label(gold)).withColumn("p", norm_label(pred))


def scored_rows(df: DataFrame, gold: str, *preds: str) -> DataFrame:
    """Rows with a gold label and a prediction from every named system."""
    for c in (gold, *preds):
        df = df.withColumn(c, norm_label(c)).where(F.col(c) != "")
    return df


def skipped_count(df: DataFrame, gold: str, pred: str, weight=None) -> DataFrame:
    """One row: all rows, scored rows, rows left out for want of a label."""
    n = F.col(weight) if weight else F.lit(1)
    ok = (norm_label(gold) != "") & (norm_label(pred) != "")
    return df.agg(
        F.sum(n).cast("bigint").alias("rows"),
        F.sum(F.when(ok, n).otherwise(F.lit(0))).cast("bigint").alias("scored"),
        F.sum(F.when(ok, F.lit(0)).otherwise(n)).cast("bigint").alias("skipped"),
    )


def cells(df: DataFrame, gold: str, pred: str, by=(), weight=None) -> DataFrame:
    """Rows per (by, g, p), unlabelled and unpredicted ones left out.

    Labels are counted as they are and normalised afterwards, a few distinct pairs instead of
    every row.
    """
    n = F.sum(weight) if weight else F.count("*")
    raw = df.groupBy(*by, F.col(gold).alias("_gold"), F.col(pred).alias("_pred")).agg(n.alias("_n"))
    rows = norm_labels(raw, "_gold", "_pred").where("g <> '' and p <> ''")
    return rows.groupBy(*by, "g", "p").agg(F.sum("_n").cast("bigint").alias("n"))


def confusion(cell: DataFrame, by=(), labels=LABEL_ORDER) -> DataFrame:
    """One row per gold label of the list, one column per predicted label, zero-filled."""
    sums = [
        F.coalesce(F.sum(F.when((F.col("g") == g) & (F.col("p") == p), F.col("n"))), F.lit(0))
        .cast("bigint")
        .alias(f"{g}__{p}")
        for g in labels
        for p in labels
    ]
    wide = cell.groupBy(*by).agg(*sums)
    rows = [
        F.struct(F.lit(i).alias("rank"), F.lit(g).alias("gold"), *[F.col(f"{g}__{p}").alias(p) for p in labels])
        for i, g in enumerate(labels)
    ]
    return wide.select(*by, F.inline(F.array(*rows)))


def class_scores(cell: DataFrame, by=(), labels=LABEL_ORDER) -> DataFrame:
    """Precision, recall, F1 and support per label; an undefined ratio is 0."""
    aggs = []
    for c in labels:
        g, p, n = F.col("g") == c, F.col("p") == c, F.col("n")
        for name, cond in (("tp", g & p), ("gold", g), ("pred", p)):
            aggs.append(F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("bigint").alias(f"{c}__{name}"))
    wide = cell.groupBy(*by).agg(*aggs)
    rows = [
        F.struct(
            F.lit(i).alias("rank"), F.lit(c).alias("label"),
            *[F.col(f"{c}__{name}").alias(name) for name in ("tp", "gold", "pred")],
        )
        for i, c in enumerate(labels)
    ]
    out = wide.select(*by, F.inline(F.array(*rows)))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return out.select(
        *by, "rank", "label",
        ratio(F.col("tp"), F.col("pred")).alias("precision"),
        ratio(F.col("tp"), F.col("gold")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("gold") + F.col("pred")).alias("f1"),
        F.col("gold").alias("support"),
    )


def class_report(cell: DataFrame, by=(), labels=LABEL_ORDER) -> DataFrame:
    """The per-label table plus macro and weighted averages."""
    per = class_scores(cell, by, labels)
    names = ("precision", "recall", "f1")
    support = F.sum("support")
    macro = per.groupBy(*by).agg(
        F.lit(len(labels)).alias("rank"), F.lit("macro avg").alias("label"),
        *[F.avg(c).alias(c) for c in names], support.cast("bigint").alias("support"),
    )
    weighted = per.groupBy(*by).agg(
        F.lit(len(labels) + 1).alias("rank"), F.lit("weighted avg").alias("label"),
        *[F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), support), F.lit(0.0)).alias(c)
          for c in names],
        support.cast("bigint").alias("support"),
    )
    return per.unionByName(macro).unionByName(weighted)


def summary_scores(cell: DataFrame, by=(), labels=LABEL_ORDER) -> DataFrame:
    """n, accuracy, macro-F1 and weighted-F1; a label without rows counts as 0 in the macro mean."""
    by = list(by)
    hits = F.sum(F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(F.lit(0)))
    total = cell.groupBy(*by).agg(F.sum("n").cast("bigint").alias("n"), (hits / F.sum("n")).alias("accuracy"))
    per = class_scores(cell, by, labels)
    f1 = per.groupBy(*by).agg(
        F.avg("f1").alias("macro_f1"),
        F.coalesce(
            F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0)
        ).alias("weighted_f1"),
    )
    if by:
        return total.join(f1, by)
    row = f1.select(F.struct("macro_f1", "weighted_f1")).scalar()
    return total.withColumn("_f1", row).select("*", "_f1.macro_f1", "_f1.weighted_f1").drop("_f1")


def class_recall(cell: DataFrame, label: str = "negative", by=()) -> DataFrame:
    """Hits, gold rows and recall of one label."""
    hits = F.sum(F.when(F.col("p") == label, F.col("n")).otherwise(F.lit(0))).cast("bigint")
    out = cell.where(F.col("g") == label).groupBy(*by).agg(
        F.coalesce(hits, F.lit(0)).alias("hits"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total"),
    )
    return out.withColumn("recall", F.coalesce(F.try_divide("hits", "total"), F.lit(0.0)))


def gates(
    cell: DataFrame, by=(), accuracy: float = ACCURACY_TARGET, negative_recall: float = NEGATIVE_RECALL_TARGET
) -> DataFrame:
    """Summary rounded to three decimals with a PASS or FAIL per target."""
    n = F.sum("n")
    right = F.sum(F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(F.lit(0)))
    neg = F.col("g") == "negative"
    neg_hits = F.sum(F.when(neg & (F.col("p") == "negative"), F.col("n")).otherwise(F.lit(0)))
    out = cell.groupBy(*by).agg(
        n.cast("bigint").alias("n"),
        (right / n).alias("_acc"),
        F.coalesce(F.try_divide(neg_hits, F.sum(F.when(neg, F.col("n")))), F.lit(0.0)).alias("_rec"),
    )
    verdict = lambda c, target: F.when(F.col(c) >= target, "PASS").otherwise("FAIL")
    return out.select(
        *by, "n",
        F.bround("_acc", 3).alias("accuracy"), verdict("_acc", accuracy).alias("accuracy_gate"),
        F.bround("_rec", 3).alias("negative_recall"), verdict("_rec", negative_recall).alias("recall_gate"),
    )


def accuracy_by(cell: DataFrame, column: str = "aspect") -> DataFrame:
    """Accuracy and size per value of a column of the cells."""
    hits = F.sum(F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(F.lit(0)))
    return (
        cell.where(F.col(column).isNotNull()).groupBy(column)
        .agg((hits / F.sum("n")).alias("accuracy"), F.sum("n").cast("bigint").alias("n"))
        .orderBy(F.desc("n"), column)
    )


def flagged_errors(
    df: DataFrame, gold: str, pred: str, keep=("aspect", "span", "text"), pair: bool = True
) -> DataFrame:
    """Rows whose prediction misses, with the pair as `gold -> pred`."""
    wrong = scored_rows(df, gold, pred).where(F.col(gold) != F.col(pred))
    out = wrong.select(*keep, gold, pred)
    return out.withColumn("error_pair", F.concat(gold, F.lit(" -> "), pred)) if pair else out


def error_pairs(cell: DataFrame, systems, by: str = "system") -> DataFrame:
    """Error pairs by system side by side, zero where a system never makes the error."""
    pair = F.concat("g", F.lit(" -> "), "p").alias("error_pair")
    counts = [
        F.sum(F.when(F.col(by) == s, F.col("n")).otherwise(F.lit(0))).cast("bigint").alias(s) for s in systems
    ]
    return cell.where("g <> p").groupBy(pair).agg(*counts)


def error_totals(cell: DataFrame, by: str = "system") -> DataFrame:
    """Errors and rows per system."""
    wrong = F.sum(F.when(F.col("g") != F.col("p"), F.col("n")).otherwise(F.lit(0)))
    return cell.groupBy(by).agg(
        wrong.cast("bigint").alias("errors"), F.sum("n").cast("bigint").alias("rows")
    )


# Baselines


def majority_label(df: DataFrame, gold: str, weight=None) -> Column:
    """The most frequent label as a scalar; ties to the least name."""
    n = F.sum(weight) if weight else F.count("*")
    counts = df.where(F.col(gold).isNotNull()).groupBy(gold).agg(n.alias("n"))
    return counts.agg(F.min_by(gold, F.struct(-F.col("n"), F.col(gold)))).scalar()


def majority_baseline(df: DataFrame, gold: str, name: str = "pred", weight=None) -> DataFrame:
    """Every row predicted as the most frequent label."""
    return df.withColumn(name, majority_label(df, gold, weight))


def rules_baseline(
    df: DataFrame, lexicon: dict, rules: Rules = Rules(), column: str = "text", name: str = "pred", alpha: float = LEXICON_ALPHA
) -> DataFrame:
    """Every row predicted from its word values and the rules on the words around them."""
    score = lexicon_rules_score(column, lexicon, rules, alpha)
    return df.withColumn("rules_score", score).withColumn(name, matching.lexicon_polarity("rules_score"))


def lexicon_baseline(
    df: DataFrame, lexicon: dict, column: str = "text", name: str = "pred", alpha: float = LEXICON_ALPHA
) -> DataFrame:
    """Every row predicted from the word valences of its text."""
    score = matching.lexicon_score(column, lexicon, alpha)
    return df.withColumn("compound", score).withColumn(name, matching.lexicon_polarity("compound"))


def system_rows(df: DataFrame, gold: str, systems: dict, by=(), weight=None) -> DataFrame:
    """Long form: one row per input row and system, `systems` mapping name to prediction column."""
    pairs = F.array(
        *[F.struct(F.lit(s).alias("system"), F.col(c).alias("pred")) for s, c in systems.items()]
    )
    extra = [weight] if weight else []
    return df.select(F.col(gold).alias("gold"), *by, *extra, F.inline(pairs))


def system_comparison(
    df: DataFrame, gold: str, systems: dict, held_out: str = "held_out", weight=None
) -> DataFrame:
    """Scores per system on the whole set and on its held-out part, from one pass over the rows."""
    cell = cells(system_rows(df, gold, systems, [held_out], weight), "gold", "pred", ["system", held_out], weight)
    subsets = F.explode(F.when(F.col(held_out), F.array(F.lit("full"), F.lit("held_out"))).otherwise(F.array(F.lit("full"))))
    return summary_scores(cell.withColumn("subset", subsets), ["system", "subset"])
