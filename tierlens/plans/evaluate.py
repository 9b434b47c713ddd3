"""Queries that score predicted against gold labels."""

from pyspark.sql import functions as F

from ..functions import matching
from ..operators import curate, evaluate, spans
from . import bridge as b
from . import curate as c
from .registry import query

LABELLED = c.LABELLED
_NORM = "CASE WHEN lower(trim({0})) IN ('nan', 'none') OR {0} IS NULL THEN '' ELSE lower(trim({0})) END"


def _scored(pred: str, name: str = "scored") -> str:
    return f"""{name} AS (
  SELECT * FROM (SELECT *, {_NORM.format('polarity')} AS g, {_NORM.format(pred)} AS p FROM gold) WHERE g <> '' AND p <> '')"""


FACTS = f"""facts AS (
  SELECT *, {b.sql_first_aspect('p_name', b.NOUNS)} AS aspect FROM (
    SELECT p_name, CASE l_returnflag WHEN 'R' THEN 'negative' WHEN 'A' THEN 'positive' ELSE 'neutral' END AS g,
      CASE WHEN l_tax < 0.05 THEN CASE l_returnflag WHEN 'R' THEN 'negative' WHEN 'A' THEN 'positive' ELSE 'neutral' END
        WHEN l_linestatus = 'F' THEN 'negative' ELSE 'positive' END AS p
    FROM lineitem JOIN part ON l_partkey = p_partkey))"""


def fact_cells(spark, sf_dir, by=()):
    """Line items as gold and predicted classes, counted per part before parts are joined."""
    gold = F.when(F.col("l_returnflag") == "R", "negative").when(F.col("l_returnflag") == "A", "positive").otherwise("neutral")
    pred = F.when(F.col("l_tax") < 0.05, gold).when(F.col("l_linestatus") == "F", "negative").otherwise("positive")
    rows = b.table(spark, sf_dir, "lineitem").withColumns({"gold": gold, "pred": pred})
    if not by:
        return evaluate.cells(rows, "gold", "pred")
    counted = evaluate.cells(rows, "gold", "pred", ["l_partkey"])
    part = b.table(spark, sf_dir, "part").select("p_partkey", matching.first_aspect("p_name", b.NOUNS).alias("aspect"))
    joined = counted.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("aspect", "g", "p").agg(F.sum("n").alias("n"))


_ORDER = ("negative", "neutral", "positive")


def _class_rows(source: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return " UNION ALL ".join(
        f"""SELECT {keys}{i} AS rank, '{x}' AS label,
  coalesce(count(*) FILTER (g = '{x}' AND p = '{x}') / nullif(count(*) FILTER (p = '{x}'), 0), 0.0) AS precision,
  coalesce(count(*) FILTER (g = '{x}' AND p = '{x}') / nullif(count(*) FILTER (g = '{x}'), 0), 0.0) AS recall,
  coalesce(2 * count(*) FILTER (g = '{x}' AND p = '{x}') / nullif(count(*) FILTER (g = '{x}') + count(*) FILTER (p = '{x}'), 0), 0.0) AS f1,
  count(*) FILTER (g = '{x}') AS support FROM {source} {group}"""
        for i, x in enumerate(_ORDER)
    )


def _rounded(df, *columns):
    return df.withColumns({x: F.round(x, 9) for x in columns})


@query(b.ctes(*LABELLED, _scored("polarity_predicted")) + """
SELECT (SELECT count(*) FROM gold) AS rows, count(*) AS scored, (SELECT count(*) FROM gold) - count(*) AS skipped FROM scored""")
def norm_labels(spark, sf_dir):
    return evaluate.skipped_count(b.gold(spark, sf_dir), "polarity", "polarity_predicted")


_SUMMARY = """
SELECT {keys}count(*) AS n, round(count(*) FILTER (g = p) / count(*), 9) AS accuracy,
  round((SELECT avg(f1) FROM per{on}), 9) AS macro_f1,
  round((SELECT sum(f1 * support) / sum(support) FROM per{on}), 9) AS weighted_f1 FROM {source}"""


@query(b.ctes(FACTS, f"per AS ({_class_rows('facts')})") + _SUMMARY.format(keys="", on="", source="facts"))
def accuracy_f1(spark, sf_dir):
    return _rounded(evaluate.summary_scores(fact_cells(spark, sf_dir)), "accuracy", "macro_f1", "weighted_f1")


@query(b.ctes(FACTS) + " UNION ALL ".join(
    f"SELECT {i} AS rank, '{g}' AS gold, " + ", ".join(f"count(*) FILTER (g = '{g}' AND p = '{p}') AS {p}" for p in _ORDER) + " FROM facts"
    for i, g in enumerate(_ORDER)))
def confusion(spark, sf_dir):
    return evaluate.confusion(fact_cells(spark, sf_dir))


@query(b.ctes(FACTS, f"per AS ({_class_rows('facts')})") + """
SELECT rank, label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM per
UNION ALL SELECT 3, 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), sum(support)::BIGINT FROM per
UNION ALL SELECT 4, 'weighted avg', round(sum(precision * support) / sum(support), 9),
  round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), sum(support)::BIGINT FROM per""")
def class_report(spark, sf_dir):
    return _rounded(evaluate.class_report(fact_cells(spark, sf_dir)), "precision", "recall", "f1")


@query(b.ctes(*LABELLED, _scored("polarity_predicted")) + """
SELECT n, round_even(acc, 3) AS accuracy, CASE WHEN acc >= 0.7 THEN 'PASS' ELSE 'FAIL' END AS accuracy_gate,
  round_even(rec, 3) AS negative_recall, CASE WHEN rec >= 0.6 THEN 'PASS' ELSE 'FAIL' END AS recall_gate
FROM (SELECT count(*) AS n, count(*) FILTER (g = p) / count(*) AS acc,
  count(*) FILTER (g = 'negative' AND p = g) / count(*) FILTER (g = 'negative') AS rec FROM scored)""")
def gates(spark, sf_dir):
    return evaluate.gates(evaluate.cells(b.gold(spark, sf_dir), "polarity", "polarity_predicted"))


@query(b.ctes(*LABELLED, _scored("polarity_predicted")) + """
SELECT hits, total, hits / total AS recall FROM (
  SELECT count(*) FILTER (p = 'negative') AS hits, count(*) AS total FROM scored WHERE g = 'negative')""")
def negative_recall(spark, sf_dir):
    return evaluate.class_recall(evaluate.cells(b.gold(spark, sf_dir), "polarity", "polarity_predicted"))


@query(b.ctes(FACTS) + """
SELECT aspect, count(*) FILTER (g = p) / count(*) AS accuracy, count(*) AS n FROM facts
WHERE aspect IS NOT NULL GROUP BY aspect""")
def per_aspect_accuracy(spark, sf_dir):
    return evaluate.accuracy_by(fact_cells(spark, sf_dir, ("aspect",)))


@query(b.ctes(*LABELLED, _scored("polarity_finetuned")) + """
SELECT label_id, aspect, span, text, g AS polarity, p AS polarity_finetuned, g || ' -> ' || p AS error_pair
FROM scored WHERE g <> p""")
def flagged_errors(spark, sf_dir):
    keep = ("label_id", "aspect", "span", "text")
    return evaluate.flagged_errors(b.gold(spark, sf_dir), "polarity", "polarity_finetuned", keep)


_BOTH = b.ctes(*LABELLED, _scored("polarity_predicted", "base"), _scored("polarity_finetuned", "tuned"))
_SYSTEMS = {"baseline": "polarity_predicted", "fine_tuned": "polarity_finetuned"}


def _system_cells(spark, sf_dir):
    rows = evaluate.system_rows(b.gold(spark, sf_dir), "polarity", _SYSTEMS)
    return evaluate.cells(rows, "gold", "pred", ["system"])


@query(_BOTH + """
SELECT error_pair, count(*) FILTER (s = 1) AS baseline, count(*) FILTER (s = 2) AS fine_tuned
FROM (SELECT 1 AS s, g || ' -> ' || p AS error_pair FROM base WHERE g <> p
  UNION ALL SELECT 2, g || ' -> ' || p FROM tuned WHERE g <> p) GROUP BY error_pair""")
def error_pairs(spark, sf_dir):
    return evaluate.error_pairs(_system_cells(spark, sf_dir), list(_SYSTEMS))


@query(_BOTH + """
SELECT 'baseline' AS system, count(*) FILTER (g <> p) AS errors, count(*) AS rows FROM base
UNION ALL SELECT 'fine_tuned', count(*) FILTER (g <> p), count(*) FROM tuned""")
def error_totals(spark, sf_dir):
    return evaluate.error_totals(_system_cells(spark, sf_dir))


@query(b.ctes(*LABELLED) + """
SELECT label_id, (SELECT polarity FROM gold GROUP BY polarity ORDER BY count(*) DESC, polarity LIMIT 1) AS pred FROM gold""")
def majority_baseline(spark, sf_dir):
    return evaluate.majority_baseline(b.gold_table(spark, sf_dir), "polarity").select("label_id", "pred")


@query(f"""
SELECT doc_id, compound, {b.sql_polarity('compound')} AS pred
FROM (SELECT doc_id, {b.sql_compound('text')} AS compound FROM documents)""")
def lexicon_baseline(spark, sf_dir):
    docs = b.texts(spark, sf_dir).select("doc_id", "text")
    return evaluate.lexicon_baseline(docs, b.VALENCE).select("doc_id", "compound", "pred")


@query(f"""
SELECT doc_id, compound, {b.sql_polarity('compound')} AS polarity
FROM (SELECT doc_id, {b.sql_compound('text')} AS compound FROM documents)""")
def lexicon_table_scores(spark, sf_dir):
    lexicon = spark.createDataFrame(list(b.VALENCE.items()), "token string, valence double")
    return spans.lexicon_table_scores(b.texts(spark, sf_dir).select("doc_id", "text"), lexicon)


@query("WITH " + b.sql_rules("documents", "doc_id", "text") + f"""
SELECT doc_id, rules_score, {b.sql_polarity('rules_score')} AS pred FROM ruled""")
def lexicon_rules(spark, sf_dir):
    docs = b.texts(spark, sf_dir).select("doc_id", "text")
    return evaluate.rules_baseline(docs, b.VALENCE, b.RULES).select("doc_id", "rules_score", "pred")


def _per_system(source: str) -> str:
    return _class_rows(source, "system, subset")


_COMPARED = f"""long AS (
  SELECT 'A naive' AS system, held_out, polarity AS g,
    (SELECT polarity FROM gold GROUP BY polarity ORDER BY count(*) DESC, polarity LIMIT 1) AS p FROM split
  UNION ALL SELECT 'B lexicon', held_out, polarity, {b.sql_polarity('compound')}
    FROM (SELECT *, {b.sql_compound('text')} AS compound FROM split)
  UNION ALL SELECT 'C full', held_out, polarity, {_NORM.format('polarity_predicted')} FROM split),
sets AS (SELECT *, 'full' AS subset FROM long WHERE p <> '' UNION ALL SELECT *, 'held_out' FROM long WHERE held_out AND p <> ''),
per AS ({_per_system('sets')})"""


@query(b.ctes(*LABELLED, c.SPLIT, _COMPARED) + """
SELECT s.system, s.subset, count(*) AS n, round(count(*) FILTER (g = p) / count(*), 9) AS accuracy,
  round(any_value(macro), 9) AS macro_f1, round(any_value(weighted), 9) AS weighted_f1
FROM sets s JOIN (SELECT system, subset, avg(f1) AS macro, sum(f1 * support) / sum(support) AS weighted
  FROM per GROUP BY system, subset) q ON s.system = q.system AND s.subset = q.subset
GROUP BY s.system, s.subset""")
def system_comparison(spark, sf_dir):
    rows = curate.with_held_out(b.gold_table(spark, sf_dir), "label_id")
    rows = evaluate.majority_baseline(rows, "polarity", "naive")
    rows = evaluate.lexicon_baseline(rows, b.VALENCE, "text", "lexicon")
    systems = {"A naive": "naive", "B lexicon": "lexicon", "C full": "polarity_predicted"}
    out = evaluate.system_comparison(rows, "polarity", systems)
    return _rounded(out, "accuracy", "macro_f1", "weighted_f1")


_RULED = b.sql_rules("split", "label_id", "text")
_ABLATED = _COMPARED.replace("  UNION ALL SELECT 'C full'", f"""  UNION ALL SELECT 'B lexicon with rules', held_out, polarity, {b.sql_polarity('rules_score')}
    FROM split JOIN ruled ON ruled.label_id = split.label_id
  UNION ALL SELECT 'C full'""")


@query(b.ctes(*LABELLED, c.SPLIT, _RULED, _ABLATED) + """
SELECT s.system, s.subset, count(*) AS n, round(count(*) FILTER (g = p) / count(*), 9) AS accuracy,
  round(any_value(macro), 9) AS macro_f1, round(any_value(weighted), 9) AS weighted_f1
FROM sets s JOIN (SELECT system, subset, avg(f1) AS macro, sum(f1 * support) / sum(support) AS weighted
  FROM per GROUP BY system, subset) q ON s.system = q.system AND s.subset = q.subset
GROUP BY s.system, s.subset""")
def system_ablation(spark, sf_dir):
    """The comparison with a further system: the lexicon with its rules."""
    rows = curate.with_held_out(b.gold_table(spark, sf_dir), "label_id")
    rows = evaluate.majority_baseline(rows, "polarity", "naive")
    rows = evaluate.lexicon_baseline(rows, b.VALENCE, "text", "lexicon")
    rows = evaluate.rules_baseline(rows, b.VALENCE, b.RULES, "text", "rules")
    systems = {"A naive": "naive", "B lexicon": "lexicon", "B lexicon with rules": "rules", "C full": "polarity_predicted"}
    return _rounded(evaluate.system_comparison(rows, "polarity", systems), "accuracy", "macro_f1", "weighted_f1")


_COMMON = f"""common AS (
  SELECT *, {_NORM.format('polarity')} AS g, {_NORM.format('polarity_predicted')} AS b, {_NORM.format('polarity_finetuned')} AS f
  FROM gold)"""


@query(b.ctes(*LABELLED, _COMMON) + """
SELECT count(*) AS n, count(*) FILTER (g = b) / count(*) AS baseline, count(*) FILTER (g = f) / count(*) AS fine_tuned
FROM common WHERE g <> '' AND b <> '' AND f <> ''""")
def common_subset(spark, sf_dir):
    rows = evaluate.scored_rows(b.gold(spark, sf_dir), "polarity", "polarity_predicted", "polarity_finetuned")
    right = lambda p: F.avg((F.col("polarity") == F.col(p)).cast("double"))
    return rows.agg(
        F.count("*").alias("n"), right("polarity_predicted").alias("baseline"), right("polarity_finetuned").alias("fine_tuned")
    )
