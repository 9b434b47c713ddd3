"""Queries on label mining, validation, sampling and splitting."""

from pyspark.sql import functions as F

from .. import constants as k
from ..functions import matching
from ..functions import tokens as tk
from ..operators import checks, curate, spans
from ..sources.io import written
from . import bridge as b
from .registry import query



def _cue_list(cues) -> str:
    return "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in cues) + "]"


_CUES, _SHIPPED = _cue_list(b.CUES), _cue_list(k.COMPLAINT_CUES)
_END = "(start + length(span))"
_DIST = (
    f"list_min(flatten([[CASE WHEN i <= {_END} AND i + length(c) >= start THEN 0 "
    f"ELSE least(abs(i - {_END}), abs(start - i - length(c))) END "
    f"for i in range(0, length(sentence)) if substring(sentence, i::INTEGER + 1, length(c)::INTEGER) = c] "
    f"for c in {_CUES}]))::INTEGER"
)
_HITS = f"list_sort(list_distinct([trim(c) for c in {_CUES} if contains(sentence, c)]))"
CUED = f"""cued AS (
  SELECT * FROM (SELECT *, {_HITS} AS hits FROM sentences) WHERE len(hits) > 0)"""
NEAR = f"""near AS (
  SELECT w.*, {b.ORDINAL} AS ordinal, array_to_string(hits, '|') AS cue_hits, len(hits)::INTEGER AS n_cues, {_DIST} AS cue_dist
  FROM word_spans w JOIN (SELECT row_ord AS r, pos AS p, hits FROM cued) ON row_ord = r AND pos = p)"""
CANDIDATES = f"""candidates AS (
  SELECT -(row_ord * {b.ID_STEP} + pos * {b.POS_STEP} + priority) - 1 AS label_id, sentence AS text, aspect, ordinal,
    CASE WHEN length(sentence) % 13 = 0 THEN span || 'zz' WHEN length(sentence) % 6 = 0 THEN substring(span, 1, 2)
      ELSE span END AS span,
    CASE WHEN length(sentence) % 29 = 0 THEN 'bogus' WHEN length(sentence) % 7 = 0 THEN 'positive'
      WHEN length(sentence) % 5 = 0 THEN 'neutral' ELSE 'negative' END AS polarity
  FROM near)"""


def _word(i: str) -> str:
    return f"regexp_full_match(substring(text, ({i})::INTEGER, 1), '[\\p{{L}}\\p{{N}}_]')"


def _inside(i: str) -> str:
    return f"({i} > 0 AND {i} < length(text) AND {_word(i)} AND {_word(i + ' + 1')})"


_FOUND = "range(0, length(text) - length(span) + 1) if substring(text, i::INTEGER + 1, length(span)::INTEGER) = span"
_PLACE = (
    f"(list_position([NOT {_inside('i')} AND NOT {_inside('(i + length(span))')} for i in {_FOUND}], true) - 1)::INTEGER"
)
CHECKED = f"""checked AS (
  SELECT *, CASE WHEN why IS NOT NULL THEN why WHEN first < label_id THEN 'duplicate'
    WHEN place IS NULL THEN 'span not aligned' END AS reason
  FROM (SELECT *, min(CASE WHEN why IS NULL AND place IS NOT NULL THEN label_id END)
      OVER (PARTITION BY lower(text), lower(span)) AS first
    FROM (SELECT c.*, {_PLACE} AS place,
        CASE WHEN polarity NOT IN ('positive', 'negative', 'neutral') THEN 'invalid polarity'
          WHEN NOT contains(text, span) THEN 'span not in text'
          WHEN (lower(text), lower(span)) IN (SELECT (lower(text), lower(span)) FROM gold) THEN 'already labelled'
        END AS why FROM candidates c)))"""
LABELLED = (b.SENTENCES, b.WORD_SPANS, b.GOLD)
VALIDATED = (*LABELLED, CUED, NEAR, CANDIDATES, CHECKED)
MERGED = """merged AS (
  SELECT label_id, text, span, polarity, aspect, ordinal, 'base' AS source FROM gold
  UNION ALL SELECT label_id, text, span, polarity, aspect, place, 'mined' FROM checked WHERE reason IS NULL)"""


def _ranked(key: str) -> str:
    return f"row_number() OVER (ORDER BY md5({key}::VARCHAR || '|42'), {key}) - 1"


SPLIT = f"""split AS (
  SELECT *, rank >= greatest(1, floor((SELECT count(*) FROM gold) * 0.8::DOUBLE)) AS held_out
  FROM (SELECT *, {_ranked('label_id')} AS rank FROM gold))"""
QUOTA = """quota AS (
  SELECT *, greatest(0, target - gold_neg)::BIGINT AS need
  FROM (SELECT *, round_even(train_pos / 1.0::DOUBLE, 0)::BIGINT AS target
    FROM (SELECT (SELECT count(*) FROM split WHERE NOT held_out AND polarity = 'positive')
        + (SELECT count(*) FROM merged WHERE source = 'mined' AND polarity = 'positive') AS train_pos,
      (SELECT count(*) FROM split WHERE NOT held_out AND polarity = 'negative') AS gold_neg,
      (SELECT count(*) FROM merged WHERE source = 'mined' AND polarity = 'negative') AS available)))"""


def _picked(pool: str, need: str, available: str) -> str:
    return f"""picked AS (
  SELECT * FROM (SELECT *, row_number() OVER (ORDER BY second, h, label_id) AS place
    FROM (SELECT *, (rank > round_even({need}::DOUBLE / greatest({available}, 1) * size, 0))::INTEGER AS second
      FROM (SELECT *, md5(label_id::VARCHAR || '|42') AS h, count(*) OVER (PARTITION BY aspect) AS size,
          row_number() OVER (PARTITION BY aspect ORDER BY md5(label_id::VARCHAR || '|42'), label_id) AS rank
        FROM {pool})))
  WHERE place <= {need})"""


@query(b.ctes(b.SENTENCES, CUED) + """
SELECT row_ord, pos, array_to_string(hits, '|') AS cue_hits, len(hits)::INTEGER AS n_cues FROM cued""")
def cue_hits(spark, sf_dir):
    rows = curate.sentence_cues(b.sentences(spark, sf_dir), b.CUES)
    return rows.select("row_ord", "pos", "cue_hits", "n_cues")


@query(b.ctes(b.SENTENCES, CUED.replace(_CUES, _SHIPPED)) + """
SELECT row_ord, pos, array_to_string(hits, '|') AS cue_hits, len(hits)::INTEGER AS n_cues FROM cued""")
def cue_hits_shipped(spark, sf_dir):
    """The cue list that operators take by default."""
    return curate.sentence_cues(b.sentences(spark, sf_dir)).select("row_ord", "pos", "cue_hits", "n_cues")


@query(b.ctes(b.SENTENCES, b.WORD_SPANS) + f"""
SELECT row_ord, pos, aspect, span, start, {b.ORDINAL} AS ordinal, {_DIST.replace(_CUES, _SHIPPED)} AS cue_dist FROM word_spans""")
def nearest_cue_shipped(spark, sf_dir):
    rows = curate.keyword_cue_distance(b.sentences(spark, sf_dir), taxonomy=b.WORDS)
    return rows.select("row_ord", "pos", "aspect", "span", "start", "ordinal", "cue_dist")


@query(b.ctes(b.SENTENCES, b.WORD_SPANS) + f"""
SELECT row_ord, pos, aspect, span, start, {b.ORDINAL} AS ordinal, {_DIST} AS cue_dist FROM word_spans""")
def nearest_cue(spark, sf_dir):
    rows = curate.keyword_cue_distance(b.sentences(spark, sf_dir), b.CUES, b.WORDS)
    return rows.select("row_ord", "pos", "aspect", "span", "start", "ordinal", "cue_dist")


_PLACES = "list_sum([len([i for i in range(0, length(sentence) - length(c) + 1) if substring(sentence, i::INTEGER + 1, length(c)) = c]) for c in {}])"


@query(b.ctes(b.SENTENCES, b.WORD_SPANS) + f"""
SELECT row_ord, pos, aspect, span, start, {b.ORDINAL} AS ordinal, {_DIST} AS cue_dist,
  {_PLACES.format(_CUES)}::INTEGER AS cue_places FROM word_spans""")
def nearest_cue_table(spark, sf_dir):
    """The same from a table of cues."""
    cues = spark.createDataFrame([(c,) for c in b.CUES], "cue string")
    rows = curate.table_cue_distance(b.sentences(spark, sf_dir), cues, b.WORDS)
    return rows.select("row_ord", "pos", "aspect", "span", "start", "ordinal", "cue_dist", "cue_places")


_MINED = """mined AS (
  SELECT * FROM near WHERE length(sentence) BETWEEN 25 AND 220 AND cue_dist <= 60
    AND lower(sentence) NOT IN (SELECT lower(text) FROM gold)
  QUALIFY row_number() OVER (PARTITION BY sentence, span ORDER BY row_ord, pos, priority) = 1)"""
_MINED_COLUMNS = (
    "sentence AS text, span, 'negative' AS polarity, ordinal, aspect, cue_hits, cue_dist, product_id, n_cues, row_ord, pos"
)


@query(b.ctes(*LABELLED, CUED, NEAR, _MINED) + f"""
SELECT {_MINED_COLUMNS}
FROM mined QUALIFY row_number() OVER (
  PARTITION BY aspect ORDER BY cue_dist, n_cues DESC, row_ord, pos, priority) <= 40""")
def mine_candidates(spark, sf_dir):
    """The closest forty per aspect."""
    return curate.mine_candidates(
        b.sentences(spark, sf_dir), b.gold_table(spark, sf_dir), cues=b.CUES, taxonomy=b.WORDS, cap=k.PER_ASPECT_CAP
    )


@query(b.ctes(*LABELLED, CUED, NEAR, _MINED) + f"""
SELECT {_MINED_COLUMNS} FROM mined""")
def mine_all_candidates(spark, sf_dir):
    return curate.mine_candidates(
        b.sentences(spark, sf_dir), b.gold_table(spark, sf_dir), cues=b.CUES, taxonomy=b.WORDS
    )


def _validated(spark, sf_dir, gold=None):
    gold = gold or b.gold_table(spark, sf_dir)
    candidates = written(b.candidates(spark, sf_dir), "candidates")
    return curate.validate_candidates(candidates, gold, "label_id")


def _merged(spark, sf_dir, gold):
    return curate.merge_labels(gold, _validated(spark, sf_dir, gold), ("label_id",))


@query(b.ctes(*VALIDATED) + """
SELECT label_id, span, polarity, reason, CASE WHEN reason IS NULL THEN place ELSE ordinal END AS ordinal FROM checked""")
def validate_candidates(spark, sf_dir):
    return _validated(spark, sf_dir).select("label_id", "span", "polarity", "reason", "ordinal")


@query(b.ctes(*VALIDATED) + "SELECT reason, count(*) AS count FROM checked WHERE reason IS NOT NULL GROUP BY reason")
def rejected_reasons(spark, sf_dir):
    rejected = curate.rejected(_validated(spark, sf_dir))
    return rejected.groupBy("reason").agg(F.count("*").alias("count"))


@query(b.ctes(*VALIDATED, MERGED) + """
SELECT polarity, count(*) FILTER (source = 'base') AS before, count(*) AS after,
  count(*) FILTER (source = 'mined') AS added FROM merged GROUP BY polarity""")
def merge_labels(spark, sf_dir):
    return curate.merge_report(_merged(spark, sf_dir, b.gold_table(spark, sf_dir)))


@query(b.ctes(*VALIDATED, MERGED) + """
SELECT label_id, polarity FROM merged m ANTI JOIN (SELECT DISTINCT md5(text || chr(1) || span) AS pair FROM gold) g
  ON md5(m.text || chr(1) || m.span) = g.pair""")
def added_labels(spark, sf_dir):
    gold = b.gold_table(spark, sf_dir)
    rows = curate.added_rows(_merged(spark, sf_dir, gold), gold, ("text", "span"))
    return rows.select("label_id", "polarity")


@query(b.ctes(*LABELLED, CUED, NEAR, CANDIDATES) + f"SELECT label_id, {_PLACE} AS ordinal FROM candidates")
def span_ordinal(spark, sf_dir):
    rows = b.candidates(spark, sf_dir)
    return rows.select("label_id", matching.aligned_ordinal("text", "span").alias("ordinal"))


_RULES = tk.TokenRules()
_ENDS = "|".join(_RULES.endings).replace("'", "''")
_WHOLE = "|".join(w.replace(".", "\\.").replace("'", "''") for w in sorted(_RULES.whole, key=lambda w: (-len(w), w)))
# No look-ahead here: what ends a word is cut off by a mark first, and no token holds a mark. Texts are in lower case.
_MARKED = r"regexp_replace(text, '([\p{L}])(n''t)\b', '\1' || chr(1) || '\2', 'g')"
_PIECES = rf"regexp_extract_all({_MARKED}, '\s+|\x01|(?:{_WHOLE})\B|n''t\b|(?:{_ENDS})\b|\p{{N}}+(?:[.,:]\p{{N}}+)*|\p{{L}}+|\.{{2,}}|[^\x01]')"
_FITS = "list_contains(starts, i) AND list_contains(ends, i + length(span))"


@query(b.ctes(*LABELLED, CUED, NEAR, CANDIDATES) + rf""",
cut AS (SELECT *, {_PIECES} AS t FROM (SELECT DISTINCT text FROM candidates)),
laid AS (SELECT text, t, [length(replace(array_to_string(t[:j], ''), chr(1), '')) for j in range(0, len(t) + 1)] AS edge FROM cut),
edges AS (
  SELECT text, [edge[j] for j in range(1, len(t) + 1) if NOT regexp_matches(t[j], '^[\s]')] AS starts,
    [edge[j + 1] for j in range(1, len(t) + 1) if NOT regexp_matches(t[j], '^[\s]')] AS ends FROM laid)
SELECT label_id, (list_position([{_FITS} for i in {_FOUND}], true) - 1)::INTEGER AS ordinal FROM candidates JOIN edges USING (text)""")
def span_ordinal_tokens(spark, sf_dir):
    """The place of a span among its occurrences, by tokens."""
    rows = b.candidates(spark, sf_dir)
    return rows.select("label_id", tk.token_ordinal("text", "span").alias("ordinal"))


_WORDS = "[w for w in regexp_split_to_array({}, '\\s+') if length(w) > 0]"


@query(b.ctes(*LABELLED) + f"""
SELECT label_id, array_to_string(list_concat(l[greatest(len(l) - 2, 1):], [span], r[1:3]), ' ') || ':' || text AS context
FROM (SELECT *, {_WORDS.format("left(text, place::INTEGER)")} AS l,
    {_WORDS.format("substring(text, place::INTEGER + length(span)::INTEGER + 1)")} AS r
  FROM (SELECT *, [i for i in {_FOUND}][ordinal + 1] AS place FROM gold))""")
def span_context(spark, sf_dir):
    rows = b.gold(spark, sf_dir)
    return rows.select("label_id", matching.span_context("text", "span", "ordinal").alias("context"))


@query(b.ctes(*LABELLED, SPLIT) + "SELECT label_id, held_out FROM split")
def holdout_split(spark, sf_dir):
    return curate.with_held_out(b.gold_table(spark, sf_dir), "label_id").select("label_id", "held_out")


@query(b.ctes(*LABELLED) + """
SELECT label_id, ('0x' || substring(md5(label_id::VARCHAR || '|42'), 1, 8))::BIGINT >= 3435973836 AS held_out FROM gold""")
def holdout_mask(spark, sf_dir):
    rows = curate.with_held_out_by_threshold(b.gold(spark, sf_dir), "label_id")
    return rows.select("label_id", "held_out")


@query("SELECT doc_id, source FROM documents ORDER BY md5(doc_id::VARCHAR || '|7'), doc_id LIMIT 50")
def seeded_sample(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents").select("doc_id", "source")
    return curate.seeded_sample(docs, "doc_id", 50, seed=7)


_POOL = """pool AS (SELECT * FROM gold WHERE polarity = 'negative')"""


@query(b.ctes(*LABELLED, _POOL, _picked("pool", "(SELECT count(*) // 3 FROM pool)", "(SELECT count(*) FROM pool)"))
       + "SELECT label_id, aspect FROM picked")
def stratified_quota(spark, sf_dir):
    pool = b.gold_table(spark, sf_dir).where("polarity = 'negative'").select("label_id", "aspect")
    need = pool.agg(F.floor(F.count("*") / 3).alias("need"), F.count("*").alias("available"))
    return curate.stratified_sample(pool, "aspect", "label_id", need).select("label_id", "aspect")


@query(b.ctes(*VALIDATED, MERGED, SPLIT, QUOTA) + """
SELECT train_pos::BIGINT AS train_pos, gold_neg, available, target, need FROM quota""")
def negative_quota(spark, sf_dir):
    gold = b.gold_table(spark, sf_dir)
    split = curate.with_held_out(gold, "label_id")
    mined = _merged(spark, sf_dir, gold).where("source = 'mined'")
    return curate.negative_quota(split.where("not held_out"), mined)


_TRAIN = f"""pool AS (SELECT * FROM merged WHERE source = 'mined' AND polarity = 'negative'),
{_picked('pool', '(SELECT need FROM quota)', '(SELECT available FROM quota)')},
train_all AS (
  SELECT label_id, text, span, ordinal, polarity FROM split WHERE NOT held_out
  UNION ALL SELECT label_id, text, span, ordinal, polarity FROM merged WHERE source = 'mined' AND polarity <> 'negative'
  UNION ALL SELECT label_id, text, span, ordinal, polarity FROM picked),
train AS (
  SELECT * FROM train_all t WHERE NOT EXISTS (SELECT 1 FROM split s WHERE s.held_out AND s.text = t.text
    AND s.span = t.span AND s.ordinal = t.ordinal))"""


@query(b.ctes(*VALIDATED, MERGED, SPLIT, QUOTA, _TRAIN) + """
SELECT 'train' AS side, label_id, polarity FROM train
UNION ALL SELECT 'test', label_id, polarity FROM split WHERE held_out""")
def build_split(spark, sf_dir):
    base = b.gold_table(spark, sf_dir)
    train, test = curate.build_split(base, _merged(spark, sf_dir, base), "label_id")
    sides = [df.select(F.lit(s).alias("side"), "label_id", "polarity") for s, df in (("train", train), ("test", test))]
    return sides[0].unionByName(sides[1])


def _sides(spark, sf_dir):
    split = curate.with_held_out(b.gold_table(spark, sf_dir), "label_id")
    return split.where("not held_out"), split.where("held_out")


@query(b.ctes(*LABELLED, SPLIT) + """
SELECT label_id, text, span, ordinal FROM split t WHERE NOT held_out AND NOT EXISTS (
  SELECT 1 FROM split s WHERE s.held_out AND s.text = t.text AND s.span = t.span AND s.ordinal = t.ordinal)""")
def leak_filter(spark, sf_dir):
    train, test = _sides(spark, sf_dir)
    return curate.drop_leaks(train, test).select("label_id", "text", "span", "ordinal")


_UNPLACED = """sides AS (
  SELECT text, span, ordinal, held_out FROM split
  UNION ALL SELECT text, span, NULL, side FROM split, (VALUES (true), (false)) v(side) WHERE held_out AND label_id % 5 = 0)"""


@query(b.ctes(*LABELLED, SPLIT, _UNPLACED) + """
SELECT count(*) AS pairs, count(DISTINCT (a.text, a.span, coalesce(a.ordinal, -1))) AS shared_keys
FROM sides a JOIN sides b ON NOT a.held_out AND b.held_out AND a.text = b.text AND a.span = b.span
  AND a.ordinal IS NOT DISTINCT FROM b.ordinal""")
def leak_check(spark, sf_dir):
    """Some test rows are on both sides without an ordinal: these leak too."""
    train, test = _sides(spark, sf_dir)
    unplaced = test.where("label_id % 5 = 0").withColumn("ordinal", F.lit(None).cast("int"))
    return curate.leak_count(train.unionByName(unplaced), test.unionByName(unplaced))


@query(b.ctes(*LABELLED, SPLIT) + """
SELECT CASE WHEN held_out THEN 'test' ELSE 'train' END AS side, polarity, count(*) AS rows FROM split GROUP BY ALL""")
def split_report(spark, sf_dir):
    return curate.split_report(*_sides(spark, sf_dir))


@query("WITH " + b.SENTENCES.replace("FROM documents", "FROM (SELECT * FROM documents ORDER BY md5(doc_id::VARCHAR || '|7'), doc_id LIMIT 50)")
       + f""", {b.WORD_SPANS}, predicted AS (
  SELECT sentence, span, {b.sql_polarity('compound')} AS polarity, {b.sql_first_aspect('span', b.WORDS)} AS aspect
  FROM (SELECT *, {b.sql_compound('sentence')} AS compound FROM word_spans))
SELECT sentence AS text, span, polarity, polarity AS polarity_predicted, aspect, 0 AS ordinal FROM predicted""")
def label_sheet(spark, sf_dir):
    sample = curate.seeded_sample(b.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50, seed=7)
    rows = b.sentences(spark, sf_dir).join(sample, F.col("row_ord") == F.col("doc_id"), "left_semi")
    predicted = spans.keyword_predictions(rows, b.VALENCE, b.WORDS)
    return curate.label_sheet(spans.attach_predictions(predicted, taxonomy=b.WORDS))


@query(b.ctes(*LABELLED, CUED, NEAR, CANDIDATES) + """
SELECT DISTINCT polarity FROM candidates WHERE polarity NOT IN ('positive', 'negative', 'neutral')""")
def invalid_labels(spark, sf_dir):
    return checks.invalid_values(curate.normal_labels(b.candidates(spark, sf_dir)), "polarity")


@query(b.ctes(*LABELLED) + "SELECT label_id, text, span, polarity, ordinal FROM gold")
def training_labels(spark, sf_dir):
    """Labels as a file might hold them, polarity spelt loosely and ordinal 0 left out, made fit for training."""
    rows = b.gold(spark, sf_dir).withColumn("polarity", F.concat(F.lit(" "), F.initcap("polarity")))
    rows = rows.withColumn("ordinal", F.nullif("ordinal", F.lit(0)))
    return curate.training_labels(written(rows, "labels")).select("label_id", "text", "span", "polarity", "ordinal")
