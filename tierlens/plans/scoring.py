"""Queries that run predictors inside Spark tasks."""

import re
from functools import partial, reduce

from pyspark.sql import functions as F

from ..constants import LABEL_ORDER, POLARITIES
from ..functions import text
from ..operators import curate, scoring, spans
from ..sources.io import work_folder, written
from ..streaming import resumable
from . import bridge as b
from .registry import query
from .curate import _PLACE, LABELLED, SPLIT
from .spans import _ATTACHED, _PREDICTED


def keyword_predictor(valence=None):
    """A stand-in for a model: first whole-word keyword per aspect, polarity from word valences."""
    valence = b.VALENCE if valence is None else valence
    patterns = [re.compile(rf"\b({'|'.join(kws)})\b") for kws in b.WORDS.values()]

    def polarity(s: str) -> str:
        total = sum(valence.get(w, 0.0) for w in re.split(r"[^a-z0-9']+", s.lower()))
        score = total / (total * total + 15.0) ** 0.5
        return "positive" if score >= 0.05 else "negative" if score <= -0.05 else "neutral"

    def predict(batch: list[str]) -> list[list[dict]]:
        out = []
        for s in batch:
            hits = [m.group(1) for m in (p.search(s) for p in patterns) if m]
            out.append([{"span": h, "polarity": polarity(s)} for h in hits])
        return out

    return predict


def fragile_predictor():
    """The same, but it fails on any batch with a sentence that contains `rewh`."""
    predict = keyword_predictor()

    def checked(batch: list[str]) -> list[list[dict]]:
        for s in batch:
            if "rewh" in s:
                raise ValueError("cannot parse")
        return predict(batch)

    return checked


@query(b.ctes(b.SENTENCES, b.WORD_SPANS, _PREDICTED) + _ATTACHED)
def score_spans(spark, sf_dir):
    scored = scoring.score_spans(b.sentences(spark, sf_dir), keyword_predictor, "keywords")
    return spans.attach_predictions(scored, taxonomy=b.WORDS).select("row_ord", "pos", "span", "polarity", "aspect")


@query(b.ctes(b.SENTENCES, b.WORD_SPANS) + """
SELECT row_ord, pos, CASE WHEN bad THEN 'ValueError: cannot parse' END AS error,
  CASE WHEN bad THEN 0 ELSE found END AS spans
FROM (SELECT s.row_ord, s.pos, contains(s.sentence, 'rewh') AS bad, count(w.span)::INTEGER AS found
  FROM sentences s LEFT JOIN word_spans w ON s.row_ord = w.row_ord AND s.pos = w.pos
  GROUP BY s.row_ord, s.pos, bad)""")
def score_fault_isolated(spark, sf_dir):
    scored = scoring.score_spans_safe(b.sentences(spark, sf_dir), fragile_predictor, "fragile")
    return scored.select("row_ord", "pos", "error", F.size("predictions").alias("spans"))


_NATIVE = b.ctes(b.SENTENCES, b.WORD_SPANS, _PREDICTED) + "SELECT row_ord, pos, span, polarity FROM predicted"


def _predict_documents(docs):
    parts = text.split_sentences(text.clean_text("text"))
    rows = docs.select(F.col("doc_id").alias("row_ord"), parts.alias("_s"))
    rows = rows.select("row_ord", F.posexplode_outer("_s").alias("pos", "sentence")).where("sentence is not null")
    predicted = spans.keyword_predictions(rows, b.VALENCE, b.WORDS)
    return predicted.select("row_ord", "pos", F.inline_outer("predictions")).where("span is not null")


@query(_NATIVE)
def resumable_scoring(spark, sf_dir):
    """The documents as two files that arrive one after the other, scored by a file stream in two rounds.

    The run's folder is named by settings and content; the second round scores only what is new.
    """
    docs = b.table(spark, sf_dir, "documents")
    folder = work_folder(spark, "scoring")
    run = resumable.run_folder(folder, predictor="keywords", version=1, input=resumable.content_fingerprint(docs))
    for half in range(2):
        docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == half).write.parquet(f"{folder}/in/part{half}")
        out = resumable.score_available(spark, f"{folder}/in/*", docs.schema, _predict_documents, run)
    resumable.finish(spark, run)
    return out.drop("batch_id")


@query(b.ctes(b.SENTENCES, b.WORD_SPANS, _PREDICTED) + """
SELECT row_ord, count(*) AS spans FROM predicted GROUP BY row_ord
UNION ALL SELECT doc_id, 0 FROM documents WHERE doc_id NOT IN (SELECT row_ord FROM predicted)""")
def resumed_batch_scoring(spark, sf_dir):
    """The batch form, interrupted once: two sources first, then whatever has no result."""
    docs = b.texts(spark, sf_dir)
    run = resumable.run_folder(work_folder(spark, "scoring"), predictor="keywords", input=resumable.content_fingerprint(docs))

    def score(rows):
        parts = text.split_sentences(text.clean_text("text"))
        rows = rows.select(F.col("doc_id").alias("row_ord"), F.explode_outer(parts).alias("sentence"))
        found = spans.keyword_predictions(rows, b.VALENCE, b.WORDS)
        return found.groupBy("row_ord").agg(F.sum(F.size("predictions")).alias("spans"))

    todo = docs.withColumn("row_ord", F.col("doc_id"))
    resumable.score_remaining(todo.where("source in ('src1', 'src2')"), score, run, "row_ord")
    return resumable.score_remaining(todo, score, run, "row_ord")


@query(b.ctes(b.SENTENCES, b.WORD_SPANS, _PREDICTED) + _ATTACHED)
def tuned_or_default_scoring(spark, sf_dir):
    """A tuned head is loaded where one is stored; without one the default would fail on some sentences.

    The head is the stand-in's: its words with their valences.
    """
    head = work_folder(spark, "head")
    spark.createDataFrame(list(b.VALENCE.items()), "word string, valence double").write.parquet(head)
    chosen = scoring.model_source(spark, head, "default")
    factory = partial(keyword_predictor, load_words(spark, head)) if chosen == head else fragile_predictor
    scored = scoring.score_spans(b.sentences(spark, sf_dir), factory, "head")
    return spans.attach_predictions(scored, taxonomy=b.WORDS).select("row_ord", "pos", "span", "polarity", "aspect")


def load_words(spark, head: str) -> dict[str, float]:
    """The words of a stored head."""
    return {r["word"]: r["valence"] for r in spark.read.parquet(head).collect()}


def prediction_counts(scored, label: str, predicted: str):
    """Rows per split, label and prediction."""
    return scored.groupBy("held_out", F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def against_majority(counts):
    """Per split: predictions, right ones, those of the most frequent label, and whether the head finds more."""
    known = counts.where("predicted is not null")
    per = known.groupBy("held_out", "label").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("right")
    )
    out = per.groupBy("held_out").agg(F.sum("n").alias("n"), F.sum("right").alias("right"), F.max("n").alias("majority"))
    return out.withColumn("beats_majority", F.col("right") > F.col("majority"))


def _beats(counts):
    """The comparison on the held-out rows, which the head has not seen, as one value."""
    return against_majority(counts).where("held_out").select("beats_majority").scalar()


_MASK = "('0x' || substring(md5(vec_id::VARCHAR || '|42'), 1, 8))::BIGINT >= 3435973836"
#: A direction in the embeddings that stands for what a real label would say of them.
_SIGNAL, _EDGE = (1.0, -0.5, 0.75, 0.25, -1.0, 0.5, -0.75), 0.08
_SQL_SIGNAL = "list_sum([" + ", ".join(f"embedding[{i + 1}]::DOUBLE * {w}" for i, w in enumerate(_SIGNAL)) + "])"


def _signal():
    total = reduce(lambda x, y: x + y, [F.element_at("embedding", i + 1).cast("double") * w for i, w in enumerate(_SIGNAL)])
    return F.when(total > _EDGE, "positive").when(total < -_EDGE, "negative").otherwise("neutral")


def train_head_counts(spark, sf_dir):
    """Rows per split, label and prediction of a multinomial head on the embeddings, trained on four fifths."""
    rows = b.table(spark, sf_dir, "embeddings").withColumn("label", _signal())
    rows = written(curate.with_held_out_by_threshold(rows, "vec_id"), "embeddings")
    model = scoring.train_embedding_head(rows.where("not held_out"), "label", LABEL_ORDER, balanced=False)
    scored = scoring.apply_head(model, scoring.with_vector(rows), LABEL_ORDER, "predicted")
    return written(prediction_counts(scored, "label", "predicted"), "counts")


@query(f"""SELECT CASE WHEN s > {_EDGE} THEN 'positive' WHEN s < -{_EDGE} THEN 'negative' ELSE 'neutral' END AS label,
  count(*) AS n, true AS beats_majority FROM (SELECT {_SQL_SIGNAL} AS s FROM embeddings WHERE {_MASK}) GROUP BY label""")
def train_head(spark, sf_dir):
    """What SQL can check of `train_head_counts`: held-out rows per label, and that the head names more of them
    right than the most frequent label does."""
    counts = train_head_counts(spark, sf_dir)
    n = F.sum(F.when(F.col("predicted").isNotNull(), F.col("n")).otherwise(0)).alias("n")
    return counts.where("held_out").groupBy("label").agg(n).withColumn("beats_majority", _beats(counts))


@query(b.ctes(b.SENTENCES, b.WORD_SPANS) + f"""
SELECT row_ord, pos, span, CASE WHEN span IN ({b._list(w for w, v in b.VALENCE.items() if v > 0)}) THEN 'positive' ELSE 'negative' END AS polarity
FROM word_spans WHERE span IN ({b._list(b.VALENCE)})""")
def stored_head_scoring(spark, sf_dir):
    """A head fitted to words of known polarity, stored, preferred to the default because it is there, and loaded."""
    path = work_folder(spark, "head")
    words = [(w, "positive" if v > 0 else "negative") for w, v in b.VALENCE.items()]
    known = spark.createDataFrame(words, "context string, polarity string")
    scoring.save_head(scoring.train_text_head(known, "polarity", balanced=False, reg=0.0), path)
    model = scoring.load_head(scoring.model_source(spark, path, "default"))
    rows = b.word_rows(spark, sf_dir).where(F.col("span").isin(*b.VALENCE)).select("row_ord", "pos", "span", F.col("span").alias("context"))
    return scoring.apply_head(model, rows, POLARITIES, "polarity").drop("context")


def score_gold_counts(spark, sf_dir):
    """Rows per split, polarity and prediction of a head on span context, trained on the gold rows kept for
    training; every gold row scored, without a prediction where its span cannot be placed."""
    rows = written(curate.with_held_out(b.gold_table(spark, sf_dir), "label_id"), "gold")
    train = scoring.with_context(rows.where("not held_out")).where("context is not null")
    model = scoring.train_text_head(train, "polarity", balanced=False, reg=0.05)
    scored = scoring.score_gold(model, rows.drop("polarity_finetuned"))
    return written(prediction_counts(scored, "polarity", "polarity_finetuned"), "counts")


@query(b.ctes(*LABELLED, SPLIT) + f"""
SELECT held_out, polarity, count(*) AS n, count(*) FILTER (place IS NULL) AS unplaced, true AS beats_majority
FROM (SELECT *, {_PLACE} AS place FROM split) GROUP BY held_out, polarity""")
def score_gold(spark, sf_dir):
    """What SQL can check of `score_gold_counts`.

    The head must find more of the held-out rows right than the most frequent polarity does.
    """
    counts = score_gold_counts(spark, sf_dir)
    unplaced = F.sum(F.when(F.col("predicted").isNull(), F.col("n")).otherwise(0)).alias("unplaced")
    out = counts.groupBy("held_out", F.col("label").alias("polarity")).agg(F.sum("n").alias("n"), unplaced)
    return out.withColumn("beats_majority", _beats(counts))
