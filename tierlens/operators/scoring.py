"""Model scoring inside Spark tasks, and a polarity head trained with Spark ML.

A predictor is any callable that takes a list of sentences and gives, in the same order, a list of
`{"span", "polarity"}` dicts for each. A factory makes one; each Python worker calls it once.
"""

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import LABEL_ORDER, POLARITIES, SPAN_LIST, WORD_CHARS
from ..functions import matching
from ..sources.io import path_exists

BATCH = 500
SAFE_RESULT = T.StructType([T.StructField("predictions", SPAN_LIST), T.StructField("error", T.StringType())])

_loaded: dict = {}


def factory_version(factory: Callable) -> str:
    """A fingerprint of a factory and what it holds on to."""
    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


def load_once(name: str, factory: Callable, version: str):
    """The model under `name` in this worker, made on first use; another version takes its place."""
    held = _loaded.get(name)
    if held is None or held[0] != version:
        _loaded[name] = held = (version, factory())
    return held[1]


def model_source(spark: SparkSession, tuned: str, default: str) -> str:
    """The locally tuned head where it exists, else the default."""
    return tuned if path_exists(spark, tuned) else default


def _chunks(items: list, size: int) -> Iterator[list]:
    for i in range(0, len(items), size):
        yield items[i : i + size]


def score_spans(
    df: DataFrame, factory: Callable, name: str, sentence: str = "sentence", batch: int = BATCH
) -> DataFrame:
    """`predictions` per sentence. Only the sentence column crosses to Python, in Arrow batches."""
    version = factory_version(factory)

    @F.pandas_udf(SPAN_LIST)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predictor = load_once(name, factory, version)
        for s in batches:
            out = []
            for part in _chunks(list(s.fillna("")), batch):
                out.extend(predictor(part))
            yield pd.Series(out, index=s.index, dtype=object)

    return df.withColumn("predictions", predict(F.col(sentence)))


def _predict_safely(predictor, part: list[str]) -> list[dict]:
    """One batch; if it fails, one by one, and a failing sentence keeps its place, empty."""
    try:
        return [{"predictions": p, "error": None} for p in predictor(part)]
    except Exception:  # noqa: BLE001
        out = []
        for s in part:
            try:
                out.append({"predictions": predictor([s])[0], "error": None})
            except Exception as e:  # noqa: BLE001
                out.append({"predictions": [], "error": f"{type(e).__name__}: {e}"})
        return out


def score_spans_safe(
    df: DataFrame, factory: Callable, name: str, sentence: str = "sentence", batch: int = BATCH
) -> DataFrame:
    """As `score_spans`, with `error` set and no spans on sentences the predictor fails on."""
    version = factory_version(factory)

    @F.pandas_udf(SAFE_RESULT)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predictor = load_once(name, factory, version)
        for s in batches:
            out = [r for part in _chunks(list(s.fillna("")), batch) for r in _predict_safely(predictor, part)]
            yield pd.DataFrame(out, columns=["predictions", "error"], dtype=object)

    return df.withColumn("_scored", predict(F.col(sentence))).select("*", "_scored.*").drop("_scored")


def quarantine(scored: DataFrame) -> DataFrame:
    """Sentences the predictor failed on."""
    return scored.where("error is not null")


# Polarity head


def _indexed(df: DataFrame, label: str, labels) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label))
    return df.withColumn("_label", (F.nullif(place, F.lit(0)) - 1).cast("double")).where("_label is not null")


def _weighted(df: DataFrame, labels) -> DataFrame:
    """Each class weighs the same in total. Reads back one count per class."""
    counts = {int(r["_label"]): r["n"] for r in df.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    weight = F.create_map(*[F.lit(x) for i, n in counts.items() for x in (float(i), total / (len(counts) * n))])
    return df.withColumn("_weight", F.element_at(weight, F.col("_label")))


def _classifier(features: str, balanced: bool, max_iter: int, reg: float) -> LogisticRegression:
    lr = LogisticRegression(
        featuresCol=features, labelCol="_label", predictionCol="_prediction", rawPredictionCol="_raw",
        probabilityCol="_probability", maxIter=max_iter, regParam=reg, family="multinomial",
    )
    return lr.setWeightCol("_weight") if balanced else lr


def _fit(df: DataFrame, stages, label: str, labels, balanced: bool) -> PipelineModel:
    rows = _indexed(df, label, labels)
    return Pipeline(stages=stages).fit(_weighted(rows, labels) if balanced else rows)


def with_vector(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """An array-of-floats column as the head's feature vector."""
    return df.withColumn("_features", array_to_vector(F.col(embedding).cast("array<double>")))


def train_embedding_head(
    df: DataFrame, label: str, labels=LABEL_ORDER, embedding: str = "embedding",
    balanced: bool = True, max_iter: int = 50, reg: float = 0.01,
) -> PipelineModel:
    """Logistic regression on sentence embeddings."""
    return _fit(with_vector(df, embedding), [_classifier("_features", balanced, max_iter, reg)], label, labels, balanced)


def train_text_head(
    df: DataFrame, label: str, labels=POLARITIES, text: str = "context",
    features: int = 1 << 14, balanced: bool = True, max_iter: int = 20, reg: float = 0.01,
) -> PipelineModel:
    """Logistic regression on hashed words, for use where no embeddings are at hand."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=f"[^{WORD_CHARS}]+"),
        HashingTF(inputCol="_words", outputCol="_features", numFeatures=features),
        _classifier("_features", balanced, max_iter, reg),
    ]
    return _fit(df, stages, label, labels, balanced)


def _named(prediction: str, labels) -> Column:
    return F.get(F.array(*[F.lit(x) for x in labels]), F.col(prediction).cast("int"))


def apply_head(model: PipelineModel, df: DataFrame, labels, name: str = "polarity_finetuned") -> DataFrame:
    """Predicted label per row."""
    out = model.transform(df).withColumn(name, _named("_prediction", labels))
    return out.drop("_words", "_features", "_raw", "_probability", "_prediction")


def save_head(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_head(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def with_context(df: DataFrame) -> DataFrame:
    """The head's input text, null where the labelled span cannot be placed."""
    placed = matching.aligned_ordinal("text", "span").isNotNull()
    return df.withColumn("context", F.when(placed, matching.span_context("text", "span", "ordinal")))


def score_gold(model: PipelineModel, gold: DataFrame, labels=POLARITIES, name: str = "polarity_finetuned"):
    """Gold rows with the head's prediction, null where the span cannot be placed."""
    rows = with_context(gold).withColumn("_placed", F.col("context").isNotNull()).fillna({"context": ""})
    out = apply_head(model, rows, labels, name)
    return out.withColumn(name, F.when(F.col("_placed"), F.col(name))).drop("context", "_placed")
