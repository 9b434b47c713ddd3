"""Toxicity scores: a small recurrent network reads every overlapping window of a text.

The score of a text is that of its worst window, on a logistic scale fitted to labelled texts. Training
takes a bounded sample of labelled rows outside the held-out fold (`POSITIVES`, `NEGATIVES`, and texts of at most
`SAMPLE_CHARS`); scoring reads all words of all texts.

Defined results: null and empty texts, and texts without letters, get the logistic value of no evidence
(the network's answer to an empty window). Several labels of one document count as their largest. Null
labels and ids teach nothing. Without labels of both kinds every score is the share of label 1 (0 without
any). Repeated rows get equal scores. Columns named like the results are replaced.
"""

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru, tokens
from .fold import held_out, sample
from .store import kept

WINDOW, STRIDE = 64, 32
THRESHOLD = 0.3
POSITIVES, NEGATIVES, SAMPLE_CHARS = 900, 2100, 20_000
VOCABULARY, EPOCHS, BATCH, RATE = 8000, 7, 96, 0.01
#: Windows read together when scoring.
TOGETHER = 1024


@dataclass
class Model:
    params: dict | None
    hashes: np.ndarray  # of vocabulary words, sorted; a word's number is its place + 1
    slope: float
    offset: float


def window_starts(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and length of all overlapping windows; the last one ends with the text, an empty text has one."""
    per = np.maximum(1, -(-(n_words - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(n_words)), per)
    k = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    length = np.minimum(n_words[text], WINDOW)
    start = np.minimum(k * STRIDE, n_words[text] - length)
    return text, start, length


def numbers(model_hashes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(model_hashes):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(model_hashes, hashes), len(model_hashes) - 1)
    return np.where(model_hashes[at] == hashes, at + 1, 0)


class Reader:
    """The distinct words of a block of texts as network inputs."""

    def __init__(self, block: tokens.Block, vocabulary: np.ndarray):
        self.words, distinct = pd.factorize(block.hashes())
        first = np.full(len(distinct), -1, np.int64)
        first[self.words[::-1]] = np.arange(block.count)[::-1]
        self.numbers = numbers(vocabulary, distinct)
        self.bucket, self.first = gru.char_buckets(block.words(first))
        self.n = len(distinct)
        text, start, self.length = window_starts(block.per_text)
        self.text, self.start = text, start + block.first[text]

    def logits(self, p) -> np.ndarray:
        gates = gru.inputs(p, self.numbers, gru.mean_of(p["char"], self.bucket, self.first))
        gates = {d: np.vstack([g, np.zeros((1, g.shape[1]), np.float32)]) for d, g in gates.items()}
        words = np.append(self.words, self.n)  # an empty window reads one blank word
        out = np.empty(len(self.start), np.float32)
        order = np.argsort(self.length, kind="stable")  # windows of one length need no mask
        for i in range(0, len(order), TOGETHER):
            at = order[i : i + TOGETHER]
            start = np.where(self.length[at] > 0, self.start[at], len(words) - 1)
            length = np.maximum(self.length[at], 1)
            out[at] = gru.forward(p, {d: _Lookup(g, words) for d, g in gates.items()}, start, length, int(length.max()))
        return out


class _Lookup:
    """`table[words[i]]` without writing out a row per word."""

    def __init__(self, table, words):
        self.table, self.words = table, words

    def __getitem__(self, at):
        return self.table[self.words[at]]


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Model:
    """Fit the network to labelled texts: a text's loss is that of the window with the highest score."""
    block = tokens.Block(texts, tokens.LETTER)
    base = Model(None, np.zeros(0, np.uint64), 0.0, 0.0)
    if not len(labels) or labels.min() == labels.max():
        rate = float(labels.mean()) if len(labels) else 0.0
        base.offset = np.log(rate / (1 - rate)) if 0 < rate < 1 else np.inf * (1 if rate else -1)
        return base
    hashes, count = np.unique(block.hashes(), return_counts=True)
    often = np.lexsort((hashes, -count))[:VOCABULARY]
    vocabulary = np.sort(hashes[often[count[often] > 1]])
    reader = Reader(block, vocabulary)
    p, rng = gru.init(len(vocabulary), seed), np.random.default_rng(seed)
    fit = rng.random(len(texts)) < 0.8  # the rest fits the logistic scale
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for epoch in range(EPOCHS):
        noise = rng.gumbel(size=len(reader.start))
        rank = noise if epoch == 0 else reader.logits(p) + 0.3 * noise
        rank = np.where(reader.length > 0, rank, -np.inf)
        best = pd.Series(rank).groupby(reader.text).idxmax().to_numpy()
        best = best[fit[reader.text[best]] & (reader.length[best] > 0)]
        rng.shuffle(best)
        for i in range(0, len(best), BATCH):
            at = best[i : i + BATCH]
            step += 1
            _step(p, reader, at, labels[reader.text[at]], moments, step, rng)
    worst = _worst(reader, reader.logits(p), len(texts))
    rest = ~fit if len({*labels[~fit]}) == 2 else np.ones(len(texts), bool)
    slope, offset = _scale(worst[rest], labels[rest])
    return Model(p, vocabulary, slope, offset)


def _step(p, reader, at, y, moments, step, rng):
    hide = rng.random(reader.n) < 0.4  # so that characters learn what words could tell
    used, local = np.unique(np.concatenate([reader.words[s : s + n] for s, n in zip(reader.start[at], reader.length[at])]), return_inverse=True)
    length = reader.length[at]
    start = np.cumsum(length) - length
    bucket, first = gru.of_words(reader.bucket, reader.first, used)
    chars = gru.mean_of(p["char"], bucket, first)
    own = np.where(hide[used], 0, reader.numbers[used])
    gates = {d: g[local] for d, g in gru.inputs(p, own, chars).items()}
    tape: dict = {}
    logit = gru.forward(p, gates, start, length, int(length.max()), tape)
    g, d_gates = gru.backward(p, tape, ((gru.sigmoid(logit) - y) / len(y)).astype(np.float32), len(local))
    x = np.concatenate([p["word"][own], chars], axis=1)
    dx = np.zeros_like(x)
    for d in "fb":
        total = np.zeros((len(used), 3 * gru.HIDDEN), np.float32)
        np.add.at(total, local, d_gates[d])
        g[f"in_{d}"], g[f"bias_{d}"] = x.T @ total, total.sum(axis=0)
        dx += total @ p[f"in_{d}"].T
    g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
    np.add.at(g["word"], own, dx[:, : gru.WORD_DIM])
    count = np.diff(first)
    np.add.at(g["char"], bucket, np.repeat(dx[:, gru.WORD_DIM :] / np.maximum(count, 1)[:, None], count, axis=0))
    for k, v in p.items():
        m, s = moments[k]
        m += 0.1 * (g[k] - m)
        s += 0.01 * (g[k] ** 2 - s)
        v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)


def _worst(reader: Reader, logits: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, -np.inf)
    np.maximum.at(out, reader.text, logits)
    return out


def _scale(x: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Logistic regression on one number, slightly damped."""
    mean, spread = x.mean(), x.std() + 1e-9
    x = (x - mean) / spread
    a, b = 1.0, 0.0
    for _ in range(rounds):
        q = gru.sigmoid(a * x + b)
        w = np.maximum(q * (1 - q), 1e-6)
        ga, gb = ((q - y) * x).sum() + 0.05 * a, (q - y).sum()
        haa, hab, hbb = (w * x * x).sum() + 0.05, (w * x).sum(), w.sum() + 1e-6
        det = haa * hbb - hab * hab + 1e-12
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, abs(da), abs(db))
        a, b = a - da / size, b - db / size
    return float(a / spread), float(b - a * mean / spread)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """A model from a bounded sample of labelled documents outside the held-out fold, trained in one task."""
    known = labels.where(~held_out()).groupBy("doc_id").agg(F.max(label).alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    known = kept(known, "labels")
    ids = sample(known, "y", 1, POSITIVES, "toxic").unionByName(sample(known, "y", 0, NEGATIVES, "toxic"))
    ids = kept(ids, "sample")
    # The sample is bounded by its two parameters, so it may be sent to every task.
    rows = docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(ids), "doc_id")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "text"]).drop_duplicates("doc_id")
        model = train([t.encode() for t in frame["text"]], frame["y"].to_numpy(np.int64))
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    found = kept(rows.withColumn("task", F.lit(1)).groupBy("task").applyInPandas(one, "model binary"), "model").first()
    return pickle.loads(found["model"]) if found else train([], np.zeros(0, np.int64))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with `score`, `predicted` (1 if the score reaches the threshold) and `worst_word`, where its worst window begins."""
    names = [c for c in docs.columns if c not in ("score", "predicted", "worst_word")]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, worst = text_scores(tokens.raw(batch["text"]), sent.value)
            more = [pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(worst)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *more], names=[*names, "score", "predicted", "worst_word"])

    return rows.mapInArrow(run, f"{fields}, score double, predicted int, worst_word bigint")


def text_scores(parts: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray]:
    out, worst = np.zeros(len(parts)), np.zeros(len(parts), np.int64)
    for at, block in tokens.blocks(parts, tokens.LETTER):
        if model.params is None:
            out[at : at + block.texts] = gru.sigmoid(model.offset) if np.isfinite(model.offset) else float(model.offset > 0)
            continue
        reader = Reader(block, model.hashes)
        logits = reader.logits(model.params)
        order = np.lexsort((reader.start, -logits, reader.text))
        first = order[np.searchsorted(reader.text[order], np.arange(block.texts))]
        out[at : at + block.texts] = gru.sigmoid(model.slope * logits[first].astype(np.float64) + model.offset)
        worst[at : at + block.texts] = reader.start[first] - block.first
    return out, worst
