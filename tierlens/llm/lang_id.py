"""Language identification by unigrams over word pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the
sum over all ways to cut it into pieces, which a forward algorithm gives; expectation maximisation with the
matching backward pass learns the probabilities. A text's score is the sum of its words' logarithms.

Learning takes a bounded sample: `SAMPLE_DOCS` labelled documents of each language outside the held-out
fold, of at most `SAMPLE_CHARS` characters each; a language without texts that short is learned from the
beginnings of its long ones. Prediction reads whole texts.

Defined results: a text that is null or has no letters is `und` with score 0, and so is every text if nothing
is labelled. Equal probabilities go to the language that sorts first. Repeated rows get equal results.
Rows without a language or an id teach nothing. Columns named like the results are replaced.
"""

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .fold import held_out
from .store import kept

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SAMPLE_DOCS, SAMPLE_CHARS = 400, 20_000
ROUNDS, SMOOTH = 4, 0.02
#: Characters with trie columns; others are pieces of one character.
ALPHABET = 160
BLOCK_BYTES, CACHE = 4 << 20, 300_000
UNKNOWN = "und"


class Pieces:
    """The pieces of the vocabulary that are letters, as a trie over character numbers."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {model.id_to_piece(i) for i in range(model.get_piece_size())}
        found = {p for p in found if p.removeprefix(MARK).isalpha() and p == p.lower() or p == MARK}
        uses = pd.Series([c for p in found if len(p) > 1 for c in set(p)]).value_counts()
        dense = sorted(uses.index, key=lambda c: (-uses[c], c))[:ALPHABET]
        singles = sorted({c for p in found for c in p} - set(dense))
        self.width = len(dense) + 1
        #: Character numbers: 1 and up have trie columns; then those that stand alone; 0 is unknown.
        self.chars = np.zeros(0x110000, np.int32)
        for i, c in enumerate([*dense, *singles]):
            self.chars[ord(c)] = i + 1
        self.n_chars = len(dense) + len(singles) + 1
        several = sorted(p for p in found if len(p) > 1 and all(c in set(dense) for c in p))
        #: Piece numbers: a character's number, then pieces of several characters.
        self.count = self.n_chars + len(several)
        self.longest = max(map(len, several), default=1)
        paths: dict[str, int] = {"": 0}
        for p in several:
            for k in range(1, len(p) + 1):
                paths.setdefault(p[:k], len(paths))
        self.next = np.zeros((len(paths), self.width), np.int32)
        self.piece = np.zeros(len(paths), np.int32)  # 0: no piece ends here
        for p, node in paths.items():
            if p:
                self.next[paths[p[:-1]], self.chars[ord(p[-1])]] = node
        for i, p in enumerate(several):
            self.piece[paths[p]] = self.n_chars + i

    def numbers(self, words: list[str]) -> np.ndarray:
        """Character numbers of marked words of one length."""
        length = len(words[0]) + 1
        code = np.array([MARK + w for w in words], f"<U{length}").view(np.uint32).reshape(len(words), length)
        return self.chars[code]

    def steps(self, chars: np.ndarray):
        """(start, end, rows, pieces) of all pieces in the words, by start; `rows` None: all words."""
        n, length = chars.shape
        for i in range(length):
            first = chars[:, i]
            yield i, i + 1, None, first
            rows = np.flatnonzero(first < self.width)
            node = self.next[0, first[rows]]
            for j in range(i + 1, min(length, i + self.longest)):
                live = node > 0
                rows, node = rows[live], node[live]
                c = chars[rows, j]
                on = c < self.width
                rows, node, c = rows[on], node[on], c[on]
                if not len(rows):
                    break
                node = self.next[node, c]
                piece = self.piece[node]
                ends = piece > 0
                if ends.any():
                    yield i, j + 1, rows[ends], piece[ends]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if len(at):
            yield at, [words[i] for i in at.tolist()]


def forward(vocabulary: Pieces, chars: np.ndarray, probs: np.ndarray, keep: bool = False):
    """Logarithm of the summed probability of each word and language; `probs` is (pieces, languages).

    The sums are scaled at every character, so words of any length stay in range.
    """
    n, length = chars.shape
    alpha = np.zeros((length + 1, n, probs.shape[1]))
    alpha[0] = 1
    log, scaled, scales = np.zeros((n, probs.shape[1])), -1, []
    for i, j, rows, piece in vocabulary.steps(chars):
        if i > scaled:  # all pieces that end here are in
            scaled = i
            s = np.maximum(alpha[i], 1e-300)
            log += np.log(s)
            for k in range(i + 1, min(length, i + vocabulary.longest) + 1):
                alpha[k] /= s
            alpha[i] = 1
            if keep:
                scales.append(s)
        if rows is None:
            alpha[j] += alpha[i] * probs[piece]
        else:
            alpha[j, rows] += alpha[i, rows] * probs[piece]
    log += np.log(np.maximum(alpha[length], 1e-300))
    return (log, scales, alpha[length]) if keep else log


def expected(vocabulary: Pieces, chars: np.ndarray, probs: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words that occur `weight` times; `probs` of one language."""
    n, length = chars.shape
    steps = list(vocabulary.steps(chars))
    # The words here are short enough for plain sums once each piece is scaled up by a fixed factor per character.
    lift = 50.0
    alpha, beta = np.zeros((length + 1, n)), np.zeros((length + 1, n))
    alpha[0] = beta[length] = 1
    everyone = np.arange(n)
    for i, j, rows, piece in steps:
        at = everyone if rows is None else rows
        alpha[j, at] += alpha[i, at] * probs[piece] * lift ** (j - i)
    for i, j, rows, piece in reversed(steps):
        at = everyone if rows is None else rows
        beta[i, at] += beta[j, at] * probs[piece] * lift ** (j - i)
    out = np.zeros(len(probs))
    whole = weight / np.maximum(alpha[length], 1e-300)
    for i, j, rows, piece in steps:
        at = everyone if rows is None else rows
        np.add.at(out, piece, alpha[i, at] * probs[piece] * lift ** (j - i) * beta[j, at] * whole[at])
    return out


def learn(vocabulary: Pieces, words: list[str], counts: np.ndarray, rounds: int = ROUNDS, smooth: float = SMOOTH) -> np.ndarray:
    """Piece probabilities of one language by expectation maximisation, with a little for every piece."""
    groups = [(vocabulary.numbers(w), counts[at]) for at, w in by_length(words)]
    probs = np.full(vocabulary.count, 1 / vocabulary.count)
    for _ in range(rounds):
        used = sum((expected(vocabulary, c, probs, n.astype(float)) for c, n in groups), np.zeros(vocabulary.count))
        probs = (used + smooth) / (used.sum() + smooth * vocabulary.count)
    return probs


def letters(words: list[bytes]) -> list[str]:
    """The letters of each word, lower-case."""
    out = []
    for w in words:
        if w.isascii():
            out.append(w.decode())  # ASCII words are letters only
        else:
            out.append("".join(c for c in w.decode("utf-8", "replace").lower() if c.isalpha()))
    return out


def runs(word: bytes, longest: int) -> list[str]:
    """The runs of letters of a word, lower-case, in pieces of at most `longest`."""
    text = "".join(c if c.isalpha() else " " for c in word.decode("utf-8", "replace").lower())
    return [run[i : i + longest] for run in text.split() for i in range(0, len(run), longest)]


@dataclass
class Model:
    languages: list[str]
    probs: np.ndarray | None  # (pieces, languages)
    path: str


def fit(docs: DataFrame, vocabulary: str = VOCABULARY, per_language: int = SAMPLE_DOCS, longest: int = 64) -> Model:
    """A model from a bounded sample of `docs` (`doc_id`, `text`, `lang`) outside the held-out fold.

    One task per language learns from that language's word counts. Words of more than `longest` letters, as
    whole paragraphs are where no blanks are written, are cut at what is no letter and into pieces that long.
    """
    known = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").where(~held_out())
    known = known.select("doc_id", "lang", (F.length("text") <= SAMPLE_CHARS).alias("_short"))
    # Hashes below a share of about twice the bound are ranked, so no task sees all documents of a language.
    sizes = known.groupBy("lang").agg(F.count_if("_short").alias("_all"), F.count("*").alias("_any"))
    long = (F.col("_all") == 0).alias("_long")
    sizes = kept(sizes.select("lang", F.when(F.col("_all") > 0, F.col("_all")).otherwise(F.col("_any")).alias("_all"), long), "languages")
    digest = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("lang")))
    share = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("double") / (1 << 32)
    ids = known.withColumn("_hash", digest).join(sizes, "lang").where("_short or _long")
    ids = ids.where(share * F.col("_all") < 2 * per_language + 20)
    order = Window.partitionBy("lang").orderBy("_hash", "doc_id")
    ids = ids.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_language)
    ids = kept(ids.select("doc_id", "lang", "_long").distinct(), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch["lang"].to_pylist()
            for at, block in tokens.blocks(tokens.raw(batch["text"]), tokens.LETTER):
                raw = block.words(np.arange(block.count))
                words = [[x] if len(x) <= longest else runs(w, longest) for x, w in zip(letters(raw), raw)]
                rows = pd.DataFrame({"lang": [langs[at + t] for t in block.owner], "word": pd.Series(words, dtype=object)})
                rows = rows.explode("word", ignore_index=True)
                rows = rows[rows["word"].str.len() > 0] if len(rows) else rows
                found = rows.groupby(["lang", "word"]).size().reset_index(name="n")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found["lang"], pa.string()), pa.array(found["word"], pa.string()), pa.array(found["n"], pa.int64())],
                    names=["lang", "word", "n"],
                )

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("word")
        probs = learn(pieces(vocabulary), frame["word"].tolist(), frame["n"].to_numpy())
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "probs": [pickle.dumps(probs.astype(np.float32))]})

    # The sample is bounded by its parameters, so its ids may be sent to every task.
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"])
    rows = rows.where((F.length("text") <= SAMPLE_CHARS) | F.col("_long"))
    words = rows.select("lang", F.substring("text", 1, SAMPLE_CHARS).alias("text")).mapInArrow(count, "lang string, word string, n bigint")
    words = words.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    learned = kept(words.groupBy("lang").applyInPandas(one, "lang string, probs binary"), "model")
    found = sorted((r["lang"], r["probs"]) for r in learned.collect())
    probs = np.stack([pickle.loads(p) for _, p in found], axis=1).astype(np.float64) if found else None
    return Model([lang for lang, _ in found], probs, vocabulary)


class Scorer:
    """Logarithms of word probabilities, remembered by word hash."""

    def __init__(self, model: Model):
        self.model, self.vocabulary = model, pieces(model.path)
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.logs = np.zeros((0, len(self.model.languages) + 1))

    def _new(self, words: list[bytes]) -> np.ndarray:
        """One row per word: a logarithm per language, and whether it has letters."""
        out = np.zeros((len(words), len(self.model.languages) + 1))
        for at, same in by_length(letters(words)):
            if same[0]:
                for i in range(0, len(same), 4096):
                    rows = at[i : i + 4096]
                    out[rows, :-1] = forward(self.vocabulary, self.vocabulary.numbers(same[i : i + 4096]), self.model.probs)
                out[at, -1] = 1
        return out

    def texts(self, block: tokens.Block) -> np.ndarray:
        """Per text: summed logarithms per language, and its number of words with letters."""
        code, distinct = pd.factorize(block.hashes())
        logs = np.empty((len(distinct), self.logs.shape[1]))
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        logs[known] = self.logs[at[known]]
        if (new := np.flatnonzero(~known)).size:
            first = np.empty(len(distinct), np.int64)
            first[code[::-1]] = np.arange(block.count)[::-1]
            logs[new] = self._new(block.words(first[new]))
            if len(self.hashes) + len(new) > CACHE:
                self._forget()
            hashes = np.concatenate((self.hashes, distinct[new]))
            order = np.argsort(hashes)
            self.hashes, self.logs = hashes[order], np.concatenate((self.logs, logs[new]))[order]
        total = np.zeros((block.texts, logs.shape[1]))
        for k in range(logs.shape[1]):
            total[:, k] = np.bincount(block.owner, weights=logs[code, k], minlength=block.texts)
        return total


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `lang_pred` and `score`, its probability among the learned languages."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value) if sent.value.languages else None
        for batch in batches:
            langs, scores = text_languages(tokens.raw(batch["text"]), scorer)
            more = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *more], names=[*names, "lang_pred", "score"])

    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double")


def text_languages(parts: list[bytes], scorer: Scorer | None) -> tuple[list[str], list[float]]:
    if scorer is None:
        return [UNKNOWN] * len(parts), [0.0] * len(parts)
    langs, scores = [], []
    for _, block in tokens.blocks(parts, tokens.LETTER, BLOCK_BYTES):
        total = scorer.texts(block)
        logs, some = total[:, :-1], total[:, -1] > 0
        best = logs.argmax(axis=1)
        share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        langs += [scorer.model.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist())]
        scores += np.where(some, share, 0.0).tolist()
    return langs, scores
