"""Spelling variants: words one edit apart, and the frequent word that a rare one is a form of.

A permuterm index: each word is marked with a terminator and rotated to every start, so that the text after a
place, the terminator and the text before it stand as one prefix. Rotations are sorted into groups by the prefix
that skips one character, which is the last of the rotation: words in a group that skip a character differ in
it alone, and a word whose whole rotation is that prefix lacks it. One scan of the sorted groups gives each
member its number of neighbours and its best one. A group has one member for each letter and one word without
it, so no group grows with the input, and no pairs are written out. An insertion into a run of equal letters can
be made at several places; it counts at the first place of the run.

Defined results: a null or empty text has no words; a null doc_id counts as the empty string. Rows that repeat a
doc_id count each. Texts of any length are read whole, `PIECE` characters at a time. A word without neighbours
has no form and is its own root. An empty table gives no rows. Other columns are not read.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import kept

LETTERS = "A-Za-zÀ-ÿ"
MIN_CHARS, MIN_COUNT, FACTOR = 7, 2, 10
#: One run in so many, by hash, loses a letter.
LOSE = 31
#: Characters of a text that are split into runs at a time.
PIECE = 1 << 20
#: Distinct words that a task holds before it sends their counts on.
HELD = 400_000
#: Marks the end of a word in a rotation; no word has it.
END = "\0"


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A text in pieces of about `size` characters, cut where no letter stands."""
    gap, at = re.compile(f"[^{LETTERS}]"), 0
    while len(text) - at > size:
        cut = gap.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def text_words(doc_id, text: str, min_chars: int = MIN_CHARS) -> Counter:
    """Counts of a text's words: runs of letters, A-Z lower-cased, one in LOSE of them short of a letter."""
    runs, out = Counter(), Counter()
    found = re.compile(f"[{LETTERS}]{{{min_chars},}}")  # a shorter run only gets shorter
    for piece in pieces(text):
        runs.update(found.findall(piece))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        low = run.encode().lower()  # of bytes: changes A-Z alone
        h = zlib.crc32(low, start)
        if h % LOSE == 0:
            run = low.decode()
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < min_chars:
                continue
            low = run.encode()
        out[low] += n
    return out


def count_words(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """`word`, `n`: the words of all texts that occur often enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def batch_of() -> pa.RecordBatch:
            words = pa.array(list(held), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    held.update(text_words(doc_id, text, min_chars))
                if len(held) > HELD:
                    yield batch_of()
                    held = Counter()
        yield batch_of()

    counted = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def rotations(words: DataFrame) -> DataFrame:
    """`prefix`, `skipped`, `n`: each word's rotations less their last character, and whole ones (`skipped` null)."""
    w, size = F.col("word"), F.length("word")
    turned = lambda left, right: F.concat(F.substring(w, right + 1, size), F.lit(END), F.substring(w, F.lit(1), left))
    places = F.sequence(F.lit(0), size)
    whole = F.transform(places, lambda i: F.struct(turned(i, i).alias("prefix"), F.lit(None).cast("string").alias("skipped")))
    short = F.transform(
        F.filter(places, lambda i: i < size),
        lambda i: F.struct(turned(i, i + 1).alias("prefix"), F.substring(w, i + 1, F.lit(1)).alias("skipped")),
    )
    return words.select("n", F.inline(F.concat(whole, short))).select("prefix", "skipped", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """`word`, `n_near`, `best` (n, word) of every word that has neighbours."""
    spread = rotations(words).repartition("prefix")
    # The word is put together behind the shuffle, from prefix and skipped character.
    before, after = F.substring_index("prefix", END, -1), F.substring_index("prefix", END, 1)
    spread = spread.withColumns({
        "word": F.concat(before, F.coalesce("skipped", F.lit("")), after),
        "first": F.coalesce(F.col("skipped") != F.substring("prefix", -1, 1), F.lit(False)),
    })
    ranked = Window.partitionBy("prefix").orderBy(F.desc("n"), "word")
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct("n", "word")
    groups = spread.select(
        "word", "skipped", "first", F.row_number().over(ranked).alias("place"), F.lead(me).over(ranked).alias("next"),
        F.first(me).over(whole).alias("top"), F.count("*").over(whole).alias("all"),
        F.count("skipped").over(whole).alias("longer"), F.count_if("first").over(whole).alias("firsts"),
    ).where(F.col("all") > 1)
    shorter = (F.col("first") & (F.col("all") > F.col("longer"))).cast("int")
    near = F.when(F.col("skipped").isNull(), F.col("firsts")).otherwise(F.col("longer") - 1 + shorter)
    found = groups.select("word", near.alias("near"), F.when(F.col("place") == 1, F.col("next")).otherwise(F.col("top")).alias("other"))
    best = F.min(F.struct((-F.col("other.n")).alias("n"), F.col("other.word").alias("word")))
    found = found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", F.struct((-F.col("best.n")).alias("n"), F.col("best.word").alias("word")).alias("best"))


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """`word`, `n`, `n_near`, `form`, `form_n`, `root` of every word of a table (`word`, `n`), each once in it.

    `form` is the most frequent neighbour, if it is `factor` times as frequent; `root` the last of the forms.
    """
    words = kept(words.select("word", "n"), "words")
    near = neighbours(words)
    has_form = F.col("best.n") >= factor * F.col("n")
    found = kept(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(has_form, F.col("best.word")).alias("form"), F.when(has_form, F.col("best.n")).alias("form_n"),
    ), "forms")
    roots = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps; counts grow by `factor` at each, so the rounds are few
        roots = kept(roots, "roots")
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if not roots.join(on, "root", "left_semi").limit(1).count():
            break
        roots = roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
