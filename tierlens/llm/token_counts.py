"""Exact histogram of encoded lengths, and totals for every context limit from its suffix sums.

Documents are encoded with a public vocabulary and counted by length. The histogram has a row per
distinct length, so everything after it is small: with `n` documents longer than a limit and `t`
tokens in those that are not, a context of that limit keeps `t + n * limit` tokens.

Defined results: null and empty texts have length 0. Repeated rows count as often as they occur. An
empty table gives an empty histogram. Other columns are not read. Texts are encoded whole.
"""

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import kept

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits text before merging; belongs to the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """`n_tokens` of every text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n_tokens"])

    return docs.select("text").mapInArrow(count, "n_tokens bigint")


def histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """`n_tokens`, `n_docs`: documents of each encoded length."""
    return encoded_lengths(docs, vocabulary).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def totals(counts: DataFrame) -> DataFrame:
    """The histogram with what holds for a context of each of its lengths.

    `docs_up_to`, `tokens_up_to`: documents no longer, and their tokens; `docs_over`: longer ones;
    `truncated_total`: tokens left when every document is cut to this length; `quantile`: the share of
    documents that are no longer. The rows are one per distinct length, not per document; lengths are
    summed in blocks first, so that no task holds more than a block or one row per block.
    """
    counts = kept(counts, "histogram")  # read twice below; texts are encoded once
    blocks = counts.withColumn("_block", F.floor(F.sqrt("n_tokens")))
    tokens = F.col("n_tokens") * F.col("n_docs")
    sums = blocks.groupBy("_block").agg(F.sum("n_docs").alias("_n"), F.sum(tokens).alias("_t"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    sums = sums.select(
        "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t0"), F.sum("_n").over(everything).alias("_all"),
    )
    inside = Window.partitionBy("_block").orderBy("n_tokens")
    out = (
        blocks.withColumn("_nb", F.sum("n_docs").over(inside)).withColumn("_tb", F.sum(tokens).over(inside))
        .join(sums, "_block")
        .withColumn("docs_up_to", F.col("_n0") + F.col("_nb"))
        .withColumn("tokens_up_to", F.col("_t0") + F.col("_tb"))
        .withColumn("docs_over", F.col("_all") - F.col("docs_up_to"))
    )
    return out.select(
        "n_tokens", "n_docs", "docs_up_to", "tokens_up_to", "docs_over",
        (F.col("tokens_up_to") + F.col("docs_over") * F.col("n_tokens")).alias("truncated_total"),
        (F.col("docs_up_to") / F.col("_all")).alias("quantile"),
    )


def truncated_total(counts: DataFrame, limits: list[int]) -> DataFrame:
    """`limit`, `total`: tokens left when documents are cut to each of the limits, from the histogram."""
    one = F.explode(F.array(*[F.lit(x).cast("bigint") for x in limits]))
    rows = counts.select("n_tokens", "n_docs", one.alias("limit"))
    return rows.groupBy("limit").agg(F.sum(F.least("n_tokens", "limit") * F.col("n_docs")).alias("total"))
