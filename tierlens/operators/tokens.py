"""True token counts of texts for a byte-pair vocabulary, dictionary first.

Texts are split into pieces by a pattern, natively. A task encodes each distinct piece of a batch once, by a merge loop
over its bytes, remembers the short ones, and adds up the pieces of a text where it lies. So the slow step grows
with the number of distinct pieces, and only a count per text is shuffled. The vocabulary is a file of tokens and
ranks, whose place is a parameter.
"""

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the pattern that cuts texts into pieces for this kind of vocabulary.
PIECES = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A larger vocabulary file is refused, as every task holds it.
VOCABULARY_BYTES = 64 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their merge ranks from lines of base64 and a number."""
    if os.path.getsize(path) > VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary of more than {VOCABULARY_BYTES} bytes: {path}")
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of a piece: of all neighbours that form a token, those of least rank merge, the left ones first."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], len(ranks)), i) for i in range(len(parts) - 1))
        if rank == len(ranks):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


LONG = 256


def n_tokens(piece: bytes, ranks: dict[bytes, int]) -> int:
    """How many tokens a piece has. Long pieces use a list of neighbours by rank in place of repeated scans."""
    if len(piece) <= LONG:
        return len(merged(piece, ranks))
    end = len(piece)
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))
    stop, alive = list(range(1, end + 1)), [True] * end
    none = len(ranks)
    heap = [(r, i, i + 2) for i in range(end - 1) if (r := ranks.get(piece[i : i + 2], none)) < none]
    heapq.heapify(heap)
    count = end
    while heap:
        _, i, to = heapq.heappop(heap)
        if not alive[i] or after[i] >= end or stop[after[i]] != to:
            continue
        gone = after[i]
        alive[gone] = False
        stop[i], after[i] = to, after[gone]
        if after[i] < end:
            before[after[i]] = i
        count -= 1
        for left in (before[i], i):
            if left >= 0 and after[left] < end:
                right = stop[after[left]]
                if (r := ranks.get(piece[left:right], none)) < none:
                    heapq.heappush(heap, (r, left, right))
    return count


#: A task remembers so many pieces of at most so many bytes, then begins anew.
KNOWN, KNOWN_BYTES = 1 << 18, 64


def piece_tokens(pieces: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """`_of`, `tokens` of rows of `_of` and `pieces`, an array: the tokens of all its pieces."""
    sent = pieces.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}

        def count(piece: bytes) -> int:
            n = known.get(piece)
            if n is None:
                n = n_tokens(piece, sent.value)
                if len(piece) <= KNOWN_BYTES:
                    known[piece] = n
            return n

        for batch in batches:
            if len(known) > KNOWN:
                known.clear()
            coded = batch.column(1).flatten().dictionary_encode()
            counts = np.array([count(p) for p in coded.dictionary.cast("binary").to_pylist()], np.int64)
            before = np.concatenate(([0], np.cumsum(counts[coded.indices.to_numpy()])))
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()
            ends = np.cumsum(sizes, dtype=np.int64)
            sums = before[ends] - before[ends - sizes]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64())], names=["_of", "tokens"])

    schema = T.StructType([pieces.schema["_of"], T.StructField("tokens", T.LongType())])
    return pieces.select("_of", "pieces").mapInArrow(run, schema)


def count_tokens(df: DataFrame, column: str, ids, ranks: dict[bytes, int], name: str = "tokens", pattern: str = PIECES) -> DataFrame:
    """(ids, `name`): the tokens of all texts of an id together; 0 for null and empty ones."""
    pieces = F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0))
    counted = piece_tokens(df.select(F.struct(*ids).alias("_of"), pieces.alias("pieces")), ranks)
    return counted.groupBy("_of").agg(F.sum("tokens").alias(name)).select("_of.*", name)
