"""Exact top-k search by distributed selection on score histograms.

Queries and candidates are cut into blocks. Every pair of blocks scores all its vectors with one matrix
product, several times: first for a histogram of coarse score buckets per query, whose global sums show
the bucket of each query's kth score, then for finer buckets inside that one, until the kth score itself
is known. A last pass keeps scores above it and, among equal scores, the smallest ids.

A block needs to report only the buckets that hold its own best k scores: the kth score over everything
is at least as high, so lower buckets can't matter.

Defined results: vectors that are null or hold a null or non-finite component take no part. Vectors are
compared with those of the same length only. A candidate with the query's own id is not its candidate.
Of several queries with one id the least vector is used; repeated candidate rows each count. Null ids
take no part. A component or a score that does not fit a long is an error. With fewer than k candidates all are returned; without any the query has no row.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .store import kept

SCALE = 64
CANDIDATES, QUERIES = 4096, 512
#: Buckets of a histogram, as a power of two.
BITS = 6
TOO_LARGE = "a component or score of these vectors does not fit a long"


def whole_numbers(vectors: DataFrame, vec: str = "embedding", key: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """`vec_id`, `v`: vectors as floor(scale * x), without those that take no part."""
    x = F.col(vec)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    rows = vectors.where(x.isNotNull() & finite & F.col(key).isNotNull())

    def whole(e: Column) -> Column:
        y = e.cast("double") * F.lit(scale)
        return F.when(F.abs(y) < 2.0**63, F.floor(y).cast("bigint")).otherwise(F.raise_error(F.lit(TOO_LARGE)).cast("bigint"))

    return rows.select(F.col(key).cast("bigint").alias("vec_id"), F.transform(x, whole).alias("v"))


def _pack(name: str, more: tuple[str, ...] = ()):
    """One row per block: ids, vectors and other whole numbers as bytes."""

    def pack(rows: pa.Table) -> pa.Table:
        n = rows.num_rows
        v = rows.column("v").combine_chunks()
        flat = v.values.to_numpy(zero_copy_only=False)[v.offsets[0].as_py() : v.offsets[-1].as_py()]
        own = {c: rows.column(c).to_numpy().astype(np.int64).tobytes() for c in ("vec_id", *more)}
        cols = {name: rows.column(name)[0].as_py(), "dim": rows.column("dim")[0].as_py(), f"{name}_n": n,
                f"{name}_v": flat.astype(np.int64).tobytes()}
        cols |= {f"{name}_{c}": b for c, b in own.items()}
        return pa.table({k: pa.array([x], pa.binary() if isinstance(x, bytes) else pa.int64()) for k, x in cols.items()})

    extra = "".join(f", {name}_{c} binary" for c in more)
    return pack, f"{name} bigint, dim bigint, {name}_n bigint, {name}_v binary, {name}_vec_id binary{extra}"


def _scores(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of queries, ids of candidates, and all inner products; a candidate with the query's id scores lowest."""
    q_id, c_id = (np.frombuffer(row[f"{s}_vec_id"], np.int64) for s in "qc")
    q, c = (np.frombuffer(row[f"{s}_v"], np.int64).reshape(row[f"{s}_n"], -1) for s in "qc")
    most = _largest(q) * _largest(c) * max(1, q.shape[1])
    same = q_id[:, None] == c_id[None, :]
    if most >= 1 << 63:  # sums of Python's whole numbers, which have no bound
        exact = q.astype(object) @ c.astype(object).T
        exact[same] = 0
        if any(not LOWEST < s < 1 << 63 for s in exact.flat):
            raise OverflowError(TOO_LARGE)
        got = exact.astype(np.int64)
        got[same] = LOWEST
        return q_id, c_id, got
    # Whole numbers below 2**24 (2**53) are exact in single (double) precision.
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    got = (q.astype(kind) @ c.astype(kind).T).astype(np.int64)
    got[same] = LOWEST
    return q_id, c_id, got


def _largest(v: np.ndarray) -> int:
    return max(int(v.max(initial=0)), -int(v.min(initial=0)))


LOWEST = np.iinfo(np.int64).min


def _best(got: np.ndarray, k: int) -> np.ndarray:
    """The kth largest score of every query in this block."""
    n = got.shape[1]
    return np.partition(got, n - k, axis=1)[:, n - k] if n > k else got.min(axis=1, initial=np.iinfo(np.int64).max)


def _histogram(shift: int, above: int, k: int):
    """Counts per query and bucket `score >> shift`, inside its bucket of the level before."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_id, _, got = _scores(row)
                inside = got > LOWEST
                if above < 63:
                    known = np.frombuffer(row["q_prefix"], np.int64)[:, None]
                    inside &= (got >> above) == known
                else:
                    inside &= (got >> shift) >= (np.maximum(_best(got, k), LOWEST + 1) >> shift)[:, None]
                at, col = np.nonzero(inside)
                bucket = got[at, col] >> shift
                order = np.lexsort((bucket, at))
                at, bucket = at[order], bucket[order]
                new = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 0) | (np.diff(bucket) != 0)))) if len(at) else at
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_id[at[new]]), pa.array(bucket[new]), pa.array(np.diff(np.append(new, len(at))))],
                    names=["query_id", "bucket", "n"],
                )

    return count, "query_id bigint, bucket bigint, n bigint"


def _found(k: int):
    """Scores of at least the kth one; a block reports its own best k, equal ones by id."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_id, c_id, got = _scores(row)
                least = np.maximum(np.frombuffer(row["q_prefix"], np.int64), _best(got, k))
                at, col = np.nonzero((got >= least[:, None]) & (got > LOWEST))
                score, ids = got[at, col], c_id[col]
                order = np.lexsort((ids, -score, at))
                at, score, ids = at[order], score[order], ids[order]
                place = np.arange(len(at)) - np.searchsorted(at, at)
                own = place < k
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_id[at[own]]), pa.array(ids[own]), pa.array(score[own])], names=["query_id", "vec_id", "score"]
                )

    return find, "query_id bigint, vec_id bigint, score bigint"


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score` from `vec_id` and whole-number vectors `v`."""
    rows = kept(vectors.withColumn("dim", F.size("v").cast("bigint")), "vectors")
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "dim")).alias("m")).select("vec_id", "m.*")
    n, n_asked, most = rows.select(
        F.count("*"), F.count_if(is_query), F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    ).first()
    c_blocks, q_blocks = -(-n // candidates) or 1, -(-n_asked // queries) or 1
    # A score is at most the larger squared length of the two vectors.
    top = min(63, max(1, int((most or 0) * (1 + 1e-9))).bit_length())

    all_c, all_q = (F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(x - 1).cast("bigint"))) for x in (c_blocks, q_blocks))
    pack, kind = _pack("c")
    blocks = rows.withColumn("c", F.pmod(F.xxhash64("vec_id"), F.lit(c_blocks))).groupBy("c", "dim").applyInArrow(pack, kind)
    blocks = kept(blocks, "blocks").withColumn("q", all_q)
    asked = asked.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)))

    def scored(what, prefix: DataFrame | None) -> DataFrame:
        side = asked.withColumn("prefix", F.lit(0).cast("bigint"))
        if prefix is not None:
            side = asked.join(prefix, F.col("vec_id") == F.col("query_id"), "left").drop("query_id")
            side = side.withColumn("prefix", F.coalesce("prefix", F.lit(LOWEST)))
        pack, kind = _pack("q", ("prefix",))
        side = side.select("q", "dim", "vec_id", "v", "prefix").groupBy("q", "dim").applyInArrow(pack, kind)
        side = side.withColumn("c", all_c)
        fn, schema = what
        return blocks.join(side, ["c", "q", "dim"]).mapInArrow(fn, schema)

    shift, above, prefix = max(0, top + 1 - BITS), 63, None
    order = Window.partitionBy("query_id").orderBy(F.desc("bucket"))
    while True:
        counts = scored(_histogram(shift, above, k), prefix).groupBy("query_id", "bucket").agg(F.sum("n").alias("n"))
        need = F.lit(k) if prefix is None else F.col("need")
        if prefix is not None:
            counts = counts.join(prefix.select("query_id", "need"), "query_id")
        counts = counts.withColumn("upto", F.sum("n").over(order)).withColumn("need", need)
        # The highest bucket with which the running count reaches k holds the kth score.
        cut = counts.where("upto >= need").groupBy("query_id").agg(
            F.max(F.struct("bucket", (F.col("need") - F.col("upto") + F.col("n")).alias("need"))).alias("c")
        )
        prefix = kept(cut.select("query_id", F.col("c.bucket").alias("prefix"), "c.need"), "kth")
        if shift == 0:
            break
        above, shift = shift, max(0, shift - BITS)
    found = scored(_found(k), prefix.select("query_id", "prefix"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
