"""Line dedup: a line that several documents hold stays only in the one with the smallest doc_id.

Lines are normalised, hashed to 128 bits and counted per hash; hashes over the threshold find their
places again, and every text is put together from its other lines by position.

Defined results: a null or empty text is one empty line, never dropped (its key is too short). Rows
that share a doc_id are one document for counting, and each keeps or loses its lines alike. A null
doc_id counts as a document after all others. Other columns pass through under their own names.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import kept

MIN_CHARS = 10
MIN_DOCS = 2
#: Blank characters at both ends of a line, not part of its key.
BLANKS = b" \t\n\x0b\x0c\r"
#: What a null doc_id counts as; the largest, so that any other document keeps the line.
NO_ID = (1 << 63) - 1


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()  # bytes.lower() changes A-Z alone


def _long(key: bytes, min_chars: int) -> bool:
    if len(key) < min_chars:
        return False
    return len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars


def _hash(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """`key`, `doc_id`, `of` of every long line, each once per document and batch.

    `of` tells rows without an id apart by their text, so that what is gathered for one is bounded by its lines.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple[bytes, int, str], None] = {}
            for i, t, of in zip(batch.column(0).to_pylist(), batch.column(1).cast("binary").to_pylist(), batch.column(2).to_pylist()):
                for line in (t or b"").split(b"\n"):
                    if _long(key := line_key(line), min_chars):
                        out[_hash(key), i, of] = None
                if len(out) > 200_000:
                    yield _pairs(out)
                    out = {}
            yield _pairs(out)

    ids = F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id")
    return docs.select(ids, "text", _of().alias("of")).mapInArrow(keys, "key binary, doc_id bigint, of string")


def _of() -> Column:
    return F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")))).otherwise(F.lit(""))


def repeated_lines(keys: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """`key`, `keeper`: hashes of lines in at least `min_docs` documents, with the smallest doc_id."""
    if min_docs == 2:  # two different documents show in the extremes: a row per key and task is shuffled
        found = keys.groupBy("key").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("_top"))
        return found.where("_top > keeper").drop("_top")
    found = keys.select("key", "doc_id").distinct().groupBy("key").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("_n"))
    return found.where(F.col("_n") >= min_docs).drop("_n")


def _pairs(out) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())],
        names=["key", "doc_id", "of"],
    )


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, columns: tuple[str, str, str] = (
        "n_lines", "n_dropped", "kept_sha256"),
) -> DataFrame:
    """`docs` with `text` less its repeated lines, and line counts and a digest of the new text.

    The columns named in `columns` replace columns of the same name.
    """
    keys = line_keys(docs, min_chars)
    # Written first, so that both sides of the join are plain shuffles and a hot line can be split.
    repeated = kept(repeated_lines(keys, min_docs), "lines")
    # A document needs only the hashes that it loses: one short row per document goes back to its text.
    lost = keys.join(repeated, "key").where("doc_id > keeper")
    lost = lost.groupBy("doc_id", "of").agg(F.collect_set("key").alias("_lost"))
    lost = lost.withColumnsRenamed({"doc_id": "_id", "of": "_of"})
    rows = docs.drop(*columns).withColumns({"_id": F.coalesce("doc_id", F.lit(NO_ID)), "_of": _of()})
    rows = rows.join(lost, ["_id", "_of"], "left").drop("_id", "_of")
    names = [f for f in rows.schema.names if f not in ("text", "_lost")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    n_lines, n_dropped, digest = columns

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new_texts, lines_n, dropped_n, digests = [], [], [], []
            for t, gone in zip(batch["text"].cast("binary").to_pylist(), batch["_lost"].to_pylist()):
                lines = (t or b"").split(b"\n")
                stay = lines
                if gone:
                    gone = set(gone)
                    stay = [x for x in lines if not _long(k := line_key(x), min_chars) or _hash(k) not in gone]
                new = b"\n".join(stay)
                new_texts.append(None if t is None else new)
                lines_n.append(len(lines))
                dropped_n.append(len(lines) - len(stay))
                digests.append(hashlib.sha256(new).hexdigest())
            more = [
                pa.array(new_texts, pa.binary()).cast(pa.string()), pa.array(lines_n, pa.int64()),
                pa.array(dropped_n, pa.int64()), pa.array(digests, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch[f] for f in names), *more], names=[*names, "text", n_lines, n_dropped, digest]
            )

    extra = f"text string, `{n_lines}` bigint, `{n_dropped}` bigint, `{digest}` string"
    return rows.mapInArrow(build, f"{fields}, {extra}")

