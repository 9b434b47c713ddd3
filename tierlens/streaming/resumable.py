"""Resumable scoring: a file stream that runs until nothing is left, and a batch form.

A run lives in a folder named by a fingerprint of its settings. Each micro-batch overwrites its own
sub-folder, so a batch that is repeated after a failure replaces what it left behind.
"""

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import anti
from ..sources.io import read_parquet, remove, split_text


def settings_fingerprint(**settings) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


def content_fingerprint(df: DataFrame) -> str:
    """A hash of all rows, whatever their order, together with their number.

    One distributed pass; two tables of equal size with different rows give different values.
    """
    row = F.xxhash64(*df.columns)
    total = F.sum(row.cast("decimal(38,0)"))
    n, x, s = df.agg(F.count("*"), F.bit_xor(row), total).first()
    return settings_fingerprint(rows=n, xor=x, sum=s)


def run_folder(root: str, **settings) -> str:
    """The folder of a run; other settings or other input give another folder."""
    return f"{root.rstrip('/')}/run-{settings_fingerprint(**settings)}"


def score_available(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    transform: Callable[[DataFrame], DataFrame],
    folder: str,
    files_per_batch: int = 64,
    glob: str | None = None,
) -> DataFrame | None:
    """Score every file of `source` not scored before and return all results so far.

    Stopping at any point and calling again continues after the last finished batch; files added
    meanwhile are picked up. None when there has been no input at all.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(split_text(batch)).write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    query = (
        reader.parquet(source)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return read_scored(spark, folder)


def read_scored(spark: SparkSession, folder: str) -> DataFrame | None:
    return read_parquet(spark, f"{folder}/out")


def remaining(df: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key has no result yet."""
    return df if done is None else anti(df, done, [key])


def score_remaining(
    df: DataFrame, transform: Callable[[DataFrame], DataFrame], folder: str, key: str, parts: int = 8
) -> DataFrame:
    """The batch form: score what has no result yet, in `parts` commits.

    What is left is written once, by hash of the key, so each commit reads its own share and a job that
    dies loses the part at hand only. `key` is unique per input row and kept by `transform`.
    """
    spark = df.sparkSession
    todo = f"{folder}/todo"
    left = remaining(df, read_scored(spark, folder), key)
    share = F.pmod(F.xxhash64(key), F.lit(parts)).alias("_part")
    left.select("*", share).write.mode("overwrite").partitionBy("_part").parquet(todo)
    for part in range(parts):
        if (rows := read_parquet(spark, f"{todo}/_part={part}")) is not None:
            transform(rows).write.mode("append").parquet(f"{folder}/out")
    remove(spark, todo)
    return read_scored(spark, folder)


def finish(spark: SparkSession, folder: str) -> None:
    """Remove what a finished run needs for resuming only; its results stay."""
    remove(spark, f"{folder}/checkpoint")
