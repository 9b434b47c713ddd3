"""A cube kept up to date: each batch of reviews adds its counts and takes back those of the reviews it replaces.

A folder holds, by version, what each review counts (`facts`), which reviews came (`reviews`), the change of the cube
(`deltas`), from time to time the whole of it (`snapshots`), and a row for each finished batch (`commits`), written
last. A batch that is repeated after a failure overwrites what it left behind, one that was finished is skipped, so
every batch counts once. The work of a batch grows with its reviews and theirs before, not with the cube.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CUBE_KEYS, POLARITIES
from ..operators.cube import with_shares
from ..operators.skew import keep_first, lookup, semi
from ..sources.io import read_parquet

MEASURES = (*POLARITIES, "spans")
#: After so many versions the cube is written whole, which bounds what a reader adds up.
SNAPSHOT_EVERY = 8


def _save(df: DataFrame, folder: str, table: str, version: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{table}/version={version}")


def _before(spark: SparkSession, folder: str, table: str, version: int) -> DataFrame | None:
    found = read_parquet(spark, f"{folder}/{table}")
    return None if found is None else found.where(F.col("version") < version)


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The finished versions, one small number for each batch."""
    found = read_parquet(spark, f"{folder}/commits")
    return [] if found is None else sorted(r[0] for r in found.select("version").distinct().collect())


def _added(parts: list[DataFrame], keys) -> DataFrame:
    rows = reduce(DataFrame.unionByName, [p.select(*keys, *MEASURES) for p in parts])
    return rows.groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in MEASURES])


def apply_batch(
    spark: SparkSession, folder: str, batch: DataFrame, version: int, transform: Callable[[DataFrame], DataFrame],
    key: str, order: str, keys=CUBE_KEYS, snapshot_every: int = SNAPSHOT_EVERY,
) -> bool:
    """Bring the cube to `version`; whether there was anything to do.

    `transform` makes spans (`key`, cube keys, `polarity`) of reviews. Of several rows of a review in the batch the
    last by `order` counts. A review that comes again replaces itself, also by one without any span.
    """
    done = versions(spark, folder)
    if version in done:
        return False
    _save(keep_first(batch, [key], [F.desc(order)]), folder, "input", version)
    reviews = spark.read.parquet(f"{folder}/input/version={version}")
    spans = transform(reviews).where("polarity IS NOT NULL")
    counts = [F.count_if(F.col("polarity") == p).alias(p) for p in POLARITIES]
    _save(spans.groupBy(key, *keys).agg(*counts, F.count("*").alias("spans")), folder, "facts", version)
    _save(reviews.select(key), folder, "reviews", version)
    now = spark.read.parquet(f"{folder}/facts/version={version}")
    ids = spark.read.parquet(f"{folder}/reviews/version={version}")
    parts, seen = [now], _before(spark, folder, "reviews", version)
    if done and seen is not None:
        last = semi(seen, ids, [key]).groupBy(key).agg(F.max("version").alias("version"))
        old = lookup(_before(spark, folder, "facts", version), last, [key, "version"], "inner")
        parts.append(old.withColumns({c: -F.col(c) for c in MEASURES}))
    changed = " OR ".join(f"{c} <> 0" for c in MEASURES)
    _save(_added(parts, keys).where(changed), folder, "deltas", version)
    if (len(done) + 1) % snapshot_every == 0:
        _save(_total(spark, folder, [*done, version], keys), folder, "snapshots", version)
    _save(spark.range(1).select(F.lit(version).alias("of")), folder, "commits", version)
    return True


def _total(spark: SparkSession, folder: str, done: list[int], keys) -> DataFrame:
    """The counts of all finished versions: the last whole cube and the changes since."""
    last, parts = -1, []
    whole = read_parquet(spark, f"{folder}/snapshots")
    if whole is not None:
        found = [r[0] for r in whole.select("version").distinct().collect() if r[0] in done]
        if found:
            last = max(found)
            parts.append(spark.read.parquet(f"{folder}/snapshots/version={last}"))
    later = [v for v in done if v > last]
    if later:
        parts.append(spark.read.parquet(f"{folder}/deltas").where(F.col("version").isin(later)))
    return _added(parts, keys).where("spans <> 0")


def read_cube(spark: SparkSession, folder: str, version: int | None = None, keys=CUBE_KEYS, keep_null_keys: bool = False) -> DataFrame | None:
    """The cube after the last finished batch, or after `version`; None before the first."""
    done = [v for v in versions(spark, folder) if version is None or v <= version]
    if not done:
        return None
    rows = _total(spark, folder, done, keys).drop("spans")
    return with_shares(rows if keep_null_keys else rows.na.drop(subset=list(keys)))


def maintain(
    spark: SparkSession, source: str, schema: T.StructType, transform: Callable[[DataFrame], DataFrame], folder: str, key: str,
    order: str, keys=CUBE_KEYS, files_per_batch: int = 64, snapshot_every: int = SNAPSHOT_EVERY, glob: str | None = None,
) -> DataFrame | None:
    """Apply every file of `source` not applied before, some files a batch, and return the cube."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)

    def write(batch: DataFrame, batch_id: int) -> None:
        apply_batch(spark, folder, batch, batch_id, transform, key, order, keys, snapshot_every)

    query = (
        reader.parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return read_cube(spark, folder, keys=keys)
