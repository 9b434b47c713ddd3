"""CSV and Parquet in and out, shared work folders, and a cached load."""

import os
import time
import uuid
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import LABEL_COLS, RAW_COLS
from . import csv_ranges

TEXT_PARTS = "spark.tierlens.text.partitions"


def read_reviews_csv(spark: SparkSession, path: str, columns=RAW_COLS) -> DataFrame:
    """Raw reviews with `row_ord`, their place in source order over all files by path.

    A file is read by many tasks, line breaks in fields or not.
    """
    return csv_ranges.read(spark, path, "row_ord", written).select(*columns, "row_ord")


def read_labels_csv(spark: SparkSession, path: str, columns=LABEL_COLS) -> DataFrame:
    """Labels with `label_id` in source order; columns the file lacks come as null."""
    rows = csv_ranges.read(spark, path, "label_id", written)
    picked = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]
    return rows.select("label_id", *picked).withColumn("ordinal", F.col("ordinal").try_cast("double").cast("int"))


#: Bytes of text in a part of a table that is written in order.
PART_BYTES = 64 << 20


def ordered_parts(df: DataFrame, order: str, least: int = 1, part_bytes: int | None = None) -> DataFrame:
    """The table in ranges of `order`, each sorted by it: `least` of them, or as many as its text needs (PART_BYTES)."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") for c, kind in df.dtypes if kind == "string"]
    size = df.agg(F.sum(sum(texts, F.lit(0)))).first()[0] or 0
    return df.repartitionByRange(max(least, -(-size // (part_bytes or PART_BYTES))), order).sortWithinPartitions(order)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_parquet(spark: SparkSession, default: str, env: str | None = None) -> DataFrame | None:
    """The table at the path an environment variable names, else at the default; None if missing."""
    path = os.environ.get(env, default) if env else default
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at the path, on any file system Spark can read."""
    try:
        spark.read.format("binaryFile").load(path).schema
        return True
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def split_text(df: DataFrame, *keys: str) -> DataFrame:
    """The table in as many parts by key as the setting TEXT_PARTS says; untouched if it is not set.

    For tables in few large row groups, which no reader setting can split, so that heavy text work
    uses all cores. Tables in files of usual size need neither the setting nor the shuffle.
    """
    parts = df.sparkSession.conf.get(TEXT_PARTS, None)
    return df.repartition(int(parts), *keys) if parts else df


def write_parquet(df: DataFrame, path: str, partition_by=()) -> None:
    """Overwrite a table; partition it by low-cardinality filter columns if any."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


#: Bytes of a row group in a table for lookups: small, so that one holds few keys.
LOOKUP_GROUP = 1 << 20


def write_lookup(df: DataFrame, path: str, key: str, group_bytes: int = LOOKUP_GROUP) -> None:
    """Overwrite a table laid out for lookups by `key`: sorted by it, in small row groups with bloom filters.

    A lookup reads the row groups whose range holds the key; where ranges overlap, as after appends, those whose
    bloom filter does.
    """
    rows = df.repartitionByRange(key).sortWithinPartitions(key)
    options = {f"parquet.bloom.filter.enabled#{key}": True, "parquet.block.size": group_bytes, "parquet.page.size": 1 << 16}
    rows.write.mode("overwrite").options(**options).parquet(path)


def write_results(cube: DataFrame, products: DataFrame, cube_path: str, products_path: str, partition_by=()):
    """The cube and the product dimension. Partitioning the cube by main category prunes scope filters."""
    write_parquet(cube, cube_path, partition_by)
    write_parquet(products, products_path)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. A session without it is refused."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return shared.rstrip("/")


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the session's shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for held in _stages:
        held.append(path)
    return path


_stages: list[list[str]] = []


@contextmanager
def stages(spark: SparkSession):
    """Folders made inside are removed at the end: put a query's planning and its action into it."""
    held: list[str] = []
    _stages.append(held)
    try:
        yield
    finally:
        _stages.remove(held)
        for path in held:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on any file system Spark can write."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table to the work folder and read it back: lineage ends, and lost tasks reread it."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def listing(spark: SparkSession, path: str) -> tuple[str, int] | None:
    """A fingerprint of a table's files (names, sizes, times) and their bytes; None if there is nothing."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    row = F.xxhash64("path", "length", "modificationTime")
    n, x, total, size = files.agg(F.count("*"), F.bit_xor(row), F.sum(row.cast("decimal(38,0)")), F.sum("length")).first()
    return f"{n}-{x}-{total}", size or 0


class TableCache:
    """Tables kept in memory while their files stay as they are, at most `ttl` seconds and `most_bytes` of files.

    An entry is released when the table's files have changed, when it is too old, when a newer one needs the room,
    and when the cache is closed; `with TableCache(spark) as cache:` closes it.
    """

    def __init__(self, spark: SparkSession, ttl: float = 3600.0, clock=time.monotonic, most_bytes: int = 1 << 30):
        self._spark, self._ttl, self._clock, self._most = spark, ttl, clock, most_bytes
        self._tables: dict[str, tuple[DataFrame, float, str, int]] = {}

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def load(self, path: str) -> DataFrame | None:
        found = listing(self._spark, path)
        held = self._tables.get(path)
        if held and found and held[2] == found[0] and self._clock() - held[1] < self._ttl:
            self._tables[path] = self._tables.pop(path)  # the latest used comes last
            return held[0]
        self.refresh(path)
        df = read_parquet(self._spark, path) if found else None
        if df is None or found[1] > self._most:
            return df
        while self._tables and sum(t[3] for t in self._tables.values()) + found[1] > self._most:
            self.refresh(next(iter(self._tables)))
        self._tables[path] = (df.persist(), self._clock(), *found)
        return df

    def refresh(self, path: str) -> None:
        """Forget a table, so the next load reads storage again."""
        held = self._tables.pop(path, None)
        if held:
            held[0].unpersist()
            self._spark.catalog.refreshByPath(path)

    def close(self) -> None:
        for path in list(self._tables):
            self.refresh(path)
