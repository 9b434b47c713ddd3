"""Tables written to the folder that driver and executors share, and what several operators need."""

from pyspark.sql import DataFrame, SparkSession

from tierlens.sources import io


def kept(df: DataFrame, name: str) -> DataFrame:
    """The table written once and read back: lineage ends, a lost executor costs a reread."""
    return io.written(df, name)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
