"""Connected components of a link table, by alternating stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import kept


def components(links: DataFrame) -> DataFrame:
    """`node`, `label`: every node of the links (`a`, `b`) with the smallest node that it reaches.

    Large stars tie all larger neighbours of a node to its least neighbour, small stars the others. The
    table never grows, and a logarithmic number of rounds leaves one star per component. Each round is
    written, so both sides of its joins are plain shuffles and a node with many links can be split.
    """
    ends = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, seen = kept(ends.distinct(), "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = kept(large.where("u <> v").distinct(), "large")
        least = kept(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = kept(small.unionByName(least.withColumnRenamed("m", "v")).where("u <> v").distinct(), "links")
        state = edges.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
