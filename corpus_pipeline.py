"""From raw documents to a training mix, in stages that each write and reread a table.

Each stage takes (spark, docs, sf_dir) and returns the columns of `docs`, the last one `copies` as well. Null
and empty texts pass through every stage unless their source's share leaves them out.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlens.llm import decontaminate, line_dedup, mixing, ngram_join, toxicity
from tierlens.llm.store import kept, table

#: No SQL: the first stage trains a network.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    rows = _packed(docs)
    model = toxicity.fit(rows, table(spark, sf_dir, "labels"))
    return _unpacked(toxicity.score(rows, model).where("predicted = 0"), docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every repeated line only in the document with the smallest id."""
    return _measured(_unpacked(line_dedup.dedup_lines(_packed(docs)), docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; of several such rows, one.

    Rows are numbered in the job that writes them, so every later job reads the same numbers.
    """
    rows = kept(_packed(docs).withColumn("row", F.monotonically_increasing_id()), "rows")
    found = ngram_join.ngram_join(rows.select(F.col("row").alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("of"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    groups = kept(rows.select("row", "doc_id").join(found, "row"), "groups")
    stay = kept(groups.groupBy("of").agg(first).select("of", F.col("first.row").alias("stays")), "stay")
    # Far fewer rows go than stay, so texts meet the former.
    gone = groups.join(stay, F.col("row") == F.col("stays"), "left_anti").select("row")
    return _unpacked(rows.join(kept(gone, "gone"), "row", "left_anti"), docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that benchmark items share with them."""
    found = decontaminate.find_leaks(_packed(docs), table(spark, sf_dir, "benchmark"), remove=True)
    return _measured(_unpacked(found, docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how often it does (`copies`)."""
    mixed = mixing.mix(mixing.measured(_packed(docs))).where("copies > 0")
    return _unpacked(mixed, [c for c in docs.columns if c != "copies"], "copies")


def _packed(docs: DataFrame) -> DataFrame:
    """`doc_id`, `text`, `source` and all columns but the text in one, whose names then meet no other."""
    return docs.select("doc_id", "text", "source", F.struct(*[c for c in docs.columns if c != "text"]).alias("_rest"))


def _unpacked(rows: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """The columns of the documents as they were, and `more` behind them."""
    own = [F.col("text") if c == "text" else F.col(f"_rest.`{c}`") for c in columns]
    return rows.select(*own, *more)


def _measured(docs: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint"))
    return docs


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name)
    return docs
