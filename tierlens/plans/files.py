"""Queries that write a table, read it back through a source, and compare."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import RAW_COLS
from ..operators import checks, marts, reviews
from ..sources import io
from . import bridge as b
from .curate import LABELLED
from .registry import query

_RAW = ", ".join(RAW_COLS)


@query(b.ctes(b.RAW) + f"SELECT row_number() OVER (ORDER BY row_ord) - 1 AS row_ord, {_RAW} FROM raw")
def reviews_csv(spark, sf_dir):
    """Reviews as several CSV files of unequal size, whose order is theirs by name."""
    raw, path = b.raw_reviews(spark, sf_dir), io.work_folder(spark, "reviews")
    io.ordered_parts(raw, "row_ord", 4).select(*RAW_COLS).write.option("header", True).option("escape", '"').csv(path)
    return io.read_reviews_csv(spark, path)


@query(b.ctes(*LABELLED) + """
SELECT row_number() OVER (ORDER BY label_id) - 1 AS label_id, text, span, polarity, ordinal,
  NULL::VARCHAR AS polarity_predicted FROM gold""")
def labels_csv(spark, sf_dir):
    """Labels without predictions as CSV."""
    rows, path = b.gold_table(spark, sf_dir), io.work_folder(spark, "labels")
    rows = io.ordered_parts(rows.select("label_id", "text", "span", "polarity", "ordinal"), "label_id", 3)
    io.write_csv(rows.select("text", "span", "polarity", "ordinal"), path)
    return io.read_labels_csv(spark, path).select("label_id", "text", "span", "polarity", "ordinal", "polarity_predicted")


def _stored(spark, sf_dir) -> str:
    """The cube and the product dimension in the work folder."""
    folder = io.work_folder(spark, "results")
    products = reviews.product_dimension(b.clean(spark, sf_dir))
    io.write_results(b.span_cube(spark, sf_dir), products, f"{folder}/cube", f"{folder}/products", ["main_category"])
    return folder


@query(b.ctes(b.SPANS, b.CUBE) + "SELECT * FROM cube")
def stored_cube(spark, sf_dir):
    """The cube through the cached load, after the input gate."""
    folder = _stored(spark, sf_dir)
    with io.TableCache(spark) as cache:
        cube, products = cache.load(f"{folder}/cube"), cache.load(f"{folder}/products")
        checks.require_data(cube, products)
    return cube


@query(b.ctes(b.SPANS, b.CUBE) + """
SELECT (SELECT count(*) FROM cube WHERE main_category = 'PROMO') AS before_rows, count(*) AS rows, sum(total)::BIGINT AS total,
  true AS same_while_unchanged, 0 AS left_in_memory FROM cube""")
def refreshed_cube(spark, sf_dir):
    """What a cached load sees of a table that is written again between two loads, and what the cache leaves behind."""
    cube, path = b.span_cube(spark, sf_dir), io.work_folder(spark, "refreshed")
    held = spark.sparkContext._jsc.sc().getPersistentRDDs
    began = held().size()
    with io.TableCache(spark) as cache:
        io.write_parquet(cube.where("main_category = 'PROMO'"), path)
        first = cache.load(path)
        before, same = first.count(), cache.load(path) is first
        io.write_parquet(cube, path)
        now = cache.load(path)
        count, total = now.agg(F.count("*"), F.sum("total")).first()
    row = (before, count, total, same, held().size() - began)
    return spark.createDataFrame([row], "before_rows bigint, rows bigint, total bigint, same_while_unchanged boolean, left_in_memory int")


@query(b.ctes(b.RAW, b.PARSED, b.CLEAN) + """
SELECT product_id, product_name, rating FROM clean QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY row_ord) = 1""")
def stored_products(spark, sf_dir):
    return io.read_parquet(spark, f"{_stored(spark, sf_dir)}/products").select("product_id", "product_name", "rating")


@query(b.ctes(b.RAW, b.PARSED, b.CLEAN) + "SELECT row_ord, product_id, clean_review FROM clean ORDER BY row_ord LIMIT 25")
def first_reviews(spark, sf_dir):
    """A smoke run's input: the first reviews in source order."""
    return reviews.first_rows(b.clean(spark, sf_dir), 25).select("row_ord", "product_id", "clean_review")


@query(b.ctes(b.SPANS, b.CUBE) + """
SELECT * FROM cube WHERE product_id = (SELECT max(product_id) FROM cube)""")
def product_lookup(spark, sf_dir):
    """One product's rows of a cube laid out for lookups."""
    path = io.work_folder(spark, "lookup")
    io.write_lookup(b.span_cube(spark, sf_dir), path, "product_id")
    cube = spark.read.parquet(path)
    return marts.product_row(cube, cube.agg(F.max("product_id")).first()[0])


@query(b.ctes(b.SPANS, b.CUBE) + """
SELECT m AS main_category, count(product_id) AS rows FROM (VALUES ('PROMO'), ('NONE SUCH'), ('LARGE')) v(m)
LEFT JOIN cube ON main_category = m GROUP BY m""")
def empty_guard(spark, sf_dir):
    """Rows per category, where a category without rows is told apart before anything is shown."""
    cube = b.span_cube(spark, sf_dir)

    def rows(name: str) -> DataFrame:
        found = checks.or_none(marts.cascade_filter(cube, name))
        n = F.lit(0).cast("bigint") if found is None else F.count("*")
        of = spark.range(1).select(n.alias("rows")) if found is None else found.agg(n.alias("rows"))
        return of.select(F.lit(name).alias("main_category"), "rows")

    return reduce(DataFrame.unionByName, [rows(x) for x in ("PROMO", "NONE SUCH", "LARGE")])
