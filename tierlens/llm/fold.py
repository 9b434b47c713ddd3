"""Which documents a model may learn from, and bounded samples of them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS, HELD = 4, 2


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that no model learns from. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def sample(rows: DataFrame, label: str, value, n: int, seed: str) -> DataFrame:
    """At most `n` rows with this label, the same ones at every run; `rows` has `doc_id`."""
    return rows.where(F.col(label) == F.lit(value)).orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(seed))), "doc_id").limit(n)
