"""Name search by an index of trigrams: what a pattern must contain selects the candidates, the pattern decides.

Postings are written in order of trigram, so a search reads the row groups of its own trigrams. A pattern that must
contain none, or that is written in a way not known here, is tried on every name.
"""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .marts import product_search

GRAM = 3
#: Alternatives of a pattern that are followed up; a pattern with more is tried on every name.
MOST = 32


def _ways(parsed) -> list[list[str | None]] | None:
    """What each alternative of a parsed pattern must contain in a row: pieces of text, None where anything may stand."""
    ways: list[list[str | None]] = [[]]
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [[chr(value)]]
        elif name == "SUBPATTERN":
            more = _ways(value[3])
        elif name == "BRANCH":
            parts = [_ways(p) for p in value[1]]
            more = None if None in parts else [w for p in parts for w in p]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            inner = _ways(value[2])
            more = None if inner is None else [[*w, None] for w in inner]
        elif name == "AT":
            more = [[]]
        else:
            more = [[None]]
        if more is None or len(ways) * len(more) > MOST:
            return None
        ways = [[*a, *b] for a in ways for b in more]
    return ways


def required_grams(pattern: str) -> list[list[str]] | None:
    """For each alternative of a pattern the trigrams that a name must have; None if any name may match."""
    try:
        ways = _ways(re._parser.parse(pattern))
    except re.error:
        return None
    if ways is None:
        return None
    out = []
    for way in ways:
        runs = "".join("\0" if piece is None else piece for piece in way).lower().split("\0")
        grams = sorted({run[i : i + GRAM] for run in runs for i in range(len(run) - GRAM + 1)})
        if not grams:
            return None
        out.append(grams)
    return out


def grams(name: Column) -> Column:
    low = F.lower(name)
    places = F.sequence(F.lit(1), F.length(low) - GRAM + 1)
    cut = F.transform(places, lambda i: F.substring(low, i, F.lit(GRAM)))
    return F.when(F.length(low) >= GRAM, F.array_distinct(cut))


def write_index(products: DataFrame, folder: str) -> None:
    """Postings (gram, product_id), each once, in order of gram."""
    rows = products.select(F.explode(grams(F.col("product_name"))).alias("gram"), "product_id").distinct()
    rows.repartitionByRange("gram").sortWithinPartitions("gram", "product_id").write.mode("overwrite").parquet(folder)


def candidates(postings: DataFrame, pattern: str) -> DataFrame | None:
    """`product_id` of names that have all trigrams of some alternative; None if that is every name."""
    wanted = required_grams(pattern)
    if wanted is None:
        return None
    every = sorted({g for way in wanted for g in way})
    rows = postings.where(F.col("gram").isin(every)).groupBy("product_id").agg(F.collect_set("gram").alias("has"))
    fits = [F.size(F.array_except(F.array(*[F.lit(g) for g in way]), "has")) == 0 for way in wanted]
    return rows.where(reduce(Column.__or__, fits)).select("product_id")


def indexed_search(products: DataFrame, postings: DataFrame, pattern: str | None) -> DataFrame:
    """The rows of `marts.product_search`, with the pattern tried on the index's candidates only."""
    found = candidates(postings, pattern) if pattern else None
    rows = products if found is None else products.join(found, "product_id", "left_semi")
    return product_search(rows, pattern)


def search_share(products: DataFrame, postings: DataFrame, pattern: str) -> DataFrame:
    """(pattern, names, candidates, matches): how many names the pattern is tried on."""
    found = candidates(postings, pattern)
    named = products.where("product_name IS NOT NULL")
    tried = named if found is None else named.join(found, "product_id", "left_semi")
    fits = F.coalesce(F.col("product_name").rlike(f"(?i){pattern}"), F.lit(False))
    counts = tried.agg(F.count("*").alias("candidates"), F.count_if(fits).alias("matches"))
    return named.agg(F.count("*").alias("names")).select(
        F.lit(pattern).alias("pattern"), "names", F.lit(counts.select("candidates").scalar()).alias("candidates"),
        F.lit(counts.select("matches").scalar()).alias("matches"))
