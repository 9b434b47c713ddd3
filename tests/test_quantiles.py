"""Order statistics by refined histograms against sorted values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierlens.operators import quantiles


def exact(values, q):
    values = sorted(v for v in values if v is not None and not math.isnan(v))
    return float(np.quantile(values, q)) if values else None


@pytest.mark.parametrize("buckets,small", [(16, 20), (1024, 20_000)])
def test_against_sorted_values(spark, buckets, small):
    rng = random.Random(buckets)
    columns = {
        "same": [5.0] * 300,
        "ties": [float(rng.choice([1, 2, 2, 3, 1000])) for _ in range(300)],
        "tails": [rng.choice([-1, 1]) * math.exp(rng.uniform(-300, 300)) for _ in range(300)],
        "near": [1.0 + i * 2.0**-52 for i in range(300)],
        "gaps": [rng.choice([None, math.nan, 0.5, 7.25]) for _ in range(300)],
        "none": [None] * 300,
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(3)
    at = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    got = quantiles.exact_quantiles(df, list(columns), at, buckets, small)
    for c, values in columns.items():
        for q in at:
            want = exact(values, q)
            assert got[c, q] == (want if want is None else pytest.approx(want, rel=1e-12)), (c, q)


def test_one_value_holds_a_third_of_many_distinct_ones(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 777.0).otherwise(F.col("id") * 1.5).alias("v"))
    values = [777.0 if i % 3 == 0 else i * 1.5 for i in range(60_000)]
    got = quantiles.exact_quantiles(df, ["v"], [0.01, 0.25, 0.5, 0.75], small=100)
    assert got == {("v", q): pytest.approx(exact(values, q)) for q in (0.01, 0.25, 0.5, 0.75)}


def test_empty_table(spark):
    assert quantiles.exact_quantiles(spark.range(0), ["id"], [0.5]) == {("id", 0.5): None}
