import math
import random

import pytest
from pyspark.sql import functions as F

from oeeforge.functions.columns import exact_mean, exact_sum


def means(spark, groups, parts):
    rows = [(k, v) for k, values in groups.items() for v in values]
    random.Random(parts).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(parts)
    return {r.k: r.m for r in df.groupBy("k").agg(exact_mean("v").alias("m")).collect()}


def test_same_bits_for_any_partitioning_and_no_lost_digits(spark):
    rng = random.Random(1)
    groups = {
        "tiny": [4e-7, 2e-7], "tinier": [1e-12, 3e-12, -2e-12], "none": [None, None], "one": [0.1], "cancel": [1e12, 1e-6, -1e12],
        "rates": [round(rng.uniform(0.01, 90), rng.randint(0, 6)) for _ in range(2000)], "mixed": [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 9) for _ in range(2000)],
        "nulls": [None, 1.5, None, 2.5], "zeros": [0.0, -0.0], "halves": [-0.5, 0.5, 1.5, -8388608.5, 8388607.5],
    }
    found = [means(spark, groups, parts) for parts in (1, 3, 16)]
    assert found[0] == found[1] == found[2]
    assert found[0]["tiny"] == (4e-7 + 2e-7) / 2 and found[0]["none"] is None
    for k, values in groups.items():
        own = [v for v in values if v is not None]
        if own:
            assert found[0][k] == pytest.approx(math.fsum(own) / len(own), rel=4e-16, abs=1e-28)


def test_sizes_beyond_the_limbs(spark):
    df = spark.createDataFrame([(1e300,), (1e300,), (-5.0,)], "v double")
    assert df.agg(exact_mean("v")).first()[0] == pytest.approx(2e300 / 3)
    assert df.where("v < 0").agg(exact_sum("v")).first()[0] == -5.0
    assert spark.createDataFrame([(float("inf"),), (1.0,)], "v double").agg(exact_sum("v")).first()[0] == float("inf")


def test_sum_of_many_equal_values(spark):
    df = spark.range(100_000).select(F.lit(28.44375).alias("v"))
    assert df.agg(exact_mean("v")).first()[0] == 28.44375
