"""Buckets of suffixes part between grams of one common token."""

import random
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from cuelake.llm import substring


@pytest.mark.parametrize("n", [1, 3, 64, 500])
def test_buckets_are_bisection(spark, n):
    rng = random.Random(n)
    pairs = [(rng.choice([-5, 0, 7]), rng.randrange(-(1 << 63), 1 << 63)) for _ in range(400)]
    splitters = sorted(set(rng.choices(pairs, k=n)) | {(7, (1 << 63) - 1)})
    rows = spark.createDataFrame(pairs + [(-(1 << 63), 0), ((1 << 63) - 1, 0)], "token long, lead long")
    got = rows.withColumn("bucket", substring._bucket(splitters)).collect()
    assert [r.bucket for r in got] == [bisect_right(splitters, (r.token, r.lead)) for r in got]


def test_a_common_token_is_cut(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([(1, rng.randrange(1 << 60)) for _ in range(4000)] + [(k, k) for k in range(100)], "token long, lead long")
    splitters = substring._splitters(rows, 8)
    got = rows.withColumn("bucket", substring._bucket(splitters)).groupBy("bucket").agg(F.count("*").alias("n")).collect()
    assert len(got) >= 7 and max(r.n for r in got) < 1200
