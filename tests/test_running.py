"""Blocked running values equal plain windows, also when one key holds most rows."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions.running import block_width, numbered, with_preceding, within_last


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(1)
    data = [(i * 3 + rnd.randrange(3), "hot" if rnd.random() < 0.6 else f"s{rnd.randrange(40)}",
             rnd.random() < 0.05) for i in range(3000)]
    return spark.createDataFrame(data, "id bigint, k string, flag boolean").cache()


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("width", [1, 7, 500, 1 << 20])
def test_numbered(rows, width):
    number = F.row_number().over(W.partitionBy("k").orderBy("id"))
    plain = rows.withColumn("n", number.cast("bigint"))
    same(numbered(rows, ["k"], ["id"], "n", width).select(*plain.columns), plain)


@pytest.mark.parametrize("width", [50, 1 << 20])
def test_numbered_over_all_rows(rows, width):
    plain = rows.withColumn("n", F.row_number().over(W.orderBy("id")).cast("bigint"))
    same(numbered(rows, [], ["id"], "n", width).select(*plain.columns), plain)


@pytest.mark.parametrize("width", [1, 7, 500, 1 << 20])
def test_within_last(rows, width):
    frame = W.partitionBy("k").orderBy("id").rowsBetween(-8, 0)
    plain = rows.withColumn("near", F.max("flag").over(frame))
    same(within_last(rows, ["k"], F.col("flag"), 8, "near", width).select(*plain.columns), plain)


@pytest.mark.parametrize("count", [1, 5, 50])
def test_with_preceding(rows, count):
    frame = W.partitionBy("k").orderBy("id").rowsBetween(-count, -1)
    plain = rows.withColumn("before", F.collect_list("id").over(frame))
    got = with_preceding(numbered(rows, ["k"], ["id"], "at", 100), ["k"], "at", F.col("id"),
                         count, "before")
    same(got.withColumn("before", F.col("before").cast("string")).select(*plain.columns),
         plain.withColumn("before", F.col("before").cast("string")))


def test_block_width_follows_the_ids(rows, spark):
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    width = block_width(rows, 10)
    assert (high - low + 1 + 9) // 10 == width
    assert block_width(rows.where("false")) == 1
    sparse = spark.range(0, 10_000_000_000, 1_000_000_000)
    assert block_width(sparse, 4) > 2_000_000_000
