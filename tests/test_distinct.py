"""Distinct sessions by bitmaps, in batch and on a stream with late rows."""

import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import distinct, metrics
from logloom.session import shared_dir
from logloom.streaming import jobs, sinks

SCHEMA = "id bigint, session_id string, timestamp string, role string, content string"


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(7)
    data = [(i, draw.choice([None, "", "hot", "hot", *[f"s{n}" for n in range(300)]]),
             f"2024-02-{draw.randint(1, 20):02d}T00:00:00+00:00", draw.choice(["user", "assistant"]),
             "x") for i in range(3000)]
    return spark.createDataFrame(data, SCHEMA).persist()


def pairs(frame):
    return sorted((r.day, r.sessions) for r in frame.collect())


def want(rows):
    return pairs(metrics.sessions_per_day(rows.fillna("", ["session_id"])))


def test_batch(spark, rows):
    assert pairs(distinct.sessions_per_day(rows)) == want(rows)
    assert distinct.sessions_per_day(rows.where("false")).collect() == []


def test_bitmaps_merge(rows):
    """Bitmaps of two halves together count a session of both once, over days as well."""
    said = distinct.said(rows).withColumn("half", F.rand(3) < 0.5).persist()
    numbers = distinct.numbered_sessions(said).persist()
    assert sorted(r.number for r in numbers.collect()) == list(range(1, numbers.count() + 1))
    halves = [distinct.day_bitmaps(said.where(c).drop("half"), numbers)
              for c in ("half", "NOT half")]
    both = halves[0].unionByName(halves[1])
    assert pairs(distinct.counted(both)) == want(rows)
    assert distinct.counted_over(both).first().sessions == numbers.count()
    assert distinct.counted_over(both.where("false")).first().sessions == 0


def test_more_sessions_than_bits(spark):
    said = spark.range(70_000).selectExpr("CAST(id AS STRING) AS session_id", "'d' AS day")
    bitmaps = distinct.day_bitmaps(said, distinct.numbered_sessions(said))
    assert bitmaps.count() == 3
    assert pairs(distinct.counted(bitmaps)) == [("d", 70_000)]


def test_stream(spark, rows, tmp_path):
    path, table, state = str(tmp_path / "log"), shared_dir(spark, "t"), shared_dir(spark, "c")
    assert jobs.read_distinct_sessions(spark, table).collect() == []
    for part in range(3):  # the days come in no order
        rows.where(F.col("id") % 3 == part).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    jobs.start_distinct_sessions(stream, table, state, sinks.AVAILABLE_NOW).awaitTermination()
    assert pairs(jobs.read_distinct_sessions(spark, table)) == want(rows)
    jobs.compact_distinct_sessions(spark, table, 1)
    assert pairs(jobs.read_distinct_sessions(spark, table)) == want(rows)
    # an unfinished batch is not seen, and written again it gives the same numbers
    sinks.write_batch(spark.createDataFrame([("new", 1)], jobs.SESSIONS), f"{table}/sessions", 3)
    spark.createDataFrame([(9000, "new", "2024-02-20T00:00:00", "user", "x")], SCHEMA) \
        .coalesce(1).write.mode("append").parquet(path)
    assert pairs(jobs.read_distinct_sessions(spark, table)) == want(rows)
    jobs.start_distinct_sessions(stream, table, state, sinks.AVAILABLE_NOW).awaitTermination()
    got, before = dict(pairs(jobs.read_distinct_sessions(spark, table))), dict(want(rows))
    assert got["2024-02-20"] == before["2024-02-20"] + 1
    numbers = sinks.read_batches(spark, f"{table}/sessions", jobs.SESSIONS)
    assert sorted(r.number for r in numbers.collect()) == list(range(1, numbers.count() + 1))
