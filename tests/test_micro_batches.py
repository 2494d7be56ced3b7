"""A stored table drained as a stream: few micro-batches, every row."""

from pyspark.sql import functions as F

from logloom.operators import attempts, turns
from logloom.plans import queries
from logloom.plans.inputs import SCHEMAS
from logloom.session import shared_dir
from logloom.streaming import jobs, sinks


def test_micro_batches_do_not_grow_with_the_table(spark):
    folder = shared_dir(spark, "many-rows")
    events = spark.range(1200, numPartitions=3).select(
        F.col("id").alias("event_id"), F.lit(None).cast("timestamp_ntz").alias("ts"),
        F.col("id").alias("user_id"), F.lit("view").alias("event_type"),
        F.lit(0.5).alias("value"), F.lit("").alias("props"))
    assert events.columns == [c.split()[0] for c in SCHEMAS["events"].split(", ")]
    events.write.parquet(f"{folder}/events.parquet")
    batches = []
    stream = queries.Tables(spark, folder).files("events", rows=20)
    sinks.start_batches(
        stream, shared_dir(spark, "state"),
        lambda rows, n: batches.append([r.event_id for r in rows.collect()]),
        sinks.AVAILABLE_NOW).awaitTermination()
    assert 1 < len(batches) <= queries.MICRO_BATCHES
    assert sorted(sum(batches, [])) == list(range(1200))


def test_turn_backlog_across_batches_and_restarts(spark, tmp_path):
    """Drafts that come late, again, after the end, without a turn; open turns stay open."""
    schema = ("turn_id bigint, draft_no int, response string, tools array<string>, pass boolean, "
              "feedback string")

    def draft(turn, n, ok):
        return (turn, n, f"r{n}", [], ok, "f")

    parts = [[draft(1, 0, False), draft(2, 1, True), draft(None, 0, False), draft(4, 0, False)],
             [draft(1, 1, True), draft(1, 1, True), draft(None, 1, True), draft(4, 0, False)],
             [draft(2, 0, False), draft(1, 0, False), draft(1, 2, True), draft(5, 0, True)]]
    path, table, state = str(tmp_path / "d"), shared_dir(spark, "t"), shared_dir(spark, "s")
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        jobs.start_turn_backlog(stream, table, state, sinks.AVAILABLE_NOW).awaitTermination()
    got = jobs.read_turn_outcomes(spark, table)
    whole = spark.createDataFrame(sum(parts, []), schema)
    want = turns.fold_drafts(whole).where("ended").drop("ended")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert sorted(str(r.turn_id) for r in got.collect()) == ["1", "2", "5", "None"]


def test_slices_of_due_work_do_not_read_each_other(spark):
    todo = spark.range(5000).selectExpr("id", "if(id % 3 = 0, NULL, 'k' || id) AS kind")
    parts = attempts.sliced(todo, ["id", "kind"], 5)
    assert all(p.columns == todo.columns for p in parts)
    assert sorted(r.id for p in parts for r in p.collect()) == list(range(5000))
    for part in parts:
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(_slice" in plan
