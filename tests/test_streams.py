"""Streams over several files equal the batch result, also after a restart."""

from itertools import permutations

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from logloom.operators import (
    checklist, guard, metrics, outbox, payload, rate_limit, turns)
from logloom.plans import inputs
from logloom.session import shared_dir
from logloom.sources import log
from logloom.streaming import jobs, sinks, stateful

LIMIT = {"limit": 3, "window_seconds": 86400}


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Events in time order as three files, oldest first."""
    path = str(tmp_path_factory.mktemp("events") / "events")
    rows = spark.read.parquet(f"{DATA}/sf0.001/events.parquet")
    for part in range(3):
        (rows.where((F.col("event_id") >= part * 350) & (F.col("event_id") < (part + 1) * 350))
         .coalesce(1).write.mode("append").parquet(path))
    return path


@pytest.fixture()
def stream(spark, events):
    def read():
        return (spark.readStream.schema(spark.read.parquet(events).schema)
                .option("maxFilesPerTrigger", 1).parquet(events))

    return read


@pytest.fixture()
def folder(spark):
    return lambda name: shared_dir(spark, name)


def drain(query):
    query.awaitTermination()


def same(a, b):
    assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(
        map(str, b.select(*sorted(b.columns)).collect()))


@pytest.fixture()
def batch(spark, events):
    return inputs.event_log(spark.read.parquet(events))


def test_role_counts(spark, stream, batch, folder):
    table = folder("t")
    drain(jobs.start_role_counts(inputs.event_log(stream()), table, folder("c"),
                                 sinks.AVAILABLE_NOW))
    same(jobs.read_role_counts(spark, table), log.role_counts(batch))


def test_dashboard_and_compaction(spark, stream, batch, folder):
    table = folder("t")
    drain(jobs.start_dashboard(inputs.event_log(stream()), table, folder("c"),
                               sinks.AVAILABLE_NOW))
    entries = payload.tool_entries(batch)

    def check():
        same(jobs.read_kpis(spark, table), metrics.dashboard_kpis(batch))
        same(jobs.read_daily_activity(spark, table), metrics.daily_activity(batch))
        assert jobs.read_top_questions(spark, table).collect() == (
            metrics.top_unknown_questions(entries).collect())
        same(jobs.read_ratings(spark, table), metrics.rating_histogram(entries))

    check()
    assert spark.read.parquet(f"{table}/flags").select("batch").distinct().count() == 3
    jobs.compact_dashboard(spark, table, 1)
    check()
    jobs.compact_dashboard(spark, table, 2)
    check()


def test_repeated_batch_changes_nothing(spark, batch, folder):
    table = folder("t")
    for _ in range(2):
        sinks.write_batch(metrics.session_flags(batch), f"{table}/flags", 0)
    same(jobs.read_kpis(spark, table), metrics.dashboard_kpis(batch))


def test_restart_goes_on_from_the_checkpoint(spark, stream, batch, folder, events):
    table, checkpoint = folder("t"), folder("c")
    for _ in range(2):
        drain(jobs.start_role_counts(inputs.event_log(stream()), table, checkpoint,
                                     sinks.AVAILABLE_NOW))
    same(jobs.read_role_counts(spark, table), log.role_counts(batch))


def test_rate_limit(spark, stream, events, folder):
    table = folder("t")
    drain(sinks.start_append(stateful.limited(inputs.incoming(stream()), **LIMIT), table,
                             folder("c"), sinks.AVAILABLE_NOW))
    rows = inputs.incoming(spark.read.parquet(events))
    same(spark.read.parquet(table), rate_limit.rate_limit_decisions(rows, **LIMIT).drop("ts"))


def test_checklist(spark, stream, events, folder):
    table = folder("t")
    entries = payload.tool_entries(inputs.checklist_log(stream()))
    drain(sinks.start_append(stateful.checklist_changes(entries), table, folder("c"),
                             sinks.AVAILABLE_NOW))
    whole = payload.tool_entries(inputs.checklist_log(spark.read.parquet(events)))
    same(stateful.checklist_from_changes(spark.read.parquet(table)),
         checklist.checklist_items(whole))


def test_turn_ends_across_batches(spark, folder, tmp_path):
    drafts = inputs.drafts(spark.read.parquet(f"{DATA}/sf0.001/events.parquet"))
    path, table = str(tmp_path / "drafts"), folder("t")
    for number in range(4):
        drafts.where(F.col("draft_no") == number).coalesce(1).write.mode("append").parquet(path)
    stream = (spark.readStream.schema(drafts.schema).option("maxFilesPerTrigger", 1)
              .parquet(path))
    drain(jobs.start_turn_outcomes(stream, table, folder("c"), sinks.AVAILABLE_NOW))
    same(jobs.read_turn_outcomes(spark, table), turns.turn_outcomes(drafts))


def test_daily(spark, stream, batch, folder):
    table = folder("d")
    drain(jobs.start_dashboard(inputs.event_log(stream()), table, folder("c"),
                               sinks.AVAILABLE_NOW))
    same(jobs.read_daily(spark, table),
         metrics.messages_per_day(batch).join(metrics.sessions_per_day(batch), "day"))


def test_drafts_in_any_order(spark, folder, tmp_path):
    """Four drafts of a turn for each order of arrival, each draft also repeated."""
    schema = ("turn_id bigint, draft_no int, response string, tools array<string>, pass boolean, "
              "feedback string")
    orders = list(permutations(range(4)))
    path, table = str(tmp_path / "any"), folder("t")
    for place in range(4):
        rows = [(n, order[place], f"r{order[place]}", [], order[place] == n % 4, "f")
                for n, order in enumerate(orders)]
        spark.createDataFrame(rows * 2, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    drain(jobs.start_turn_outcomes(stream, table, folder("c"), sinks.AVAILABLE_NOW))
    got = {r.turn_id: r for r in jobs.read_turn_outcomes(spark, table).collect()}
    assert sinks.read_batches(spark, table, jobs.OUTCOME).distinct().count() == len(orders)
    for n in range(len(orders)):
        assert (got[n].attempts, got[n].passed) == (n % 4, True)
        assert [r.response for r in got[n].rejections] == [f"r{i}" for i in range(n % 4)]


def test_screening_and_outbox(spark, stream, events, batch, folder):
    table, delivered = folder("t"), []
    notices = outbox.outbox(payload.tool_entries(inputs.event_log(stream())),
                            jobs.screened(inputs.incoming(stream())))
    drain(jobs.start_outbox(notices, table, folder("c"),
                            deliver=lambda rows: delivered.append(rows.count()),
                            trigger=sinks.AVAILABLE_NOW))
    incoming = jobs.screened(inputs.incoming(spark.read.parquet(events)))
    whole = outbox.outbox(payload.tool_entries(batch), incoming)
    same(jobs.read_outbox(spark, table), whole)
    assert sum(delivered) == whole.count()


def test_guard_on_a_stream(spark, stream, events, folder):
    """Limit, rules and verdict in order, with rows that have no session or time."""
    def messages(rows):
        return inputs.incoming(rows).withColumns({
            "session_id": F.expr("if(id % 7 = 0, NULL, session_id)"),
            "ts": F.expr("if(id % 13 = 0, NULL, ts)")})

    table = folder("t")
    rows = spark.read.parquet(events)
    verdicts = inputs.incoming_verdicts(rows)
    one_batch = spark.readStream.schema(rows.schema).parquet(events)
    drain(sinks.start_append(jobs.guard_decisions(messages(one_batch), verdicts, **LIMIT), table,
                             folder("c"), sinks.AVAILABLE_NOW))
    same(spark.read.parquet(table), guard.guard_decisions(messages(rows), verdicts, **LIMIT))


def test_dashboard_before_and_after(spark, stream, batch, folder):
    """Empty tables before the first batch; the same result when covered folders are gone."""
    table = folder("t")
    assert tuple(jobs.read_kpis(spark, table).first()) == (0, 0.0, 0, 0, 0.0)
    for read in (jobs.read_daily, jobs.read_daily_activity, jobs.read_top_questions,
                 jobs.read_ratings):
        assert read(spark, table).collect() == []
    assert jobs.read_outbox(spark, table).collect() == []
    assert jobs.read_turn_outcomes(spark, table).collect() == []
    drain(jobs.start_dashboard(inputs.event_log(stream()), table, folder("c"),
                               sinks.AVAILABLE_NOW))
    with pytest.raises(ValueError):
        jobs.remove_compacted(spark, table, 1)
    jobs.compact_dashboard(spark, table, 0)
    jobs.compact_dashboard(spark, table, 1)
    jobs.remove_compacted(spark, table, 1)
    assert spark.read.parquet(f"{table}/days").where("batch < 1").isEmpty()
    same(jobs.read_kpis(spark, table), metrics.dashboard_kpis(batch))
    same(jobs.read_top_questions(spark, table),
         metrics.top_unknown_questions(payload.tool_entries(batch)))


def test_log_sink(spark, stream, batch, folder):
    path = folder("log")
    drain(jobs.start_log(inputs.event_log(stream()), path, folder("c"), sinks.AVAILABLE_NOW))
    same(log.read_log(spark, path).select(*log.COLUMNS), batch)


def test_stored_log_as_stream(spark, batch, folder):
    path, table = folder("log"), folder("t")
    log.write_log(batch, path)
    stored = log.stream_log(spark, path, max_files=40)
    drain(sinks.start_append(guard.unsafe_messages(stored), table, folder("c"),
                             sinks.AVAILABLE_NOW))
    same(spark.read.parquet(table), guard.unsafe_messages(batch))


def test_late_rows(spark, folder, tmp_path):
    """A row that comes days late counts."""
    path = str(tmp_path / "late")
    schema = "id bigint, session_id string, timestamp string, role string, content string"
    for number, day in enumerate(["01", "10", "11", "01"]):
        spark.createDataFrame(
            [(number, f"s{number}", f"2024-03-{day}T10:00:00+00:00", "user", "x")],
            schema).coalesce(1).write.mode("append").parquet(path)
    rows = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    board = folder("d")
    drain(jobs.start_dashboard(rows, board, folder("c"), sinks.AVAILABLE_NOW))
    daily = {r.day: (r.messages, r.sessions)
             for r in jobs.read_daily(spark, board).collect()}
    assert daily == {"2024-03-01": (2, 2), "2024-03-10": (1, 1), "2024-03-11": (1, 1)}
    counted = {(r.day, r.metric): r.value for r in jobs.read_daily_activity(spark, board).collect()}
    assert counted[("2024-03-01", "Mensajes")] == 2
    assert jobs.read_kpis(spark, board).first().sessions == 4
