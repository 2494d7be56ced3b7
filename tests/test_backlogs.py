"""Jobs over stored tables that follow the table's size: one parse, joins, no call per key."""

import pytest
from pyspark.sql import functions as F

from logloom.operators import distinct, metrics, payload
from logloom.plans import queries
from logloom.session import shared_dir
from logloom.streaming import jobs, sinks, stateful

CALL = "session_id string, id bigint, pos int, name string, arguments string"


def rows_of(frame):
    return sorted(map(str, frame.collect()))


def test_dashboard_parses_payloads_once(spark, tmp_path):
    """odd rows give the same parts; each payload is parsed once for all four."""
    contents = [None, "", "not json", "{}", "[]", "[1, null]", '["record_user_details"]',
                '[{"name":"record_unknown_question","arguments":{"question":"q"}},'
                '{"name":"record_unknown_question","arguments":{"question":5}},'
                '{"name":"record_unknown_question","arguments":{"question":""}},{"name":null}]',
                '[{"name":"record_user_details","arguments":{"email":"a@x"}},'
                '{"name":"schedule_call_tool"},{"arguments":{}}]',
                *[f'[{{"name":"record_feedback_tool","arguments":{{"rating":{r}}}}}]'
                  for r in ("1", "5", "6", '"5"', "5.0", "true", "null")]]
    sessions, times = ["a", "", None], ["2024-01-01T00:00:00.000000+00:00", None]
    made = [(n, sessions[n % 3], times[n % 5 == 0], role, content) for n, (role, content) in
            enumerate((r, c) for r in ("user", "tool_log", "assistant", "x", None)
                      for c in contents)]
    path = str(tmp_path / "log")
    spark.createDataFrame(made * 2, "id bigint, session_id string, timestamp string, "
                          "role string, content string").write.parquet(path)
    log = spark.read.parquet(path)
    tools = payload.tool_entries(log)
    want = {"flags": metrics.session_flags(log), "days": metrics.day_sessions(log),
            "questions": metrics.asked_questions(tools), "ratings": metrics.rating_counts(tools)}
    assert log.where("role = 'tool_log'").count() and not want["questions"].isEmpty()
    for name, part in jobs._dashboard_parts(log).items():
        assert part.dtypes == want[name].dtypes
        assert rows_of(part) == rows_of(want[name])
    plan = metrics.counted_rows(log)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Generate ") == 1


def test_numbers_without_an_order_are_dense(spark):
    """each part continues the numbers of the part before it."""
    sessions = spark.range(1000, numPartitions=7).selectExpr("'s' || id AS session_id").where(
        "session_id > 's4'")
    got = distinct.numbered_in_parts(sessions, 11).collect()
    assert len({r.session_id for r in got}) == sessions.count() == len(got)
    assert sorted(r.number for r in got) == list(range(11, 11 + len(got)))
    assert distinct.numbered_in_parts(sessions.limit(0), 3).collect() == []


@pytest.fixture()
def checklist_parts(spark):
    def call(session, at, name, arguments):
        return (session, at, 0, name, arguments)

    def create(session, at, *items):
        return call(session, at, "create_checklist",
                    '{"descriptions":[%s]}' % ",".join(f'"{i}"' for i in items))

    def mark(session, at, index):
        return call(session, at, "mark_complete", f'{{"index":{index}}}')

    parts = [[create("a", 1, "x", "y"), mark("a", 2, 2), mark("a", 3, 3), mark(None, 4, 1),
              create(None, 5, "n"), create("", 6, "e"), create("a", 7), mark("a", 8, '"1"')],
             [create("a", 9, "z"), create("a", 9, "z"), mark("a", 8, 3), mark("a", 10, 4),
              mark("a", 1 << 40, 0), mark(None, 11, 1), call("b", 12, "mark_complete", "{}"),
              mark("", 13, 2)],
             [create("b", 14, "p"), mark("b", 15, 1), mark("a", 16, 1)]]
    return [spark.createDataFrame(part, CALL).coalesce(1) for part in parts]


def test_checklist_backlog_equals_keyed_state(spark, checklist_parts, tmp_path):
    """sessions without a name, repeated calls, marks before their item, restarts."""
    path, table, state = str(tmp_path / "calls"), shared_dir(spark, "t"), shared_dir(spark, "s")
    live, live_state = shared_dir(spark, "live"), shared_dir(spark, "live-state")
    for part in checklist_parts:
        part.write.mode("append").parquet(path)
        entries = spark.readStream.schema(CALL).parquet(path).withColumn(
            "args", F.try_parse_json("arguments")).drop("arguments")
        jobs.start_checklist_backlog(entries, table, state,
                                     sinks.AVAILABLE_NOW).awaitTermination()
        sinks.start_append(stateful.checklist_changes(entries), live, live_state,
                           sinks.AVAILABLE_NOW).awaitTermination()
    got, want = jobs.read_checklist_changes(spark, table), spark.read.parquet(live)
    assert rows_of(got.select(*want.columns)) == rows_of(want)
    assert rows_of(stateful.checklist_from_changes(got)) == rows_of(
        stateful.checklist_from_changes(want))


def test_registered_checklist_makes_no_call_per_session(spark, monkeypatch):
    monkeypatch.setattr(stateful, "checklist_changes", None)
    got = queries.registered()["stream_checklist"](spark, "/root/testdata/sf0.001")
    want = queries.registered()["checklist_items"](spark, "/root/testdata/sf0.001")
    assert rows_of(got.select(*want.columns)) == rows_of(want)
