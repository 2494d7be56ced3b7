"""Open-shaped JSON: what counts, what is skipped, what keeps its type."""

import json

from pyspark.sql import functions as F

from logloom import constants as C
from logloom.functions import variant as V
from logloom.operators import checklist, events, metrics, mining, outbox, payload


def tools(log_rows, *contents, session="s"):
    return payload.tool_entries(log_rows(*[(session, "tool_log", c) for c in contents]))


def call(name, /, **args):
    return {"name": name, "arguments": args}


def test_only_lists_give_entries(log_rows):
    rows = tools(log_rows, "not json", '{"name": "x"}', "3", "null", '"x"', "[]", "",
                 '["bare", {"name": "n", "arguments": {"a": 1}}, {}, 7, null, [1], true]')
    assert [(r.id, r.pos, r.name) for r in rows.orderBy("id", "pos").collect()] == [
        (7, 0, "bare"), (7, 1, "n"), (7, 2, "")]


def test_order_is_id_then_position(log_rows):
    rows = tools(log_rows, '["a", "b"]', '["c"]').orderBy("id", "pos")
    assert [r.name for r in rows.collect()] == ["a", "b", "c"]


def test_null_or_list_arguments_read_as_empty(log_rows):
    rows = tools(log_rows, json.dumps([
        {"name": C.RECORD_DETAILS, "arguments": None},
        {"name": C.RECORD_DETAILS, "arguments": ["email"]},
        {"name": C.RECORD_DETAILS}]))
    assert [(r.email, r["name"], r.counts_as_lead) for r in events.leads(rows).collect()] == [
        (None, C.DEFAULT_NAME, False)] * 3


def test_lead_needs_a_truthy_email(spark, log_rows):
    values = ["", "a@x.io", 0, 1, 0.0, 0.5, True, False, None, [], [0], {}, {"a": 1}, " ", "0"]
    rows = tools(log_rows, *[json.dumps([call(C.RECORD_DETAILS, email=v)]) for v in values])
    got = [r.counts_as_lead for r in events.leads(rows).orderBy("id").collect()]
    assert got == [bool(v) for v in values]


def test_only_json_integers_are_ratings(log_rows):
    texts = ["5", "true", "5.0", '"5"', "0", "6", "-1", "null", "[5]", "5e0"]
    rows = tools(log_rows, *[
        f'[{{"name": "{C.RECORD_FEEDBACK}", "arguments": {{"rating": {t}}}}}]' for t in texts])
    got = [r.rating for r in events.feedback(rows).orderBy("id").collect()]
    assert got == [5, 1, None, None, 0, 6, -1, None, None, None]
    assert [tuple(r) for r in metrics.rating_histogram(rows).collect()] == [
        ("1", 1), ("2", 0), ("3", 0), ("4", 0), ("5", 1)]


def test_no_rating_gives_no_rows_but_a_schema(log_rows):
    empty = metrics.rating_histogram(tools(log_rows, '["x"]'))
    assert empty.columns == ["rating", "count"] and empty.collect() == []


def test_questions_by_exact_text(log_rows):
    asked = ["b", "a", "a ", "A", "a", "", None, "b"]
    rows = tools(log_rows, json.dumps([call(C.RECORD_UNKNOWN, question=q) for q in asked]))
    assert [tuple(r) for r in metrics.top_unknown_questions(rows).collect()] == [
        ("b", 2), ("a", 2), ("a ", 1), ("A", 1)]


def test_ninth_question_is_cut(log_rows):
    rows = tools(log_rows, json.dumps([call(C.RECORD_UNKNOWN, question=str(i)) for i in range(9)]))
    assert [r.question for r in metrics.top_unknown_questions(rows).collect()] == list("01234567")


def test_duplicate_keys_keep_the_last(log_rows):
    rows = tools(log_rows, '[{"name": "a", "name": "b"}]')
    assert rows.first().name == "b"


def test_rate_may_exceed_hundred(log_rows):
    lead = json.dumps([call(C.RECORD_DETAILS, email="e")])
    rows = log_rows(("a", "user", "hi"), ("a", "tool_log", lead), ("b", "tool_log", lead))
    kpi = metrics.dashboard_kpis(rows).first()
    assert (kpi.sessions, kpi.lead_sessions, kpi.lead_rate) == (1, 2, 200.0)


def test_rates_without_sessions_are_zero(log_rows):
    kpi = metrics.dashboard_kpis(log_rows(("a", "guardrail_log", '{"reason": "unsafe"}'))).first()
    assert tuple(kpi) == (0, 0.0, 0, 0, 0.0)


def test_rounding_ties_to_even(spark):
    from logloom.functions.text import percent
    rows = spark.range(1, 1500, 7).select(F.col("id").alias("b")).crossJoin(
        spark.range(0, 60).select(F.col("id").alias("a")))
    for r in rows.select("a", "b", percent(F.col("a"), F.col("b")).alias("p")).collect():
        assert r.p == round(r.a / r.b * 100, 1), r


def test_unknown_session_without_question_text(log_rows):
    rows = log_rows(("a", "user", "hi"), ("a", "tool_log", f'["{C.RECORD_UNKNOWN}"]'))
    flags = metrics.session_flags(rows).first()
    assert (flags.has_unknown, flags.has_lead, flags.has_call) == (True, False, False)


def test_tool_names_are_distinct_sorted_and_not_empty(spark):
    row = spark.createDataFrame([('["b", {"name": "a"}, "b", "", {"x": 1}, 3]',)], "c string")
    assert row.select(payload.tool_names(F.try_parse_json("c")).alias("t")).first().t == ["a", "b"]


def test_evaluator_rows_of_both_shapes(log_rows):
    full = {"attempts": 3, "passed": False, "max_retries_exceeded": True, "user_message": "q",
            "final_response": "r", "rejections": [
                {"attempt": 1, "response": "r1", "feedback": "f1", "tools_used": ["x", "y"]},
                "junk", {"feedback": "f2"}]}
    rows = log_rows(*[("s", "evaluator_log", json.dumps(c)) for c in [
        {"attempts": 2, "passed": True}, full, [1], "text"]], ("s", "evaluator_log", "oops"))
    entries = payload.evaluator_entries(rows)
    assert [(r.attempts, r.passed, len(r.rejections)) for r in entries.orderBy("id").collect()] == [
        (2, True, 0), (3, False, 2)]
    drafts = payload.rejections(entries).orderBy("feedback").collect()
    assert [(d.attempt, d.feedback, d.tools_used) for d in drafts] == [
        (1, "f1", ["x", "y"]), (None, "f2", None)]


def test_failures_need_false_three_attempts_and_a_message(log_rows):
    base = {"attempts": 3, "passed": False, "user_message": "q"}
    cases = [base, {**base, "passed": None}, {**base, "passed": "false"}, {**base, "passed": 0},
             {**base, "attempts": 2}, {**base, "attempts": 4}, {**base, "user_message": ""},
             {"attempts": 3, "passed": False}, {"passed": False, "user_message": "q"},
             {"attempts": 3, "user_message": "q"}]
    rows = log_rows(*[("s", "evaluator_log", json.dumps(c)) for c in cases])
    failures = mining.max_retry_failures(payload.evaluator_entries(rows))
    assert [r.id for r in failures.orderBy("id").collect()] == [0, 5]
    assert mining.failure_count(failures).first().failures == 2


def test_digest_lines(log_rows):
    case = {"attempts": 3, "passed": False, "user_message": "why?", "rejections": [
        {"attempt": 1, "response": "x" * 600, "feedback": "long", "tools_used": ["b", "a"]},
        {"feedback": "short", "response": "", "tools_used": []}, {"attempt": 3}]}
    rows = log_rows(("s", "evaluator_log", json.dumps(case)),
                    ("s", "evaluator_log", json.dumps({**case, "rejections": None})))
    failures = mining.max_retry_failures(payload.evaluator_entries(rows))
    blocks = [r.block for r in mining.failure_digest(failures).orderBy("failure_no").collect()]
    assert blocks == [
        "## Failure 1\nUser question: why?\n- Attempt 1 rejected: long\n  Draft: " + "x" * 500
        + "\n  Tools: b, a\n- Attempt ? rejected: short\n- Attempt 3 rejected: ",
        "## Failure 2\nUser question: why?"]
    latest = mining.failure_digest(failures, last_n=1).collect()
    assert [(r.id, r.failure_no) for r in latest] == [(1, 1)]


def test_tool_calls_from_completions(spark):
    def completion(*calls):
        return json.dumps({"tool_calls": [
            {"id": f"c{n}", "function": {"name": name, "arguments": args}}
            for n, (name, args) in enumerate(calls)]})

    rows = spark.createDataFrame([
        (1, completion((C.SCHEDULE_CALL, '{"email": "e"}'), ("nope", "{}"))),
        (2, '{"content": "no calls"}'), (3, "oops")], "id bigint, completion string")
    calls = payload.tool_calls(rows).orderBy("id", "pos")
    got = [(r.id, r.pos, r.call_id, r["name"], r.known, r.result, r.email) for r in calls.select(
        "*", V.text(F.col("args"), "email").alias("email")).collect()]
    assert got == [(1, 0, "c0", C.SCHEDULE_CALL, True, None, "e"),
                   (1, 1, "c1", "nope", False, "Unknown tool: nope", None)]


def test_argument_violations(log_rows):
    rows = tools(log_rows, json.dumps([
        call(C.MARK_COMPLETE, index="1", completion_notes="n"),
        call(C.MARK_COMPLETE, index=1),
        call(C.CREATE_CHECKLIST, descriptions=["a", 1]),
        call(C.CREATE_CHECKLIST, descriptions=[]),
        call(C.RECORD_FEEDBACK, rating=5, comment="c", mood="good"),
        {"name": C.RECORD_UNKNOWN, "arguments": None},
        call("unregistered", x=1)]))
    found = payload.arg_violations(rows)
    assert sorted((r.pos, r.arg, r.violation) for r in found.collect()) == [
        (0, "index", "type"), (1, "completion_notes", "missing"), (2, "descriptions", "type"),
        (4, "mood", "extra"), (5, "question", "missing")]


def test_a_user_can_register_a_tool(log_rows):
    registry = C.TOOL_ARGUMENTS + [("my_tool", "x", "string", True)]
    rows = tools(log_rows, json.dumps([call("my_tool", x=1)]))
    assert [r.violation for r in payload.arg_violations(rows, registry).collect()] == ["type"]


def test_checklist_replay(log_rows):
    def mark(n):
        return call(C.MARK_COMPLETE, index=n, completion_notes="x")

    rows = tools(log_rows, json.dumps([
        mark(1), call(C.CREATE_CHECKLIST, descriptions=["a", "b"]), mark(2), mark(3), mark(0)]),
        json.dumps([call(C.CREATE_CHECKLIST, descriptions=["c"]), mark(-1), mark(True),
                    mark("3"), mark(3.0)]))
    items = checklist.checklist_items(rows)
    assert [tuple(r) for r in items.orderBy("item_no").collect()] == [
        ("s", 1, "a", True), ("s", 2, "b", True), ("s", 3, "c", False)]
    bad = checklist.bad_marks(rows)
    assert sorted((r.id, r.pos, r["index"]) for r in bad.collect()) == [
        (0, 0, 1), (0, 3, 3), (0, 4, 0), (1, 1, -1)]


def test_checklist_report(log_rows, spark):
    rows = tools(log_rows, json.dumps([
        call(C.CREATE_CHECKLIST, descriptions=["a", "b"]),
        call(C.MARK_COMPLETE, index=2, completion_notes="")]))
    sessions = spark.createDataFrame([("s",), ("t",), ("t",)], "session_id string")
    report = checklist.checklist_report(rows, sessions)
    assert [r.line for r in report.orderBy("session_id", "line_no").collect()] == [
        "Checklist #1: [ ] a", "Checklist #2: [x] b", "No checklist items yet."]


def test_event_defaults_apply_only_when_absent(log_rows):
    rows = tools(log_rows, json.dumps([
        call(C.RECORD_DETAILS, email="e"), call(C.RECORD_DETAILS, email="e", name=None, notes="n"),
        call(C.CHECK_AVAILABILITY, date="d"), call(C.RECORD_FEEDBACK, rating=4)]))
    assert [(r["name"], r.notes) for r in events.leads(rows).orderBy("pos").collect()] == [
        (C.DEFAULT_NAME, C.DEFAULT_NOTES), (None, "n")]
    assert events.availability_requests(rows).first().time_preference == "any"
    assert events.feedback(rows).first().comment == ""


def test_notices(log_rows):
    rows = tools(log_rows, json.dumps([
        call(C.RECORD_DETAILS, email="e", name="N"), call(C.RECORD_UNKNOWN, question="100%?"),
        call(C.RECORD_FEEDBACK, rating=True), call(C.CHECK_AVAILABILITY, date="d"),
        call(C.SCHEDULE_CALL, email="e", date="d", time="t", name=None),
        call(C.MARK_COMPLETE, index=1)]))
    assert [(r.kind, r.text) for r in outbox.event_notices(rows).orderBy("pos").collect()] == [
        ("lead", "Recording interest from N with email e and notes not provided"),
        ("unknown_question", "Recording 100%? asked that I couldn't answer"),
        ("feedback", "Feedback recibido: True/5 - "),
        ("availability", "Consulta de disponibilidad: d (preferencia: any)"),
        ("booking", "Call agendada con None (e) — d a las t")]


def test_entries_can_be_stored_and_read_again(spark, log_rows, tmp_path):
    rows = tools(log_rows, json.dumps([
        call(C.RECORD_FEEDBACK, rating=5), call(C.RECORD_FEEDBACK, rating="5"), "x"]))
    rows.write.parquet(str(tmp_path / "entries"))
    stored = spark.read.parquet(str(tmp_path / "entries"))
    assert [r.rating for r in events.feedback(stored).orderBy("pos").collect()] == [5, None]


def test_json_outside_the_standard(log_rows):
    """NaN makes a payload invalid; text after a complete value is ignored."""
    rows = tools(log_rows, '[{"name": "a", "arguments": {"x": NaN}}]', '["b"] and more')
    assert [r.name for r in rows.collect()] == ["b"]


def test_no_grading_row_does_not_mean_passed(spark):
    from logloom.operators import turns
    drafts = spark.createDataFrame(
        [(1, 0, "r", [], True, ""), (2, 0, "r", [C.SCHEDULE_CALL], False, "f")],
        "turn_id bigint, draft_no int, response string, tools array<string>, "
        "pass boolean, feedback string")
    rows = turns.turn_outcomes(drafts).select(
        F.col("turn_id").alias("id"), F.lit("s").alias("session_id"), F.lit("t").alias("timestamp"),
        F.lit("q").alias("user_message"), "response", F.col("tools").alias("tools_used"),
        "attempts", "passed", F.lit(None).cast("string").alias("evaluator_detail"))
    assert rows.where("NOT passed").count() == 1
    assert turns.turns_to_log(rows).where("role = 'evaluator_log'").count() == 0


def test_attempts_must_be_a_number(log_rows):
    base = {"passed": False, "user_message": "q"}
    rows = log_rows(*[("s", "evaluator_log", json.dumps({**base, "attempts": value}))
                      for value in ("3", True, [3], 3, 3.0)])
    failed = mining.max_retry_failures(payload.evaluator_entries(rows))
    assert sorted(r.id for r in failed.collect()) == [3, 4]


def test_questions_of_different_types(log_rows):
    rows = log_rows(*[("s", "tool_log", json.dumps([
        {"name": "record_unknown_question", "arguments": {"question": q}}]))
        for q in (5, "5", "5", "why", 5, 5)])
    top = metrics.top_unknown_questions(payload.tool_entries(rows)).collect()
    assert [(r.question, r.times) for r in top] == [("5", 3), ("5", 2), ("why", 1)]
