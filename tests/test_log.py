"""Reading and writing the log, and facts."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from logloom.operators import metrics, payload, quality, requests
from logloom.plans import inputs
from logloom.plans.dashboard import load_dashboard
from logloom.sources import facts, log


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "messages")
    log.write_log(inputs.event_log(spark.read.parquet(f"{DATA}/sf0.001/events.parquet")), path)
    return path


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_round_trip(spark, stored):
    original = inputs.event_log(spark.read.parquet(f"{DATA}/sf0.001/events.parquet"))
    back = log.read_log(spark, stored).select(*log.COLUMNS)
    assert original.exceptAll(back).count() == back.exceptAll(original).count() == 0


def test_role_filter_prunes_folders(spark, stored):
    text = plan(payload.tool_entries(log.read_log(spark, stored)))
    assert "PartitionFilters: [isnotnull(role" in text and "role" in text
    assert "day" not in text.split("ReadSchema:")[1].split("\n")[0]


def test_kpis_do_not_read_user_texts(spark, stored):
    text = plan(metrics.dashboard_kpis(log.read_log(spark, stored)))
    schemas = [part.split("\n")[0] for part in text.split("ReadSchema: ")[1:]]
    assert sorted("content" in s for s in schemas) == [False, True]
    assert text.count("Exchange hashpartitioning") == 1


def test_day_column_is_used_where_stored(spark, stored):
    rows = metrics.messages_per_day(log.read_log(spark, stored).where(F.col("day") >= "2024-01-20"))
    assert "PartitionFilters" in plan(rows) and rows.count() == 11


def test_appending_adds_rows(spark, log_rows, tmp_path):
    path = str(tmp_path / "log")
    log.write_log(log_rows(("a", "user", "x")), path)
    log.write_log(log_rows(("a", "user", "y"), ("a", "assistant", "z")), path)
    assert sorted(r.content for r in log.read_log(spark, path).collect()) == ["x", "y", "z"]


@pytest.mark.parametrize("fmt", ["json", "csv", "orc"])
def test_exports(spark, log_rows, tmp_path, fmt):
    rows = log_rows(("a", "user", 'say "hi",\nthen go'), ("a", "tool_log", '[{"name": "x"}]'))
    writer = rows.coalesce(1).write.format(fmt)
    if fmt == "csv":
        writer = writer.options(header=True, escape='"')
    writer.save(str(tmp_path / fmt))
    assert sorted(map(tuple, log.read_export(spark, str(tmp_path / fmt), fmt).collect())) == sorted(
        map(tuple, rows.collect()))


def test_transcript_of_one_session(log_rows):
    rows = log_rows(("a", "user", "1"), ("b", "user", "2"), ("a", "tool_log", "[]"),
                    ("a", "assistant", "3"))
    assert [r.content for r in log.transcript(rows, "a").collect()] == ["1", "3"]
    assert [r.content for r in log.transcript(rows).collect()] == ["1", "3", "2"]


def test_sessions_with_blocks_only_are_none(log_rows):
    rows = log_rows(("a", "user", "1"), ("b", "guardrail_log", '{"reason": "unsafe"}'))
    assert [tuple(r) for r in log.session_registry(rows).collect()] == [
        ("a", "2024-01-01T00:00:00.000000+00:00")]


def test_ts_of_iso_texts(spark):
    texts = ["2024-01-01T10:00:00.000001+00:00", "2024-01-01T10:00:00+00:00",
             "2024-01-01T10:00:00+02:00", "yesterday"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, timestamp string")
    micros = [r[0] for r in log.with_ts(rows).orderBy("id").select(
        F.unix_micros("ts") - 1_704_067_200_000_000).collect()]
    assert micros == [36_000_000_001, 36_000_000_000, 28_800_000_000, None]


def test_fifteenth_day_is_cut(spark):
    rows = spark.range(40).select(
        "id", F.lit("s").alias("session_id"),
        F.concat(F.date_add(F.lit("2024-01-01"), F.floor(F.col("id") / 2).cast("int") * 3)
                 .cast("string"), F.lit("T10:00:00+00:00")).alias("timestamp"),
        F.lit("user").alias("role"), F.lit("x").alias("content"))
    days = metrics.messages_per_day(rows).collect()
    assert len(days) == 14 and days[0].day == "2024-01-19" and days[0].messages == 2
    daily = metrics.daily_activity(rows).collect()
    assert len(daily) == 28 and [r.metric for r in daily[:2]] == ["Mensajes", "Sesiones"]


def test_dashboard_of_an_empty_log(log_rows):
    board = load_dashboard(log_rows(("a", "user", "x")).where("false"))
    assert tuple(board.kpis.first()) == (0, 0.0, 0, 0, 0.0)
    for table in (board.daily, board.unknown, board.ratings):
        assert table.collect() == []
    assert board.daily.columns == ["day", "metric", "value"]
    assert board.unknown.columns == ["question", "times"]
    assert board.failures.first().failures == 0


def test_facts_from_files(spark, tmp_path):
    (tmp_path / "summary.txt").write_text("I build things.\nBorn in Rosario.\n", encoding="utf-8")
    (tmp_path / "profile.txt").write_text("5 años de experiencia", encoding="utf-8")
    rows = facts.read_facts(spark, str(tmp_path))
    assert {r.source: r.text.count("\n") for r in rows.collect()} == {
        "summary.txt": 2, "profile.txt": 0}
    assert [r.text for r in facts.context_rows(rows).orderBy("source").collect()] == [
        facts.CONTEXT_HEADING, "profile.txt:\n5 años de experiencia",
        "summary.txt:\nI build things.\nBorn in Rosario.\n"]
    assert {r.source: r.supports_age for r in facts.context_supports_age(rows).collect()} == {
        "summary.txt": True, "profile.txt": False}


def test_rows_without_a_session(spark, log_rows, tmp_path):
    """They are one session, named by the empty text, wherever sessions are formed."""
    rows = log_rows((None, "user", "a call"), (None, "assistant", "A"), (None, "user", "b"),
                    ("s", "user", "c"))
    history = requests.chat_history(rows).where("session_id = ''").orderBy("id").collect()
    assert [r["at"] for r in history] == [1, 2, 3]
    assert requests.chat_requests(rows, "S").count() == 3
    assert {r.id: r.operational for r in quality.operational_turns(rows).collect()} == {
        0: True, 2: True, 3: False}
    log.write_log(rows, str(tmp_path / "log"))
    stored = log.read_log(spark, str(tmp_path / "log"))
    assert {r.session_id for r in log.session_registry(stored).collect()} == {"", "s"}


def test_daily_activity_reads_the_latest_days_only(spark, tmp_path):
    rows = spark.sql("""SELECT id, 's' || id % 3 AS session_id, '2024-01-' ||
        lpad(id % 28 + 1, 2, '0') || 'T10:00:00+00:00' AS timestamp, 'user' AS role,
        'x' AS content FROM range(200)""")
    log.write_log(rows, str(tmp_path / "log"))
    stored = log.read_log(spark, str(tmp_path / "log"))
    for metric in (metrics.daily_activity, metrics.sessions_per_day, metrics.messages_per_day):
        assert metric(stored).collect() == metric(rows).collect()
    plan = metrics.daily_activity(stored)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
