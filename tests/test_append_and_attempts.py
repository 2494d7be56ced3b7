"""Ids given by the log, and calls kept in a ledger."""

import datetime as dt

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from logloom.functions.running import placed_by_sums
from logloom.operators import attempts, guard
from logloom.operators.turns import turns_to_log
from logloom.plans import inputs
from logloom.session import shared_dir
from logloom.sources import append, log
from logloom.streaming import sinks

TURN = ("session_id string, timestamp string, user_message string, response string, "
        "tools_used array<string>, attempts int, passed boolean, evaluator_detail string")


def turns_of(spark, rows):
    return spark.createDataFrame(rows, TURN)


def turn(n, session="s", tools=None, tries=0):
    return (session, f"2024-01-{n % 28 + 1:02d}T00:00:00+00:00", f"m{n}", f"r{n}", tools, tries,
            bool(tries), None)


def test_sums_before_each_row(spark):
    rows = spark.createDataFrame([(i % 7, i, (i * 13) % 5) for i in range(500)],
                                 "a int, b int, w int").repartition(6)
    got = {(r.a, r.b): r.at for r in placed_by_sums(rows, ["a", "b"], "w", "at").collect()}
    total = 0
    for a, b, w in sorted((i % 7, i, (i * 13) % 5) for i in range(500)):
        assert got[a, b] == total
        total += w


def test_ids_have_no_gaps(spark):
    path = shared_dir(spark, "log")
    hot = [turn(i, "hot", ["t"], i % 3) for i in range(400)]
    append.append_turns(turns_of(spark, hot).repartition(7), path)
    append.append_turns(turns_of(spark, []), path)
    append.append_turns(turns_of(spark, [turn(i, f"s{i}") for i in range(50)] + [turn(5)] * 3), path)
    rows = append.read_appended(spark, path)
    ids = sorted(r.id for r in rows.collect())
    assert ids == list(range(1, len(ids) + 1))
    # the rows of a turn follow each other, in the order of roles
    whole = turns_to_log(turns_of(spark, hot).withColumn("id", F.lit(0)))
    assert rows.where("session_id = 'hot'").count() == whole.count()
    said = {(r.content): r.id for r in rows.where("role IN ('user', 'assistant')").collect()}
    assert all(said[f"r{i}"] == said[f"m{i}"] + 1 for i in range(400))
    assert log.session_registry(rows).count() == 52


def test_a_batch_written_again_keeps_its_ids(spark):
    path = shared_dir(spark, "log")
    first, second = ([turn(i, f"s{i % 5}") for i in r] for r in (range(60), range(60, 90)))
    append.append_turns(turns_of(spark, first), path, 0)
    append.append_turns(turns_of(spark, second), path, 1)
    before = sorted(map(str, append.read_appended(spark, path).collect()))
    append.append_turns(turns_of(spark, second).repartition(5), path, 1)
    assert sorted(map(str, append.read_appended(spark, path).collect())) == before
    # rows of a batch that is not in the ledger are not seen
    turns_to_log(turns_of(spark, first).withColumn("id", F.lit(1))).withColumn(
        "day", F.lit("d")).write.partitionBy("day", "role").parquet(f"{path}/rows/batch=2")
    assert sorted(map(str, append.read_appended(spark, path).collect())) == before


def test_ids_of_a_stream(spark, tmp_path):
    path, state, source = shared_dir(spark, "log"), shared_dir(spark, "c"), str(tmp_path / "t")
    rows = [turn(i, f"s{i % 3}", None, i % 2) for i in range(40)]
    for part in range(4):
        turns_of(spark, rows[part * 10:part * 10 + 10]).coalesce(1).write.mode("append") \
            .parquet(source)
    stream = (spark.readStream.schema(TURN).option("maxFilesPerTrigger", 1).parquet(source))
    append.start_turn_log(stream, path, state, sinks.AVAILABLE_NOW).awaitTermination()
    got = append.read_appended(spark, path)
    assert sorted(r.id for r in got.collect()) == list(range(1, got.count() + 1))
    assert got.count() == turns_to_log(turns_of(spark, rows).withColumn("id", F.lit(0))).count()
    assert append.read_appended(spark, shared_dir(spark, "none")).collect() == []


NOTICE = "id bigint, pos int, kind string, text string"


def clock(minutes):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minutes)


def test_only_what_failed_is_delivered_again(spark, tmp_path):
    sent, path = tmp_path / "sent", shared_dir(spark, "ledger")
    sent.mkdir()
    where = str(sent)

    def send(notice):
        with open(f"{where}/{notice['id']}-{notice['kind']}", "a") as out:
            out.write("x")
        if notice["id"] in (1, 4, 7) and notice["attempt"] < 3 or notice["id"] == 5:
            raise OSError("no route")

    notices = spark.createDataFrame(
        [(i, 0, kind, "t") for i in range(8) for kind in ("lead", "booking")] * 2
        + [(None, 0, None, "t")], NOTICE)
    options = {"most": 4, "pause_seconds": 60, "slice_rows": 5}
    assert attempts.deliver_due(notices, path, send, now=clock(0), **options) == 4
    counts = {f.name: len(f.read_text()) for f in sent.iterdir()}
    assert set(counts.values()) == {1} and len(counts) == 17
    # the pause is not over, then it is, then it is twice as long
    assert attempts.deliver_due(notices, path, send, now=clock(0.5), **options) == 0
    assert attempts.deliver_due(notices, path, send, now=clock(1), **options) == 2
    assert attempts.deliver_due(notices, path, send, now=clock(2), **options) == 0
    for minute in (3, 7, 60, 999):
        attempts.deliver_due(notices, path, send, now=clock(minute), **options)
    counts = {f.name: len(f.read_text()) for f in sent.iterdir()}
    for i in range(8):
        for kind in ("lead", "booking"):
            assert counts[f"{i}-{kind}"] == (4 if i == 5 else 3 if i % 3 == 1 else 1)
    ledger = attempts.read_ledger(spark, path, notices.select(*attempts.NOTICE_KEYS).schema)
    states = {(r.id, r.kind): (r.state, r.attempts) for r in attempts.outcomes(
        notices, ledger, attempts.NOTICE_KEYS, 4).collect()}
    assert states[5, "lead"] == ("given_up", 4) and states[1, "lead"] == ("answered", 3)
    assert states[None, None] == ("answered", 1)
    assert ledger.where("id = 5").select("error").distinct().collect()[0][0] == "OSError: no route"


def test_model_requests_are_asked_once(spark, tmp_path):
    asked, path = tmp_path / "asked", shared_dir(spark, "ledger")
    where = str(asked)

    def ask(row):
        with open(where, "a") as out:
            out.write(f"{row['prompt']}\n")
        if row["prompt"] == "p3":
            raise TimeoutError
        return "SAFE" if row["prompt"] != "p1" else "UNSAFE"

    requests = spark.createDataFrame([(i, f"p{i % 5}") for i in range(40)] + [(99, None)],
                                     "id bigint, prompt string")
    attempts.ask_due(requests, ["prompt"], path, ask, now=clock(0), most=2)
    attempts.ask_due(requests, ["prompt"], path, ask, now=clock(9), most=2)
    attempts.ask_due(requests.union(spark.createDataFrame([(100, "new")], requests.schema)),
                     ["prompt"], path, ask, now=clock(99), most=2)
    lines = asked.read_text().split("\n")[:-1]
    assert sorted(lines) == ["None", "new", "p0", "p1", "p2", "p3", "p3", "p4"]
    got = guard.guard_verdicts(attempts.answers(requests, ["prompt"], path, most=2))
    found = {(r.prompt, r.state, r.safe) for r in got.collect()}
    assert found == {("p0", "answered", True), ("p1", "answered", False),
                     ("p2", "answered", True), ("p3", "given_up", False),
                     ("p4", "answered", True), (None, "answered", True)}
    assert got.count() == 41


@pytest.mark.parametrize("name", ["answers", "deliver"])
def test_no_work(spark, name):
    path = shared_dir(spark, "ledger")
    if name == "deliver":
        assert attempts.deliver_due(spark.createDataFrame([], NOTICE), path, print) == 0
    else:
        rows = spark.createDataFrame([(1, "p")], "id bigint, prompt string")
        [row] = attempts.answers(rows, ["prompt"], path).collect()
        assert (row.state, row.verdict, row.attempts) == ("waiting", None, 0)
