"""The registered queries: (spark, folder of sample tables) -> DataFrame."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import variant as V
from logloom.functions.text import iso_utc
from logloom.operators import (
    attempts, checklist, distinct, events, guard, metrics, mining, outbox, payload, quality,
    rate_limit, requests, schemas, turns)
from logloom.plans import inputs
from logloom.session import configure, shared_dir
from logloom.sources import append, facts, log
from logloom.streaming import jobs, sinks, stateful, verdicts

DAY_LIMIT = {"limit": 3, "window_seconds": 86400}
#: A stored table comes as a stream in so many micro-batches of so many files, or fewer.
MICRO_BATCHES, BATCH_FILES = 6, 16
SYSTEM_TEXT = "You answer for the owner of this page."


class Tables:
    """The sample tables and the inputs projected from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder

    def batch(self, name: str) -> DataFrame:
        return (self.spark.read.schema(inputs.SCHEMAS[name])
                .parquet(f"{self.folder}/{name}.parquet"))

    def stream(self, name: str) -> DataFrame:
        # a glob, so that a single file works as well as a folder of files
        return (self.spark.readStream.schema(inputs.SCHEMAS[name])
                .parquet(f"{self.folder}/{name}.parque[t]"))

    def files(self, name: str, rows: int = 4_000) -> DataFrame:
        """The whole table as a stream of files, in at most MICRO_BATCHES micro-batches.

        A micro-batch costs its jobs however few rows it has, so its size follows the
        table's. ``rows`` is the least size of a full file.
        """
        path = shared_dir(self.spark, f"stream-{name}")
        table = self.batch(name)
        rows = max(rows, -(-table.count() // (MICRO_BATCHES * BATCH_FILES)))
        table.write.option("maxRecordsPerFile", rows).parquet(path)
        files = len(self.spark.read.schema(table.schema).parquet(path).inputFiles())
        return (self.spark.readStream.schema(table.schema)
                .option("maxFilesPerTrigger", max(1, -(-files // MICRO_BATCHES))).parquet(path))

    @property
    def log(self) -> DataFrame:
        return inputs.event_log(self.batch("events"))

    @property
    def entries(self) -> DataFrame:
        return payload.tool_entries(self.log)

    @property
    def evaluations(self) -> DataFrame:
        return payload.evaluator_entries(self.log)

    @property
    def failures(self) -> DataFrame:
        return mining.max_retry_failures(self.evaluations)

    @property
    def chat(self) -> DataFrame:
        return inputs.chat_log(self.batch("conversations"))

    @property
    def graded(self) -> DataFrame:
        replied = turns.turns(self.chat).where(F.col("response").isNotNull())
        return quality.quality_cascade(replied, self.facts)

    @property
    def facts(self) -> DataFrame:
        return facts.facts_from_table(self.batch("documents"), "source", "text")

    @property
    def checklist_entries(self) -> DataFrame:
        return payload.tool_entries(inputs.checklist_log(self.batch("events")))

    @property
    def decisions(self) -> DataFrame:
        rows = self.batch("events")
        return guard.guard_decisions(inputs.incoming(rows), inputs.incoming_verdicts(rows),
                                     **DAY_LIMIT)

    @property
    def live_decisions(self) -> DataFrame:
        return jobs.guard_decisions(inputs.incoming(self.stream("events")),
                                    inputs.incoming_verdicts(self.batch("events")), **DAY_LIMIT)


def _joined(rows: DataFrame, *names: str) -> DataFrame:
    """Array columns as comma-joined text."""
    for name in names:
        rows = rows.withColumn(name, F.array_join(F.col(name).cast("array<string>"), ","))
    return rows


def _finish(query) -> None:
    query.awaitTermination()


# -- scans, sources, sinks ---------------------------------------------------------

def log_role_counts(t: Tables) -> DataFrame:
    return log.role_counts(t.log)


def _saved_turns(t: Tables) -> DataFrame:
    """A turn per event, as it is saved: turn_id and the columns of ``turns_to_log``."""
    rows = t.batch("events")
    outcome = turns.turn_outcomes(inputs.drafts(rows))
    asked = F.concat(F.lit("q"), F.col("turn_id").cast("string"))
    at = rows.select(F.col("event_id").alias("turn_id"), "ts")
    return outcome.join(at, "turn_id").select(
        "turn_id", (F.col("turn_id") * 4).alias("id"),
        F.concat(F.lit("t"), (F.col("turn_id") % 100).cast("string")).alias("session_id"),
        iso_utc(F.col("ts")).alias("timestamp"),
        asked.alias("user_message"), "response", F.col("tools").alias("tools_used"),
        "attempts", "passed",
        turns.evaluator_detail(F.col("max_retries_exceeded"), F.col("attempts"), asked,
                               F.col("response"), F.col("rejections"))
        .alias("evaluator_detail"))


def turns_to_log(t: Tables) -> DataFrame:
    return turns.turns_to_log(_saved_turns(t))


def appended_log(t: Tables) -> DataFrame:
    """Turns appended in two batches; the log gives the ids."""
    path, saved = shared_dir(t.spark, "appended"), _saved_turns(t)
    for odd in (0, 1):
        append.append_turns(saved.where(F.col("turn_id") % 2 == odd), path)
    return append.read_appended(t.spark, path)


def guard_block_log(t: Tables) -> DataFrame:
    return guard.block_rows(t.decisions)


def session_transcript(t: Tables) -> DataFrame:
    return log.transcript(t.chat)


def session_registry(t: Tables) -> DataFrame:
    return log.session_registry(t.log)


def approved_facts(t: Tables) -> DataFrame:
    return t.facts


def context_rows(t: Tables) -> DataFrame:
    # every ninth fact has no source
    rows = t.batch("documents").withColumn("source", F.expr("if(doc_id % 9 = 0, NULL, source)"))
    return facts.context_rows(facts.facts_from_table(rows, "source", "text"))


def stream_log_counts(t: Tables) -> DataFrame:
    table, state = shared_dir(t.spark, "roles"), shared_dir(t.spark, "roles-state")
    _finish(jobs.start_role_counts(inputs.event_log(t.files("events")), table, state,
                                   sinks.AVAILABLE_NOW))
    return jobs.read_role_counts(t.spark, table)


# -- payloads ------------------------------------------------------------------------

def tool_entries(t: Tables) -> DataFrame:
    args = F.col("args")
    rating = V.member(args, "rating")
    return t.entries.select(
        "id", "session_id", "pos", "name",
        V.text(args, "email").alias("email"), V.text(args, "question").alias("question"),
        V.text(args, "date").alias("date"), V.text(args, "time").alias("time"),
        V.integer(rating).alias("rating"), V.only_string(rating).alias("rating_text"))


def evaluator_entries(t: Tables) -> DataFrame:
    return t.evaluations.select(
        "id", "session_id", "timestamp", "attempts", "passed", "max_retries_exceeded",
        "user_message", "final_response",
        F.size("rejections").cast("bigint").alias("n_rejections"))


def rejections(t: Tables) -> DataFrame:
    return _joined(payload.rejections(t.evaluations), "tools_used")


def guard_blocks(t: Tables) -> DataFrame:
    return payload.guard_blocks(t.log)


def turn_tool_names(t: Tables) -> DataFrame:
    return payload.turn_tool_names(t.log).drop("tools")


def tool_calls_extracted(t: Tables) -> DataFrame:
    calls = payload.tool_calls(inputs.completions(t.batch("events")))
    args = F.col("args")
    return calls.select("id", "pos", "call_id", "name", "known", "result",
                        V.text(args, "email").alias("email"),
                        V.text(args, "time").alias("time"))


def tool_arg_violations(t: Tables) -> DataFrame:
    return payload.arg_violations(payload.tool_calls(inputs.completions(t.batch("events"))))


def nested_arg_violations(t: Tables) -> DataFrame:
    return schemas.schema_violations(inputs.nested_calls(t.batch("events")),
                                     {"plan_meeting": inputs.PLAN_MEETING})


# -- dashboard -----------------------------------------------------------------------

def dashboard_kpis(t: Tables) -> DataFrame:
    return metrics.dashboard_kpis(t.log)


def messages_per_day(t: Tables) -> DataFrame:
    return metrics.messages_per_day(t.log)


def sessions_per_day(t: Tables) -> DataFrame:
    return metrics.sessions_per_day(t.log)


def distinct_sessions(t: Tables) -> DataFrame:
    return distinct.sessions_per_day(t.log, days=None)


def daily_activity(t: Tables) -> DataFrame:
    return metrics.daily_activity(t.log)


def top_unknown_questions(t: Tables) -> DataFrame:
    return metrics.top_unknown_questions(t.entries)


def rating_histogram(t: Tables) -> DataFrame:
    return metrics.rating_histogram(t.entries)


def session_flags(t: Tables) -> DataFrame:
    return metrics.session_flags(t.log)


def failure_count(t: Tables) -> DataFrame:
    return mining.failure_count(t.failures)


# -- event tables ------------------------------------------------------------------------

def leads(t: Tables) -> DataFrame:
    return events.leads(t.entries)


def unknown_questions(t: Tables) -> DataFrame:
    return events.unknown_questions(t.entries)


def feedback(t: Tables) -> DataFrame:
    return events.feedback(t.entries)


def availability_requests(t: Tables) -> DataFrame:
    return events.availability_requests(t.entries)


def bookings(t: Tables) -> DataFrame:
    return events.bookings(t.entries)


def checklist_items(t: Tables) -> DataFrame:
    return checklist.checklist_items(t.checklist_entries)


def checklist_report(t: Tables) -> DataFrame:
    return checklist.checklist_report(t.checklist_entries)


def checklist_bad_marks(t: Tables) -> DataFrame:
    return checklist.bad_marks(t.checklist_entries)


# -- guardrails ------------------------------------------------------------------------------

def unsafe_messages(t: Tables) -> DataFrame:
    return _joined(guard.unsafe_messages(t.chat), "matched_rules")


def rate_limit_decisions(t: Tables) -> DataFrame:
    decided = rate_limit.rate_limit_decisions(inputs.incoming(t.batch("events")), **DAY_LIMIT)
    return decided.drop("ts")


def burst_rate_limit(t: Tables) -> DataFrame:
    """The usual limit; ten senders, messages 400 times closer in time."""
    rows = inputs.incoming(t.batch("events")).selectExpr(
        "id", "'g' || (id % 10) AS session_id",
        "timestamp_micros(unix_micros(ts) div 400) AS ts")
    return rate_limit.rate_limit_decisions(rows).drop("ts")


def guard_verdicts(t: Tables) -> DataFrame:
    return guard.guard_verdicts(inputs.guard_texts(t.batch("labels"))).select("doc_id", "safe")


def guard_decisions(t: Tables) -> DataFrame:
    return t.decisions.select("id", "session_id", "allowed", "reason", "reply")


# -- quality -----------------------------------------------------------------------------------

def reply_word_counts(t: Tables) -> DataFrame:
    return quality.reply_word_counts(t.chat)


def quality_cascade(t: Tables) -> DataFrame:
    return t.graded.select("session_id", "timestamp", "words", "outcome", "feedback")


def operational_turns(t: Tables) -> DataFrame:
    return quality.operational_turns(t.chat)


def context_supports_age(t: Tables) -> DataFrame:
    return facts.context_supports_age(t.facts)


def declined_without_record(t: Tables) -> DataFrame:
    return quality.declined_without_record(turns.turns(t.chat))


def judge_verdicts(t: Tables) -> DataFrame:
    return quality.judge_verdicts(inputs.judge_texts(t.batch("labels"))).select(
        "doc_id", "pass", "feedback")


def _outcome_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "turn_id", "attempts", "passed", "max_retries_exceeded", "response",
        F.array_join(F.transform("rejections", lambda r: F.concat_ws(
            ":", r["attempt"].cast("string"), r["response"], r["feedback"],
            F.array_join(r["tools_used"], "+"))), ",").alias("rejected"))


def turn_outcomes(t: Tables) -> DataFrame:
    return _outcome_columns(turns.turn_outcomes(inputs.drafts(t.batch("events"))))


def turns_assembled(t: Tables) -> DataFrame:
    return _joined(turns.turns(t.log), "tools")


# -- mining and requests -----------------------------------------------------------------------

def max_retry_failures(t: Tables) -> DataFrame:
    return t.failures.drop("rejections")


def failure_digest(t: Tables) -> DataFrame:
    return mining.failure_digest(t.failures)


def chat_requests(t: Tables) -> DataFrame:
    revisions = t.graded.where(F.col("feedback").isNotNull()).select(
        F.col("user_row_id").alias("id"), "feedback")
    rows = requests.chat_requests(t.chat, SYSTEM_TEXT, revisions)
    return rows.select("id", "session_id", F.col("at").alias("place"), F.array_join(F.transform(
        "messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
        .alias("request"))


def chat_history(t: Tables) -> DataFrame:
    return requests.chat_history(t.chat).withColumnRenamed("at", "place")


def long_chat_history(t: Tables) -> DataFrame:
    """The log as five long conversations."""
    session = F.concat(F.lit("c"), (F.col("id") % 20).cast("string"))
    rows = requests.chat_history(t.log.withColumn("session_id", session))
    return rows.withColumnRenamed("at", "place")


def judge_requests(t: Tables) -> DataFrame:
    return requests.judge_requests(t.graded, quality.operational_turns(t.chat))


def guard_requests(t: Tables) -> DataFrame:
    return requests.guard_requests(t.chat)


def outbox_rows(t: Tables) -> DataFrame:
    return outbox.outbox(t.entries, t.decisions)


# -- calls to other programs -----------------------------------------------------------------------

def _rounds(count: int, run) -> None:
    """Run at times far enough apart for every pause to be over."""
    for n in range(count):
        run(datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(hours=n))


def delivered_notices(t: Tables) -> DataFrame:
    """Notices to a receiver that refuses each id % 4 times; given up after three attempts."""
    def send(notice):
        if notice["attempt"] <= notice["id"] % 4:
            raise ConnectionError("refused")

    path, notices = shared_dir(t.spark, "deliveries"), outbox.event_notices(t.entries)
    _rounds(4, lambda now: attempts.deliver_due(notices, path, send, now=now, most=3))
    ledger = attempts.read_ledger(t.spark, path, notices.select(*attempts.NOTICE_KEYS).schema)
    return attempts.outcomes(notices, ledger, attempts.NOTICE_KEYS, 3).select(
        *attempts.NOTICE_KEYS, "attempts", "state")


def answered_requests(t: Tables) -> DataFrame:
    """Classifier requests put to a stand-in that goes by their length and fails on some."""
    def ask(row):
        if len(row["prompt"]) % 5 == 0:
            raise TimeoutError
        return "UNSAFE" if len(row["prompt"]) % 5 == 1 else " safe\n"

    path, asked = shared_dir(t.spark, "answers"), requests.guard_requests(t.chat)
    _rounds(2, lambda now: attempts.ask_due(asked, ["prompt"], path, ask, now=now, most=2))
    found = attempts.answers(asked, ["prompt"], path, most=2)
    return guard.guard_verdicts(found).select("id", "session_id", "attempts", "state", "safe")


# -- streams ---------------------------------------------------------------------------------------

def stream_outbox(t: Tables) -> DataFrame:
    table, state = shared_dir(t.spark, "outbox"), shared_dir(t.spark, "outbox-state")
    notices = outbox.outbox(payload.tool_entries(inputs.event_log(t.stream("events"))),
                            t.live_decisions)
    _finish(jobs.start_outbox(notices, table, state, trigger=sinks.AVAILABLE_NOW))
    return jobs.read_outbox(t.spark, table)


def stream_guard_decisions(t: Tables) -> DataFrame:
    table, state = shared_dir(t.spark, "decided"), shared_dir(t.spark, "decided-state")
    _finish(sinks.start_append(t.live_decisions, table, state, sinks.AVAILABLE_NOW))
    return t.spark.read.parquet(table).select("id", "session_id", "allowed", "reason", "reply")


def stream_block_log(t: Tables) -> DataFrame:
    table, state = shared_dir(t.spark, "blocked"), shared_dir(t.spark, "blocked-state")
    _finish(jobs.start_log(guard.block_rows(t.live_decisions), table, state,
                           sinks.AVAILABLE_NOW))
    return log.read_log(t.spark, table).select(*log.COLUMNS)


def _dashboard(t: Tables, read) -> DataFrame:
    table, state = shared_dir(t.spark, "dashboard"), shared_dir(t.spark, "dashboard-state")
    _finish(jobs.start_dashboard(inputs.event_log(t.files("events")), table, state,
                                 sinks.AVAILABLE_NOW))
    return read(t.spark, table)


def stream_kpis(t: Tables) -> DataFrame:
    return _dashboard(t, jobs.read_kpis)


def stream_daily(t: Tables) -> DataFrame:
    return _dashboard(t, jobs.read_daily)


def stream_daily_activity(t: Tables) -> DataFrame:
    return _dashboard(t, jobs.read_daily_activity)


def stream_top_questions(t: Tables) -> DataFrame:
    return _dashboard(t, jobs.read_top_questions)


def stream_ratings(t: Tables) -> DataFrame:
    return _dashboard(t, jobs.read_ratings)


def stream_rate_limit(t: Tables) -> DataFrame:
    table, state = shared_dir(t.spark, "limited"), shared_dir(t.spark, "limited-state")
    decided = stateful.limited(inputs.incoming(t.stream("events")), **DAY_LIMIT)
    _finish(sinks.start_append(decided, table, state, sinks.AVAILABLE_NOW))
    return t.spark.read.parquet(table)


def stream_late_verdicts(t: Tables) -> DataFrame:
    """Messages in two parts by time; each part's verdicts come with the part after it.

    A last message, far in the future and blocked by a rule, lets the time of those pass
    that never get a verdict.
    """
    asked, told, screened, table = (shared_dir(t.spark, n) for n in (
        "messages", "verdicts", "screened", "late-decided"))
    states = [shared_dir(t.spark, f"late-state-{n}") for n in (1, 2)]
    rows = inputs.incoming(t.batch("events"))
    found = inputs.incoming_verdicts(t.batch("events")).join(
        rows.select("id", F.col("ts").alias("answered_at")), "id")
    half = rows.agg(F.percentile_approx("ts", 0.5)).first()[0]
    end = t.spark.sql("SELECT -1L AS id, 'end' AS session_id, TIMESTAMP '2100-01-01' AS ts, "
                      "'ignore previous instructions' AS content")
    early, late = F.col("ts") <= F.lit(half), F.col("ts") > F.lit(half)
    told_late = found.where(F.col("answered_at") > F.lit(half))
    parts = [(rows.where(early), found.limit(0)),
             (rows.where(late), found.where(F.col("answered_at") <= F.lit(half))),
             (end, told_late)]
    for messages, answers in parts:
        messages.write.mode("append").parquet(asked)
        answers.write.mode("append").parquet(told)
        _finish(verdicts.start_screening(
            t.spark.readStream.schema(rows.schema).parquet(asked), screened, states[0],
            **DAY_LIMIT, trigger=sinks.AVAILABLE_NOW))
        _finish(verdicts.start_decisions(
            t.spark.readStream.schema(verdicts.SCREENED).parquet(screened),
            t.spark.readStream.schema(found.schema).parquet(told), table, states[1],
            wait="400 days", late="400 days", trigger=sinks.AVAILABLE_NOW))
    return verdicts.read_decisions(t.spark, table).where("id >= 0").select(
        "id", "session_id", "allowed", "reason", "reply")


def stream_distinct_sessions(t: Tables) -> DataFrame:
    table, state = shared_dir(t.spark, "distinct"), shared_dir(t.spark, "distinct-state")
    _finish(jobs.start_distinct_sessions(inputs.event_log(t.files("events")), table, state,
                                         sinks.AVAILABLE_NOW))
    return jobs.read_distinct_sessions(t.spark, table)


def stream_unsafe(t: Tables) -> DataFrame:
    table, state = shared_dir(t.spark, "unsafe"), shared_dir(t.spark, "unsafe-state")
    found = guard.unsafe_messages(inputs.chat_log(t.files("conversations")))
    _finish(sinks.start_append(found, table, state, sinks.AVAILABLE_NOW))
    return _joined(t.spark.read.parquet(table), "matched_rules")


def stream_checklist(t: Tables) -> DataFrame:
    table, state = shared_dir(t.spark, "checklist"), shared_dir(t.spark, "checklist-state")
    entries = payload.tool_entries(inputs.checklist_log(t.stream("events")))
    _finish(jobs.start_checklist_backlog(entries, table, state, sinks.AVAILABLE_NOW))
    return stateful.checklist_from_changes(jobs.read_checklist_changes(t.spark, table))


def stream_turn_outcomes(t: Tables) -> DataFrame:
    table, state = shared_dir(t.spark, "turns"), shared_dir(t.spark, "turns-state")
    _finish(jobs.start_turn_backlog(inputs.drafts(t.files("events")), table, state,
                                    sinks.AVAILABLE_NOW))
    return _outcome_columns(jobs.read_turn_outcomes(t.spark, table))


QUERIES = {
    "log_role_counts": log_role_counts,
    "turns_to_log": turns_to_log,
    "appended_log": appended_log,
    "guard_block_log": guard_block_log,
    "session_transcript": session_transcript,
    "session_registry": session_registry,
    "approved_facts": approved_facts,
    "context_rows": context_rows,
    "stream_log_counts": stream_log_counts,
    "tool_entries": tool_entries,
    "evaluator_entries": evaluator_entries,
    "rejections": rejections,
    "guard_blocks": guard_blocks,
    "turn_tool_names": turn_tool_names,
    "tool_calls_extracted": tool_calls_extracted,
    "tool_arg_violations": tool_arg_violations,
    "nested_arg_violations": nested_arg_violations,
    "dashboard_kpis": dashboard_kpis,
    "messages_per_day": messages_per_day,
    "sessions_per_day": sessions_per_day,
    "distinct_sessions": distinct_sessions,
    "daily_activity": daily_activity,
    "top_unknown_questions": top_unknown_questions,
    "rating_histogram": rating_histogram,
    "session_flags": session_flags,
    "failure_count": failure_count,
    "leads": leads,
    "unknown_questions": unknown_questions,
    "feedback": feedback,
    "availability_requests": availability_requests,
    "bookings": bookings,
    "checklist_items": checklist_items,
    "checklist_report": checklist_report,
    "checklist_bad_marks": checklist_bad_marks,
    "unsafe_messages": unsafe_messages,
    "rate_limit_decisions": rate_limit_decisions,
    "burst_rate_limit": burst_rate_limit,
    "guard_verdicts": guard_verdicts,
    "guard_decisions": guard_decisions,
    "reply_word_counts": reply_word_counts,
    "quality_cascade": quality_cascade,
    "operational_turns": operational_turns,
    "context_supports_age": context_supports_age,
    "declined_without_record": declined_without_record,
    "judge_verdicts": judge_verdicts,
    "turn_outcomes": turn_outcomes,
    "turns": turns_assembled,
    "max_retry_failures": max_retry_failures,
    "failure_digest": failure_digest,
    "chat_requests": chat_requests,
    "chat_history": chat_history,
    "long_chat_history": long_chat_history,
    "judge_requests": judge_requests,
    "guard_requests": guard_requests,
    "outbox": outbox_rows,
    "delivered_notices": delivered_notices,
    "answered_requests": answered_requests,
    "stream_late_verdicts": stream_late_verdicts,
    "stream_distinct_sessions": stream_distinct_sessions,
    "stream_outbox": stream_outbox,
    "stream_guard_decisions": stream_guard_decisions,
    "stream_block_log": stream_block_log,
    "stream_kpis": stream_kpis,
    "stream_rate_limit": stream_rate_limit,
    "stream_unsafe": stream_unsafe,
    "stream_daily": stream_daily,
    "stream_daily_activity": stream_daily_activity,
    "stream_top_questions": stream_top_questions,
    "stream_ratings": stream_ratings,
    "stream_checklist": stream_checklist,
    "stream_turn_outcomes": stream_turn_outcomes,
}


def registered():
    def bind(query):
        return lambda spark, folder: query(Tables(spark, folder))

    return {name: bind(query) for name, query in QUERIES.items()}
