"""Streaming jobs over the message log.

Each ``start_*`` takes a streaming DataFrame, a table folder and a checkpoint
folder and returns the running query; each ``read_*`` gives the current result
as a batch DataFrame. ``trigger`` is ``REFRESH`` (30 seconds) by default;
``AVAILABLE_NOW`` drains the source and stops.
"""

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom import constants as C
from logloom.functions.text import preview
from logloom.operators import checklist, distinct, metrics, turns
from logloom.operators.guard import decided, is_unsafe, ruled
from logloom.session import stored
from logloom.sources.log import LOG_SCHEMA, role_counts, with_day
from logloom.streaming.sinks import (
    OPEN, Version, batch_folder, compact, pinned, publish, read_batches, read_version,
    remove_covered, start_append, start_batches, write_batch)
from logloom.streaming.stateful import ended_drafts, with_rate_limit

NOTICE = "id bigint, pos int, kind string, text string"
OUTCOME = ("turn_id bigint, attempts bigint, passed boolean, max_retries_exceeded boolean, "
           "response string, tools array<string>, rejections array<struct<attempt: int, "
           "response: string, feedback: string, tools_used: array<string>>>")


# -- the log itself ------------------------------------------------------------------

def start_log(rows: DataFrame, path: str, checkpoint: str, trigger=None) -> StreamingQuery:
    """Append log rows, as from ``turns_to_log`` or ``block_rows``, by day and role."""
    return start_append(with_day(rows), path, checkpoint, trigger, ["day", "role"])


# -- rows per role -----------------------------------------------------------------

def start_role_counts(messages: DataFrame, table: str, checkpoint: str,
                      trigger=None) -> StreamingQuery:
    return start_batches(messages, checkpoint,
                         lambda rows, n: write_batch(role_counts(rows), table, n), trigger)


def read_role_counts(spark: SparkSession, table: str) -> DataFrame:
    return read_batches(spark, table, "role string, n bigint").groupBy("role").agg(F.sum("n").alias("n"))


# -- refreshing dashboard ------------------------------------------------------------

@dataclass(frozen=True)
class LiveDashboard:
    version: Version | None
    kpis: DataFrame
    daily: DataFrame
    unknown: DataFrame
    ratings: DataFrame


def _merge_days(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day", "session_id").agg(F.sum("n").alias("n"))


def _merge_questions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("question", "is_text").agg(F.sum("times").alias("times"),
                                        F.min("first").alias("first"))


def _merge_ratings(rows: DataFrame) -> DataFrame:
    return rows.groupBy("r").agg(F.sum("n").alias("n"))


DASHBOARD_TABLES = {
    "flags": metrics.merge_flags,
    "days": _merge_days,
    "questions": _merge_questions,
    "ratings": _merge_ratings,
}


def _dashboard_parts(rows: DataFrame) -> dict[str, DataFrame]:
    return _parts_of(metrics.counted_rows(rows))


def _parts_of(counted: DataFrame) -> dict[str, DataFrame]:
    """The four parts from ``metrics.counted_rows``."""
    one = F.count(F.lit(1))
    return {
        "flags": metrics.merge_flags(counted),
        "days": counted.where("has_user").groupBy("day", "session_id").agg(one.alias("n")),
        "questions": counted.where("at IS NOT NULL").groupBy("question", "is_text").agg(
            one.alias("times"), F.min("at").alias("first")),
        "ratings": counted.where("r IS NOT NULL").groupBy("r").agg(one.alias("n"))}


def _dashboard_table(spark: SparkSession, table: str, name: str,
                     version: Version | None = None) -> DataFrame:
    """A part as ``version`` has it, else as the newest version that is complete."""
    schema = _dashboard_parts(spark.createDataFrame([], LOG_SCHEMA))[name].schema
    version = version or pinned(spark, table)
    rows = (read_batches(spark, f"{table}/{name}", schema) if version is None
            else read_version(spark, f"{table}/{name}", schema, version))
    return DASHBOARD_TABLES[name](rows)


def start_dashboard(messages: DataFrame, table: str, checkpoint: str,
                    trigger=None) -> StreamingQuery:
    """Keep mergeable parts of all dashboard metrics; late rows always count.

    A batch becomes visible, in all parts at once, when all its parts are written. A
    repeated batch that was complete is not written again.
    """
    spark = messages.sparkSession
    if pinned(spark, table) is None:
        publish(spark, table, "batch", OPEN)

    def write(rows, batch_id):
        session = rows.sparkSession
        if pinned(session, table).batch >= batch_id:
            return
        rows = rows.persist()
        try:
            _at_once([(part, f"{table}/{name}", batch_id)
                      for name, part in _parts_of(rows).items()])
        finally:
            rows.unpersist()
        publish(session, table, "batch", batch_id)

    # payloads are parsed here, once for all parts
    return start_batches(metrics.counted_rows(messages), checkpoint, write, trigger)


def _at_once(writes: list[tuple[DataFrame, str, int]]) -> None:
    """Write tables beside each other, so that small jobs do not wait in turn."""
    session = writes[0][0].sparkSession
    with ThreadPoolExecutor(len(writes)) as pool:
        for done in [pool.submit(inheritable_thread_target(session)(write_batch), *w)
                     for w in writes]:
            done.result()


def compact_dashboard(spark: SparkSession, table: str, upto: int) -> None:
    """Fold all parts up to batch ``upto``, which must be complete, and then publish that."""
    if pinned(spark, table).batch < upto:
        raise ValueError(f"batch {upto} of {table} is not complete")
    for name, merge in DASHBOARD_TABLES.items():
        compact(spark, f"{table}/{name}", merge, upto)
    publish(spark, table, "snapshot", upto)


def remove_compacted(spark: SparkSession, table: str, upto: int) -> None:
    for name in DASHBOARD_TABLES:
        remove_covered(spark, f"{table}/{name}", upto)


def read_dashboard(spark: SparkSession, table: str, days: int = C.ACTIVE_DAYS,
                   limit: int = C.TOP_QUESTIONS) -> LiveDashboard:
    """All metrics as after one and the same batch, however many are being written."""
    version = pinned(spark, table)
    return LiveDashboard(
        version, read_kpis(spark, table, version),
        read_daily_activity(spark, table, days, version),
        read_top_questions(spark, table, limit, version), read_ratings(spark, table, version))


def read_kpis(spark: SparkSession, table: str, version: Version | None = None) -> DataFrame:
    return metrics.kpis(_dashboard_table(spark, table, "flags", version))


def read_daily_activity(spark: SparkSession, table: str, days: int = C.ACTIVE_DAYS,
                        version: Version | None = None) -> DataFrame:
    return metrics.activity_rows(_dashboard_table(spark, table, "days", version), days)


def read_daily(spark: SparkSession, table: str, days: int = C.ACTIVE_DAYS,
               version: Version | None = None) -> DataFrame:
    """day, messages, sessions of the latest active days; late rows count."""
    per_day = _dashboard_table(spark, table, "days", version).groupBy("day").agg(
        F.sum("n").alias("messages"), F.count(F.lit(1)).alias("sessions"))
    return per_day.orderBy(F.desc("day")).limit(days)


def read_top_questions(spark: SparkSession, table: str, limit: int = C.TOP_QUESTIONS,
                       version: Version | None = None) -> DataFrame:
    return metrics.most_asked(_dashboard_table(spark, table, "questions", version), limit)


def read_ratings(spark: SparkSession, table: str, version: Version | None = None) -> DataFrame:
    return metrics.zero_filled_ratings(_dashboard_table(spark, table, "ratings", version))


# -- distinct sessions per day ----------------------------------------------------------------

SESSIONS, BITMAPS = "session_id string, number bigint", "day string, bucket bigint, bits binary"


def start_distinct_sessions(messages: DataFrame, table: str, checkpoint: str,
                            trigger=None) -> StreamingQuery:
    """Keep each session's number, and per day and batch the bitmaps of its sessions.

    New sessions get the numbers after those of the last complete batch; a batch that is
    written again numbers its sessions and makes its bitmaps anew. Late rows count.
    """
    spark = messages.sparkSession
    if pinned(spark, table) is None:
        publish(spark, table, "batch", OPEN)

    def write(rows, batch_id):
        session = rows.sparkSession
        version = pinned(session, table)
        if version.batch >= batch_id:
            return
        known = read_version(session, f"{table}/sessions", SESSIONS, version)
        said = stored(rows.distinct(), "said")
        new = said.join(known, "session_id", "left_anti").select("session_id").distinct()
        write_batch(distinct.numbered_in_parts(new, known.count() + 1), f"{table}/sessions",
                    batch_id)
        numbers = known.unionByName(
            session.read.schema(SESSIONS).parquet(batch_folder(f"{table}/sessions", batch_id)))
        write_batch(distinct.day_bitmaps(said, numbers), f"{table}/bitmaps", batch_id)
        publish(session, table, "batch", batch_id)

    return start_batches(distinct.said(messages), checkpoint, write, trigger)


def compact_distinct_sessions(spark: SparkSession, table: str, upto: int) -> None:
    if pinned(spark, table).batch < upto:
        raise ValueError(f"batch {upto} of {table} is not complete")
    compact(spark, f"{table}/sessions", lambda rows: rows, upto)
    compact(spark, f"{table}/bitmaps", distinct.merged_bitmaps, upto)
    publish(spark, table, "snapshot", upto)


def read_distinct_sessions(spark: SparkSession, table: str,
                           days: int | None = C.ACTIVE_DAYS) -> DataFrame:
    """day, sessions as of the last complete batch."""
    version = pinned(spark, table) or Version(OPEN)
    return distinct.counted(read_version(spark, f"{table}/bitmaps", BITMAPS, version), days)


# -- turn outcomes ---------------------------------------------------------------------------

def start_turn_outcomes(drafts: DataFrame, table: str, checkpoint: str,
                        trigger=None, keep_ms: int | None = None) -> StreamingQuery:
    """Write a turn as soon as the drafts are there that end it; only open turns have state."""
    def write(rows, batch_id):
        write_batch(turns.fold_drafts(rows).where("ended").drop("ended"), table, batch_id)

    return start_batches(ended_drafts(drafts, keep_ms=keep_ms), checkpoint, write, trigger)


def start_turn_backlog(drafts: DataFrame, table: str, checkpoint: str,
                       trigger=None) -> StreamingQuery:
    """As ``start_turn_outcomes``, for few large micro-batches: joins instead of keyed state.

    Per micro-batch the drafts of turns that have ended are dropped by ``table`` and the
    open ones of the batch before, kept beside the checkpoint, come in again. So a batch
    costs what it and the ended turns' ids hold, and no call per turn.
    """
    def write(rows, batch_id):
        session, kept = rows.sparkSession, f"{checkpoint}/open-drafts"
        ended = read_version(session, table, OUTCOME, Version(batch_id - 1)).select(
            F.col("turn_id").alias("_ended"))
        todo = rows.join(ended, F.col("turn_id").eqNullSafe(F.col("_ended")), "left_anti")
        if batch_id:
            todo = todo.unionByName(
                session.read.schema(rows.schema).parquet(batch_folder(kept, batch_id - 1)))
        folded = stored(turns.fold_drafts(todo), "folded")
        waiting = folded.where("NOT ended").select(F.col("turn_id").alias("_open"))
        write_batch(todo.join(waiting, F.col("turn_id").eqNullSafe(F.col("_open")), "left_semi")
                    .distinct(), kept, batch_id)
        write_batch(folded.where("ended").drop("ended"), table, batch_id)

    return start_batches(drafts, checkpoint, write, trigger)


def read_turn_outcomes(spark: SparkSession, table: str) -> DataFrame:
    """Each ended turn, as it was written when it ended."""
    return read_batches(spark, table, OUTCOME)


# -- checklists ------------------------------------------------------------------------------

CHANGE = "session_id string, item_no bigint, item string, mark_ok boolean"


def start_checklist_backlog(entries: DataFrame, table: str, checkpoint: str,
                            trigger=None) -> StreamingQuery:
    """As ``stateful.checklist_changes``, for few large micro-batches: joins instead of state.

    Per micro-batch the items that sessions had before are counted from ``table``, so a
    batch costs what it and the items hold, and no call per session.
    """
    def write(rows, batch_id):
        before = read_version(rows.sparkSession, table, CHANGE, Version(batch_id - 1)).where(
            "mark_ok IS NULL").groupBy("session_id").agg(F.max("item_no").alias("items"))
        write_batch(checklist.changes(rows, before), table, batch_id)

    return start_batches(checklist.calls(entries), checkpoint, write, trigger)


def read_checklist_changes(spark: SparkSession, table: str) -> DataFrame:
    return read_batches(spark, table, CHANGE)


# -- screening and outbox -------------------------------------------------------------------

def screened(messages: DataFrame) -> DataFrame:
    """Decide each message by the rules alone; no state, no shuffle."""
    unsafe = is_unsafe(F.col("content"))
    return messages.select(
        "id", "session_id", "ts", preview(F.col("content")).alias("preview"),
        (~unsafe).alias("allowed"),
        F.when(unsafe, "unsafe").alias("reason"))


def guard_decisions(messages: DataFrame, verdicts: DataFrame | None = None,
                    limit: int = C.RATE_LIMIT,
                    window_seconds: int = C.RATE_WINDOW_SECONDS) -> DataFrame:
    """The whole decision on a stream of messages: rate limit, then rules, then verdict.

    As ``guard.guard_decisions``; ``verdicts`` is a table that is read per micro-batch.
    """
    rows = with_rate_limit(ruled(messages), limit, window_seconds)
    return decided(rows, verdicts)


def start_outbox(notices: DataFrame, table: str, checkpoint: str, deliver=None,
                 trigger=None) -> StreamingQuery:
    """Append notices (id, pos, kind, text); ``deliver`` gets each written batch.

    After a failure a batch may be delivered again, with the same keys.
    """
    def write(rows, batch_id):
        write_batch(rows, table, batch_id)
        if deliver is not None:
            deliver(rows.sparkSession.read.parquet(batch_folder(table, batch_id)))

    return start_batches(notices, checkpoint, write, trigger)


def read_outbox(spark: SparkSession, table: str) -> DataFrame:
    return read_batches(spark, table, NOTICE).dropDuplicates(["id", "pos", "kind"])
