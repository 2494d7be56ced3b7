"""Dashboard metrics over the message log."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom import constants as C
from logloom.functions import variant as V
from logloom.functions.running import place
from logloom.functions.text import percent
from logloom.operators.payload import tool_entries
from logloom.sources.log import role_rows, with_day

FLAGS = ["has_user", "has_lead", "has_call", "has_unknown"]


def counts_as_lead(name: Column, args: Column) -> Column:
    """A details call with any non-empty email value."""
    return F.coalesce((name == C.RECORD_DETAILS) & V.truthy(V.member(args, "email")),
                      F.lit(False))


def row_flags(messages: DataFrame) -> DataFrame:
    """Each user row and tool call with what it says about its session.

    The two roles are read apart, so that user texts are not read at all.
    """
    no = F.lit(False)
    users = role_rows(messages, C.USER).select(
        "session_id", F.lit(True).alias("has_user"), no.alias("has_lead"), no.alias("has_call"),
        no.alias("has_unknown"))
    name = F.col("name")
    calls = tool_entries(messages).select(
        "session_id", no.alias("has_user"),
        counts_as_lead(name, F.col("args")).alias("has_lead"),
        (name == C.SCHEDULE_CALL).alias("has_call"),
        (name == C.RECORD_UNKNOWN).alias("has_unknown"))
    return users.unionByName(calls)


def merge_flags(flags: DataFrame) -> DataFrame:
    """One row per session; OR-ing is idempotent, so replayed rows do no harm."""
    return flags.groupBy("session_id").agg(*[F.bool_or(f).alias(f) for f in FLAGS])


def session_flags(messages: DataFrame) -> DataFrame:
    """has_user, has_lead, has_call, has_unknown per session."""
    return merge_flags(row_flags(messages))


def counted_rows(messages: DataFrame) -> DataFrame:
    """Each user row and tool call with all that the dashboard counts of it, parsed once.

    The flags of ``row_flags``; ``day`` of a user row; ``question``, ``is_text`` and the
    place ``at`` of an unanswered question; ``r``, a rating from 1 to 5.
    """
    no, name, args = F.lit(False), F.col("name"), F.col("args")
    question = V.member(args, "question")
    asked = F.coalesce((name == C.RECORD_UNKNOWN) & V.truthy(question), no)
    rating = F.when(name == C.RECORD_FEEDBACK, V.integer(V.member(args, "rating")))
    calls = tool_entries(messages).select(
        "session_id", F.lit(None).cast("string").alias("day"), no.alias("has_user"),
        counts_as_lead(name, args).alias("has_lead"),
        (name == C.SCHEDULE_CALL).alias("has_call"),
        (name == C.RECORD_UNKNOWN).alias("has_unknown"),
        F.when(asked, V.text(args, "question")).alias("question"),
        F.when(asked, V.json_type(question) == "STRING").alias("is_text"),
        F.when(asked, place(F.col("id"), F.col("pos"))).alias("at"),
        F.when(rating.between(1, 5), rating).alias("r"))
    users = role_rows(with_day(messages), C.USER).select(
        "session_id", "day", F.lit(True).alias("has_user"), no.alias("has_lead"),
        no.alias("has_call"), no.alias("has_unknown"),
        *[F.lit(None).cast(calls.schema[c].dataType).alias(c)
          for c in ("question", "is_text", "at", "r")])
    return users.unionByName(calls)


def kpis(flags: DataFrame) -> DataFrame:
    """The one-row KPI bundle from session flags.

    Lead, call and unknown sessions come from tool rows, the total from user
    rows; the sets are not intersected, so a rate may exceed 100.
    """
    def sessions(flag):
        return F.count_if(F.col(flag))

    return flags.agg(
        sessions("has_user").alias("sessions"),
        sessions("has_lead").alias("lead_sessions"),
        sessions("has_call").alias("call_sessions"),
        sessions("has_unknown").alias("_unknown"),
    ).select(
        "sessions",
        percent(F.col("lead_sessions"), F.col("sessions")).alias("lead_rate"),
        "lead_sessions",
        "call_sessions",
        percent(F.col("_unknown"), F.col("sessions")).alias("unknown_rate"),
    )


def dashboard_kpis(messages: DataFrame) -> DataFrame:
    """KPIs in one pass over the log and one shuffle on session."""
    return kpis(session_flags(messages))


def _recent(messages: DataFrame, days: int) -> DataFrame:
    """User rows of the latest active days.

    In a stored log day and role are folders: the days are found without reading
    a column, and only their folders are read. Elsewhere a second scan would save
    nothing, so all user rows are taken.
    """
    users = role_rows(with_day(messages), C.USER)
    if "day" not in messages.columns:
        return users
    latest = _latest(users.groupBy("day").agg(F.count(F.lit(1)).alias("_n")), days)
    # as many rows as days
    return users.join(F.broadcast(latest.select("day")), "day", "left_semi")


def _latest(days: DataFrame, limit: int) -> DataFrame:
    return days.orderBy(F.desc("day")).limit(limit)


def messages_per_day(messages: DataFrame, days: int = C.ACTIVE_DAYS) -> DataFrame:
    """User messages of the latest active days, oldest first."""
    per_day = role_rows(with_day(messages), C.USER).groupBy("day").agg(
        F.count(F.lit(1)).alias("messages"))
    return _latest(per_day, days).orderBy("day")


def sessions_per_day(messages: DataFrame, days: int = C.ACTIVE_DAYS) -> DataFrame:
    """Distinct sessions with a user row of the latest active days, oldest first."""
    per_day = _recent(messages, days).groupBy("day").agg(
        F.count_distinct("session_id").alias("sessions"))
    return _latest(per_day, days).orderBy("day")


def daily_activity(messages: DataFrame, days: int = C.ACTIVE_DAYS,
                   labels=(C.LABEL_MESSAGES, C.LABEL_SESSIONS)) -> DataFrame:
    """Both daily series as (day, metric, value), two rows per day.

    Both series count user rows, so they share their days and one aggregation
    gives what limiting each and merging them would. Counting per (day,
    session) first keeps a busy day off a single task.
    """
    return activity_rows(_per_day_session(_recent(messages, days)), days, labels)


def day_sessions(messages: DataFrame) -> DataFrame:
    """User messages per (day, session)."""
    return _per_day_session(role_rows(with_day(messages), C.USER))


def _per_day_session(users: DataFrame) -> DataFrame:
    return users.groupBy("day", "session_id").agg(F.count(F.lit(1)).alias("n"))


def activity_rows(per_session: DataFrame, days: int = C.ACTIVE_DAYS,
                  labels=(C.LABEL_MESSAGES, C.LABEL_SESSIONS)) -> DataFrame:
    per_day = per_session.groupBy("day").agg(F.sum("n").alias(labels[0]),
                                             F.count(F.lit(1)).alias(labels[1]))
    return (
        _latest(per_day, days)
        .unpivot("day", list(labels), "metric", "value")
        .orderBy("day", "metric")
    )


def asked_questions(entries: DataFrame) -> DataFrame:
    """Unanswered questions by exact value: times asked and where first seen.

    The text "5" and the number 5 are different questions; ``is_text`` tells.
    """
    question = V.member(F.col("args"), "question")
    return (
        entries.where((F.col("name") == C.RECORD_UNKNOWN) & V.truthy(question))
        .select(V.text(F.col("args"), "question").alias("question"),
                (V.json_type(question) == "STRING").alias("is_text"),
                place(F.col("id"), F.col("pos")).alias("at"))
        .groupBy("question", "is_text").agg(F.count(F.lit(1)).alias("times"), F.min("at").alias("first"))
    )


def most_asked(asked: DataFrame, limit: int = C.TOP_QUESTIONS) -> DataFrame:
    return asked.orderBy(F.desc("times"), "first").limit(limit).select("question", "times")


def top_unknown_questions(entries: DataFrame, limit: int = C.TOP_QUESTIONS) -> DataFrame:
    """The most asked unanswered questions, first seen first on ties."""
    return most_asked(asked_questions(entries), limit)


def rating_counts(entries: DataFrame) -> DataFrame:
    """How often each rating from 1 to 5 was given as a JSON integer."""
    return (
        entries.where(F.col("name") == C.RECORD_FEEDBACK)
        .select(V.integer(V.member(F.col("args"), "rating")).alias("r"))
        .where(F.col("r").between(1, 5))
        .groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    )


def zero_filled_ratings(counts: DataFrame) -> DataFrame:
    """Five rows, or none if nothing was rated; both sides hold at most five."""
    scale = counts.sparkSession.range(1, 6).select(F.col("id").alias("r"))
    filled = scale.join(F.broadcast(counts), "r", "left").select(
        F.col("r").cast("string").alias("rating"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("count"))
    total = F.sum("count").over(W.partitionBy(F.lit(0)))
    return (
        filled.withColumn("_total", total).where(F.col("_total") > 0).drop("_total")
        .orderBy("rating")
    )


def rating_histogram(entries: DataFrame) -> DataFrame:
    """Counts of ratings 1 to 5, zero filled; no rows if there is no such rating."""
    return zero_filled_ratings(rating_counts(entries))
