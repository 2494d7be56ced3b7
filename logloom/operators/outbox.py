"""Notifications as rows: one per recorded event, one per blocked message."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom import constants as C
from logloom.functions import variant as V


NONE = "None"


def _arg(name: str, default: str = NONE):
    """An argument as a notice shows it: null as None, booleans capitalised."""
    args = F.col("args")
    value = F.coalesce(V.text_or(args, name, default), F.lit(NONE))
    is_boolean = V.json_type(V.member(args, name)) == "BOOLEAN"
    return F.when(is_boolean, F.initcap(value)).otherwise(value)


def event_notices(entries: DataFrame) -> DataFrame:
    """id, pos, kind, text for the five tools that notify; one projection."""
    notices = [
        (C.RECORD_DETAILS, "lead",
         F.format_string(C.NOTICE_LEAD, _arg("name", C.DEFAULT_NAME), _arg("email"),
                         _arg("notes", C.DEFAULT_NOTES))),
        (C.RECORD_UNKNOWN, "unknown_question",
         F.format_string(C.NOTICE_UNKNOWN, _arg("question"))),
        (C.RECORD_FEEDBACK, "feedback",
         F.format_string(C.NOTICE_FEEDBACK, _arg("rating"),
                         _arg("comment", C.DEFAULT_COMMENT))),
        (C.CHECK_AVAILABILITY, "availability",
         F.format_string(C.NOTICE_AVAILABILITY, _arg("date"),
                         _arg("time_preference", C.DEFAULT_TIME_PREFERENCE))),
        (C.SCHEDULE_CALL, "booking",
         F.format_string(C.NOTICE_BOOKING, _arg("name", C.DEFAULT_NAME), _arg("email"),
                         _arg("date"), _arg("time"))),
    ]
    kind = text = F
    for tool, label, notice in notices:
        kind = kind.when(F.col("name") == tool, label)
        text = text.when(F.col("name") == tool, notice)
    return entries.select("id", "pos", kind.alias("kind"), text.alias("text")).where(
        F.col("kind").isNotNull())


def block_notices(decisions: DataFrame) -> DataFrame:
    """The same columns for blocked messages; ``pos`` is 0."""
    short = F.substring("session_id", 1, C.SESSION_PREFIX_CHARS)
    text = F.when(F.col("reason") == "rate_limit",
                  F.format_string(C.NOTICE_RATE_LIMIT, short)).otherwise(
        F.format_string(C.NOTICE_UNSAFE, F.col("preview")))
    return decisions.where(~F.col("allowed")).select(
        "id", F.lit(0).alias("pos"), F.concat(F.lit("blocked_"), F.col("reason")).alias("kind"),
        text.alias("text"))


def outbox(entries: DataFrame, decisions: DataFrame) -> DataFrame:
    return event_notices(entries).unionByName(block_notices(decisions))
