"""Event tables: one row per recorded call of a tool, with typed columns."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom import constants as C
from logloom.functions import variant as V
from logloom.operators.metrics import counts_as_lead

KEYS = ["id", "session_id", "pos"]


def _calls(entries: DataFrame, tool: str) -> DataFrame:
    return entries.where(F.col("name") == tool)


def _arg(name: str, default: str | None = None):
    args = F.col("args")
    value = V.text(args, name) if default is None else V.text_or(args, name, default)
    return value.alias(name)


def leads(entries: DataFrame) -> DataFrame:
    """Every details call; ``counts_as_lead`` marks those with an email."""
    return _calls(entries, C.RECORD_DETAILS).select(
        *KEYS, _arg("email"), _arg("name", C.DEFAULT_NAME), _arg("notes", C.DEFAULT_NOTES),
        counts_as_lead(F.col("name"), F.col("args")).alias("counts_as_lead"))


def unknown_questions(entries: DataFrame) -> DataFrame:
    return _calls(entries, C.RECORD_UNKNOWN).select(*KEYS, _arg("question"))


def feedback(entries: DataFrame) -> DataFrame:
    """Every feedback call; ``rating`` is NULL unless it is a JSON integer."""
    return _calls(entries, C.RECORD_FEEDBACK).select(
        *KEYS, V.integer(V.member(F.col("args"), "rating")).alias("rating"),
        _arg("comment", C.DEFAULT_COMMENT))


def availability_requests(entries: DataFrame) -> DataFrame:
    return _calls(entries, C.CHECK_AVAILABILITY).select(
        *KEYS, _arg("date"), _arg("time_preference", C.DEFAULT_TIME_PREFERENCE))


def bookings(entries: DataFrame) -> DataFrame:
    return _calls(entries, C.SCHEDULE_CALL).select(
        *KEYS, _arg("email"), _arg("date"), _arg("time"), _arg("name", C.DEFAULT_NAME))
