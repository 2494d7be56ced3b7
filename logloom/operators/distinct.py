"""Exact distinct sessions per day that merge: bitmaps over dense session numbers.

Sessions get the numbers 1, 2, 3 and so on. A day's sessions are then bits: one bitmap of
32,768 bits per day and range of numbers, made by an aggregation with map-side combine.
Bitmaps of days, batches or weeks merge by "or" and are counted exactly, without a row per
(day, session) ever being kept or shuffled again.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom import constants as C
from logloom.functions.running import placed_by_sums
from logloom.session import stored
from logloom.sources.log import role_rows, with_day

#: ``monotonically_increasing_id`` holds the partition above so many bits.
TURN_BITS = 33


def said(messages: DataFrame) -> DataFrame:
    """session_id, day of the user messages; no session is the one named by the empty text."""
    return with_day(role_rows(messages, C.USER)).fillna("", ["session_id"]).select(
        "session_id", "day")


def numbered_sessions(sessions: DataFrame, first: int = 1) -> DataFrame:
    """session_id, number: distinct sessions numbered from ``first`` in their order."""
    rows = sessions.select("session_id").distinct().withColumn("_one", F.lit(1).cast("bigint"))
    return placed_by_sums(rows, ["session_id"], "_one", "number").select(
        "session_id", (F.col("number") + first).alias("number"))


def numbered_in_parts(sessions: DataFrame, first: int = 1) -> DataFrame:
    """session_id, number: distinct sessions numbered from ``first``, one part after the other.

    As ``numbered_sessions`` without its order: rows are stored where they lie and one
    count per partition is fetched, so nothing is sorted or dealt again.
    """
    laid = stored(sessions.select("session_id").withColumn(
        "_turn", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_turn", TURN_BITS)
    offsets, at = [], first
    for row in laid.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy(
            "part").collect():
        offsets += [F.lit(row.part), F.lit(at)]
        at += row.n
    if not offsets:
        return laid.select("session_id", F.lit(first).cast("bigint").alias("number"))
    start = F.try_element_at(F.create_map(*offsets), part)
    turn = F.col("_turn").bitwiseAND(F.lit((1 << TURN_BITS) - 1))
    return laid.select("session_id", (start + turn).cast("bigint").alias("number"))


def day_bitmaps(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """day, bucket, bits for rows (session_id, day)."""
    # distinct first: on the map side that leaves a row per session and day of a task
    return (
        rows.distinct().join(numbers, "session_id")
        .groupBy("day", F.bitmap_bucket_number("number").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")))


def merged_bitmaps(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.groupBy("day", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def counted(bitmaps: DataFrame, days: int | None = C.ACTIVE_DAYS) -> DataFrame:
    """day, sessions: of the latest ``days`` active days, or of all."""
    per_day = merged_bitmaps(bitmaps).groupBy("day").agg(
        F.sum(F.bitmap_count("bits")).alias("sessions"))
    return per_day if days is None else per_day.orderBy(F.desc("day")).limit(days)


def counted_over(bitmaps: DataFrame) -> DataFrame:
    """sessions: the distinct sessions of all days in ``bitmaps`` together, one row."""
    return bitmaps.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")).agg(
        F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("sessions"))


def sessions_per_day(messages: DataFrame, days: int | None = C.ACTIVE_DAYS) -> DataFrame:
    rows = said(messages)
    return counted(day_bitmaps(rows, numbered_sessions(rows)), days)
