"""Decisions on messages whose classifier verdict comes later, as a stream of its own.

Two jobs. ``start_screening`` decides the rate limit and the rules and stores every
message with both. ``awaited`` reads that table and the verdicts as streams: what limit
or rules block is decided at once; the others wait in the state of a stream-stream join
until their verdict comes, and are blocked when ``wait`` has passed without one.

Time is that of the messages. The verdict side is told it too, so that messages time out
even if no verdict ever comes. A message without a time cannot wait and is blocked; one
that comes more than ``late`` after newer ones is dropped by Spark, and so never allowed.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom import constants as C
from logloom.operators.guard import ruled, verdict_is_safe, with_reason
from logloom.streaming.sinks import read_batches, start_append, start_batches, write_batch
from logloom.streaming.stateful import with_rate_limit

SCREENED = ("id bigint, session_id string, ts timestamp, preview string, unsafe boolean, "
            "within_limit boolean")
NO_MESSAGE = -(1 << 63)
DECISION = ("id bigint, session_id string, ts timestamp, preview string, allowed boolean, "
            "reason string, reply string")


def start_screening(messages: DataFrame, table: str, checkpoint: str, limit: int = C.RATE_LIMIT,
                    window_seconds: int = C.RATE_WINDOW_SECONDS, late: str | None = None,
                    trigger=None) -> StreamingQuery:
    """Store every message (id, session_id, ts, content) with its limit and rules."""
    rows = ruled(messages.withColumn("ts", F.col("ts").cast("timestamp")))
    return start_append(with_rate_limit(rows, limit, window_seconds, late), table, checkpoint,
                        trigger)


def awaited(screened: DataFrame, verdicts: DataFrame, wait: str = "10 minutes",
            late: str = "10 minutes") -> DataFrame:
    """One decision per message and verdict; ``read_decisions`` makes it one per message.

    ``screened`` is a stream of SCREENED rows, ``verdicts`` one of (id, verdict,
    answered_at). A verdict counts from its message's time on, for ``wait``.
    """
    # rows that only tell the time are dropped after they have told it: these conditions
    # read the time, so that no optimiser moves them before it
    waits = F.coalesce(F.when(F.col("ts").isNotNull(), F.col("within_limit") & ~F.col("unsafe")),
                       F.lit(False))
    answers_one = F.when(F.col("_at").isNotNull(), F.col("_of") != NO_MESSAGE)
    closed = with_reason(screened.where(~waits), F.lit(True))
    asked = screened.withWatermark("ts", late).where(waits)
    clock = screened.select(F.lit(NO_MESSAGE).cast("bigint").alias("_of"),
                            F.lit(None).cast("string").alias("verdict"),
                            F.col("ts").alias("_at"))
    answers = (
        verdicts.select(F.col("id").alias("_of"), "verdict",
                        F.col("answered_at").cast("timestamp").alias("_at"))
        .unionByName(clock).withWatermark("_at", late).where(answers_one))
    met = asked.join(answers, F.expr(
        f"id = _of AND _at >= ts AND _at <= ts + INTERVAL {wait}"), "left_outer")
    return closed.unionByName(with_reason(met, ~verdict_is_safe(F.col("verdict"))))


def start_decisions(screened: DataFrame, verdicts: DataFrame, table: str, checkpoint: str,
                    wait: str = "10 minutes", late: str = "10 minutes",
                    trigger=None) -> StreamingQuery:
    return start_batches(awaited(screened, verdicts, wait, late), checkpoint,
                         lambda rows, n: write_batch(rows, table, n), trigger)


def read_decisions(spark: SparkSession, table: str) -> DataFrame:
    """One decision per message; of several verdicts one that blocks counts."""
    decision = F.min(F.struct("allowed", "reason", "reply")).alias("d")
    return (
        read_batches(spark, table, DECISION)
        .groupBy("id", "session_id", "ts", "preview").agg(decision)
        .select("id", "session_id", "ts", "preview", "d.allowed", "d.reason", "d.reply"))
