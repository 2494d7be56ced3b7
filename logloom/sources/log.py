"""The message log: batch and stream reads, role scans, partitioned writes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import constants as C

LOG_SCHEMA = "id bigint, session_id string, timestamp string, role string, content string"
LAYOUT_SCHEMA = LOG_SCHEMA + ", day string"
COLUMNS = ["id", "session_id", "timestamp", "role", "content"]


def with_day(messages: DataFrame) -> DataFrame:
    """Add ``day``, the first ten characters of the ISO timestamp, unless stored."""
    if "day" in messages.columns:
        return messages
    return messages.withColumn("day", F.substring("timestamp", 1, 10))


def with_ts(messages: DataFrame) -> DataFrame:
    """Add ``ts``, the timestamp as such; NULL where the text is none."""
    return messages.withColumn("ts", F.try_to_timestamp("timestamp"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Read a log written by :func:`write_log`; role and day filters prune files."""
    return spark.read.schema(LAYOUT_SCHEMA).parquet(path)


def read_export(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Read a log exported by another program as JSON lines, CSV with header or ORC.

    Rows without a session are one session, named by the empty text.
    """
    reader = spark.read.schema(LOG_SCHEMA)
    if fmt == "csv":
        # texts may hold line breaks and doubled quotes
        reader = reader.options(header=True, multiLine=True, quote='"', escape='"')
    return reader.format(fmt).load(path).fillna("", ["session_id"])


def stream_log(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same log as a stream of newly added files."""
    reader = spark.readStream.schema(LAYOUT_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def write_log(messages: DataFrame, path: str, mode: str = "append") -> None:
    """Append rows partitioned by day and role.

    The rebalance hint lets AQE split a day and role that hold much of the data
    and merge small ones, so files come out even. Rows without a session are one
    session, named by the empty text.
    """
    (with_day(messages).fillna("", ["session_id"])
     .hint("rebalance", "day", "role")
     .write.mode(mode).partitionBy("day", "role").parquet(path))


def role_rows(messages: DataFrame, *roles: str) -> DataFrame:
    return messages.where(F.col("role").isin(*roles))


def role_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def transcript(messages: DataFrame, session_id: str | None = None) -> DataFrame:
    """User and assistant rows in id order, of one session or of all.

    For all sessions the order comes from a range partitioning on
    (session_id, id), which also spreads a hot session.
    """
    rows = role_rows(messages, C.USER, C.ASSISTANT).select(
        "session_id", "id", "timestamp", "role", "content")
    if session_id is not None:
        return rows.where(F.col("session_id") == session_id).orderBy("id")
    return rows.orderBy("session_id", "id")


def session_registry(messages: DataFrame) -> DataFrame:
    """Sessions with a user row and when they began, oldest first."""
    return (
        role_rows(messages, C.USER)
        .groupBy("session_id").agg(F.min("timestamp").alias("started_at"))
        .orderBy("started_at")
    )
