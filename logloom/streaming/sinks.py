"""Tables fed by micro-batches.

Each micro-batch writes one folder named after its id, and a repeated batch
overwrites its own folder, so replays after a failure change nothing. Readers
merge the folders. ``compact`` folds finished batches into a snapshot, after
which readers skip what the snapshot covers; ``remove_covered`` deletes it.

Several tables that belong together are published together: a batch, or a snapshot, gets
a mark once all its folders are complete, and readers pin the newest marks. What they see
of every table is then the state after one batch, whatever is being written.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

AVAILABLE_NOW = {"availableNow": True}
REFRESH = {"processingTime": "30 seconds"}
OPEN = -1


def batch_folder(table: str, batch_id: int) -> str:
    return f"{table}/upto={OPEN}/batch={batch_id}"


def write_batch(rows: DataFrame, table: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(batch_folder(table, batch_id))


def _parts(rows: DataFrame, before: int | None = None, upto: int | None = None) -> DataFrame:
    """The newest snapshot (older than ``before``) and the open batches after it.

    One number is fetched first, so that the rest is a filter on folders.
    """
    snapshots = rows if before is None else rows.where(F.col("upto") < before)
    newest = snapshots.agg(F.max("upto")).first()[0]
    later = (F.col("upto") == OPEN) & (F.col("batch") > newest)
    if upto is not None:
        later = later & (F.col("batch") <= upto)
    snapshot = (F.col("upto") == newest) & (F.col("upto") != OPEN)
    return rows.where(snapshot | later).drop("upto", "batch")


@dataclass(frozen=True)
class Version:
    """The last finished batch, and the last snapshot that is complete in all tables."""

    batch: int
    snapshot: int = OPEN


def _hadoop(spark: SparkSession, path: str):
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    return to_path, to_path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def publish(spark: SparkSession, table: str, kind: str, number: int) -> None:
    """Mark a ``batch`` or ``snapshot`` of all tables under ``table`` as complete."""
    to_path, files = _hadoop(spark, table)
    files.create(to_path(f"{table}/versions/{kind}-{number}"), True).close()


def pinned(spark: SparkSession, table: str) -> Version | None:
    """The newest version; none where nothing was ever published."""
    to_path, files = _hadoop(spark, table)
    newest = {}
    for mark in files.globStatus(to_path(f"{table}/versions/*-*")) or []:
        kind, number = mark.getPath().getName().split("-", 1)
        newest[kind] = max(newest.get(kind, OPEN), int(number))
    return Version(newest["batch"], newest.get("snapshot", OPEN)) if newest else None


def read_version(spark: SparkSession, table: str, schema: StructType | str,
                 version: Version) -> DataFrame:
    """The table as that version has it."""
    try:
        rows = spark.read.parquet(table)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
    covered = (F.col("upto") == version.snapshot) & (F.col("upto") != OPEN)
    later = (F.col("upto") == OPEN) & F.col("batch").between(version.snapshot + 1, version.batch)
    return rows.where(covered | later).drop("upto", "batch")


def read_batches(spark: SparkSession, table: str, schema: StructType | str) -> DataFrame:
    """The table as it is now: empty, with ``schema``, before the first batch."""
    try:
        rows = spark.read.parquet(table)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
    return _parts(rows)


def compact(spark: SparkSession, table: str, merge: Callable[[DataFrame], DataFrame],
            upto: int) -> None:
    """Fold everything up to batch ``upto`` into one snapshot."""
    covered = _parts(spark.read.parquet(table), before=upto, upto=upto)
    merge(covered).write.mode("overwrite").parquet(f"{table}/upto={upto}/batch={upto}")


def remove_covered(spark: SparkSession, table: str, upto: int) -> None:
    """Delete the folders that the snapshot ``upto`` covers.

    For when no reader is left that began before ``compact``: a reader names its
    files when it begins.
    """
    to_path, files = _hadoop(spark, table)
    if not files.exists(to_path(f"{table}/upto={upto}/batch={upto}/_SUCCESS")):
        raise ValueError(f"{table} has no snapshot {upto}")
    for folder in files.globStatus(to_path(f"{table}/upto=*/batch=*")):
        found = folder.getPath()
        snapshot = int(found.getParent().getName().split("=")[1])
        batch = int(found.getName().split("=")[1])
        if batch <= upto and snapshot != upto:
            files.delete(found, True)


def start_batches(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None],
                  trigger=None, mode: str = "append") -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write).outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or REFRESH)).start()
    )


def start_append(stream: DataFrame, path: str, checkpoint: str, trigger=None,
                 partition_by=()) -> StreamingQuery:
    """Append rows to a Parquet table, exactly once."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .partitionBy(*partition_by)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or REFRESH)).start()
    )
