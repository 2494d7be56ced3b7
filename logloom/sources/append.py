"""A log whose ids are given by the log itself.

Every append is a batch. Its rows get the ids after those of all earlier batches; they
are written first, then a row in the ledger that says how many they were. Readers see the
batches in the ledger, so ids have no gaps and no row is seen before its batch is whole. A
batch that is written again, after a failure, starts at the same id and gets the same ids.
One writer at a time.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.operators.turns import numbered_log
from logloom.sources.log import COLUMNS, LOG_SCHEMA, with_day

LEDGER = "n bigint, rows bigint, batch bigint"


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{path}/ledger")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], LEDGER)


def append_turns(turns: DataFrame, path: str, batch: int | None = None) -> None:
    """Append the log rows of ``turns`` (as for ``turns_to_log``, without id).

    ``batch`` defaults to the number after the last one; streams give their own.
    """
    spark = turns.sparkSession
    ledger = _ledger(spark, path)
    if batch is None:
        batch = (ledger.agg(F.max("batch")).first()[0] or 0) + 1
    taken = ledger.where(F.col("batch") < batch).agg(F.sum("rows")).first()[0] or 0
    folder = f"{path}/rows/batch={batch}"
    with_day(numbered_log(turns, taken + 1)).write.mode("overwrite").partitionBy(
        "day", "role").parquet(folder)
    # one row, also for a batch without rows
    spark.read.schema(f"{LOG_SCHEMA}, day string").parquet(folder).agg(
        F.max("id").alias("n"), F.count(F.lit(1)).alias("rows")) \
        .write.mode("overwrite").parquet(f"{path}/ledger/batch={batch}")


def start_turn_log(turns: DataFrame, path: str, checkpoint: str, trigger) -> StreamingQuery:
    """Append a stream of turns, each micro-batch as one batch."""
    return (
        turns.writeStream.foreachBatch(lambda rows, n: append_turns(rows, path, n))
        .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """The log as of its last finished batch; role and day filters prune files."""
    last = _ledger(spark, path).agg(F.max("batch")).first()[0]
    if last is None:
        return spark.createDataFrame([], LOG_SCHEMA)
    rows = spark.read.schema(f"{LOG_SCHEMA}, batch bigint, day string").parquet(f"{path}/rows")
    return rows.where(F.col("batch") <= last).select(*COLUMNS)
