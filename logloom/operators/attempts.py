"""Calls to other programs, each kept in a ledger: deliveries, model requests.

Work is a table with a key. Every attempt at a key becomes a row of the ledger, with the
answer or the error. ``run_due`` tries what has no answer yet and is due: never tried, or
failed less than ``most`` times with its pause over, which doubles with each failure. So
a run after a failure, or after a crash, repeats only what has no answer; what has failed
``most`` times is given up, and readers treat it as refused.

Work goes in slices, one Spark job each, whose attempts are committed together: a crash
loses the record of the slices that are running, no more, and their calls are made again.
"""

from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from logloom.session import shared_dir, stored

ATTEMPT = "attempt int, at timestamp, answer string, error string"
MOST, PAUSE_SECONDS, SLICE_ROWS = 5, 30, 100_000
SLICE_FILES = 8
MOST_DOUBLINGS = 30


def read_ledger(spark: SparkSession, path: str, keys: StructType) -> DataFrame:
    schema = StructType([*keys, *StructType.fromDDL(ATTEMPT)])
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def outcomes(work: DataFrame, ledger: DataFrame, keys: list[str], most: int = MOST) -> DataFrame:
    """``work`` with attempts, answer, last_at and state: answered, waiting or given_up.

    The first answer counts. Rows of ``work`` with one key share its outcome.
    """
    answered = F.when(F.col("error").isNull(), F.col("attempt"))
    made = ledger.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.max("attempt").alias("attempts"), F.max("at").alias("last_at"),
        F.min_by("answer", answered).alias("answer"), F.min(answered).alias("_answered"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    state = (F.when(F.col("_answered").isNotNull(), "answered")
             .when(F.col("attempts") >= most, "given_up").otherwise("waiting"))
    return (
        work.join(made, same, "left")
        .withColumn("attempts", F.coalesce("attempts", F.lit(0)))
        .withColumn("state", state).drop("_answered", *[f"_{k}" for k in keys]))


def due(work: DataFrame, ledger: DataFrame, keys: list[str], now: Column, most: int = MOST,
        pause_seconds: float = PAUSE_SECONDS) -> DataFrame:
    """The rows of ``work`` to try at ``now``, one per key, with the number of the attempt."""
    pause = F.lit(float(pause_seconds)) * F.pow(
        F.lit(2.0), F.least(F.col("attempts") - 1, F.lit(MOST_DOUBLINGS)))
    over = F.col("last_at").isNull() | (
        F.unix_micros(now) >= F.unix_micros("last_at") + (pause * 1_000_000).cast("bigint"))
    rows = outcomes(work.dropDuplicates(keys), ledger, keys, most)
    return rows.where((F.col("state") == "waiting") & over).select(
        *work.columns, (F.col("attempts") + 1).cast("int").alias("attempt"))


def _tried(call, keys):
    names = [*keys, "attempt", "answer", "error"]

    def run(batches):
        for batch in batches:
            answers, errors = [], []
            for row in batch.to_pylist():
                try:
                    answers.append(call(row))
                    errors.append(None)
                except Exception as error:  # whatever went wrong is what the ledger is for
                    answers.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in [*keys, "attempt"]), pa.array(answers, pa.string()),
                 pa.array(errors, pa.string())], names)

    return run


def sliced(todo: DataFrame, keys: list[str], slices: int) -> list[DataFrame]:
    """``todo`` in slices by key, each in a folder of its own, so that none reads the others."""
    path, drawn = shared_dir(todo.sparkSession, "due-slices"), F.xxhash64(*keys)
    place = F.pmod(F.floor(drawn / slices), F.lit(SLICE_FILES))
    (todo.withColumn("_slice", F.pmod(drawn, F.lit(slices)).cast("int"))
     .repartition("_slice", place).write.partitionBy("_slice").parquet(path))
    schema = StructType([*todo.schema, StructField("_slice", IntegerType())])
    rows = todo.sparkSession.read.schema(schema).parquet(path)
    return [rows.where(F.col("_slice") == n).drop("_slice") for n in range(slices)]


def run_due(work: DataFrame, path: str, keys: list[str], call: Callable[[dict], str | None],
            now=None, most: int = MOST, pause_seconds: float = PAUSE_SECONDS,
            slice_rows: int = SLICE_ROWS) -> int:
    """Try what is due and note every attempt under ``path``; gives the number of slices.

    ``call`` gets a row of ``work``, with ``attempt`` from 1, in a Spark task; what it
    returns is the answer, what it raises the error. ``now`` is a timestamp, by default
    the current one. Answers of None are answers.
    """
    spark = work.sparkSession
    now = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    schema = work.select(*keys).schema
    ledger = read_ledger(spark, path, schema)
    todo = stored(due(work, ledger, keys, now, most, pause_seconds), "due")
    slices = -(-todo.count() // slice_rows)
    tried = StructType([*schema, *StructType.fromDDL("attempt int, answer string, error string")])
    parts = sliced(todo, keys, slices) if slices > 1 else [todo] * slices
    for rows in parts:
        (rows.mapInArrow(_tried(call, keys), tried).withColumn("at", now)
         .select(*keys, "attempt", "at", "answer", "error").write.mode("append").parquet(path))
    return slices


# -- two uses ----------------------------------------------------------------------------

NOTICE_KEYS = ["id", "pos", "kind"]


def deliver_due(notices: DataFrame, path: str, send: Callable[[dict], None], **options) -> int:
    """Deliver notices (id, pos, kind, text): ``send`` raises where it fails."""
    return run_due(notices, path, NOTICE_KEYS, send, **options)


def with_digest(requests: DataFrame, content: list[str]) -> DataFrame:
    """Model requests with the digest of what is asked; equal requests have one."""
    return requests.withColumn("digest", F.sha2(F.to_json(F.struct(*content), {
        "ignoreNullFields": "false"}), 256))


def ask_due(requests: DataFrame, content: list[str], path: str, ask: Callable[[dict], str],
            **options) -> int:
    """Ask what has no answer yet, equal requests once; ``ask`` gets the ``content`` columns."""
    work = with_digest(requests, content).select("digest", *content)
    return run_due(work, path, ["digest"], ask, **options)


def answers(requests: DataFrame, content: list[str], path: str, most: int = MOST) -> DataFrame:
    """Requests with ``verdict``, and ``state``; without an answer the verdict is NULL.

    ``guard_verdicts`` and ``judge_verdicts`` refuse what has no verdict.
    """
    work = with_digest(requests, content)
    ledger = read_ledger(requests.sparkSession, path, work.select("digest").schema)
    return outcomes(work, ledger, ["digest"], most).withColumnRenamed(
        "answer", "verdict").drop("digest", "last_at")
