"""Session settings and the shared working folder."""

import os
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ARROW_BATCH = "4m"


def build_session(master: str = "local[*]", app_name: str = "logloom", **conf) -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the cluster's own."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.python.unix.domain.socket.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on.

    UTC because days are cut from UTC text; duplicate JSON keys keep the last
    value; AQE splits skewed join partitions and coalesces small ones; Arrow batches
    are cut by bytes, so that long texts do not fill a Python worker.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    return spark


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="logloom-")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which every executor sees.

    Without that setting a temporary folder serves in local mode (tests); on a
    cluster, where other executors would not see it, its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_root()
    return os.path.join(root, "logloom", f"{name}-{uuid.uuid4().hex}")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    What follows neither computes the rows again nor loses them with an executor, and
    values that depend on where a row lies stay as they are.
    """
    path = shared_dir(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
