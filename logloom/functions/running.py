"""Exact per-key running values that stay spread out when one key is hot.

A plain ``row_number() OVER (PARTITION BY session ORDER BY id)`` sorts a whole
session in one task. ``id`` is unique, so a block of ``width`` consecutive ids
holds at most ``width`` log rows of a session: windows below run per
(session, block), and only one summary row per block goes through the
per-session window. Rows whose key is NULL are one key, the empty text.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.session import stored

BLOCK_IDS = 1 << 20
BLOCKS = 4096
CHUNKS = 20


def block_width(messages: DataFrame, blocks: int = BLOCKS) -> int:
    """A width that cuts the ids of a log into about ``blocks`` blocks.

    Worth its scan of one column where ids are sparse (times in microseconds):
    then most sessions lie in one block and few block rows are made.
    """
    low, high = messages.agg(F.min("id"), F.max("id")).first()
    return 1 if low is None else max(1, -(-(high - low + 1) // blocks))


def place(entry_id: Column, pos: Column) -> Column:
    """(id, pos) as one number in the same order.

    A number, unlike a struct, lets min and max run as hash aggregations.
    """
    return entry_id.cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(10,0)") + pos


def whole_part(value: Column, width: int) -> Column:
    """value / width rounded down, in integers."""
    return F.call_function("div", value - F.pmod(value, F.lit(width)), F.lit(width))


def _block(width: int) -> Column:
    return whole_part(F.col("id"), width)


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.fillna("", keys) if keys else rows


def _preceding(keys):
    return W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str,
             width: int = BLOCK_IDS) -> DataFrame:
    """Add the 1-based position of each row within ``keys`` in the given order.

    ``order`` must begin with ``id``. With no keys the numbering is global and
    the single-task window sees one row per block.
    """
    rows = _named(rows, keys).withColumn("_block", _block(width))
    blocks = (
        rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(_preceding(keys)), F.lit(0)))
        .drop("_n")
    )
    local = F.row_number().over(W.partitionBy(*keys, "_block").orderBy(*order))
    return (
        rows.withColumn("_local", local)
        .join(blocks, [*keys, "_block"])
        .withColumn(name, (F.col("_before") + F.col("_local")).cast("bigint"))
        .drop("_block", "_before", "_local")
    )


def summed_before(rows: DataFrame, keys: list[str], order: list[str], size: str, name: str,
                  width: int = BLOCK_IDS) -> DataFrame:
    """Add the sum of ``size`` over the rows before each within ``keys``, which are not null.

    ``order`` must begin with ``id``; rows without an id come last. As in ``numbered``, the
    window over a whole key sees one row per block.
    """
    last = F.lit((1 << 63) - 1)
    rows = rows.withColumn("_block", F.coalesce(_block(width), last))
    blocks = (
        rows.groupBy(*keys, "_block").agg(F.sum(size).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(_preceding(keys)), F.lit(0)))
        .drop("_n"))
    inside = W.partitionBy(*keys, "_block").orderBy(*[F.asc_nulls_last(c) for c in order]) \
        .rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.withColumn("_local", F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .join(blocks, [*keys, "_block"])
        .withColumn(name, (F.col("_before") + F.col("_local")).cast("bigint"))
        .drop("_block", "_before", "_local"))


def placed_by_sums(rows: DataFrame, order: list[Column | str], size: str, name: str) -> DataFrame:
    """Add the sum of ``size`` over all rows before each, in one order of the whole table.

    Rows are range-partitioned, sorted and stored; sums run within each partition, and
    one row per partition carries them on. Nothing needs dense or unique keys. Rows that
    are equal in ``order`` may change places, others never do, however Spark deals them.
    """
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({
        "_part": F.spark_partition_id(), "_turn": F.monotonically_increasing_id()})
    laid = stored(laid, "placed")
    parts = laid.groupBy("_part").agg(F.sum(size).alias("_n"))
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    inside = W.partitionBy("_part").orderBy("_turn").rowsBetween(W.unboundedPreceding, -1)
    return (
        laid.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .join(parts, "_part")
        .withColumn(name, (F.col("_ahead") + F.col("_inside")).cast("bigint"))
        .drop("_part", "_turn", "_inside", "_ahead"))


def within_last(rows: DataFrame, keys: list[str], flag: Column, lookback: int, name: str,
                width: int = BLOCK_IDS) -> DataFrame:
    """Does ``flag`` hold on the row or on one of its ``lookback`` predecessors by id.

    Carries two running values per key across blocks: rows so far, and the
    position of the last flagged row. Where ``rows`` has no columns but id, keys
    and those of ``flag``, the block summary reads the same shuffle as the rows.
    """
    inside = W.partitionBy(*keys, "_block").orderBy("id")
    rows = _named(rows, keys).withColumn("_block", _block(width)).where("_block IS NOT NULL")
    local = rows.withColumn("_local", F.row_number().over(inside)).withColumn(
        "_hit", F.max(F.when(flag, F.col("_local"))).over(inside))
    blocks = (
        local.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"),
                                           F.max("_hit").alias("_last"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(_preceding(keys)), F.lit(0)))
        .withColumn("_hit_before",
                    F.max(F.col("_before") + F.col("_last")).over(_preceding(keys)))
        .drop("_n", "_last")
    )
    at = F.col("_before") + F.col("_local")
    last_hit = F.greatest("_hit_before", F.col("_before") + F.col("_hit"))
    return (
        local.join(blocks, [*keys, "_block"])
        .withColumn(name, F.coalesce(at - last_hit <= lookback, F.lit(False)))
        .drop("_block", "_local", "_hit", "_before", "_hit_before")
    )


def with_preceding(rows: DataFrame, keys: list[str], at: str, values: Column, count: int,
                   name: str) -> DataFrame:
    """Collect ``values`` of up to ``count`` rows before each row, oldest first.

    ``at`` is the position from ``numbered``. Positions are cut into chunks of
    ``CHUNKS * count``; the last ``count`` rows of a chunk are also lent to the
    next. So a group holds at most ``(CHUNKS + 1) * count`` rows, whatever the
    size of its key.
    """
    size = CHUNKS * count
    chunk = whole_part(F.col(at) - 1, size)
    near_end = (F.col(at) - 1) % size >= size - count
    lent = rows.withColumn("_chunk", F.explode(
        F.when(near_end, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))))
    frame = W.partitionBy(*keys, "_chunk").orderBy(at).rowsBetween(-count, -1)
    return (
        lent.withColumn(name, F.collect_list(values).over(frame))
        .where(F.col("_chunk") == chunk)
        .drop("_chunk")
    )
