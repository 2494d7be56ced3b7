"""Exact sliding-log rate limit per session, in batch.

A message gets in if fewer than ``limit`` accepted messages of its session are
younger than the window; a rejected message is not charged. That makes each
decision depend on earlier decisions, so it is no window count. The work that
must follow that order is cut down first:

1. Time is cut into cells as long as the window. If a cell and the one before
   it hold at most ``limit`` messages together, everything in the cell gets in.
   Counting cells is a hash aggregation with map-side combine.
2. The other ("busy") cells form runs. The cell before a run is calm, so its
   messages are known to be accepted and the run can start from them: runs are
   independent of each other.
3. Of the messages of one instant only the first ``limit`` can get in; the rest
   are dropped before the shuffle, as rejected.
4. What is left is gathered and sorted in slices of a cell: even in time, and cut again by
   rows where a burst falls into one. The ordered pass gets the bare offsets in the cell, four bytes per message for windows up to
   half an hour: the slices of a run stream through one carry of ``limit``
   times, which jumps from one accepted message to the next.

A cell accepts at most ``limit`` messages, being one window long; messages look
their cell up in that short list of ids. No step holds a session or a run: the
ordered pass keeps one Arrow batch and the carry.
"""

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom import constants as C
from logloom.functions.running import whole_part
from logloom.functions.sliding import admit

MICROS = 1_000_000
SLICE_ROWS = 2_000
TIME_SLICE = ["session_id", "_run", "_cell", "_slice"]
SLICE = [*TIME_SLICE, "_sub"]
PASS = ["session_id", "_run", "_cell", "_offsets"]


def busy_cells(rows: DataFrame, limit: int) -> DataFrame:
    """Cells whose messages need the ordered pass: their size and their run."""
    by_cell = W.partitionBy("session_id").orderBy("_cell")

    def beside(move, step):
        """The count of the adjoining cell, NULL if that is empty."""
        adjoins = move("_cell", 1).over(by_cell) == F.col("_cell") + step
        return F.when(adjoins, move("_n", 1).over(by_cell))

    n, before, after = F.col("_n"), F.col("_before"), F.col("_after")
    busy = n + F.coalesce(before, F.lit(0)) > limit
    lead_in = ~busy & F.coalesce(n + after > limit, F.lit(False))
    starts = lead_in | before.isNull()
    return (
        rows.groupBy("session_id", "_cell").agg(F.count(F.lit(1)).alias("_n"))
        .withColumns({"_before": beside(F.lag, -1), "_after": beside(F.lead, 1)})
        .where(busy | lead_in)
        .withColumn("_run", F.max(F.when(starts, F.col("_cell"))).over(by_cell))
        .select("session_id", "_cell", "_n", "_run")
    )


def _ordered_pass(limit: int, window: int):
    def over_slices(batches):
        run, carry = None, deque(maxlen=limit)
        for batch in batches:
            taken = []
            for session, first, cell, offsets in zip(*(batch[c] for c in PASS)):
                if (session, first) != run:
                    run, carry = (session, first), deque(maxlen=limit)
                times = offsets.astype("int64") + cell * window
                taken.append(admit(times.tolist(), carry, window))
            yield batch[SLICE].assign(_taken=taken)

    return over_slices


def sliced(rows: DataFrame, limit: int, window: int) -> DataFrame:
    """The messages of busy cells by slices of at most ``SLICE_ROWS``: SLICE, _rows."""
    in_cell = F.col("_at") - F.col("_cell") * window
    parts = whole_part(F.col("_n"), SLICE_ROWS) + 1
    instant = W.partitionBy("session_id", "_at").orderBy("id")
    in_slice = F.row_number().over(W.partitionBy(*TIME_SLICE).orderBy("_at", "id"))
    return (
        rows.select("session_id", "_cell", "_at", "id")
        .join(busy_cells(rows, limit), ["session_id", "_cell"])
        .withColumn("_slice", whole_part(in_cell * parts, window))
        .withColumn("_nth", F.row_number().over(instant))
        .where(F.col("_nth") <= limit)
        .withColumn("_sub", whole_part(in_slice.cast("bigint") - 1, SLICE_ROWS))
        # both uses of the slices read this one shuffle
        .repartition(*SLICE)
        .groupBy(*SLICE)
        .agg(F.sort_array(F.collect_list(F.struct("_at", "id"))).alias("_rows"))
    )


def _accepted(rows: DataFrame, limit: int, window: int) -> DataFrame:
    """Per busy cell, the ids that get in."""
    slices = sliced(rows, limit, window)
    width = "int" if window < 1 << 31 else "bigint"
    offsets = F.transform("_rows", lambda r: (r["_at"] - F.col("_cell") * window).cast(width))
    taken = (
        slices.select(*SLICE, offsets.alias("_offsets"))
        .repartition("session_id", "_run").sortWithinPartitions(*SLICE)
        .mapInPandas(_ordered_pass(limit, window),
                     "session_id string, _run bigint, _cell bigint, _slice bigint, _sub bigint, "
                     "_taken array<int>")
    )
    ids = F.transform("_taken", lambda i: F.col("_rows.id")[i])
    return (
        slices.join(taken, SLICE, "left")
        .groupBy("session_id", "_cell").agg(F.flatten(F.collect_list(ids)).alias("_accepted"))
    )


def with_rate_limit(messages: DataFrame, limit: int = C.RATE_LIMIT,
                    window_seconds: int = C.RATE_WINDOW_SECONDS) -> DataFrame:
    """Add ``within_limit`` to messages with id, session_id and ts.

    Order inside a session is (ts, id); a message exactly ``window_seconds``
    old no longer counts. Messages without a session are one session, named by the
    empty text; a message without a time gets in and counts for no other.
    """
    window = window_seconds * MICROS
    rows = (
        messages.fillna("", ["session_id"]).withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")))
        .withColumn("_cell", whole_part(F.col("_at"), window))
    )
    inside = F.coalesce(F.array_contains("_accepted", F.col("id")), F.lit(True))
    return (
        rows.join(_accepted(rows, limit, window), ["session_id", "_cell"], "left")
        .withColumn("within_limit", inside)
        .select(*messages.columns, "within_limit")
    )


def rate_limit_decisions(messages: DataFrame, limit: int = C.RATE_LIMIT,
                         window_seconds: int = C.RATE_WINDOW_SECONDS) -> DataFrame:
    return with_rate_limit(messages.select("id", "session_id", "ts"), limit, window_seconds)
