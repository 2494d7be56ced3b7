"""Keyed state for the operators that depend on arrival order."""

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BooleanType, StructField, StructType

from logloom import constants as C
from logloom.functions import variant as V
from logloom.functions.sliding import admit
from logloom.operators.quality import used_operational_tool
from logloom.session import ROCKSDB

MICROS = 1_000_000
WITHIN = StructField("within_limit", BooleanType())


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class RateLimiter(StatefulProcessor):
    """Keeps the last accepted times of a session, at most ``limit`` of them.

    With ``ends`` a timer forgets them once the watermark has left their window.
    """

    def __init__(self, limit: int, window: int, ends: bool = False):
        self.limit, self.window, self.ends = limit, window, ends

    def init(self, handle) -> None:
        self.handle = handle
        self.accepted = handle.getListState("accepted", "at bigint")

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable",
                                                  ignore_index=True)
        timed = batch["at"].dropna().astype("int64")  # the others, sorted last, get in
        carry = deque((at for (at,) in self.accepted.get()), maxlen=self.limit)
        within = batch["at"].isna()
        within[admit(timed.tolist(), carry, self.window)] = True
        if carry:
            self.accepted.put([(at,) for at in carry])
        if self.ends and carry:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((max(carry) + self.window) // 1000 + 1)
        yield batch.drop(columns="session_id").assign(
            at=batch["at"].astype("Int64"), within_limit=within, session_id=key[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.accepted.clear()
        return iter(())

    def close(self) -> None:
        pass


def limited(messages: DataFrame, limit: int = C.RATE_LIMIT,
            window_seconds: int = C.RATE_WINDOW_SECONDS, late: str | None = None) -> DataFrame:
    """id, session_id, within_limit of a stream with id, session_id, ts."""
    rows = messages.select("id", "session_id", "ts")
    return with_rate_limit(rows, limit, window_seconds, late).drop("ts")


def with_rate_limit(messages: DataFrame, limit: int = C.RATE_LIMIT,
                    window_seconds: int = C.RATE_WINDOW_SECONDS,
                    late: str | None = None) -> DataFrame:
    """Add ``within_limit`` to a stream with id, session_id, ts and what else it has.

    Sessions and times that are missing count as in the batch operator. The state
    holds ``limit`` times per session. With ``late`` (such as "1 hour") a session's state
    ends when the watermark, that much behind the newest message, has left the window of
    its last message; Spark drops messages that come later than that, so they are never
    allowed. Without it the state does not end. Inside a micro-batch the order is (ts, id), across micro-batches arrival. A
    session's rows of one micro-batch meet in one task, so bound the batch at
    the source (``maxFilesPerTrigger``).
    """
    use_rocksdb(messages.sparkSession)
    columns, ts = messages.columns, F.col("ts").cast("timestamp")
    rows = messages.fillna("", ["session_id"]).withColumn("at", F.unix_micros(ts))
    rows = rows.drop("ts") if late is None else rows.withColumn("ts", ts).withWatermark("ts", late)
    return (
        rows.groupBy("session_id")
        .transformWithStateInPandas(
            RateLimiter(limit, window_seconds * MICROS, ends=late is not None),
            outputStructType=StructType([*rows.schema, WITHIN]),
            outputMode="append", timeMode="None" if late is None else "EventTime")
        .withColumn("ts", F.timestamp_micros("at")).select(*columns, "within_limit")
    )


class EndedTurns(StatefulProcessor):
    """Holds a turn's drafts by number until one ends it, then lets all of them go.

    What stays of an ended turn is a mark, for as long as ``keep_ms`` says.
    """

    def __init__(self, max_retries: int, keep_ms: int | None):
        self.max_retries, self.keep_ms = max_retries, keep_ms

    def init(self, handle) -> None:
        self.drafts = handle.getMapState(
            "drafts", "draft_no int",
            "passed boolean, feedback string, response string, tools array<string>, ends boolean")
        self.ended = handle.getValueState("ended", "ended boolean", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues):
        if self.ended.exists():
            for _ in rows:
                pass
            return
        seen = {int(n): tuple(draft) for (n,), draft in self.drafts.iterator()}
        before = dict(seen)
        for chunk in rows:
            for n, *draft in zip(chunk["draft_no"], chunk["passed"], chunk["feedback"],
                                 chunk["response"], chunk["tools"], chunk["ends"]):
                n, draft = int(n), (
                    None if draft[0] is None else bool(draft[0]), draft[1], draft[2],
                    None if draft[3] is None else list(draft[3]), bool(draft[4]))
                if n not in seen or order_of(draft) < order_of(seen[n]):
                    seen[n] = draft
        end = min((n for n, draft in seen.items() if draft[4]), default=None)
        if end is not None and all(n in seen for n in range(end + 1)):
            self.drafts.clear()
            self.ended.update((True,))
            rows = [(key[0], n, *seen[n][:4]) for n in range(end + 1)]
            yield pd.DataFrame(rows, columns=["turn_id", "draft_no", "passed", "feedback",
                                              "response", "tools"])
            return
        for n, draft in seen.items():
            if before.get(n) != draft:
                self.drafts.updateValue((n,), draft)

    def close(self) -> None:
        pass


def order_of(draft: tuple) -> tuple:
    """The order of drafts with one number, as Spark orders them: missing values first."""
    return tuple((value is not None, value) if not isinstance(value, list) else
                 (True, [(x is not None, x) for x in value]) for value in draft[:4])


def ended_drafts(drafts: DataFrame, max_retries: int = C.MAX_RETRIES,
                 keep_ms: int | None = None) -> DataFrame:
    """The drafts of each turn, once, in the micro-batch in which the turn ends.

    ``drafts`` is a stream of (turn_id, draft_no, response, tools, pass, feedback). Drafts
    may come in any order and repeated; those after the end are dropped. ``keep_ms``
    bounds how long an ended turn is remembered, by the clock; after that, drafts that come
    again would count as a new turn. Such a query runs until it is stopped, as Spark makes
    batches for the clock: ``AVAILABLE_NOW`` would not end it.
    """
    use_rocksdb(drafts.sparkSession)
    ends = (F.coalesce("pass", F.lit(False)) | (F.col("draft_no") >= max_retries)
            | used_operational_tool(F.col("tools")))
    rows = drafts.where(F.col("draft_no").between(0, max_retries)).select(
        "turn_id", F.col("draft_no").cast("int").alias("draft_no"), F.col("pass").alias("passed"),
        "feedback", "response", "tools", ends.alias("ends"))
    schema = StructType([f for f in rows.schema if f.name != "ends"])
    return rows.groupBy("turn_id").transformWithStateInPandas(
        EndedTurns(max_retries, keep_ms), outputStructType=schema, outputMode="append",
        timeMode="None" if keep_ms is None else "ProcessingTime").withColumnRenamed(
            "passed", "pass")


class ChecklistNumbers(StatefulProcessor):
    """Keeps only how many items a session has: it numbers items and checks marks."""

    def init(self, handle) -> None:
        self.items = handle.getValueState("items", "n bigint")

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows)).sort_values(["id", "pos"], kind="stable")
        count = self.items.get()[0] if self.items.exists() else 0
        out = []
        for created, index in zip(batch["created"], batch["index"]):
            if created is not None:
                out += [(n, item, None) for n, item in enumerate(created, count + 1)]
                count += len(created)
            else:
                out.append((int(index), None, bool(1 <= index <= count)))
        self.items.update((count,))
        result = pd.DataFrame(out, columns=["item_no", "item", "mark_ok"])
        result.insert(0, "session_id", key[0])
        yield result

    def close(self) -> None:
        pass


def checklist_changes(entries: DataFrame) -> DataFrame:
    """Items as they get their number, and marks as they are accepted or not."""
    use_rocksdb(entries.sparkSession)
    args = F.col("args")
    creates = F.col("name") == C.CREATE_CHECKLIST
    created = F.when(creates, F.coalesce(V.text_list(V.member(args, "descriptions")),
                                         F.array().cast("array<string>")))
    index = F.when(F.col("name") == C.MARK_COMPLETE, V.integer(V.member(args, "index")))
    return (
        entries.select("session_id", "id", "pos", created.alias("created"), index.alias("index"))
        .where(F.col("created").isNotNull() | F.col("index").isNotNull())
        .groupBy("session_id")
        .transformWithStateInPandas(
            ChecklistNumbers(),
            outputStructType="session_id string, item_no bigint, item string, mark_ok boolean",
            outputMode="append", timeMode="None")
    )


def checklist_from_changes(changes: DataFrame) -> DataFrame:
    """Every item and whether an accepted mark completed it."""
    return (
        changes.groupBy("session_id", "item_no")
        .agg(F.max("item").alias("item"),
             F.coalesce(F.bool_or("mark_ok"), F.lit(False)).alias("done"))
        .where(F.col("item").isNotNull())
    )
