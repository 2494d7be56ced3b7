"""Checklist state replayed from the tool calls of each session."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom import constants as C
from logloom.functions import variant as V
from logloom.functions.running import BLOCK_IDS, numbered, place, summed_before


def _descriptions():
    return V.text_list(V.member(F.col("args"), "descriptions"))


def created_items(entries: DataFrame, width: int = BLOCK_IDS) -> DataFrame:
    """Items in order of creation, numbered from 1 within their session."""
    items = (
        entries.where(F.col("name") == C.CREATE_CHECKLIST)
        .select("id", "pos", "session_id",
                F.posexplode(_descriptions()).alias("item_pos", "item"))
    )
    return numbered(items, ["session_id"], ["id", "pos", "item_pos"], "item_no", width)


def marks(entries: DataFrame) -> DataFrame:
    """Completion calls with an integer index."""
    return (
        entries.where(F.col("name") == C.MARK_COMPLETE)
        .select("id", "pos", "session_id",
                V.integer(V.member(F.col("args"), "index")).alias("index"),
                V.text(F.col("args"), "completion_notes").alias("completion_notes"))
        .where(F.col("index").isNotNull())
    )


def checklist_items(entries: DataFrame, width: int = BLOCK_IDS) -> DataFrame:
    """Every item and whether a later call completed it.

    A call completes item n only if item n exists by then, that is if the call
    comes after the item's creation; the latest call on n decides, so marks are
    reduced to one row per (session, index) before the join.
    """
    last_mark = marks(entries).groupBy("session_id", F.col("index").alias("item_no")).agg(
        F.max(place(F.col("id"), F.col("pos"))).alias("last_mark"))
    return (
        created_items(entries, width)
        .join(last_mark, ["session_id", "item_no"], "left")
        .select("session_id", "item_no", "item",
                F.coalesce(F.col("last_mark") > place(F.col("id"), F.col("pos")),
                           F.lit(False)).alias("done"))
    )


def bad_marks(entries: DataFrame, width: int = BLOCK_IDS) -> DataFrame:
    """Completion calls on an item that did not exist yet."""
    items = created_items(entries, width).select(
        "session_id", F.col("item_no").alias("index"), F.struct("id", "pos").alias("created"))
    called = marks(entries)
    return (
        called.join(items, ["session_id", "index"], "left")
        .where(F.col("created").isNull() | (F.col("created") > F.struct("id", "pos")))
        .select("id", "session_id", "pos", "index", F.lit(C.BAD_CHECKLIST_INDEX).alias("result"))
    )


def checklist_report(entries: DataFrame, sessions: DataFrame | None = None,
                     width: int = BLOCK_IDS) -> DataFrame:
    """Report lines per session in item order; one line for a session without items.

    ``sessions`` may name more sessions than those with entries.
    Lines stay rows, since a session's report has no size bound:
    ``orderBy("session_id", "line_no")`` prints it.
    """
    lines = checklist_items(entries, width).select(
        "session_id", F.col("item_no").alias("line_no"),
        F.concat(F.lit("Checklist #"), F.col("item_no").cast("string"),
                 F.when(F.col("done"), ": [x] ").otherwise(": [ ] "),
                 F.col("item")).alias("line"))
    creates = F.coalesce((F.col("name") == C.CREATE_CHECKLIST) & (F.size(_descriptions()) > 0),
                         F.lit(False))
    seen = entries.select("session_id", creates.alias("creates"))
    if sessions is not None:
        seen = seen.unionByName(sessions.select("session_id", F.lit(False).alias("creates")))
    without_items = (
        seen.groupBy("session_id").agg(F.bool_or("creates").alias("creates"))
        .where(~F.col("creates"))
        .select("session_id", F.lit(0).cast("bigint").alias("line_no"),
                F.lit(C.NO_CHECKLIST).alias("line"))
    )
    return lines.unionByName(without_items)


def calls(entries: DataFrame) -> DataFrame:
    """session_id, id, pos, created, index: calls that create items or mark one complete."""
    created = F.when(F.col("name") == C.CREATE_CHECKLIST, F.coalesce(
        _descriptions(), F.array().cast("array<string>")))
    index = F.when(F.col("name") == C.MARK_COMPLETE,
                   V.integer(V.member(F.col("args"), "index")))
    return (
        entries.select("session_id", "id", "pos", created.alias("created"), index.alias("index"))
        .where(F.col("created").isNotNull() | F.col("index").isNotNull()))


def changes(called: DataFrame, before: DataFrame, width: int = BLOCK_IDS) -> DataFrame:
    """Items as they get their number, and marks as they are accepted or not.

    ``called`` holds rows of ``calls``, ``before`` (session_id, items) how many items
    sessions had before. A session without a name is one of its own.
    """
    rows = called.withColumns({
        "_key": F.struct(F.col("session_id").isNull(), F.coalesce("session_id", F.lit(""))),
        "_size": F.coalesce(F.size("created"), F.lit(0)).cast("bigint")})
    rows = summed_before(rows, ["_key"], ["id", "pos"], "_size", "_ahead", width)
    had = before.select(F.col("session_id").alias("_had"), "items")
    rows = rows.join(had, F.col("session_id").eqNullSafe(F.col("_had")), "left").withColumn(
        "_count", F.col("_ahead") + F.coalesce("items", F.lit(0)))
    items = rows.where("created IS NOT NULL").select(
        "session_id", "_count", F.posexplode("created").alias("at", "item")).select(
        "session_id", (F.col("_count") + F.col("at") + 1).alias("item_no"), "item",
        F.lit(None).cast("boolean").alias("mark_ok"))
    marked = rows.where("created IS NULL").select(
        "session_id", F.col("index").alias("item_no"), F.lit(None).cast("string").alias("item"),
        F.col("index").between(1, F.col("_count")).alias("mark_ok"))
    return items.unionByName(marked)
