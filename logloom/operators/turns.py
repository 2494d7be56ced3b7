"""Turns: assembled from the log, folded from drafts, written back to the log."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom import constants as C
from logloom.functions.running import placed_by_sums
from logloom.functions.text import iso_utc
from logloom.operators.payload import tool_names
from logloom.operators.quality import used_operational_tool
from logloom.sources.log import role_rows


def turns(messages: DataFrame) -> DataFrame:
    """One row per turn, whose rows share (session_id, timestamp).

    Where several turns share both, each user row begins one, in the order of id;
    rows before the first user row belong to the first. A turn begins with a user row; the reply, tool row and grading row may be
    missing. ``tools`` holds distinct names; ``attempts`` and ``passed`` are
    NULL where no grading row was written, which does not mean "passed".
    """
    def content(role):
        return F.min_by(F.when(F.col("role") == role, F.col("content")),
                        F.when(F.col("role") == role, F.col("id")))

    grading = F.try_parse_json("_evaluator")
    begun = F.count(F.when(F.col("role") == C.USER, 1)).over(
        W.partitionBy("session_id", "timestamp").orderBy("id"))
    return (
        role_rows(messages, C.USER, C.ASSISTANT, C.TOOL_LOG, C.EVALUATOR_LOG)
        .withColumn("_turn", F.greatest(begun, F.lit(1)))
        .groupBy("session_id", "timestamp", "_turn")
        .agg(F.min(F.when(F.col("role") == C.USER, F.col("id"))).alias("user_row_id"),
             content(C.USER).alias("user_message"),
             content(C.ASSISTANT).alias("response"),
             content(C.TOOL_LOG).alias("_tools"),
             content(C.EVALUATOR_LOG).alias("_evaluator"))
        .where(F.col("user_row_id").isNotNull())
        .select("session_id", "timestamp", "user_row_id", "user_message", "response",
                F.coalesce(tool_names(F.try_parse_json("_tools")),
                           F.array().cast("array<string>")).alias("tools"),
                F.try_variant_get(grading, "$.attempts", "bigint").alias("attempts"),
                F.try_variant_get(grading, "$.passed", "boolean").alias("passed"))
    )


def fold_drafts(drafts: DataFrame, max_retries: int = C.MAX_RETRIES) -> DataFrame:
    """Fold the drafts seen so far of each turn; ``ended`` tells whether it is over.

    Works on a stream in update mode too, in any order of arrival: a turn has ended
    when a draft that ends it and all drafts before that are there, so later or
    repeated drafts repeat the same row. Of repeated draft numbers one row counts.
    """
    fold = (
        drafts.where(F.col("draft_no") <= max_retries)
        .groupBy("turn_id")
        .agg(F.sort_array(F.collect_list(
            F.struct("draft_no", "pass", "feedback", "response", "tools"))).alias("_rows"))
        .withColumn("all", F.filter("_rows", lambda d, i: (i == 0) | (
            d["draft_no"] != F.get("_rows", i - 1)["draft_no"])))
    )
    stops = F.transform(
        F.filter("all", lambda d: d["pass"] | (d["draft_no"] >= max_retries)
                 | used_operational_tool(d["tools"])),
        lambda d: d["draft_no"])
    failing = F.filter("seen", lambda d: ~d["pass"])
    rejected = F.transform(failing, lambda d, i: F.struct(
        (i + 1).cast("int").alias("attempt"), d["response"].alias("response"),
        d["feedback"].alias("feedback"),
        F.array_sort(F.array_distinct(F.coalesce(d["tools"], F.array().cast("array<string>"))))
        .alias("tools_used")))
    return (
        fold.withColumn("stop", F.array_min(stops))
        .withColumn("attempts", F.coalesce("stop", F.element_at("all", -1)["draft_no"]))
        .withColumn("seen", F.filter("all", lambda d: d["draft_no"] <= F.col("attempts")))
        .withColumn("last", F.element_at("seen", -1))
        .select(
            "turn_id", F.col("attempts").cast("bigint").alias("attempts"),
            F.col("last.pass").alias("passed"),
            (~F.col("last.pass") & (F.col("attempts") >= max_retries))
            .alias("max_retries_exceeded"),
            F.col("last.response").alias("response"),
            F.col("last.tools").alias("tools"),
            rejected.alias("rejections"),
            F.coalesce(F.size("seen") == F.col("stop") + 1, F.lit(False)).alias("ended"))
    )


def turn_outcomes(drafts: DataFrame, max_retries: int = C.MAX_RETRIES) -> DataFrame:
    """Fold graded drafts (turn_id, draft_no from 0, response, tools, pass, feedback).

    A turn ends at the first draft that passes, that is the last one allowed, or
    that used an operational tool. No draft after ``max_retries`` can count, so
    those are filtered out first and a turn gathers at most ``max_retries + 1``.
    """
    return fold_drafts(drafts, max_retries).drop("ended")


def evaluator_detail(max_retries_exceeded: Column, attempts: Column, user_message: Column,
                     response: Column, rejections: Column) -> Column:
    """The full grading record of a turn that used up its retries, else NULL."""
    return F.when(max_retries_exceeded, F.to_json(F.struct(
        attempts.alias("attempts"), F.lit(False).alias("passed"),
        F.lit(True).alias("max_retries_exceeded"), user_message.alias("user_message"),
        response.alias("final_response"), rejections.alias("rejections"))))


def _with_lines(turns: DataFrame, *kept: str) -> DataFrame:
    """session_id, timestamp, lines: the log rows of each turn as (place, role, content)."""
    timestamp = F.coalesce("timestamp", iso_utc(F.current_timestamp())).alias("timestamp")
    used = F.when(F.size("tools_used") > 0, F.to_json("tools_used"))
    short = F.when(F.col("attempts") > 0, F.to_json(F.struct("attempts", "passed")))
    rows = [
        (C.USER, F.col("user_message")),
        (C.ASSISTANT, F.col("response")),
        (C.TOOL_LOG, used),
        (C.EVALUATOR_LOG, F.coalesce("evaluator_detail", short)),
    ]
    lines = F.array(*[
        F.struct(F.lit(n).alias("place"), F.lit(role).alias("role"), content.alias("content"))
        for n, (role, content) in enumerate(rows)])
    return turns.select(*kept, "session_id", timestamp,
                        F.filter(lines, lambda r: r["content"].isNotNull()).alias("lines"))


def turns_to_log(turns: DataFrame) -> DataFrame:
    """Two to four log rows per turn, all with its timestamp.

    Input: id (first of four free ids), session_id, timestamp, user_message,
    response, tools_used (any array, or NULL), attempts, passed,
    evaluator_detail (JSON text or NULL). A turn without a timestamp gets the
    current one. A turn graded once writes no grading row unless it carries a
    detail. ``numbered_log`` finds the ids itself.
    """
    return (
        _with_lines(turns, "id").select("id", "session_id", "timestamp",
                                        F.explode("lines").alias("r"))
        .select((F.col("id") + F.col("r.place")).alias("id"), "session_id", "timestamp", "r.role",
                "r.content")
    )


def numbered_log(turns: DataFrame, first: int = 1) -> DataFrame:
    """The same rows with ids ``first``, ``first`` + 1 and so on, without gaps.

    Turns come in the order of timestamp and session, of equal ones in the order of their
    contents, so the same turns always get the same ids; a turn's rows follow each other.
    Turns that are equal in everything are interchangeable.
    """
    rows = _with_lines(turns).withColumn("_rows", F.size("lines").cast("bigint"))
    placed = placed_by_sums(rows, ["timestamp", "session_id", F.to_json("lines")], "_rows", "_at")
    return (
        placed.select("_at", "session_id", "timestamp", F.posexplode("lines").alias("_n", "r"))
        .select((F.col("_at") + F.col("_n") + first).alias("id"), "session_id", "timestamp",
                "r.role", "r.content")
    )
