"""The rule part of the answer quality gate."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom import constants as C
from logloom.functions import variant as V
from logloom.functions.running import BLOCK_IDS, within_last
from logloom.functions.text import contains_any, matches, matches_any, word_count
from logloom.sources.facts import any_supports_age
from logloom.sources.log import role_rows

OPERATIONAL_LENGTH, LENGTH, AGE, MISSING_TOOL, TO_JUDGE = (
    "operational_length", "length", "age", "missing_tool", "to_judge")


def reply_word_counts(messages: DataFrame) -> DataFrame:
    return role_rows(messages, C.ASSISTANT).select(
        "id", "session_id", word_count(F.col("content")).cast("bigint").alias("words"))


def used_operational_tool(tools: Column) -> Column:
    return F.coalesce(
        F.arrays_overlap(tools, F.array(*[F.lit(t) for t in C.OPERATIONAL_TOOLS])), F.lit(False))


def operational_turns(messages: DataFrame, lookback: int = C.HISTORY_LOOKBACK,
                      width: int = BLOCK_IDS) -> DataFrame:
    """User messages with scheduling or contact language in them or shortly before.

    No hint holds a space, so a hint occurs in the joined text if and only if it
    occurs in one of the messages. Only a number per message is shuffled: 1 for
    a user's, 2 more for one with a hint.
    """
    hint = contains_any(F.col("content"), C.OPERATIONAL_HINTS)
    signs = role_rows(messages, C.USER, C.ASSISTANT).select(
        "id", "session_id",
        (F.when(F.col("role") == C.USER, 1).otherwise(0) + F.when(hint, 2).otherwise(0))
        .alias("sign"))
    return (
        within_last(signs, ["session_id"], F.col("sign") >= 2, lookback, "operational", width)
        .where(F.col("sign") % 2 == 1)
        .select("id", "session_id", "operational")
    )


def is_unsure_without_record(response: Column, tools: Column) -> Column:
    """Says it does not know, but did not record the question."""
    recorded = F.coalesce(F.array_contains(tools, C.RECORD_UNKNOWN), F.lit(False))
    return ~recorded & matches(response, C.UNSURE)


def declined_without_record(turns: DataFrame) -> DataFrame:
    return turns.where(is_unsure_without_record(F.col("response"), F.col("tools"))).select(
        "session_id", "timestamp", "user_row_id", "response")


def quality_cascade(turns: DataFrame, facts: DataFrame | None = None,
                    max_words: int = C.MAX_WORDS) -> DataFrame:
    """Grade each reply by the first rule it breaks; the rest goes to the judge.

    ``facts`` (source, text) are the approved texts; whether one of them supports
    age claims is one value, found by an aggregation of theirs. The turns need no
    shuffle.
    """
    message, response, tools = F.col("user_message"), F.col("response"), F.col("tools")
    words = F.col("words")
    supported = F.lit(False) if facts is None else any_supports_age(facts)
    invented_age = (matches(message, C.AGE_QUESTION) & ~supported
                    & matches_any(response, C.AGE_CLAIMS))
    outcome = (
        F.when((words > max_words) & used_operational_tool(tools), OPERATIONAL_LENGTH)
        .when(words > max_words, LENGTH)
        .when(invented_age, AGE)
        .when(is_unsure_without_record(response, tools), MISSING_TOOL)
        .otherwise(TO_JUDGE)
    )
    kind = F.col("outcome")
    feedback = (
        F.when(kind == OPERATIONAL_LENGTH,
               F.format_string(C.FEEDBACK_OPERATIONAL_LENGTH, words, F.lit(max_words)))
        .when(kind == LENGTH, F.format_string(C.FEEDBACK_LENGTH, words, F.lit(max_words)))
        .when(kind == AGE, C.FEEDBACK_AGE)
        .when(kind == MISSING_TOOL, C.FEEDBACK_MISSING_TOOL)
    )
    return (
        turns.withColumn("words", word_count(response).cast("bigint"))
        .withColumn("outcome", outcome)
        .withColumn("feedback", feedback)
    )


def judge_verdicts(verdicts: DataFrame) -> DataFrame:
    """Parse judge output; only a JSON object whose ``pass`` is true passes.

    Text that is no JSON object fails with a standard feedback.
    """
    v = F.col("_v")
    parsed = V.begins_object(F.col("verdict")) & v.isNotNull()
    return (
        verdicts.withColumn("_v", F.try_parse_json("verdict"))
        .withColumn("pass", V.is_true(V.member(v, "pass")))
        .withColumn("feedback", F.when(parsed, F.coalesce(V.text(v, "feedback"), F.lit("")))
                    .otherwise(C.FEEDBACK_UNVERIFIED))
        .drop("_v")
    )
