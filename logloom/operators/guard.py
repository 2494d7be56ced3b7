"""Screening of incoming messages."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom import constants as C
from logloom.functions.text import gated, iso_utc, matches, matches_any, preview, strip
from logloom.operators.rate_limit import with_rate_limit


def is_unsafe(text: Column, patterns=None) -> Column:
    if patterns is not None:
        return matches_any(text, patterns)
    return gated(text, C.UNSAFE_NEEDLES, matches_any(text, C.UNSAFE_PATTERNS))


def unsafe_messages(messages: DataFrame, patterns=None) -> DataFrame:
    """User messages that match a rule, with the 1-based numbers of the rules."""
    rules = F.array_compact(F.array(*[
        F.when(matches(F.col("content"), p), F.lit(n))
        for n, p in enumerate(patterns or C.UNSAFE_PATTERNS, 1)]))
    return (
        messages.where((F.col("role") == C.USER) & is_unsafe(F.col("content"), patterns))
        .select("id", "session_id", "content", rules.alias("matched_rules"))
    )


def verdict_is_safe(verdict: Column) -> Column:
    """Only the word SAFE lets a message pass; anything else, or nothing, blocks."""
    return F.coalesce(F.upper(strip(verdict)) == "SAFE", F.lit(False))


def guard_verdicts(verdicts: DataFrame) -> DataFrame:
    return verdicts.withColumn("safe", verdict_is_safe(F.col("verdict")))


def guard_decisions(messages: DataFrame, verdicts: DataFrame | None = None,
                    limit: int = C.RATE_LIMIT,
                    window_seconds: int = C.RATE_WINDOW_SECONDS) -> DataFrame:
    """Decide every incoming message: rate limit, then rules, then verdict.

    ``messages`` holds id, session_id, ts, content. ``verdicts`` holds id and
    the classifier's verdict; a message without one is blocked. With no verdict
    table at all the rules alone decide.
    """
    return decided(with_rate_limit(ruled(messages), limit, window_seconds), verdicts)


def ruled(messages: DataFrame) -> DataFrame:
    """Texts are tested where they are read; only the result and a preview go on."""
    content = F.col("content")
    return messages.select("id", "session_id", "ts", preview(content).alias("preview"),
                           is_unsafe(content).alias("unsafe"))


def decided(rows: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """The decision from ``within_limit``, ``unsafe`` and the verdict, in that order."""
    if verdicts is None:
        return with_reason(rows, F.col("unsafe"))
    rows = rows.join(verdicts.select("id", "verdict"), "id", "left")
    return with_reason(rows, F.col("unsafe") | ~verdict_is_safe(F.col("verdict")))


def with_reason(rows: DataFrame, unsafe: Column) -> DataFrame:
    reason = F.when(~F.col("within_limit"), "rate_limit").when(unsafe, "unsafe")
    reply = (F.when(F.col("reason") == "rate_limit", C.REPLY_RATE_LIMITED)
             .when(F.col("reason") == "unsafe", C.REPLY_BLOCKED).otherwise(""))
    return (
        rows.withColumn("reason", reason)
        .select("id", "session_id", "ts", "preview",
                F.col("reason").isNull().alias("allowed"), "reason", reply.alias("reply"))
    )


def block_rows(decisions: DataFrame) -> DataFrame:
    """Log rows for the blocked messages; a blocked message leaves no user row."""
    return decisions.where(~F.col("allowed")).select(
        "id", "session_id", iso_utc(F.col("ts")).alias("timestamp"),
        F.lit(C.GUARDRAIL_LOG).alias("role"), F.to_json(F.struct("reason")).alias("content"))
