"""Failed turns and the digest made of them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom import constants as C
from logloom.functions.running import block_width, numbered


def max_retry_failures(evaluations: DataFrame, max_retries: int = C.MAX_RETRIES) -> DataFrame:
    """Turns graded false after all retries, with a user message to learn from."""
    return (
        evaluations
        .where(F.col("passed_is_false") & F.col("has_user_message")
               & (F.coalesce("attempts", F.lit(0)) >= max_retries))
        .select("id", "session_id", "timestamp", "attempts", "user_message",
                "final_response", "rejections")
    )


def failure_count(failures: DataFrame) -> DataFrame:
    return failures.agg(F.count(F.lit(1)).alias("failures"))


def failure_digest(failures: DataFrame, last_n: int | None = None,
                   width: int | None = None) -> DataFrame:
    """One text block per failure, numbered from 1 in id order.

    The blocks of ids that the numbering goes by are as wide as the ids are sparse
    (``block_width``), unless ``width`` says otherwise.

    Blocks stay rows, because the whole digest has no size bound;
    ``orderBy("failure_no")`` lists them. ``last_n`` keeps the latest failures.
    """
    if last_n is not None:
        failures = failures.orderBy(F.desc("id")).limit(last_n)

    def rejection_lines(r):
        has_draft = F.length(r["response"]) > 0
        has_tools = F.size(r["tools_used"]) > 0
        return F.concat_ws(
            "\n",
            F.concat(F.lit("- Attempt "), F.coalesce(r["attempt"].cast("string"), F.lit("?")),
                     F.lit(" rejected: "), F.coalesce(r["feedback"], F.lit(""))),
            F.when(has_draft, F.concat(F.lit("  Draft: "),
                                       F.substring(r["response"], 1, C.DRAFT_CHARS))),
            F.when(has_tools, F.concat(F.lit("  Tools: "), F.array_join(r["tools_used"], ", "))),
        )

    block = F.array_join(
        F.concat(
            F.array(F.concat(F.lit("## Failure "), F.col("failure_no").cast("string")),
                    F.concat(F.lit("User question: "), F.col("user_message"))),
            F.transform("rejections", rejection_lines)),
        "\n")
    width = width or block_width(failures)
    return numbered(failures, [], ["id"], "failure_no", width).select(
        "id", "failure_no", block.alias("block"))
