"""Approved facts: the texts an assistant may cite."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import constants as C
from logloom.functions.text import gated, matches

CONTEXT_HEADING = "Approved facts; nothing outside this text may be cited:"


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: source (file name) and whole text."""
    return (
        spark.read.text(path, wholetext=True)
        .select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("source"),
                F.col("value").alias("text"))
    )


def facts_from_table(rows: DataFrame, source: str, text: str) -> DataFrame:
    return rows.select(F.col(source).cast("string").alias("source"), F.col(text).alias("text"))


def context_rows(facts: DataFrame) -> DataFrame:
    """The approved facts as prompt text: is_heading, source, text.

    To print with the heading first, then in the order of source. A fact without a source
    is its text alone; a missing text is empty. Rows, not one string, as facts have no
    size bound; requests refer to them (``requests.judge_requests``).
    """
    heading = facts.sparkSession.sql(
        "SELECT true AS is_heading, CAST(NULL AS STRING) AS source, :heading AS text",
        args={"heading": CONTEXT_HEADING})
    return heading.unionByName(facts.select(
        F.lit(False).alias("is_heading"), "source",
        F.concat_ws(":\n", "source", F.coalesce("text", F.lit(""))).alias("text")))


def supports_age(text: Column) -> Column:
    """Does a context text state an age, birth or years other than of experience."""
    low = F.lower(text)
    return gated(low, C.AGE_CONTEXT_NEEDLES, matches(low, C.AGE_IN_CONTEXT))


def context_supports_age(facts: DataFrame) -> DataFrame:
    """Per source, whether any of its texts supports an age claim.

    Texts are tested one by one and the flags merged on the map side, so no
    source's texts are ever joined into one string.
    """
    return facts.groupBy("source").agg(
        F.bool_or(supports_age(F.col("text"))).alias("supports_age"))


def any_supports_age(facts: DataFrame) -> Column:
    """Whether any text supports an age claim, as a one-row subquery; false without facts."""
    return F.coalesce(
        facts.agg(F.bool_or(supports_age(F.col("text")))).scalar(), F.lit(False))
