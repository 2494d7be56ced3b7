"""A corpus from documents to token ids, as stages over stored tables.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given; all but
the last return the columns of ``documents``. ``n_chars`` follows the text.

ORACLE_SQL is None: compression, hashing and segmentation have no SQL form; the
stages are tested against brute force instead.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.llm import line_runs, mixing, near_dedup, quality, sentencepiece
from logloom.llm.common import stored, table, unused
from logloom.llm.queries import MOST, SHARE, schedule, tokenizer
from logloom.session import configure

#: Near duplicates: 80 % of the shingles in common.
NEAR = {"percent": 80, "rows": 8, "bands": 48}
#: Numbers of documents that their doc_id does not name begin here.
BEYOND = 1 << 62


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least one half."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(F.col("text"), model) >= 0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines; those left empty by it go."""
    [count] = unused(docs, "removed")
    removed = line_runs.remove_repeats(docs, removed=count).where(
        (F.col(count) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return removed.select(*[
        F.when(F.col(count) > 0, F.length("text")).otherwise(F.col(c))
        .cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c)
        for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id.

    Rows that repeat a doc_id and its text are one document. Of unlike texts with one
    doc_id, or without any, each is a document of its own: the operator is given numbers
    beyond all ids for them, drawn from id and text.
    """
    own = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text",
                      F.xxhash64("text").alias("hash"))
    unlike = stored(
        own.where("doc_id IS NOT NULL").groupBy("doc_id")
        .agg(F.min("hash").alias("first"), F.max("hash").alias("last")).where("first < last")
        .select(F.col("doc_id").alias("id"), "first"), "pipeline-unlike")
    named = F.col("doc_id").isNotNull() & F.coalesce(F.col("first") == F.col("hash"), F.lit(True))
    drawn = F.lit(BEYOND) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(BEYOND))
    own = own.join(unlike, F.expr("doc_id = id"), "left").withColumn(
        "node", F.when(named, F.col("doc_id").cast("bigint")).otherwise(drawn))
    kept = near_dedup.near_duplicates(
        own.select(F.col("node").alias("doc_id"), "text"), **NEAR).where("kept").select(
        F.col("doc_id").alias("kept")).distinct()
    turn = F.row_number().over(W.partitionBy("node").orderBy("text"))
    return (own.join(kept, F.expr("node = kept")).withColumn("turn", turn).where("turn = 1")
            .select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.mixed(docs, schedule, SHARE, MOST)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' piece ids instead of their texts."""
    return sentencepiece.encode(docs, tokenizer("piece_bpe_32k.model")).withColumn(
        "n_tokens", F.size("ids"))


STAGES = [("quality classifier", classify), ("line dedup", drop_repeated_lines),
          ("minhash near-dedup", drop_near_duplicates), ("source mixing", mix),
          ("sentencepiece", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
