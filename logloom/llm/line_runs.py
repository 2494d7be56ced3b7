"""Repeated runs of lines, found with a suffix array by distributed prefix doubling.

The documents, in the order of doc_id, are one sequence of line ids. Suffixes are
ranked by their first line, then by their first 2, 4, 8... lines: a suffix's new rank
is the place of the pair (its rank, the rank of the suffix that many lines on) in the
sorted pairs. Ranks keep the order of the suffixes, and suffixes of equal rank are
an interval of the suffix array with a common prefix of that many lines. Suffixes
alone in their interval are settled and dropped.

A run of lines that occurs before and holds at least ``min_words`` words is deleted;
its first occurrence stays. Every line of such a run lies in a window that just holds
``min_words`` words, counted forward from its first line or backward from its last.
Two windows of n lines are equal if their first and last 2^k lines are (2^k <= n <
2^(k+1)): they form a common-prefix interval of n lines, and all of its windows but
the first are deleted. So doubling stops at ``min_words`` lines, however long the
runs are, and overlapping windows make up the maximal runs.

Lines without words are no part of the sequence; they go with the line before them.
Lines are compared by two 64-bit hashes. Null texts stay null, empty texts empty.
Rows that repeat a doc_id and text are one document and get the same result; rows
that share only the doc_id are ordered by a hash of their text; null ids come last.
No rows give no rows; other columns pass through.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.llm.common import stored, words

MIN_WORDS = 50
LAST = (1 << 63) - 1
KEY = ["_id", "_h"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)),
                             "_h": F.xxhash64("text")})


def lines(docs: DataFrame, min_words: int) -> DataFrame:
    """The lines with words, numbered through the corpus.

    pos; _id, _h, _from and _to, the line and the blank lines after it; a and b, its
    hashes; left, the lines after it in its document; forward and back, the lengths
    of the windows that begin and end with it (null where words are too few).
    """
    cut = _keyed(docs.where("text IS NOT NULL").select("doc_id", "text")).select(
        *KEY, F.split("text", "\n").alias("_lines"))
    # stored, as the ranges are drawn from a sample, which would read and cut the texts again
    counted = stored(
        cut.select(*KEY, F.size("_lines").alias("n"), F.posexplode("_lines").alias("_from", "line"))
        .select(*KEY, "n", "_from", words(F.col("line")).alias("w"),
                F.xxhash64("line").alias("a"), F.xxhash64(F.lit(17), F.col("line")).alias("b"))
        .where("w > 0"), "runs-counted")
    found = (
        counted.repartitionByRange(*KEY)
        # rows that repeat a document
        .groupBy(*KEY, "_from").agg(*[F.min(c).alias(c) for c in ("n", "w", "a", "b")])
        .sortWithinPartitions(*KEY, "_from"))
    inside = W.partitionBy(*KEY).orderBy("_from")
    ahead = W.partitionBy(*KEY).orderBy("_start").rangeBetween(0, min_words - 1)
    behind = W.partitionBy(*KEY).orderBy("_end").rangeBetween(1 - min_words, 0)
    numbered = (
        found.withColumn("_end", F.sum("w").over(inside))
        .withColumn("_start", F.col("_end") - F.col("w"))
        .withColumn("_to", F.coalesce(F.lead("_from").over(inside), F.col("n")) - 1)
        .withColumn("left", F.count(F.lit(1)).over(W.partitionBy(*KEY))
                    - F.row_number().over(inside))
        .withColumn("forward", F.when(F.max("_end").over(ahead) - F.col("_start") >= min_words,
                                      F.count(F.lit(1)).over(ahead)))
        .withColumn("back", F.when(F.col("_end") - F.min("_start").over(behind) >= min_words,
                                   F.count(F.lit(1)).over(behind)))
        .sortWithinPartitions(*KEY, "_from"))
    return stored(numbered.select(
        F.monotonically_increasing_id().alias("pos"), *KEY, "_from", "_to", "a", "b",
        F.col("left").cast("bigint"), "forward", "back"), "runs-lines")


def first_ranks(numbered: DataFrame) -> DataFrame:
    """pos, rank, left, forward, back of the lines that occur more than once."""
    ids = stored(
        numbered.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .orderBy("a", "b").select("a", "b", F.monotonically_increasing_id().alias("rank")),
        "runs-ids")
    return stored(numbered.select("pos", "a", "b", "left", "forward", "back")
                  .join(ids, ["a", "b"]).drop("a", "b"), "runs-rank0")


def doubled(ranks: DataFrame, step: int, name: str) -> DataFrame:
    """Ranks by twice as many lines, of the suffixes that are not alone in theirs.

    A document that ends before is least; a settled suffix equals no other.
    """
    following = ranks.select((F.col("pos") - step).alias("pos"), F.col("rank").alias("next"))
    pairs = stored(
        ranks.join(following, "pos", "left").withColumn(
            "next", F.when(F.col("left") < step, -1)
            .otherwise(F.coalesce("next", -2 - F.col("pos")))), f"{name}-pairs")
    order = stored(
        pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .orderBy("rank", "next")
        .select("rank", "next", F.monotonically_increasing_id().alias("_new")), f"{name}-order")
    return stored(pairs.join(order, ["rank", "next"])
                  .select("pos", F.col("_new").alias("rank"), "left"), name)


def later_copies(windows: DataFrame, ranks: DataFrame, block: int) -> DataFrame:
    """The windows (start, n) that equal one with a smaller start."""
    found = (windows.join(ranks.select(F.col("pos").alias("start"), F.col("rank").alias("head")),
                          "start")
             .withColumn("_tail", F.col("start") + F.col("n") - block)
             .join(ranks.select(F.col("pos").alias("_tail"), F.col("rank").alias("tail")),
                   "_tail"))
    found = found.select("start", "n", "head", "tail")
    first = (found.groupBy("n", "head", "tail")
             .agg(F.min("start").alias("first"), F.count(F.lit(1)).alias("copies"))
             .where("copies > 1").drop("copies"))
    return found.join(first, ["n", "head", "tail"]).where("start > first").select("start", "n")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_id, _h, _drop: per document with deletions the numbers of the deleted lines."""
    numbered = lines(docs, min_words)
    ranks = first_ranks(numbered)
    windows = stored(
        ranks.where("forward IS NOT NULL").select(F.col("pos").alias("start"),
                                                  F.col("forward").alias("n"))
        .unionByName(ranks.where("back IS NOT NULL").select(
            (F.col("pos") - F.col("back") + 1).alias("start"), F.col("back").alias("n")))
        .distinct(), "runs-windows")
    longest = windows.agg(F.max("n")).first()[0] or 0
    ranks, block, parts = ranks.select("pos", "rank", "left"), 1, []
    while block <= longest:
        of_size = windows.where((F.col("n") >= block) & (F.col("n") < 2 * block))
        parts.append(stored(later_copies(of_size, ranks, block), f"runs-copies{block}"))
        if 2 * block <= longest:
            ranks = doubled(ranks, block, f"runs-rank{2 * block}")
        block *= 2
    if not parts:
        parts = [windows]  # no window at all
    copies = parts[0]
    for part in parts[1:]:
        copies = copies.unionByName(part)
    gone = copies.select(F.explode(F.expr("sequence(start, start + n - 1)")).alias("pos")) \
        .distinct()
    return (numbered.join(gone, "pos").groupBy(*KEY)
            .agg(F.flatten(F.collect_list(F.sequence("_from", "_to"))).alias("_drop")))


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS,
                   removed: str = "removed_lines") -> DataFrame:
    """``docs`` with later copies of runs deleted from ``text``; ``removed`` counts lines."""
    columns = [c for c in docs.columns if c != removed]
    # the caller's other columns travel as one, whatever their names
    packed = docs.select(F.struct("doc_id", *[c for c in columns if c not in ("doc_id", "text")])
                         .alias("_row"), "doc_id", "text")
    rows = _keyed(packed).join(repeated_lines(docs, min_words), KEY, "left")
    cut = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col("_drop"))
    text = F.when(F.col("_drop").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.element_at(cut, i + 1)), "\n"))
    return rows.select(*[text.alias("text") if c == "text" else F.col("_row")[c].alias(c)
                         for c in columns], F.coalesce(F.size("_drop"), F.lit(0)).alias(removed))
