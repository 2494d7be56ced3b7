"""Mixing of sources by a time-varying curriculum.

A schedule gives each source a weight over training time 0 to 1, as straight
lines between knots. The integral of the weight is the source's share; the shares
are cut at ``most`` times the source's size and the rest is shared again. Within a
source documents stand in a fixed pseudo-random order; the words asked for until
time t are target * (integral to t / whole integral), and inverting that gives
each copy of a document its training position.

Running sums are taken in blocks of the order, so no task sorts a whole source;
only one row per block passes through a window over its source.

Null source: a source of its own, last. Null or empty text: size 0, nothing taken,
no position. Rows that repeat a doc_id count each. No rows give no rows; other
columns pass through ``mixed`` and are ignored by ``plan``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.llm.common import stored, words

BLOCK_ROWS = 20_000
KNOTS = "array<struct<t:double,w:double>>"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, and the pseudo-random order key of each document."""
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"),
                       F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_key"))


def source_sizes(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source").agg(F.sum("size").alias("source_size"))


def cycled(sources: DataFrame, shapes: list[list[tuple[float, float]]]) -> DataFrame:
    """A schedule that gives the shapes in turn to the sources, by name, null last.

    The window sees one row per source.
    """
    shape = F.array(*[
        F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w"))
                  for t, w in knots]) for knots in shapes])
    at = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.select("source", shape[F.pmod(at, F.lit(len(shapes)))].cast(KNOTS)
                          .alias("knots"))


def _segments(schedule: DataFrame) -> DataFrame:
    """Per source its straight pieces, with the integral before and after each."""
    pieces = F.transform(
        F.sequence(F.lit(0), F.size("knots") - 2),
        lambda i: F.struct(
            F.col("knots")[i]["t"].alias("t"), F.col("knots")[i]["w"].alias("w"),
            ((F.col("knots")[i + 1]["w"] - F.col("knots")[i]["w"])
             / (F.col("knots")[i + 1]["t"] - F.col("knots")[i]["t"])).alias("slope"),
            ((F.col("knots")[i + 1]["w"] + F.col("knots")[i]["w"])
             * (F.col("knots")[i + 1]["t"] - F.col("knots")[i]["t"]) / 2).alias("area")))
    summed = F.transform("pieces", lambda x, i: F.struct(
        x["t"].alias("t"), x["w"].alias("w"), x["slope"].alias("slope"),
        F.aggregate(F.slice("pieces", F.lit(1), i), F.lit(0.0), lambda a, p: a + p["area"])
        .alias("before"),
        F.aggregate(F.slice("pieces", F.lit(1), i + 1), F.lit(0.0), lambda a, p: a + p["area"])
        .alias("after")))
    return (schedule.withColumn("pieces", pieces)
            .select("source", summed.alias("pieces"))
            .withColumn("weight", F.element_at("pieces", -1)["after"]))


def targets(sources: DataFrame, schedule: DataFrame, share: float, most: float) -> DataFrame:
    """source, source_size, target, weight, pieces.

    ``share`` of all words is dealt out by weight; a target stops at ``most`` times
    its source's size. The level at which no target is above its bound is found in
    the order of bound / weight: the windows see one row per source.
    """
    weighed = (sources.alias("s").join(_segments(schedule).alias("w"),
                                       F.expr("s.source <=> w.source"))
               .select("s.source", "source_size", "weight", "pieces")
               .withColumn("_cap", F.col("source_size") * F.lit(most)))
    order = W.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    before = order.rowsBetween(W.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(everything) * F.lit(share)
              - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
             / (F.sum("weight").over(everything)
                - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    levels = weighed.withColumn("_level", level)
    open_level = F.max(F.when(F.col("_level") * F.col("weight") < F.col("_cap"),
                              F.col("_level"))).over(everything)
    return levels.withColumn("_open", open_level).select(
        "source", "source_size",
        F.coalesce(F.least(F.col("_cap"), F.col("_open") * F.col("weight")), F.col("_cap"))
        .alias("target"), "weight", "pieces")


def _time(demand: Column) -> Column:
    """Training time at which ``demand`` of the source's integral is reached."""
    piece = F.coalesce(F.get(F.filter("pieces", lambda p: demand < p["after"]), F.lit(0)),
                       F.element_at("pieces", -1))
    rest = demand - piece["before"]
    return piece["t"] + 2 * rest / (
        piece["w"] + F.sqrt(piece["w"] * piece["w"] + 2 * piece["slope"] * rest))


def plan(docs: DataFrame, schedule, share: float, most: float,
         block_rows: int = BLOCK_ROWS, extra: list[str] | None = None) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, before, taken, position.

    ``schedule`` makes the schedule from the sources: source, knots. ``before`` is
    the number of words of the source that stand before the document. Every
    document is taken ``floor(target / source_size)`` times; those at the start of
    the order once more, the last of them in part, until the target is met.
    ``position`` is the training time of the first copy, null if none is taken.
    """
    sized = stored(sizes(docs), "mix-sizes")
    digits = 1
    while sized.count() > block_rows * 16 ** digits:
        digits += 1
    per_source = targets(source_sizes(sized), schedule(source_sizes(sized)), share, most)
    sized = sized.withColumn("_block", F.substring("_key", 1, digits))
    blocks = (sized.groupBy("source", "_block").agg(F.sum("size").alias("_words"))
              .withColumn("_from", F.coalesce(
                  F.sum("_words").over(W.partitionBy("source").orderBy("_block")
                                       .rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
    placed = (
        sized.alias("d").join(blocks.alias("b"), F.expr(
            "d.source <=> b.source AND d._block = b._block"))
        .select("d.*", "_from")
        .withColumn("before", F.col("_from") + F.coalesce(
            F.sum("size").over(W.partitionBy("source", "_block").orderBy("_key", "doc_id", "size")
                               .rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
    known = (placed.alias("d").join(per_source.alias("s"), F.expr("d.source <=> s.source"))
             .select("doc_id", "d.source", "size", "source_size", "target", "before", "weight",
                     "pieces"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))) \
        .otherwise(0)
    rest = F.floor(F.col("target")) - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return (
        known.withColumn("taken", (whole * F.col("size") + part).cast("bigint"))
        .withColumn("position", F.when(F.col("taken") > 0, _time(
            F.col("before") / F.col("target") * F.col("weight"))))
        .select("doc_id", "source", "size", "source_size", "target", "before", "taken",
                "position", *(extra or [])))


def mixed(docs: DataFrame, schedule, share: float, most: float,
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of ``docs``, whole, once for each copy taken, in training order.

    A document's last copy is taken where its middle lies before the end of the
    target. Rows that repeat a doc_id, source and size share one decision.
    """
    columns = docs.columns
    whole = F.floor(F.col("target") / F.col("source_size"))
    rest = F.col("target") - whole * F.col("source_size")
    last = (F.col("before") + F.col("size") / 2 < rest).cast("int")
    planned = (
        plan(docs, schedule, share, most, block_rows, extra=["weight", "pieces"])
        .where("size > 0").dropDuplicates(["doc_id", "source", "size"])
        .withColumn("_copies", (whole + last).cast("int")).where("_copies > 0"))
    times = planned.select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"),
        F.col("size").alias("_size"),
        F.transform(F.sequence(F.lit(0), F.col("_copies") - 1), lambda copy: _time(
            F.least((copy * F.col("source_size") + F.col("before")) / F.col("target"),
                    F.lit(1.0)) * F.col("weight"))).alias("_times"))
    # the caller's columns travel as one, whatever their names
    packed = docs.select(F.struct(*columns).alias("_row"), "doc_id", "source",
                         words(F.col("text")).alias("_words"))
    chosen = packed.join(times, F.expr(
        "doc_id <=> _id AND source <=> _source AND _words = _size"))
    return (chosen.select("_row", "doc_id", F.explode("_times").alias("_time"))
            .repartitionByRange("_time", "doc_id").sortWithinPartitions("_time", "doc_id")
            .select(*[F.col("_row")[c].alias(c) for c in columns]))
