"""How the filters of a cleaning run interact: what each removes, in every order.

A row fails some of n filters, noted as a mask of n bits. All that the audit tells
follows from how many rows each of the 2 ** n coalitions of filters removes (a row
goes if it fails any filter of the coalition): the counts of a step are differences of
two coalitions, and the Shapley values are the additive values that come closest to
the removals by kernel-weighted least squares, held to share out the removals of all
filters exactly. The normal equations are the same for all parts of the data, so they
are solved once, in rationals, with the removals left open; each part's values are
then sums of its removals times the solved weights.

Rows meet only as counts: first by text, to find those identical to one with a smaller
id, then by part and mask, of which there are at most 2 ** n per part.

Nulls and empty texts: a null text counts as empty; an empty text has no words and
fails A, and E where a smaller id is empty too. A row without an id is identical to no
smaller one, and no other row is identical to it. Rows that repeat an id each count;
equal texts of one id are not smaller than each other. A null source is the part named by
the empty text. A document is good or toxic if any of its labels says so. No rows give
no rows; other columns are ignored.
"""

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import WORD, stored

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
SIGNS = "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"


def content_mask(text, spans=WORD):
    """Bits of A to D for a text that is not null."""
    words = F.regexp_count(text, F.lit(spans))
    distinct = F.size(F.array_remove(F.array_distinct(F.split(text, SPACE)), ""))
    failed = [words < LEAST_WORDS,
              100 * distinct < LEAST_DISTINCT * words,
              100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(text),
              text.rlike(SIGNS)]
    return sum((F.when(f, F.lit(1 << i)).otherwise(0) for i, f in enumerate(failed)), F.lit(0))


def tabulated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: how many rows fail exactly the filters of a mask.

    Of rows with one text all but those with the least id fail E. Texts are compared by
    SHA-256; they are counted by (id, text), then by (text, part, labels) with the least
    id, so that a text with a third of all rows is a few counts in the last step.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint"), F.coalesce(F.col("source").cast("string"), F.lit(""))
        .alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"),
        content_mask(text).alias("mask"))
    counted = rows.groupBy("doc_id", "part", "sha", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    marked = counted.join(marks, "doc_id", "left").withColumns(
        {c: F.coalesce(c, no) for c in ("good", "toxic")})
    some = F.col("doc_id").isNotNull()
    groups = marked.groupBy("sha", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(some, F.col("n")).otherwise(0)).alias("named"),
        F.min(F.when(some, F.struct("doc_id", "n"))).alias("first"))
    groups = stored(groups, "audit-texts")
    # few texts occur more than once; the rest need not meet
    least = groups.groupBy("sha").agg(F.min("first.doc_id").alias("least"),
                                      F.sum("named").alias("copies")).where("copies > 1")
    spared = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    later = F.when(F.col("least").isNotNull(), F.col("named") - spared).otherwise(0)
    split = groups.join(least.drop("copies"), "sha", "left").withColumn("later", later)
    e = 1 << (len(FILTERS) - 1)
    both = F.array(F.struct((F.col("mask") + e).alias("mask"), F.col("later").alias("n")),
                   F.struct(F.col("mask"), (F.col("n") - F.col("later")).alias("n")))
    return (split.select("part", "good", "toxic", F.explode(both).alias("x"))
            .select("part", "good", "toxic", "x.mask", "x.n").where("n > 0")
            .groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")))


def shapley_weights(n: int) -> list[list[int]]:
    """Per filter the weight of each coalition's removals in n! times its Shapley value.

    Least squares over all coalitions other than none and all, weighted by the kernel
    (n - 1) / (C(n, s) s (n - s)), held to sum to the removals of all filters: the
    normal equations with one multiplier, solved by elimination with one right-hand
    side per coalition.
    """
    size, everything = 1 << n, (1 << n) - 1
    kernel = {s: Fraction(n - 1, comb(n, s) * s * (n - s)) for s in range(1, n)}
    left = [[Fraction(0)] * (n + 1) for _ in range(n + 1)]
    right = [[Fraction(0)] * size for _ in range(n + 1)]
    for coalition in range(1, everything):
        inside = [i for i in range(n) if coalition >> i & 1]
        weight = kernel[len(inside)]
        for i in inside:
            right[i][coalition] += weight
            for j in inside:
                left[i][j] += weight
    for i in range(n):
        left[i][n] = left[n][i] = Fraction(1)
    right[n][everything] = Fraction(1)
    for k in range(n + 1):
        pivot = next(r for r in range(k, n + 1) if left[r][k])
        for side in (left, right):
            side[k], side[pivot] = side[pivot], side[k]
        scale = left[k][k]
        left[k], right[k] = [x / scale for x in left[k]], [x / scale for x in right[k]]
        for r in range(n + 1):
            if r != k and (times := left[r][k]):
                left[r] = [x - times * y for x, y in zip(left[r], left[k], strict=True)]
                right[r] = [x - times * y for x, y in zip(right[r], right[k], strict=True)]
    found = [[x * factorial(n) for x in row] for row in right[:n]]
    assert all(x.denominator == 1 for row in found for x in row)
    return [[int(x) for x in row] for row in found]


def coalitions(table: DataFrame, n: int) -> DataFrame:
    """Per part: size, and by coalition the rows, good rows and toxic rows that go."""
    every = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    parts = table.groupBy("part").agg(F.sum("n").alias("size"))
    gone = (
        table.select("*", F.explode(every).alias("coalition"))
        .withColumn("n", F.when(F.col("mask").bitwiseAND(F.col("coalition")) != 0, F.col("n"))
                    .otherwise(0))
        .groupBy("part", "coalition").agg(
            F.sum("n").alias("gone"),
            F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
        .groupBy("part").agg(F.array_sort(F.collect_list(
            F.struct("coalition", "gone", "good", "toxic"))).alias("by")))
    return parts.join(gone, "part").select("part", "size", *[
        F.col(f"by.{c}").alias(c) for c in ("gone", "good", "toxic")])


def steps(filters: str) -> str:
    """SQL for an array of all orders' steps with the coalitions before and after."""
    n, found = len(filters), []
    for order in permutations(range(n)):
        before, name = 0, "".join(filters[i] for i in order)
        for step, i in enumerate(order, 1):
            found.append(f"struct('{name}' AS filter_order, {step} AS step, {i} AS own, "
                         f"{before} AS before, {before | 1 << i} AS after)")
            before |= 1 << i
    return f"inline(array({', '.join(found)}))"


def audited(table: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from ``tabulated`` counts."""
    n = len(filters)
    every = (1 << n) - 1
    values = F.array(*[
        sum((F.get("gone", F.lit(s)) * w for s, w in enumerate(row) if w), F.lit(0).cast("bigint"))
        for row in shapley_weights(n)])
    parts = coalitions(table, n).withColumn("values", values)
    rows = parts.selectExpr("*", steps(filters))

    def at(name, where):
        return F.get(name, F.col(where))

    def step(name):
        return at(name, "after") - at(name, "before")

    own = F.expr("shiftleft(1, own)")
    return rows.select(
        "part", "filter_order", "step", (F.col("size") - at("gone", "after")).alias("kept"),
        step("gone").alias("removed"), (F.get("gone", own) - step("gone")).alias("redundant"),
        (F.get("gone", F.lit(every)) - F.get("gone", F.lit(every) - own)).alias("unique_fails"),
        step("good").alias("good_lost"), step("toxic").alias("toxic_lost"),
        F.get("values", F.col("own")).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five text filters over ``docs`` (doc_id, text, source)."""
    return audited(stored(tabulated(docs, labels), "audit-table"))
