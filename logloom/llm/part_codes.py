"""Vectors as short codes: each part of a vector becomes the index of its nearest entry.

Components become integers, floor(scale * x), and all sums stay integers, so results do
not depend on how Spark deals the rows. Every part position has a codebook of its own,
which starts with the parts of the vectors with the smallest ids and is refined by rounds
of assignment and averaging.

Assignment walks a trie over the distinct parts of a block of vectors. Sorted parts are
the trie in depth-first order: a node at depth d is a run of parts that agree in their
first d components. Each node's distances to all entries, summed over the components on
its path, are computed once, from its parent's, and shared by all parts below it; a leaf
takes the least one, and adds its part, times the number of vectors that have it, to the
entry's sum. The distances held at once are at most (rows of a block) x (entries) per
depth. Blocks are walked where the vectors lie, so no vector is ever shuffled: a round
moves one partial sum per task and entry, and the codebooks, of fixed size, go with the
tasks.

Vectors that are null or hold null or non-finite components are dropped. All vectors have
the length of the first one (smallest id); a vector of another length has no code and no
error, and a length that is no multiple of the parts is an error, as are components
beyond ``LIMIT``. Ties go to the entry with the lower index. Rows that repeat an id each
count; of the starting vectors those with equal ids come in the order of their
components, ids that are null come last. Fewer vectors than entries give fewer entries.
No rows give no rows; extra columns are ignored.
"""

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from logloom.llm.common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BLOCK = 1 << 15
#: Squared differences of a part's components must fit in 63 bits with their sum.
LIMIT = 1 << 26
SUMS = "part int, entry int, n bigint, sums array<bigint>"


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """Rows with a vector of finite components, as integers in ``ints``."""
    x = F.col("embedding").cast("array<double>")
    broken = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.withColumn("ints", x).where(x.isNotNull() & ~broken).withColumn(
        "ints", F.transform("ints", lambda v: F.floor(v * F.lit(float(scale)))))


def nearest_entries(parts: np.ndarray, counts: np.ndarray, entries: np.ndarray):
    """(nearest entry, distance) of sorted distinct ``parts``; per entry n and sums.

    One depth after the other; ``node`` holds each part's node of the depth above.
    """
    distances = np.zeros((1, len(entries)), np.int64)
    node = np.zeros(len(parts), np.int64)
    begins = np.arange(len(parts)) == 0
    for depth in range(parts.shape[1]):
        begins[1:] |= parts[1:, depth] != parts[:-1, depth]
        first = np.flatnonzero(begins)
        step = parts[first, depth, None] - entries[None, :, depth]
        distances = distances[node[first]] + step * step
        node = np.cumsum(begins) - 1
    best = distances.argmin(1)
    least = distances[np.arange(len(best)), best]
    n = np.zeros(len(entries), np.int64)
    sums = np.zeros(entries.shape, np.int64)
    np.add.at(n, best, counts)
    np.add.at(sums, best, parts * counts[:, None])
    return best, least, n, sums


def walked(vectors: np.ndarray, books: np.ndarray):
    """Per part position of a block: codes and errors of its rows; n and sums by entry."""
    for part, entries in enumerate(books):
        width = entries.shape[1]
        own = vectors[:, part * width:(part + 1) * width]
        order = np.lexsort(own.T[::-1]) if width else np.arange(len(own))
        ranked = own[order]
        begins = np.ones(len(own), bool)
        begins[1:] = (ranked[1:] != ranked[:-1]).any(1)
        first = np.flatnonzero(begins)
        counts = np.diff(np.append(first, len(own)))
        best, least, n, sums = nearest_entries(ranked[first], counts, entries)
        leaf = np.empty(len(own), np.int64)
        leaf[order] = np.cumsum(begins) - 1
        yield part, best[leaf], least[leaf], n, sums


def blocks(batches, length: int, block: int):
    """(record batch, which rows have ``length`` components, those rows' components)."""
    for batch in batches:
        for start in range(0, len(batch), block):
            rows = batch.slice(start, block)
            fits = rows["ints"].value_lengths().to_numpy(zero_copy_only=False) == length
            values = rows["ints"].filter(pa.array(fits)).flatten().to_numpy()
            if max(-int(values.min(initial=0)), int(values.max(initial=0))) > LIMIT:
                raise ValueError(f"vector components beyond {LIMIT} after scaling")
            yield rows, fits, values.reshape(int(fits.sum()), length)


def refined(rows: DataFrame, books: np.ndarray, block: int) -> np.ndarray:
    """The codebooks after one round."""
    length = books.shape[0] * books.shape[2]

    def run(batches):
        n, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for _, _, vectors in blocks(batches, length, block):
            for part, _, _, more, added in walked(vectors, books):
                n[part] += more
                sums[part] += added
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([
            pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]),
            pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))],
            ["part", "entry", "n", "sums"])

    width = books.shape[2]
    summed = rows.select("ints").mapInArrow(run, SUMS).groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}")
                                 for i in range(width)])
    after = books.copy()
    for row in summed.collect():  # one row per entry
        after[row["part"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return after


def coded(rows: DataFrame, books: np.ndarray, block: int) -> DataFrame:
    """vec_id, label, code, error of ``rows`` (vec_id, label, ints)."""
    length, kept = books.shape[0] * books.shape[2], ["vec_id", "label"]
    digits = np.array([f"{i:02x}".encode() for i in range(256)], "S2")

    def run(batches):
        for batch, fits, vectors in blocks(batches, length, block):
            codes = np.zeros((len(vectors), len(books)), "S2")
            errors = np.zeros(len(vectors), np.int64)
            for part, best, least, _, _ in walked(vectors, books):
                codes[:, part] = digits[best]
                errors += least
            text, error = np.full(len(batch), None, object), np.full(len(batch), None, object)
            text[fits], error[fits] = [row.tobytes().decode() for row in codes], errors
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in kept), pa.array(text, pa.string()),
                 pa.array(error, pa.int64())], [*kept, "code", "error"])

    schema = rows.select(*kept).schema.add("code", "string").add("error", LongType())
    return rows.select(*kept, "ints").mapInArrow(run, schema)


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
           scale: int = SCALE, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) per usable row of ``vectors``, and the codebooks.

    ``vectors`` has vec_id, embedding and label. ``entries`` is at most 256, as a code has
    two hex digits per part. The codebooks are an array (part, entry, component).
    """
    rows = usable(vectors.select("vec_id", "label", "embedding"), scale)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(1).collect()
    length = len(first[0]["ints"]) if first else 0
    if length % parts:
        raise ValueError(f"{length} components make no {parts} equal parts")
    start = rows.where(F.size("ints") == length).orderBy(
        F.col("vec_id").asc_nulls_last(), "ints").limit(entries).collect()
    books = np.array([r["ints"] for r in start], np.int64).reshape(
        len(start), parts, length // parts).swapaxes(0, 1)
    for _ in range(rounds if start else 0):
        books = refined(rows, books, block)
    return coded(rows, books, block), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, in decimal, comma-joined."""
    return sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error: the error summed over its label; nulls are one label."""
    codes = stored(codes, "codes")
    total = F.coalesce(F.sum("error"), F.lit(0)).cast("bigint").alias("label_error")
    by_label = stored(codes.groupBy(F.col("label").alias("_label")).agg(total), "code-labels")
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
