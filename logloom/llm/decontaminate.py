"""Passages that documents share with benchmark items, found by winnowing.

Texts are runs of ASCII letters (lower-cased), digits and characters beyond ASCII; all
else separates words. A window is ``span`` consecutive words of an item; a shorter item
is one window. Of the k-grams in each window the least hash is its fingerprint, so two
windows with the same words have the same one, and every passage of ``span`` words that
a document shares with an item is found. Shorter items keep every n-gram of their length
(their k is that length, of one k-gram the least is itself).

The fingerprints of the items, however many, become a bitmap of 2 ** ``bits`` bits, which
goes to every task: documents drop the windows whose fingerprint is not in it while their
words are at hand. What is left is joined with the items' windows by fingerprint, and
each hit is extended to the words of the whole window, which must be equal. Windows that
overlap or touch are then one span of words that are hit.

Documents with the same words are one text, looked up once. Texts with the same set of
windows share one list of items. Keys of the joins are salted, as one passage may occur
in a third of all documents.

Null and empty texts, and those of separators,
have no words and are not hit; such items have no windows. Items without an id mark words
but name no item; rows that repeat an item_id are one item. Rows that repeat a doc_id
each count. No rows give no rows; without items nothing is hit. Other columns are ignored.
"""

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.llm.common import stored
from logloom.llm.near_dedup import WordHashes, mixed

SPAN, GRAM, BITS, SALTS = 10, 5, 26, 16
PORTION = 1 << 20
#: A-Z become a-z; ASCII other than letters and digits becomes a space.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32
               for b in range(256))
WINDOW = "start: int, words: int, print: bigint, text: binary"
TEXT = f"key binary, n_words bigint, windows array<struct<{WINDOW}>>"
WINDOWS = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()),
                              ("print", pa.int64()), ("text", pa.binary())]))


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(FOLDED).split()


def gram_hashes(coded: np.ndarray, widths) -> dict[int, np.ndarray]:
    """Per width the hashes of all runs of so many words, each from the one before."""
    found, sums = {}, np.zeros(len(coded) + 1, np.uint64)
    for n in range(1, min(max(widths, default=0), len(coded)) + 1):
        sums = mixed(sums[:len(coded) - n + 1] + coded[n - 1:], n)
        if n in widths:
            found[n] = sums
    return found


def prints(coded: np.ndarray, span: int, gram: int, shorter) -> list[tuple[int, np.ndarray]]:
    """(words, fingerprint of the window from each word on) for all kinds of windows."""
    grams = gram_hashes(coded, {gram, *shorter})
    found = [(n, grams[n]) for n in shorter if n in grams]
    if len(coded) >= span:
        least, count = grams[gram], len(coded) - span + 1
        reach, width = 1, span - gram + 1  # the least of ``reach`` neighbours, by doubling
        while reach < width:
            more = min(reach, width - reach)
            least = np.minimum(least[:-more], least[more:])
            reach += more
        found.append((span, least[:count]))
    return [(n, x.view(np.int64)) for n, x in found]


def _rows(batch, name, hashes, chosen):
    """The column ``name`` of a batch with TEXT, in portions of at least PORTION words.

    ``chosen`` gives (window words, starts, fingerprints) for the hashes of a text's words.
    """
    first, count, keys, sizes, windows = 0, 0, [], [], []
    for last, text in enumerate(batch["text"], 1):
        words = split(text.as_py())
        count += len(words)
        keys.append(blake2b(b" ".join(words), digest_size=16).digest())
        sizes.append(len(words))
        windows.append([
            {"start": s, "words": n, "print": p, "text": b" ".join(words[s:s + n])}
            for n, starts, found in chosen(hashes(words))
            for s, p in zip(starts.tolist(), found.tolist(), strict=True)])
        if count >= PORTION or last == len(batch):
            yield pa.RecordBatch.from_arrays([
                batch[name].slice(first, last - first), pa.array(keys, pa.binary()),
                pa.array(sizes, pa.int64()), pa.array(windows, WINDOWS)],
                [name, "key", "n_words", "windows"])
            first, count, keys, sizes, windows = last, 0, [], [], []


def item_windows(items: DataFrame, span: int, gram: int) -> DataFrame:
    """item_id, words, print, text: every window of every item."""
    def chosen(coded):
        kinds = prints(coded, span, gram, [len(coded)] if 0 < len(coded) < span else [])
        return [(n, np.arange(len(found)), found) for n, found in kinds]

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            yield from _rows(batch, "item_id", hashes, chosen)

    return (items.select(F.col("item_id").cast("string"), "text")
            .mapInArrow(run, f"item_id string, {TEXT}")
            .select("item_id", F.inline("windows")).drop("start").distinct())


def bitmap(windows: DataFrame, bits: int) -> bytes:
    """2 ** ``bits`` bits, with those of the windows' fingerprints set.

    The set bits come as bitmaps of 4 KB, so at most 2 ** bits / 8 bytes.
    """
    place = F.expr(f"shiftrightunsigned(print, {64 - bits}) + 1")
    parts = windows.select(place.alias("place")).groupBy(
        F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("set"))
    out = bytearray(max(1 << bits >> 3, 4096))
    for row in parts.collect():
        at = (row["bucket"] - 1) * 4096
        out[at:at + 4096] = row["set"]
    return bytes(out)


def suspects(docs: DataFrame, shared, shorter: list[int], span: int, gram: int,
             bits: int) -> DataFrame:
    """doc_id and TEXT; of the windows those whose fingerprint is in the bitmap."""
    def run(batches):
        known, shift = np.frombuffer(shared.value, np.uint8), np.uint64(64 - bits)

        def chosen(coded):
            found = []
            for n, values in prints(coded, span, gram, shorter):
                place = (values.view(np.uint64) >> shift).astype(np.int64)
                at = np.flatnonzero(known[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                if len(at):
                    found.append((n, at, values[at]))
            return found

        hashes = WordHashes()
        for batch in batches:
            yield from _rows(batch, "doc_id", hashes, chosen)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, f"doc_id bigint, {TEXT}")


def hits(found: DataFrame, windows: DataFrame, salts: int) -> DataFrame:
    """key, start, words, class: the texts' windows that are windows of items."""
    theirs = windows.select("print", "words", "text", "class").distinct().withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    ours = found.select("key", F.inline("windows")).distinct().withColumn(
        "salt", F.pmod(F.hash("key", "start"), F.lit(salts)))
    return ours.join(theirs, ["print", "words", "text", "salt"]).select(
        "key", "start", "words", "class")


def spans(hit: DataFrame) -> DataFrame:
    """key, spans (array of first, last), n_hit: the words that some window covers."""
    order = W.partitionBy("key").orderBy("start", "words")
    before = F.max(F.col("start") + F.col("words")).over(
        order.rowsBetween(W.unboundedPreceding, -1))
    apart = F.coalesce(F.col("start") > F.col("before"), F.lit(True)).cast("int")
    return (
        hit.select("key", "start", "words").withColumn("before", before)
        .withColumn("island", F.sum(apart).over(order.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("key", "island").agg(
            F.min("start").alias("first"),
            (F.max(F.col("start") + F.col("words")) - 1).alias("last"))
        .groupBy("key").agg(
            F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"),
            F.sum(F.col("last") - F.col("first") + 1).alias("n_hit")))


def owners(hit: DataFrame, windows: DataFrame) -> DataFrame:
    """key, items: the sorted ids, as strings, of the items with a window in the text."""
    sets = stored(hit.groupBy("key").agg(
        F.array_sort(F.collect_set("class")).alias("classes")).withColumn(
        "set", F.sha2(F.array_join(F.transform("classes", F.hex), ",").cast("binary"), 256)),
        "leak-sets")
    items = windows.where("item_id IS NOT NULL").select("class", "item_id").distinct()
    listed = (sets.groupBy("set").agg(F.first("classes").alias("classes"))
              .select("set", F.explode("classes").alias("class")).join(items, "class")
              .groupBy("set").agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    return sets.select("key", "set").join(listed, "set").select("key", "items")


def contaminated(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM,
                 bits: int = BITS, salts: int = SALTS) -> DataFrame:
    """doc_id, n_words, n_hit, spans, items for every row of ``docs`` (doc_id, text).

    ``items`` has item_id and text. ``spans`` are (first, last) word numbers from 0,
    ``items`` sorted ids as strings; both are empty where nothing is hit.
    """
    windows = stored(item_windows(items, span, gram).withColumn(
        "class", F.unhex(F.md5("text"))), "leak-items")
    shorter = sorted(r["words"] for r in windows.select("words").distinct().collect()
                     if r["words"] < span)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(windows, bits))
    found = stored(suspects(docs, shared, shorter, span, gram, bits), "leak-texts")
    hit = stored(hits(found.where(F.size("windows") > 0), windows, salts), "leak-hits")
    by_text = stored(spans(hit).join(owners(hit, windows), "key", "left"), "leak-found")
    return found.select("doc_id", "key", "n_words").join(by_text, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("spans", F.array().cast(by_text.schema["spans"].dataType)).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))
