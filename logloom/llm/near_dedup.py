"""Near duplicates by one-permutation MinHash with optimal densification.

A document's set is its distinct shingles of ``words`` words (ASCII white space
between, A-Z lower-cased); with fewer words the whole sequence is one shingle. One
hash of each shingle picks a bin and a value, the bin keeps its least value; an empty
bin borrows from a non-empty bin chosen by a hash that all documents share. ``rows``
bins make a band; documents with the same band meet in a bucket.

Documents with the same set are one from the start. In a bucket a star of candidate
pairs is made: the member that shares most buckets with others, as the origin of a
group of copies does, with each other member. Its pairs are confirmed on the full sets,
and confirmed links are joined to components.

Links between members that are not the star's are found exactly, by prefixes: with the
shingles of all sets in one order, two sets of n shingles that share ceil(t n) have one
in common among the first n - ceil(t n) + 1 of each. Members of buckets that still hold
several components list those few shingles; members of different components that meet in
a list are confirmed on the full sets. The order puts rare shingles first, so that texts
which only share a template do not meet. It may be any order, so frequent shingles are
counted on a sample of the members and told to the tasks up to a bound.

Result per document row: doc_id, n_shingles, component_id (smallest doc_id that can
be reached), kept. Null or empty texts and texts of white space have no shingles and
are linked with nothing; for a null doc_id all of this holds but it is never a
component's name unless alone, and it is kept alone. Rows that repeat a doc_id have
one component and are all kept or not. No rows give no rows; other columns are
ignored.
"""

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import stored

WORDS = 5
ROWS, BANDS = 10, 48
#: The order of shingles: one of SAMPLED members is counted; the HINTS most frequent come last.
SAMPLED, HINTS = 8, 1 << 20
#: Bits that tell the tasks which texts they need (4 MB).
MARKS = 1 << 25
PORTION = 1 << 22
SKETCH = "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>"
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ np.uint64(salt)) * ODD
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


class WordHashes:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 1 << 20):
        self.known: dict[bytes, bytes] = {}
        self.most, self.held = most, 0

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.frombuffer(b"".join([known[w] for w in words]), np.uint64)
        except KeyError:
            new = {w for w in words if w not in known}
            self.held += sum(map(len, new))
            if len(known) + len(new) > self.most or self.held > 16 * self.most:
                known.clear()
                new, self.held = set(words), sum(map(len, set(words)))
            for w in new:
                known[w] = blake2b(w, digest_size=8).digest()
            return np.frombuffer(b"".join([known[w] for w in words]), np.uint64)


def shingles(text: str | None, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    coded = hashes((text or "").encode("utf-8", "replace").lower().split())
    if not len(coded):
        return coded
    width = min(words, len(coded))
    sums = np.full(len(coded) - width + 1, width, np.uint64)
    for i in range(width):
        sums = mixed(sums + coded[i:len(coded) - width + 1 + i], i + 1)
    return np.unique(sums)


def densify_order(bins: int, tries: int = 64) -> np.ndarray:
    """For each bin the bins it asks in turn; the same for every document."""
    own = np.arange(bins, dtype=np.uint64)[:, None]
    turn = np.arange(1, tries + 1, dtype=np.uint64)[None, :]
    return (mixed(own * np.uint64(1 << 20) + turn, 77) % np.uint64(bins)).astype(np.int64)


def signature(hashed: np.ndarray, bins: int, order: np.ndarray) -> np.ndarray:
    """Least value per bin; empty bins borrow the first non-empty in their order."""
    drawn = mixed(hashed, 0x5BD1E995)
    where = (drawn % np.uint64(bins)).astype(np.int64)
    least = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, where, drawn)
    filled = np.zeros(bins, bool)
    filled[where] = True
    empty = np.flatnonzero(~filled)
    if len(empty):
        open_bins = filled[order[empty]]
        source = order[empty, open_bins.argmax(1)]
        lost = ~open_bins.any(1)  # all tries met empty bins: the next filled one
        if lost.any():
            full = np.flatnonzero(filled)
            source[lost] = full[np.searchsorted(full, empty[lost]) % len(full)]
        least[empty] = least[source]
    return least


def band_keys(least: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit key per band, different between bands."""
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for column in least[:rows * bands].reshape(bands, rows).T:
        keys = mixed(keys * ODD + column, 3)
    return keys.view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(
        pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()),
        pa.array(np.concatenate([*parts, np.empty(0, np.int64)]), pa.int64()))


def sketches(docs: DataFrame, rows: int, bands: int, words: int) -> DataFrame:
    """Per row of ``docs``: set size, digest of the set, band keys."""
    def run(batches):
        hashes, order = WordHashes(), densify_order(rows * bands)
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in batch["text"]:
                found = shingles(text.as_py(), hashes, words)
                sizes.append(len(found))
                digests.append(blake2b(found.tobytes(), digest_size=16).digest())
                keys.append(band_keys(signature(found, rows * bands, order), rows, bands)
                            if len(found) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                _lists(keys)], ["doc_id", "n_shingles", "digest", "bands"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SKETCH)


def sets(docs: DataFrame, words: int) -> DataFrame:
    """Rows with ``shingles`` for their text, in portions of at least PORTION shingles."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            first, found, held = 0, [], 0
            for last, text in enumerate(batch["text"], 1):
                found.append(shingles(text.as_py(), hashes, words).view(np.int64))
                held += len(found[-1])
                if held >= PORTION or last == len(batch):
                    yield pa.RecordBatch.from_arrays(
                        [*(batch[c].slice(first, last - first) for c in kept), _lists(found)],
                        [*kept, "shingles"])
                    first, found, held = last, [], 0

    schema = ", ".join(f"{c} bigint" for c in kept)
    return docs.select(*kept, "text").mapInArrow(run, f"{schema}, shingles array<bigint>")


def stars(members: DataFrame) -> DataFrame:
    """Pairs (node, centre) of bucket members (band, node, shared)."""
    # ties are broken by a hash, the same in all buckets
    rank = F.col("shared") * (1 << 20) + F.pmod(F.xxhash64("node"), F.lit(1 << 20))
    centres = members.groupBy("band").agg(F.max_by("node", rank).alias("centre"))
    return (members.join(centres, "band").where("node <> centre")
            .select("node", "centre").distinct())


def frequent(found: DataFrame, sampled: int, hints: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that recur among sampled sets, at most ``hints``, and their counts."""
    rows = (
        found.where(F.pmod(F.xxhash64("node"), F.lit(sampled)) == 0)
        .select(F.explode("shingles").alias("shingle"))
        .groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .orderBy(F.desc("n"), "shingle").limit(hints).toArrow())
    shingle, n = (rows[c].to_numpy().astype(np.int64) for c in ("shingle", "n"))
    order = np.argsort(shingle)
    return shingle[order], n[order]


def prefixes(found: DataFrame, shared, percent: int) -> DataFrame:
    """shingle, node, component, n, place: each set's first shingles, rare ones before others."""
    def run(batches):
        known, counts = shared.value
        for batch in batches:
            out, lengths = [], []
            for one in batch["shingles"]:
                own = one.values.to_numpy()
                n = len(own)
                first = n - -(-percent * n // 100) + 1
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    often = np.where(known[at] == own, counts[at], 0)
                    own = own[np.argsort(often, kind="stable")]
                out.append(own[:first])
                lengths.append(n)
            taken = list(map(len, out))
            each = np.repeat(np.arange(len(batch)), taken)
            places = [np.arange(c) for c in taken]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([*out, np.empty(0, np.int64)])),
                batch["node"].take(pa.array(each)), batch["component"].take(pa.array(each)),
                pa.array(np.array(lengths, np.int64)[each]),
                pa.array(np.concatenate([*places, np.empty(0, np.int64)]))],
                ["shingle", "node", "component", "n", "place"])

    return found.mapInArrow(
        run, "shingle bigint, node bigint, component bigint, n bigint, place bigint")


def meetings(index: DataFrame, percent: int) -> DataFrame:
    """a, b (a < b) of different components that meet in ``index`` and can be similar.

    The first shingle that two sets have in common, in the order, leaves both enough
    shingles from it on: sets of n and m need (n + m) * percent / (100 + percent) in common.
    In each list the members outside the largest component meet all others, so a list
    of one component costs nothing and its largest one never meets itself.
    """
    inside = index.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("c"))
    mixed = inside.groupBy("shingle").agg(
        F.max(F.struct("c", "component")).alias("top"), F.count(F.lit(1)).alias("kinds")
    ).where("kinds > 1").select("shingle", F.col("top.component").alias("main"))
    rows = stored(index.join(mixed, "shingle"), "near-lists")
    left = rows.where("component <> main").select(
        "shingle", *[F.col(c).alias(f"{c}_l") for c in ("node", "component", "n", "place")])
    rest = F.least(F.col("n") - F.col("place"), F.col("n_l") - F.col("place_l"))
    return (
        left.join(rows, "shingle")
        .where("component <> component_l AND (component = main OR node > node_l)")
        .where(rest * (100 + percent) >= (F.col("n") + F.col("n_l")) * percent)
        .select(F.least("node", "node_l").alias("a"), F.greatest("node", "node_l").alias("b"))
        .distinct())


def remaining(placed: DataFrame, texts: DataFrame, percent: int, words: int, sampled: int,
              hints: int) -> DataFrame:
    """Links a, b between components, among the members of buckets with several.

    ``placed`` has band, node, component. All such links are found that have
    100 * common >= percent * union, also those between buckets.
    """
    opened = placed.groupBy("band").agg(
        F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    members = stored(placed.join(opened.select("band"), "band", "left_semi")
                     .select("node", "component").distinct(), "near-open")
    found = stored(sets(texts.join(members, "node"), words), "near-sets")
    shared = placed.sparkSession.sparkContext.broadcast(frequent(found, sampled, hints))
    index = stored(prefixes(found, shared, percent), "near-prefixes")
    pairs = stored(meetings(index, percent), "near-meetings")
    return similar(pairs, found.select("node", "shingles").join(ends(pairs), "node", "left_semi"),
                   percent)


def ends(pairs: DataFrame) -> DataFrame:
    """The nodes of ``pairs``."""
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def similar(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """a, b of ``pairs`` whose sets, in ``found``, have 100 * common >= percent * union."""
    common = F.size(F.array_intersect("left", "right")).cast("bigint")
    union = F.size("left") + F.size("right") - common
    return (pairs.join(found.select(F.col("node").alias("b"), F.col("shingles").alias("right")),
                       "b")
            .join(found.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
            .where(100 * common >= percent * union).select("a", "b"))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """``similar`` pairs by their texts."""
    return similar(pairs, sets(texts.join(ends(pairs), "node", "left_semi"), words), percent)


def likely(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """All ``rows`` whose node is in ``nodes``, and a few others.

    A bitmap of hashes, MARKS bits whatever the number of nodes, goes to every task, so
    that an exact join afterwards does not move the texts of all rows.
    """
    bit = F.pmod(F.xxhash64("node"), F.lit(MARKS)).cast("int")
    own, place = F.shiftright(bit, 15), bit.bitwiseAND(0x7FFF)
    marks = nodes.groupBy(own.alias("_part")).agg(
        F.bitmap_construct_agg(place.cast("bigint")).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10)
    marked = F.pmod(F.floor(byte.cast("int") / F.pow(F.lit(2), place.bitwiseAND(7))), F.lit(2)) == 1
    return rows.join(F.broadcast(marks), own == F.col("_part")).where(marked).select(*rows.columns)


def linked(sketched: DataFrame, texts: DataFrame, percent: int, words: int, sampled: int,
           hints: int) -> DataFrame:
    """node, component of the nodes that are linked with others in some bucket.

    Stars and prefixes read the texts of bucket members only, which are stored once.
    """
    members = sketched.select("node", F.explode("bands").alias("band"))
    members = stored(members.join(
        members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "band"),
        "near-buckets")
    nodes = members.groupBy("node").agg(F.sum("n").alias("shared"))
    members = stored(members.drop("n").join(nodes, "node"), "near-members")
    # an inner join: a semi-join would be pushed below the marks
    texts = stored(likely(texts, nodes).join(nodes.select("node"), "node"), "near-texts")
    size = sketched.select("node", "n_shingles")
    pairs = stars(members).select(F.least("node", "centre").alias("a"),
                                  F.greatest("node", "centre").alias("b")).distinct()
    # sets whose sizes differ too much cannot be similar enough
    pairs = stored(
        pairs.join(size.toDF("a", "size_a"), "a").join(size.toDF("b", "size_b"), "b")
        .where(F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent)
        .select("a", "b"), "near-pairs")
    joined = stored(components(confirmed(pairs, texts, percent, words)), "near-joined")
    placed = members.select("node", "band").join(joined, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    links = stored(remaining(placed, texts, percent, words, sampled, hints), "near-links")
    return joined if links.isEmpty() else stored(merged(joined, links), "near-linked")


def merged(joined: DataFrame, links: DataFrame) -> DataFrame:
    """node, component after further links (a, b); only components they touch are walked."""
    for side in ("a", "b"):
        links = links.join(joined.toDF(side, "_home"), side, "left") \
            .withColumn(side, F.coalesce("_home", side)).drop("_home")
    moved = components(links.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return (
        joined.join(moved.toDF("component", "_to"), "component", "left")
        .select("node", F.coalesce("_to", "component").alias("component"))
        .unionByName(moved.join(joined, "node", "left_anti")))


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node reached) for every node of ``edges`` (a, b).

    Rounds of two steps until nothing changes: each node links its larger
    neighbours to its least neighbour, then each node its smaller ones. Edges only
    lose length, so a chain of n links takes about log n rounds.
    """
    def large(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        return (both.where("b > a").join(least, "a")
                .select(F.col("least").alias("a"), "b").where("a < b"))

    def small(edges):
        least = edges.groupBy("b").agg(F.min("a").alias("least"))
        joined = edges.join(least, "b")
        return (joined.where("a <> least").select(F.col("least").alias("a"), F.col("a").alias("b"))
                .unionByName(least.select(F.col("least").alias("a"), "b")).where("a < b"))

    def state(edges):
        return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))) \
            .first()

    edges = stored(edges.select("a", "b").distinct(), "near-edges")
    before, turn = None, 0
    while (now := state(edges)) != before:
        before, turn = now, turn + 1
        edges = stored(small(large(edges).distinct()).distinct(), f"near-edges{turn}")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def first_of_each(filled: DataFrame, repeated: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n_shingles, digest, bands: the rows of ``filled`` whose doc_id is a node, once.

    Most rows are. The doc_ids that are no nodes, and those that come again, are few;
    finding them moves ids and digests only, not the bands of all rows.
    """
    others = stored(
        filled.select("doc_id", "digest").join(repeated.select("digest", "node"), "digest")
        .where("doc_id <> node").select("doc_id").distinct()
        .join(nodes, F.expr("doc_id = node"), "left_anti"), "near-others")
    again = stored(filled.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                   .select("doc_id"), "near-again")
    heads = filled.join(others, "doc_id", "left_anti").select(
        "doc_id", "n_shingles", "digest", "bands")
    return (
        heads.join(again, "doc_id", "left_anti")
        .unionByName(heads.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "digest"]))
        .withColumnRenamed("doc_id", "node"))


def near_duplicates(docs: DataFrame, percent: int = 85, rows: int = ROWS, bands: int = BANDS,
                    words: int = WORDS, sampled: int = SAMPLED,
                    hints: int = HINTS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Nodes are the smallest doc_ids of the documents with one set. Sketches are stored
    once; texts are read again once, for documents that share a bucket.
    """
    sketched = stored(sketches(docs, rows, bands, words), "near-sketches")
    filled = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # stored, so that the join below has an exchange of its own that can be split
    same = stored(filled.groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")), "near-same")
    heads = stored(first_of_each(filled, same.where("n > 1"), same.select("node")), "near-heads")
    same = same.drop("n")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("node"), "text")
    found = linked(heads, texts, percent, words, sampled, hints)
    placed = (
        sketched.select("doc_id", "n_shingles", "digest")
        .join(same.withColumnRenamed("node", "_node"), "digest", "left")
        .join(found.select(F.col("node").alias("_node"), "component"), "_node", "left"))
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "_node"))
    return placed.select("doc_id", "n_shingles", F.coalesce(component, F.col("doc_id"))
                         .alias("component_id")) \
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
