"""Exact and near duplicates against plain programs."""

import random
from collections import defaultdict
from hashlib import sha256
from itertools import combinations

import numpy as np
import pytest

from conftest import DATA
from pyspark.sql import functions as F
from logloom.llm import exact_dedup, near_dedup

SCHEMA = "doc_id bigint, text string, keep_id string, digest string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(UPPER)].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        taken = False
        for i in ids:
            kept = i == keep and not taken
            taken = taken or kept
            out.append((i, keep, len(ids), kept, sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("key_bytes", [32, 1, 0])
def test_exact_even_where_digests_collide(spark, key_bytes):
    draw = random.Random(1)
    rows = [(draw.choice([None, *range(40)]), draw.choice(["a", "A", "Éa", "éa", "", None, "b c",
                                                           "B c", "x" * 5000, "d"]))
            for _ in range(150)]
    # an id stands for one text where digests collide, as documents are found by id
    rows = list({i: (i, t) for i, t in rows}.values()) * 2
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(5)
    assert rows_of(exact_dedup.deduplicate(frame, salts=3, key_bytes=key_bytes)) == exact(rows)


def test_exact_hot_group(spark):
    rows = [(i, "Same Text") for i in range(3000)] + [(i, f"own {i}") for i in range(3000, 4000)]
    frame = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA).repartition(20)
    assert rows_of(exact_dedup.deduplicate(frame)) == exact(rows)


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.deduplicate(empty).collect() == []
    assert near_dedup.near_duplicates(empty).collect() == []


def shingles(text):
    words = (text or "").translate(UPPER).encode().split()
    width = min(5, len(words))
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if words else set()


def near(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    meets = defaultdict(set)
    for i, found in sets.items():
        for s in found:
            meets[s].add(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in {p for ids in meets.values() for p in combinations(sorted(ids), 2)}:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return sorted(((i, len(sets[i]), root(i), root(i) == i) for i in sets), key=str)


def changed(draw, words, count):
    words = list(words)
    for _ in range(count):
        words[draw.randrange(len(words))] = f"new{draw.random()}"
    return words


@pytest.mark.parametrize(("percent", "rows", "bands"), [(85, 10, 48), (80, 8, 48)])
def test_near_copies(spark, percent, rows, bands):
    draw = random.Random(percent)
    texts = []
    for group in range(40):
        words = [f"W{draw.randrange(500)}" for _ in range(draw.choice([3, 12, 80, 400]))]
        texts += [words] + [changed(draw, words, draw.randint(0, max(1, len(words) // 60)))
                            for _ in range(draw.choice([0, 1, 3, 30]))]
    draw.shuffle(texts)
    data = [(i, " ".join(w)) for i, w in enumerate(texts)] + [(9000, ""), (9001, " \n"), (9002, None)]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in data], SCHEMA)
    assert rows_of(near_dedup.near_duplicates(frame, percent, rows, bands)) == near(data, percent)


def template_pairs(own, shared, count=150):
    """Texts 2 i and 2 i + 1 share ``shared`` of their ``own`` shingles besides 356 of a template."""
    template = [f"W{i}" for i in range(360)]
    return [(2 * i + side, " ".join([*template, *[f"pair{i}-{k}" for k in range(shared)],
                                     *[f"own{i}-{side}-{k}" for k in range(own - shared)]]))
            for i in range(count) for side in (0, 1)]


@pytest.mark.parametrize("order", [{}, {"sampled": 1, "hints": 50}, {"hints": 0}])
def test_pairs_in_large_buckets_of_unlike_texts(spark, order):
    data = template_pairs(45, 13)  # 85.2 % in a pair, 79.8 % between pairs
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in data], SCHEMA)
    got = near_dedup.near_duplicates(frame, **order)
    assert rows_of(got) == sorted(((i, 401, i - i % 2, i % 2 == 0) for i, _ in data), key=str)


def test_lists_of_several_batches_of_a_task(spark):
    """op10: the counts of frequent shingles hold for every Arrow batch, not the first alone."""
    rows = [(n, n % 3, [n, 1000, 2000, 3000 + n]) for n in range(20)]
    found = spark.createDataFrame(
        rows, "node bigint, component bigint, shingles array<bigint>").coalesce(1)
    often = np.array([1000, 2000]), np.array([9, 20])
    shared = spark.sparkContext.broadcast(often)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "3")
    try:
        got = rows_of(near_dedup.prefixes(found, shared, 50))
    finally:
        spark.conf.set(size, before)
    # rare ones first, three of four with 50 percent
    assert got == sorted(((s, n, c, 4, place) for n, c, (a, b, _, d) in rows
                          for place, s in enumerate((a, d, b))), key=str)


def test_sample_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(near_dedup.near_duplicates(docs)) == near(data, 85)


def test_null_and_repeated_ids(spark):
    frame = spark.createDataFrame([(None, "a b c d e f", "", ""), (5, "a b c d e f", "", ""),
                                   (5, "a b c d e f", "", ""), (9, "A b c d e f", "", "")], SCHEMA)
    assert rows_of(near_dedup.near_duplicates(frame)) == sorted([
        (None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (9, 2, 5, False)], key=str)


def test_chain_of_components(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(500, 501), (500, 502), (501, 502)]
    got = near_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {(r.node, r.component) for r in got.collect()} == {
        *((i, 1) for i in range(1, 201)), (500, 500), (501, 500), (502, 500)}


def test_texts_of_members_are_told_apart_by_marks(spark):
    """All wanted rows pass, hardly any other; null nodes do not hurt."""
    rows = spark.range(20_000).selectExpr("id * 7919 - 5000000 AS node", "'t' || id AS text")
    rows = rows.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS node, 'x' AS text"))
    nodes = rows.where("node % 10 = 0").select("node")
    got = near_dedup.likely(rows, nodes)
    assert got.columns == ["node", "text"]
    wanted = {r.node for r in nodes.collect()}
    found = [r.node for r in got.collect()]
    assert wanted <= set(found) and len(found) == len(set(found)) <= len(wanted) + 50


def test_first_of_each_keeps_every_head_once(spark):
    """Repeated rows, copies, and one doc_id with unlike sets, against the plain join."""
    rows = [(1, 3, b"a"), (1, 3, b"a"), (2, 3, b"a"), (2, 4, b"b"), (3, 5, b"c"), (4, 5, b"c"),
            (5, 4, b"b"), (6, 6, b"d"), (6, 7, b"e"), (6, 7, b"e")]
    filled = spark.createDataFrame([(*r, [r[0], r[1]]) for r in rows], near_dedup.SKETCH)
    same = filled.groupBy("digest").agg(F.min("doc_id").alias("node"),
                                        F.count(F.lit(1)).alias("n"))
    got = near_dedup.first_of_each(filled, same.where("n > 1"), same.select("node"))
    nodes = {r.node for r in same.collect()}
    assert sorted((r.node, r.n_shingles, bytes(r.digest)) for r in got.collect()) == sorted(
        {r for r in rows if r[0] in nodes})
