"""Mixing, quality scores, nearest neighbours, tool calls and the registered SQL."""

import json
import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from logloom.llm import mixing, nearest, quality, tool_calls
from logloom.llm.oracle import ORACLE
from logloom.llm.queries import CURRICULUM, QUERIES, TOOLS, schedule

FOLDER = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ["documents", "labels", "embeddings", "conversations", "benchmark"]:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == sorted(map(str, want))


MIX = "doc_id bigint, text string, source string, size string, position string"


def mix_rows(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], MIX)


def test_targets_are_met(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 50)), None if i % 7 == 0 else f"s{i % 5}")
            for i in range(600)] + [(1000 + i, "big " * 40, "hot") for i in range(400)]
    rows += [(5000, None, "s1"), (5001, "", "empty"), (None, "a b", "s2")]
    got = mixing.plan(mix_rows(spark, rows), schedule, 1.5, 2.0, block_rows=20).collect()
    assert len(got) == len(rows)
    totals, targets, sizes = {}, {}, {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        totals[r.source] = totals.get(r.source, 0) + r.taken
        targets[r.source], sizes[r.source] = r.target, r.source_size
        assert (r.position is None) == (r.taken == 0)
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for source, target in targets.items():
        assert target <= 2 * sizes[source]
        assert target - 1 < totals[source] <= target


def test_position_inverts_the_demand():
    for knots in [*CURRICULUM, [(0, 1), (0.25, 3), (1, 0.5)]]:
        def area(t, knots=knots):
            steps = np.linspace(0, t, 20001)
            return np.trapezoid(np.interp(steps, *zip(*knots, strict=True)), steps)

        assert area(1) > 0
        pieces, before = [], 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            pieces.append((t0, w0, (w1 - w0) / (t1 - t0), before))
            before += (w0 + w1) * (t1 - t0) / 2
        for demand in np.linspace(0, before * 0.999, 9):
            t0, w0, slope, start = max(p for p in pieces if p[3] <= demand)
            rest = demand - start
            t = t0 + 2 * rest / (w0 + math.sqrt(w0 * w0 + 2 * slope * rest))
            assert area(t) == pytest.approx(demand, abs=1e-4)


def test_training_order(spark):
    knots = [(0.0, 1.0), (0.25, 3.0), (1.0, 0.5)]
    rows = [(i, "one two three four", "ab"[i % 2]) for i in range(200)]

    def early_and_late(sources):
        return mixing.cycled(
            sources, [knots, [(0, 0.5), (0.75, 3), (1, 1)]])

    docs = mix_rows(spark, rows)
    mixed = [r.source for r in mixing.mixed(docs, early_and_late, 1.5, 2.0).collect()]
    assert abs(len(mixed) - 300) <= 4
    assert mixed[:100].count("a") > mixed[-100:].count("a") + 20
    again = mixing.plan(docs.repartition(7), early_and_late, 1.5, 2.0)
    assert sorted(map(tuple, again.collect())) == sorted(
        map(tuple, mixing.plan(docs, early_and_late, 1.5, 2.0).collect()))


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], MIX)
    assert mixing.plan(empty, schedule, 1.5, 2.0).collect() == []
    assert mixing.mixed(empty, schedule, 1.5, 2.0).collect() == []


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    model = quality.fit(docs, labels)
    held = (docs.join(labels, "doc_id").where(quality.part(F.col("doc_id")) == quality.HELD_OUT)
            .select("quality", quality.score(F.col("text"), model).alias("score")).collect())
    y, p = np.array([r.quality for r in held]), np.array([r.score for r in held])
    assert ((p >= 0.5) == y).mean() > 0.93
    assert (p[y == 1] >= 0.5).mean() > 0.95
    blind = labels.withColumn("quality", F.when(
        quality.part(F.col("doc_id")) == quality.HELD_OUT, 1 - F.col("quality")).otherwise(
            F.col("quality")))
    assert quality.fit(docs, blind) == model


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x " * 200_000, "c"),
                                  (None, "y", "d"), (2, "", "b")],
                                 "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(1, 1), (9, None), (2, 5), (None, 0)],
                                   "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    scores = [r[0] for r in docs.select(quality.score(F.col("text"), model)).collect()]
    assert len(scores) == 5
    assert all(0 <= s <= 1 for s in scores)
    assert quality.fit(docs, labels.where("false")).prior == 0.5
    assert docs.where("false").select(quality.score(F.col("text"), model)).collect() == []


def test_part_is_the_crc_of_the_text(spark):
    got = spark.range(50).select("id", quality.part(F.col("id")).alias("p")).collect()
    assert all(r.p == zlib.crc32(str(r.id).encode()) % 3 for r in got)


VECTORS = "vec_id bigint, embedding array<float>, score string, bucket string"


def brute(rows, is_query, k):
    rows = {i: np.array(v, float) for i, v in rows}
    out = []
    for q, v in rows.items():
        if is_query(q):
            near = sorted((-float(v @ w), i) for i, w in rows.items() if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(near, 1)]
    return sorted(out)


def test_recall(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in rows.collect()], lambda i: i % 20 == 0, 20)
    got = nearest.nearest(rows, F.col("vec_id") % 20 == 0).collect()
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(got) == len(want)
    assert sum((q, i) in found for q, _, i, _ in want) >= 0.95 * len(want)


def test_recall_with_the_functions_of_a_large_table(spark):
    draw = np.random.default_rng(5)  # 8 functions is what 3 million entries get
    rows = [(i, v.tolist()) for i, v in enumerate(draw.standard_normal((4000, 32)).astype("f4"))]
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS)
    want = brute(rows, lambda i: i % 40 == 0, 10)
    got = nearest.nearest(frame, F.col("vec_id") % 40 == 0, k=10, functions=8).collect()
    found = {(r.query_id, r.vec_id) for r in got}
    assert sum((q, i) in found for q, _, i, _ in want) >= 0.95 * len(want)


def test_hot_vectors_and_faults(spark):
    draw = np.random.default_rng(2)
    rows = [(i, [1.0, 0.0, 0.5, 0.25]) for i in range(300)]
    rows += [(i, draw.standard_normal(4).astype("f4").tolist()) for i in range(300, 420)]
    bad = [(900, None), (901, []), (902, [0.0] * 4), (903, [1.0, None, 1.0, 1.0]),
           (904, [float("nan")] * 4), (905, [float("inf")] * 4), (906, [1.0, 2.0]), (None, [1.0] * 4)]
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows + bad + rows[:2]], VECTORS)
    got = nearest.nearest(frame, F.col("vec_id") % 10 == 0, k=5, probe_count=100, functions=2,
                          chunk=16)
    want = brute(rows, lambda i: i % 10 == 0, 5)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect()) == [w[:3] for w in want]


def test_few_or_no_candidates(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0], "", ""), (7, [0.0, 2.0], "", "")], VECTORS)
    assert [tuple(r) for r in nearest.nearest(frame, F.col("vec_id") == 0).collect()] == [
        (0, 1, 7, 0.0)]
    assert nearest.nearest(frame.where("false"), F.col("vec_id") == 0).collect() == []


def test_perturbations_are_in_order_and_valid():
    found = nearest.perturbations(4, 60)
    assert found[0] == ()
    assert len(set(found)) == len(found)
    assert all(7 - j not in ranks for ranks in found for j in ranks)


MESSAGES = ("conv_id bigint, turn bigint, role string, text string, "
            f"calls array<struct<id:string,name:string,arguments:string>>, result_for string, "
            "place string")


def test_tool_calls(spark):
    rows = [
        (1, 0, "user", "hi", None, None, "x"),
        (1, 1, "assistant", None, [
            ("c", "read", '{"source": "$b", "max_chars": 3}'),
            ("b", "read", '{"max_chars": "x", "source": "$a", "zeta": 1}'),
            ("a", "search", '{"query":"q", "limit" : 2.5}'),
            ("d", "rate", '[1]'), ("e", "erase", '{}'), (None, "rate", '{"score": 1}'),
            ("f", "read", '{"source":"$g","max_chars":1}'),
            ("g", "read", '{"source":"$f","max_chars":1}')], None, "x"),
        (1, 2, "tool", "A", None, "a", "x"), (1, 3, "tool", "A2", None, "a", "x"),
        (1, 0, "tool", "early", None, "b", "x"), (1, 4, "tool", "lost", None, "zz", "x"),
        (1, 5, "assistant", "", [("a", "rate", '{"score":1e1}'),
                                 ("h", "read", '{"source":"$none","max_chars":1}')], None, "x"),
        (None, 1, "assistant", "t", [("n", "rate", "not json")], None, "x"),
        (None, 2, "tool", None, None, "n", "x")]
    got = tool_calls.events(spark.createDataFrame(rows, MESSAGES), TOOLS).orderBy(
        "conv_id", "turn", "step", "at", "part").collect()
    one = [r for r in got if r.conv_id == 1]
    problems = {(r.turn, r.call_id): list(r.problems) for r in one if r.kind == "call"}
    assert problems == {
        (1, "c"): ["no result"], (1, "b"): ["extra zeta", "type max_chars"],
        (1, "a"): ["type limit"], (1, "d"): ["no result", "no object"],
        (1, "e"): ["no result", "unknown tool"], (1, None): ["no id", "no result"],
        (1, "f"): ["no result", "cycle"], (1, "g"): ["no result", "cycle"],
        (5, "a"): ["repeated id", "no result"], (5, "h"): ["no result", "reference none"]}
    order = [(r.kind, r.call_id) for r in one if r.turn == 1]
    calls = [c for k, c in order if k == "call"]
    assert calls.index("a") < calls.index("b") < calls.index("c")
    assert order.index(("result", "b")) == order.index(("call", "b")) + 1
    results = [(r.turn, r.call_id, list(r.problems)) for r in one if r.kind == "result"]
    assert results == [(1, "b", []), (2, "a", []), (3, "a", ["repeated result"]),
                       (4, "zz", ["no call"])]
    for r in got:
        parsed = json.loads(r.json)
        assert json.dumps(parsed, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json
        assert parsed["kind"] == r.kind
    null = [(r.kind, list(r.problems)) for r in got if r.conv_id is None]
    assert null == [("message", []), ("call", ["no object"]), ("result", [])]
    assert tool_calls.events(spark.createDataFrame([], MESSAGES), TOOLS).collect() == []
