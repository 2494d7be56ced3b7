"""Line dedup against a quadratic program that extends every earlier match."""

import random
from collections import defaultdict

import pytest

from conftest import DATA
from logloom.llm import common, line_runs

SCHEMA = "doc_id bigint, text string, source string, removed_lines string"


def without_repeats(rows, least):
    """rows: (doc_id, text) in order; the text that is left of each."""
    lines, gone, starts = [], set(), defaultdict(list)
    for d, (_, text) in enumerate(rows):
        for i, line in enumerate(text.split("\n")):
            if line.split():
                lines.append((d, i, line))
    for p, (d, _, line) in enumerate(lines):
        for q in starts[line]:
            n = size = 0
            while (p + n < len(lines) and lines[p + n][0] == d and lines[q + n][0] == lines[q][0]
                   and lines[p + n][2] == lines[q + n][2]):
                size += len(lines[p + n][2].split())
                n += 1
            if size >= least:
                gone.update(x[:2] for x in lines[p:p + n])
        starts[line].append(p)
    left = []
    for d, (_, text) in enumerate(rows):
        kept, dropped = [], False
        for i, line in enumerate(text.split("\n")):
            dropped = (d, i) in gone if line.split() else dropped
            if not dropped:
                kept.append(line)
        left.append("\n".join(kept))
    return left


@pytest.mark.parametrize("least", [1, 3, 8])
def test_random_lines(spark, least):
    draw = random.Random(least)
    rows = [(i, "\n".join(draw.choice(["a", "b b", "c c c", "", "  "])
                          for _ in range(draw.randint(0, 12)))) for i in range(50)]
    frame = spark.createDataFrame([(i, t, "s", "x") for i, t in rows], SCHEMA)
    got = {r.doc_id: r.text for r in line_runs.remove_repeats(frame, least).collect()}
    assert [got[i] for i, _ in rows] == without_repeats(rows, least)


def test_sample_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r for r in line_runs.remove_repeats(docs).collect()}
    assert [got[i].text for i, _ in rows] == without_repeats(rows, line_runs.MIN_WORDS)
    assert any(r.removed_lines for r in got.values())


def test_nulls_repeats_and_long_texts(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    long = "\n".join(f"line {i}" for i in range(4000))
    frame = spark.createDataFrame([
        (1, passage, "s", None), (1, passage, "s", None), (2, f"own\n\n{passage}\n\nend", None, "x"),
        (None, passage, "s", "y"), (3, None, "s", "y"), (4, "", "s", "y"), (5, long, "s", "y"),
        (6, long, "s", "y"), (7, "own", "s", "y")], SCHEMA)
    got = sorted(((r.doc_id, r.text, r.removed_lines) for r in
                  line_runs.remove_repeats(frame).collect()), key=str)
    assert got == sorted([
        (1, passage, 0), (1, passage, 0), (2, "own\n\nend", 2), (None, "", 1), (3, None, 0),
        (4, "", 0), (5, long, 0), (6, "", 4000), (7, "own", 0)], key=str)


def test_no_rows(spark):
    got = line_runs.remove_repeats(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["doc_id", "text", "source", "removed_lines"]
    assert got.collect() == []


def test_texts_are_cut_once_for_the_ranges(spark, monkeypatch):
    """op1: what is dealt by ranges, and read twice for them, is lines, not texts."""
    cut = []

    def stored(frame, name):
        cut.append((name, "Generate" in frame._jdf.queryExecution().executedPlan().toString()))
        return common.stored(frame, name)

    monkeypatch.setattr(line_runs, "stored", stored)
    frame = spark.createDataFrame([(i, "a b c\n\nd e f") for i in range(4)],
                                  "doc_id bigint, text string")
    assert line_runs.lines(frame, 2).count() == 8
    assert cut == [("runs-counted", True), ("runs-lines", False)]
