"""The pipeline's stages on the sample documents and on odd rows."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

import corpus_pipeline  # noqa: E402
from conftest import DATA  # noqa: E402
from test_duplicates import near, template_pairs  # noqa: E402
from test_line_runs import without_repeats  # noqa: E402

FOLDER = f"{DATA}/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given, and in the end what the last returned."""
    docs, seen = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        seen.append(docs)
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*seen, docs]


def pairs(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()),
                  key=lambda p: (p[0] is None, p))


def test_columns(stages):
    assert all(frame.columns == COLUMNS for frame in stages[:-1])


def test_quality_keeps_clean_documents(spark, stages):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    kept = {r.doc_id for r in stages[1].collect()}
    marked = [(r.doc_id, r.quality) for r in stages[0].join(labels, "doc_id").collect()]
    good = [i for i, q in marked if q == 1]
    assert sum(i in kept for i in good) >= 0.95 * len(good)


def test_lines(stages):
    given = pairs(stages[1])
    left = without_repeats(given, 50)
    want = [(i, new) for (i, old), new in zip(given, left, strict=True) if new == old or new.split()]
    assert pairs(stages[2]) == want
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_near_duplicates(stages):
    given = pairs(stages[2])
    kept = [i for i, _, _, stays in near(given, 80) if stays]
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(kept)


def test_near_duplicates_among_many_unlike_texts(spark):
    rows = [(i, t, "en", "s", len(t)) for i, t in template_pairs(60, 14)]  # 80.1 % and 74.8 %
    docs = spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, 300, 2))


def test_mix(stages):
    sizes, taken = {}, {}
    for frame, into in ((stages[3], sizes), (stages[4], taken)):
        for r in frame.collect():
            into.setdefault(r.source, []).append(len(r.text.split()))
    total = sum(map(sum, sizes.values()))
    assert sum(map(sum, taken.values())) == pytest.approx(1.5 * total, rel=0.1)
    assert all(sum(taken.get(s, [])) <= 2 * sum(n) for s, n in sizes.items())


def test_pieces(stages):
    given = stages[4].count()
    out = stages[5]
    assert out.count() == given
    assert out.where((F.size("ids") == 0) | (F.size("ids") != F.col("n_tokens"))).count() == 0


def test_odd_rows(spark):
    rows = [(None, "a b c", None, None, None), (1, None, "en", "s", None), (1, None, "en", "s", None),
            (2, "", "en", "s", 0), (3, "x y", "en", None, 3), (3, "x y", "en", None, 3)]
    docs = spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for frame in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, FOLDER)
            assert set(out.columns) >= {"doc_id"}
            assert out.count() <= 2 * frame.count()


def test_unlike_texts_with_one_id(spark):
    """Each has its own decision; rows without an id too."""
    long, other = (" ".join(f"{w}{i}" for i in range(60)) for w in "ab")
    near_long = long + " end"
    rows = [(5, long), (5, other), (3, long), (None, near_long), (None, "own text"), (None, "own text"),
            (8, "single"), (8, "single")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER)
    assert sorted(pairs(got), key=str) == sorted(
        [(3, long), (5, other), (None, "own text"), (8, "single")], key=str)


CLASHING = ["_id", "_h", "_row", "_drop", "removed", "removed_lines", "_time", "_size", "_source",
            "_times", "_words", "row", "hash", "first", "last", "id", "node", "kept", "turn", "own"]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[1:4]])
def test_columns_named_like_internal_ones(spark, stage):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(30).persist()
    more = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in CLASHING])
    plain, got = stage(spark, docs, FOLDER), stage(spark, more, FOLDER)
    assert got.columns == more.columns
    assert pairs(got) == pairs(plain)
    for c in CLASHING:
        assert got.where(F.col(c) != F.concat(F.lit(c), F.col("doc_id"))).isEmpty()
