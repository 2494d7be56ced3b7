"""What a Python worker holds at once: one short Arrow batch and a small store."""

import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F

from logloom.llm import common, nearest, sentencepiece, vocabulary
from logloom.session import configure


def test_long_texts_come_in_short_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array(
                [batch.num_rows])], ["held", "n"])

    texts = configure(spark).range(0, 5000, 1, 1).selectExpr("repeat('x', 4000) AS text")
    got = texts.mapInArrow(sizes, "held bigint, n bigint").collect()
    assert sum(r.n for r in got) == 5000
    assert max(r.held for r in got) < 6 << 20


def test_words_stay_few_in_a_worker():
    coder = vocabulary.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in letters]
    words += ["q" + w for w in words]
    most, first = 0, [coder.encode(w) for w in words[:50]]
    for at in range(0, 700_000, 5_000):
        coder.encode(" ".join(words[at:at + 5_000]))
        most = max(most, len(coder.known))
    assert most <= 340_000
    assert [coder.encode(w) for w in words[:50]] == first


def test_words_that_recur_are_coded_once(monkeypatch):
    """op6: they stay known when the store is full."""
    coder = vocabulary.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(vocabulary, "CACHE_WORDS", 400)
    asked, real = [], coder.tokenizer

    class Model:
        def tokenize(self, text):
            asked.append(text)
            return real.model.tokenize(text)

    class Tokenizer:
        model, encode_batch_fast = Model(), real.encode_batch_fast

    coder.tokenizer = Tokenizer()
    letters = "abcdefghij"
    words = [a + b + c + "x" for a in letters for b in letters for c in letters]
    for at in range(0, 1000, 50):
        coder.encode(" ".join(["recurring", *words[at:at + 50]]))
        assert len(coder.known) + len(coder.before) <= 400
    assert asked.count("recurring") == 1 and len(asked) == 1001


def test_pieces_stay_few_in_a_worker():
    coder = sentencepiece.Encoder(sentencepiece.Vocabulary.of({
        p: -1.0 for p in ["▁", *"0123456789"]}))
    first = coder.encode("0 1 22 333")
    for at in range(0, 400_000, 10_000):
        coder.encode(" ".join(map(str, range(at, at + 10_000))))
        assert len(coder.known) <= 1 << 17
    assert (coder.encode("0 1 22 333") == first).all()


def test_probes_of_a_task_stay_few(spark, tmp_path, monkeypatch):
    """op7: no table of probes, no vectors per table: a batch of queries with 8 x 300 probes each."""
    draw = np.random.default_rng(4)
    vectors = draw.standard_normal((3000, 32)).astype("f4")
    rows = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")
    rows.write.parquet(str(tmp_path / "rows"))
    written = []
    real = common.shared_dir
    for module in [common, nearest]:
        monkeypatch.setattr(module, "shared_dir", lambda *a: written.append(real(*a)) or written[-1],
                            raising=False)
    got = nearest.nearest(spark.read.parquet(str(tmp_path / "rows")), F.col("vec_id") % 2 == 0,
                          k=5, functions=8, probe_count=300)
    assert got.count() == 1500 * 5
    stored = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    held = sum(stored(w).getFileSystem(conf).getContentSummary(stored(w)).getLength() for w in written)
    assert held < 6 * vectors.nbytes


def test_nearest_in_slices_and_bounded_blocks(monkeypatch):
    """op7: many probes of many queries at once, entries over several slices: exact, in little memory."""
    draw = np.random.default_rng(6)
    vectors = draw.standard_normal((4000, 24)).astype("f4")
    top = float(np.sqrt((vectors.astype(float) ** 2).sum(1)).max())
    hashes, ranks = nearest.Hashes(24, 8, 8, 1.6, 3), nearest.perturbations(8, 400)
    asked = vectors[:2000].astype(float)
    monkeypatch.setattr(nearest, "SLICE", 8 * 24 * 2500)
    monkeypatch.setattr(nearest, "LOOKUPS", 1 << 18)

    def batches():
        for i in range(0, len(vectors), 1000):
            part = vectors[i:i + 1000]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(i, i + len(part))), pa.ListArray.from_arrays(
                    np.arange(0, part.size + 1, 24, dtype="i4"), part.ravel())], ["entry", "vector"])

    search = nearest.Search(np.arange(len(asked)), asked, hashes, ranks, top, 4, 64)
    tracemalloc.start()
    found = [r for b in search.run(batches()) for r in zip(*b.to_pydict().values(), strict=True)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 << 20  # the cells of all probes alone would be 410 MB
    near = nearest.Hashes.places(hashes, nearest.lifted(vectors.astype(float), top))
    for i in range(0, len(asked), 100):
        own = hashes.places(nearest.normed(asked[i:i + 1]))
        seen = np.flatnonzero(nearest.turns(np.broadcast_to(own, near.shape), near, ranks) < len(ranks))
        want = sorted(zip((-(vectors[seen].astype(float) @ asked[i])).round(9), seen))[:4]
        assert sorted((round(-s, 9), e) for q, e, s in found if q == i) == want


def test_nearest_broadcasts_no_table(spark, monkeypatch):
    """op7: Spark sizes rows that Python makes, or equal rows, far too low to choose a broadcast."""
    draw = np.random.default_rng(8)
    rows = spark.createDataFrame(
        [(i, draw.standard_normal(8).astype("f4").tolist()) for i in range(400)] + [
            (i, [1.0] * 8) for i in range(400, 600)], "vec_id bigint, embedding array<float>")
    plans, real, best = [], nearest.stored, nearest._best

    def plan(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return frame

    monkeypatch.setattr(nearest, "stored", lambda frame, name: real(plan(frame), name))
    monkeypatch.setattr(nearest, "_best", lambda *a: plan(best(*a)))
    got = plan(nearest.nearest(rows, F.col("vec_id") % 10 == 0, k=5, functions=2, probe_count=30))
    assert got.count() == 60 * 5
    assert not any("Broadcast" in p for p in plans)
    assert sum("SortMergeJoin" in p for p in plans) >= 2
