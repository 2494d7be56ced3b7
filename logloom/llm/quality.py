"""Quality score by compression with a good and a bad dictionary.

Texts are cut into blocks of ``block_bytes`` and each block is compressed twice, by
zstandard with a dictionary built from good and one built from bad labelled text.
The difference of the sizes, by the text's length and by the compressed sizes,
becomes a probability by logistic regression on labelled rows that the dictionaries
have not seen.

The model is fitted on a bounded sample of labelled rows: at most ``sample_docs``
documents per class and part, and at most ``sample_blocks`` of their blocks per
dictionary, chosen by hash. All rows are scored, over their whole texts.

Null text counts as empty; an empty text gets a score like any other. Labels other
than 0 and 1, null ids and labels without a document are not learned from. Where
only one class has labels the score is that class for all, without labels 0.5.
Other columns of the documents pass through.
"""

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS = 4_000
SAMPLE_BLOCKS = 10_000
BLOCK_BYTES = 2048
DICTIONARY_BYTES = 96 * 1024
PARTS = 3
HELD_OUT = 1


def part(doc_id: Column) -> Column:
    """Which third of the documents: 0 builds dictionaries, 2 calibrates, 1 is held out."""
    return F.crc32(doc_id.cast("string")) % PARTS


@dataclass
class Model:
    """Two dictionaries and the calibration; a few hundred KB whatever the input."""

    good: bytes = b""
    bad: bytes = b""
    weights: list[float] = field(default_factory=list)
    prior: float = 0.5
    block_bytes: int = BLOCK_BYTES


def blocks(text: str | None, size: int) -> list[bytes]:
    data = (text or "").encode("utf-8", "replace")
    return [data[i:i + size] for i in range(0, max(1, len(data)), size)]


def _compressor(dictionary: bytes):
    return zstandard.ZstdCompressor(
        level=3, write_content_size=False, write_dict_id=False,
        dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


class Features:
    """Sizes of a text under both dictionaries, as inputs of the calibration."""

    def __init__(self, model: Model):
        self.size = model.block_bytes
        self.good, self.bad = _compressor(model.good), _compressor(model.bad)

    def __call__(self, text: str | None) -> list[float]:
        cut = blocks(text, self.size)
        good = sum(len(self.good.compress(b)) for b in cut)
        bad = sum(len(self.bad.compress(b)) for b in cut)
        length = sum(map(len, cut)) + 1
        return [1.0, (bad - good) / (length + 64), (bad - good) / (good + bad),
                good / (length + 64), float(np.log(length))]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3):
    """Weighted logistic regression by Newton steps, on standardised inputs."""
    mean, spread = x.mean(0), x.std(0)
    mean[0], spread[0] = 0, 1
    z = (x - mean) / np.where(spread > 0, spread, 1)
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        slope = z.T @ (weight * (y - p)) - ridge * beta
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    beta /= np.where(spread > 0, spread, 1)
    beta[0] -= beta[1:] @ mean[1:]
    return beta.tolist()


def _sample(labels: DataFrame, which: int, quality: int, count: int) -> DataFrame:
    """At most ``count`` labelled ids, in the order of a hash."""
    return (labels.where((F.col("_part") == which) & (F.col("quality") == quality))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(count))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS,
        sample_blocks: int = SAMPLE_BLOCKS, block_bytes: int = BLOCK_BYTES,
        dictionary_bytes: int = DICTIONARY_BYTES) -> Model:
    """Learn from ``labels`` (doc_id, quality), but for the held-out third."""
    labels = (labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
              .groupBy("doc_id").agg(F.max("quality").alias("quality"))
              .withColumn("_part", part(F.col("doc_id"))).where(F.col("_part") != HELD_OUT))
    counts = {r["quality"]: r["n"] for r in
              labels.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Model(prior=float(next(iter(counts), 0.5)))
    chosen = _sample(labels, 0, 0, sample_docs)
    for which, quality in ((0, 1), (2, 0), (2, 1)):
        chosen = chosen.unionByName(_sample(labels, which, quality, sample_docs))
    # at most 4 * sample_docs narrow rows, so a broadcast is bounded
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    @F.pandas_udf("array<binary>")
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda t: blocks(t, block_bytes))

    pieces = (texts.where("_part = 0")
              .select("quality", "doc_id", F.posexplode(cut(F.coalesce("text", F.lit(""))))
                      .alias("at", "block")))
    dictionaries = {}
    for quality in (0, 1):
        rows = (pieces.where(F.col("quality") == quality)
                .orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at")
                .select("block").limit(sample_blocks).collect())
        dictionaries[quality] = _dictionary([bytes(r["block"]) for r in rows], dictionary_bytes)
    model = Model(good=dictionaries[1], bad=dictionaries[0], block_bytes=block_bytes,
                  prior=counts[1] / (counts[0] + counts[1]))

    @F.pandas_udf("array<double>")
    def features(text: pd.Series) -> pd.Series:
        return text.map(Features(model))

    seen = (texts.where("_part = 2")
            .select("quality", features(F.coalesce("text", F.lit(""))).alias("x")).collect())
    y = np.array([r["quality"] for r in seen], float)
    if len(set(y)) < 2:
        return model
    share = np.array([counts[0], counts[1]]) / np.array([(y == 0).sum(), (y == 1).sum()])
    weight = share[y.astype(int)]
    model.weights = _logistic(np.array([r["x"] for r in seen]), y, weight / weight.mean())
    return model


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; the samples themselves where there are too few."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def score(text: Column, model: Model) -> Column:
    """Probability that the text is of quality 1."""
    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        if not model.weights:
            return pd.Series([model.prior] * len(texts), dtype=float)
        measure, weights = Features(model), np.array(model.weights)
        x = np.array([measure(t) for t in texts]).reshape(-1, len(weights))
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))))

    return probability(F.coalesce(text, F.lit("")))
