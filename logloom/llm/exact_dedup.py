"""Exact duplicates by skew-safe combining of winners.

Three stages, each comparing full contents: every task merges equal texts of an
Arrow batch; digest groups are merged within salts, so that no task gets a whole
hot group; the winners of the salts are merged globally. Only narrow rows
(document id, digest) are then joined with the winners.

Nulls and empty texts: a null text counts as empty, empty texts are equal to each
other. A null doc_id never wins against another id. Rows that repeat a doc_id with
the same text count each; one of them stays. No rows give no rows; other columns
are ignored.
"""

from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import stored

SALTS = 32
LOCAL = "sha binary, content binary, keep_id bigint, n bigint"
MEMBER = "doc_id bigint, sha binary"


def normalised(texts: pa.Array) -> list[bytes]:
    """Texts with A-Z lower-cased, as UTF-8."""
    return pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_binary()).to_pylist()


def _local_winners(batches):
    for batch in batches:
        found = {}
        for doc_id, content in zip(batch["doc_id"].to_pylist(), normalised(batch["text"]),
                                   strict=True):
            known = found.setdefault(content, [doc_id, 0])
            known[1] += 1
            if doc_id is not None and (known[0] is None or doc_id > known[0]):
                known[0] = doc_id
        contents = list(found)
        yield pa.RecordBatch.from_arrays([
            pa.array([sha256(c).digest() for c in contents], pa.binary()),
            pa.array(contents, pa.binary()),
            pa.array([found[c][0] for c in contents], pa.int64()),
            pa.array([found[c][1] for c in contents], pa.int64()),
        ], ["sha", "content", "keep_id", "n"])


def _members(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([
            batch["doc_id"],
            pa.array([sha256(c).digest() for c in normalised(batch["text"])], pa.binary()),
        ], ["doc_id", "sha"])


def _members_with_content(batches):
    for batch in batches:
        contents = normalised(batch["text"])
        yield pa.RecordBatch.from_arrays([
            batch["doc_id"], pa.array([sha256(c).digest() for c in contents], pa.binary()),
            pa.array(contents, pa.binary()),
        ], ["doc_id", "sha", "content"])


def winners(docs: DataFrame, salts: int = SALTS, key_bytes: int = 32) -> DataFrame:
    """One row per distinct text: key (the first bytes of its digest), sha, keep_id, n."""
    key = F.substring("sha", 1, key_bytes)
    best = (F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    local = (docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_local_winners, LOCAL)
             .withColumn("key", key)
             .withColumn("salt", F.pmod(F.xxhash64("keep_id"), F.lit(salts))))
    salted = local.groupBy("key", "salt", "sha", "content").agg(*best)
    return salted.groupBy("key", "sha", "content").agg(*best)


def deduplicate(docs: DataFrame, salts: int = SALTS, key_bytes: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Texts are grouped by digest and content; documents find their group again by
    digest. Where one key stands for several contents (with 32 bytes: a collision
    of SHA-256; fewer bytes are for tests), those documents are joined by content.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    best = stored(winners(docs, salts, key_bytes).drop("content"), "exact-winners")
    members = (docs.mapInArrow(_members, MEMBER)
               .groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("copies"))
               .withColumn("key", F.substring("sha", 1, key_bytes)))
    collided = best.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    if collided.isEmpty():
        found = members.drop("sha").join(best, "key")
    else:
        found = _by_content(docs, members, best, collided.select("key"), key_bytes)
    first = F.col("copy") == 1
    return found.select(
        "doc_id", "keep_id", F.col("n").alias("group_size"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    ).select("doc_id", "keep_id", "group_size",
             (F.col("doc_id").eqNullSafe(F.col("keep_id")) & first).alias("kept"), "text_sha256")


def _by_content(docs, members, best, collided, key_bytes):
    plain = members.join(collided, "key", "left_anti").drop("sha").join(best, "key")
    texts = (docs.mapInArrow(_members_with_content, f"{MEMBER}, content binary")
             .withColumn("key", F.substring("sha", 1, key_bytes))
             .join(collided, "key", "left_semi"))
    heads = (best.alias("b").join(texts.alias("t"),
                                  F.expr("b.key = t.key AND b.sha = t.sha "
                                         "AND b.keep_id <=> t.doc_id"))
             .select("b.key", "b.keep_id", "b.n", "b.sha", "t.content").distinct())
    close = (texts.drop("sha").groupBy("doc_id", "key", "content")
             .agg(F.count(F.lit(1)).alias("copies"))
             .join(heads, ["key", "content"]).drop("content"))
    return plain.unionByName(close)
