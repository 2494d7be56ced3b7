"""Token ids in files of independent zstandard frames with a seek table.

A file holds the ids of consecutive documents as little-endian unsigned 32-bit
integers, cut into frames of ``frame_bytes``. Every frame carries zstandard's own
checksum. A skippable frame at the end is the seek table of the published seekable
format: for each frame its compressed and decompressed size and the low half of its
XXH64, then the number of frames, a descriptor and a magic number. An index table
(Parquet) says for each document its file, its first token there and its length, so
a reader decompresses only the frames that hold the documents asked for.

One task writes one file; a repeated task writes one of another name, and only files
that the index names count. Readers give rows by portions of READ_BYTES. Files go
through Arrow's file systems to the shared folder.

Nulls and empty texts: only the end id. Repeated rows are written each; a null
doc_id comes first. No rows give no files and an empty result. Other columns are
ignored.
"""

import struct
import uuid
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logloom.llm.vocabulary import encoder
from logloom.session import shared_dir

FRAME_BYTES, READ_BYTES = 1 << 18, 1 << 25
LEVEL = 3
# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
FOOTER, ENTRY, HEADER = "<IBI", "<III", "<II"

INDEX = "doc_id bigint, file string, first bigint, n_tokens bigint"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") \
        else (fs.LocalFileSystem(), uri)


class FrameWriter:
    """Appends bytes to a file; ``close`` adds the seek table."""

    def __init__(self, path: str, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        files, where = file_system(path)
        self.out = files.open_output_stream(where, compression=None)
        self.frame_bytes, self.pending, self.entries = frame_bytes, bytearray(), []
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)

    def write(self, data: bytes) -> None:
        self.pending += data
        while len(self.pending) >= self.frame_bytes:
            self._frame(bytes(self.pending[:self.frame_bytes]))
            del self.pending[:self.frame_bytes]

    def _frame(self, data: bytes) -> None:
        packed = self.compressor.compress(data)
        self.out.write(packed)
        self.entries.append(struct.pack(ENTRY, len(packed), len(data),
                                        xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.pending:
            self._frame(bytes(self.pending))
        table = b"".join(self.entries) + struct.pack(
            FOOTER, len(self.entries), WITH_CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack(HEADER, SKIPPABLE, len(table)) + table)
        self.out.close()


class FrameReader:
    """Reads byte ranges of a file; keeps the last frame it has decompressed."""

    def __init__(self, path: str):
        files, where = file_system(path)
        self.file = files.open_input_file(where)
        size = self.file.size()
        entry, footer = struct.calcsize(ENTRY), struct.calcsize(FOOTER)
        count, _, magic = struct.unpack(FOOTER, self.file.read_at(footer, size - footer))
        if magic != SEEKABLE:
            raise ValueError(f"no seek table at the end of {path}")
        table = self.file.read_at(count * entry, size - footer - count * entry)
        self.packed, self.plain, self.sums = [0], [0], []
        for packed, plain, checksum in struct.iter_unpack(ENTRY, table):
            self.packed.append(self.packed[-1] + packed)
            self.plain.append(self.plain[-1] + plain)
            self.sums.append(checksum)
        self.decompressor = zstandard.ZstdDecompressor()
        self.at, self.data, self.frames_read = None, b"", 0

    def _frame(self, n: int) -> bytes:
        if n != self.at:
            packed = self.file.read_at(self.packed[n + 1] - self.packed[n], self.packed[n])
            data = self.decompressor.decompress(packed)
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[n]:
                raise ValueError(f"frame {n} does not match its checksum")
            self.at, self.data, self.frames_read = n, data, self.frames_read + 1
        return self.data

    def read(self, start: int, length: int) -> bytes:
        parts, end = [], start + length
        while start < end:
            n = bisect_right(self.plain, start) - 1
            low = start - self.plain[n]
            part = self._frame(n)[low:low + end - start]
            parts.append(part)
            start += len(part)
        return b"".join(parts)

    def close(self) -> None:
        self.file.close()


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, files, firsts, counts = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array(files, pa.string()), pa.array(firsts, pa.int64()),
        pa.array(counts, pa.int64())], ["doc_id", "file", "first", "n_tokens"])


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int,
          frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files under ``folder``; returns the index.

    Documents are range-partitioned by doc_id, so file names ascend with the ids.
    """
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        writer, name, total = None, "", 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                if writer is None:
                    # a repeated task writes a file of its own; the index names the one that counts
                    name = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.zst"
                    writer = FrameWriter(f"{folder}/{name}", frame_bytes)
                ids = encoder(vocabulary).encode(text.as_py()) + end
                writer.write(ids)
                rows.append((doc_id, name, total, len(ids) // 4))
                total += len(ids) // 4
            if rows:
                yield _index_batch(rows)
        if writer is not None:
            writer.close()

    spark = docs.sparkSession
    files, path = file_system(folder)
    files.create_dir(path)
    ordered = (docs.select(F.col("doc_id").cast("bigint"), "text")
               .repartitionByRange("doc_id", F.xxhash64("text"))
               .sortWithinPartitions("doc_id", F.xxhash64("text")))
    ordered.mapInArrow(encode, INDEX).write.parquet(f"{folder}/index")
    return index(spark, folder)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, file, first, n_tokens, start: ``start`` counts over all files.

    The running sum sees one row per file.
    """
    rows = spark.read.schema(INDEX).parquet(f"{folder}/index")
    files = (rows.groupBy("file").agg(F.sum("n_tokens").alias("_tokens"))
             .select("file", F.coalesce(
                 F.sum("_tokens").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)),
                 F.lit(0)).alias("_base")))
    return rows.join(files, "file").withColumn("start", F.col("_base") + F.col("first")) \
        .drop("_base")


def read(documents: DataFrame, folder: str) -> DataFrame:
    """The ids (binary) of the documents asked for: rows of ``index``."""
    def fetch(batches):
        reader, name = None, None
        for batch in batches:
            done, ids, held = 0, [], 0
            for last, (file, first, count) in enumerate(zip(
                    batch["file"].to_pylist(), batch["first"].to_pylist(),
                    batch["n_tokens"].to_pylist(), strict=True), 1):
                if file != name:
                    if reader:
                        reader.close()
                    reader, name = FrameReader(f"{folder}/{file}"), file
                ids.append(reader.read(first * 4, count * 4))
                held += count * 4
                if held >= READ_BYTES or last == len(batch):
                    yield pa.RecordBatch.from_arrays(
                        [*batch.slice(done, last - done).columns, pa.array(ids, pa.binary())],
                        [*batch.schema.names, "ids"])
                    done, ids, held = last, [], 0
        if reader:
            reader.close()

    schema = StructType(documents.schema.fields).add("ids", "binary")
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (documents.repartition(parts, "file").sortWithinPartitions("file", "first")
            .mapInArrow(fetch, schema))


def fresh_folder(spark: SparkSession) -> str:
    return shared_dir(spark, "token-frames")
