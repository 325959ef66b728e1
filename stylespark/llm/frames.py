"""Token ids in seekable files: independent zstandard frames, a trailing seek table, a checksum per frame.

One file holds a range of ascending doc_ids, one frame a document's ids as little-endian unsigned 32-bit
integers. After the frames come two skippable frames: the documents' keys, and the seek table, whose footer is last:

    seek table   12 bytes per frame: compressed size, size, low 32 bits of XXH64 of the content
    footer       number of frames (4), flags (1: bit 7 = checksums), magic 0x8F92EAB1 (4)

A reader takes the footer, then the table, then only the frames it wants. Files are written under the
name of the task's attempt; only files whose task succeeded are in the manifest, so attempts that were
lost leave files that nobody reads.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stylespark.llm.common import opened, prepared, shared_dir, written
from stylespark.llm.encoders import word_bpe

SKIPPABLE, SEEK_FRAME, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
END_ID = 1
LEVEL = 3
#: Bytes of text for a file, about; of more than MOST_FILES files' worth, files grow.
FILE_BYTES, MOST_FILES = 16 << 20, 100_000
MANIFEST = "shard int, path string, frames long, ids long, file_bytes long, first_id long, last_id long"
RESULT = "shard int, doc_id long, before long, n_tokens long, ids_crc32 long"


def xxh32low(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Frames into an open binary file; close() ends it with the keys and the seek table."""

    def __init__(self, out, level: int = LEVEL) -> None:
        import zstandard

        self.out, self.packer = out, zstandard.ZstdCompressor(level=level)
        self.table, self.keys, self.at = [], [], 0

    def add(self, key: int | None, data: bytes) -> None:
        frame = self.packer.compress(data)
        self.table.append((len(frame), len(data), xxh32low(data)))
        self.keys.append(key)
        self.out.write(frame)
        self.at += len(frame)

    def close(self) -> int:
        known = np.array([k is not None for k in self.keys], np.uint8)
        keys = self.packer.compress(np.array([k or 0 for k in self.keys], "<i8").tobytes() + known.tobytes())
        seek = np.array(self.table, "<u4").reshape(-1, 3).tobytes() + struct.pack("<IBI", len(self.table), 0x80, SEEK_MAGIC)
        tail = struct.pack("<II", SKIPPABLE, len(keys)) + keys + struct.pack("<II", SEEK_FRAME, len(seek)) + seek
        self.out.write(tail)
        return self.at + len(tail)


class Reader:
    """Random access to a seekable file: the keys, and the content of the frames asked for."""

    def __init__(self, file, size: int) -> None:
        import zstandard

        self.file, self.unpacker = file, zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack("<IBI", self.bytes_at(size - 9, 9))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError("no seek table")
        own = size - 9 - 12 * n
        self.table = np.frombuffer(self.bytes_at(own, 12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.table[:, 0])))
        if struct.unpack("<II", self.bytes_at(own - 8, 8)) != (SEEK_FRAME, 12 * n + 9):
            raise ValueError("broken seek table")
        at = int(self.start[-1])
        _, length = struct.unpack("<II", self.bytes_at(at, 8))
        keys = self.unpacker.decompress(self.bytes_at(at + 8, length), max_output_size=9 * n + 1)
        known = np.frombuffer(keys[8 * n :], np.uint8)
        self.keys = [k if ok else None for k, ok in zip(np.frombuffer(keys[: 8 * n], "<i8").tolist(), known, strict=True)]

    def bytes_at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, i: int) -> bytes:
        packed, size, check = map(int, self.table[i])
        data = self.unpacker.decompress(self.bytes_at(int(self.start[i]), packed), max_output_size=size) if size else b""
        if len(data) != size or xxh32low(data) != check:
            raise ValueError(f"frame {i}: checksum differs")
        return data

    def find(self, keys: Iterable[int]) -> Iterator[tuple[int, bytes]]:
        """The frames of these keys alone."""
        wanted = set(keys)
        for i, k in enumerate(self.keys):
            if k in wanted:
                yield k, self.frame(i)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, name, writer, ids, ends = word_bpe(), f"{folder}/{uuid.uuid4().hex}.zst", None, 0, [None, None]
        end = np.array([END_ID], np.uint32)
        for batch in batches:
            keys, texts = (batch.column(k).to_pylist() for k in range(2))
            for k, own in zip(keys, tool.encode(texts), strict=True):
                if writer is None:
                    file = opened(name, "w")
                    writer = Writer(file)
                writer.add(k, np.concatenate((own, end)).astype("<u4", copy=False).tobytes())
                ids += len(own) + 1
                if k is not None:
                    ends = [k if ends[0] is None else ends[0], k]
        if writer is not None:
            size = writer.close()
            file.close()
            yield pa.RecordBatch.from_pylist([dict(shard=TaskContext.get().partitionId(), path=name, frames=len(writer.keys), ids=ids, file_bytes=size, first_id=ends[0], last_id=ends[1])], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("frames", pa.int64()), ("ids", pa.int64()), ("file_bytes", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())]))

    return run


def write_token_files(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode every document and write the files, in ascending doc_id order over the files (null first).

    Returns the manifest, a row per file. Documents are dealt by ranges of doc_id, a hash of the text and the row's place, so
    that neither a repeated doc_id nor repeated rows gather in a task. An empty table gives no file.
    """
    spark = prepared(docs.sparkSession)
    folder = folder or shared_dir(spark, "token-files")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    n = max(1, min(MOST_FILES, -(-((size[0] or 0) + 16 * size[1]) // file_bytes)))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash").asc(), F.col("_place").asc()]
    dealt = rows.select("doc_id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_place"))
    dealt = dealt.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return written(dealt.mapInArrow(_write(folder), MANIFEST), "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            with opened(row["path"], "r") as file:
                reader = Reader(file, row["file_bytes"])
                out, before = [], 0
                for i, key in enumerate(reader.keys):
                    data = reader.frame(i)
                    out.append((row["shard"], key, before, len(data) // 4, zlib.crc32(data)))
                    before += len(data) // 4
                columns = list(zip(*out, strict=True)) or [()] * 5
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document from the files: doc_id, start, n_tokens, ids_crc32. Checks each frame's checksum."""
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per file, at most MOST_FILES
    base = manifest.select("shard", F.coalesce(F.sum("ids").over(ahead), F.lit(0)).alias("base"))
    rows = manifest.repartitionById(max(1, manifest.count()), F.col("shard")).mapInArrow(_read, RESULT)  # a task per file
    return rows.join(F.broadcast(base), "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def _lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            with opened(row["path"], "r") as file:
                found = list(Reader(file, row["file_bytes"]).find(row["keys"]))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([np.frombuffer(d, "<u4").astype(np.int64) for _, d in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """The ids of the documents in keys (doc_id), decompressing only their frames.

    Files hold ranges in ascending order, so a key's files are found by two binary searches; of repeated doc_ids there may be several."""
    spark = prepared(keys.sparkSession)
    files = manifest.where("first_id is not null").orderBy("shard").select("path", "file_bytes", "first_id", "last_id").collect()  # at most MOST_FILES
    shared = spark.sparkContext.broadcast((np.array([f.first_id for f in files], np.int64), np.array([f.last_id for f in files], np.int64), [f.path for f in files], [f.file_bytes for f in files]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, path, size = shared.value
        for batch in batches:
            asked = batch.column(0).to_numpy()
            lo, hi = np.searchsorted(last, asked, "left"), np.searchsorted(first, asked, "right")
            n = np.maximum(0, hi - lo)
            at = (np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([path[i] for i in at], pa.string()), pa.array([size[i] for i in at], pa.int64()), pa.array(np.repeat(asked, n))], names=["path", "file_bytes", "doc_id"])

    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    hit = asked.mapInArrow(find, "path string, file_bytes long, doc_id long")
    return hit.groupBy("path", "file_bytes").agg(F.collect_set("doc_id").alias("keys")).mapInArrow(_lookup, "doc_id long, ids array<long>")


def token_files(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents and read them back.

    Null or empty texts hold the end id alone; repeated rows and repeated doc_ids are kept, each with a
    frame of its own; null doc_ids come first. A very long text is one frame, encoded by slices of its chunks. An empty table
    gives no rows. Further columns are ignored, whatever their names.
    """
    return read_token_files(write_token_files(docs, doc_id, text))
