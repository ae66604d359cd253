"""Token ids in binary files with one shared zstandard dictionary and random access.

A file holds documents in key order, each compressed on its own with a
dictionary trained on other documents' ids, so that short documents compress
well and one of them can be read without its neighbours.

    magic        8 bytes
    dictionary   32 bytes, SHA-256 of the dictionary that the frames need
    frames       one zstandard frame for each document: its ids, little endian
    index        for n documents: n keys (int64), n flags (uint8; 1: null key),
                 n+1 frame offsets (uint64), n+1 places of first ids (uint64)
    footer       n, index offset, bytes for each id (uint64 each), magic

A task writes its files as it goes, under names of its own, and returns one row
for each; only rows of tasks that ended well are in the manifest, so files of
lost or repeated tasks are never read.  Where a file's ids begin among all ids
follows from the manifest.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, table, written
from .packing import _ENCODERS, Encoder, vocabulary

END = 2
MAGIC = b"SLTOKEN1"
#: A file ends after so many bytes of frames or so many documents.
FILE_BYTES, FILE_DOCS = 64 << 20, 1 << 20
#: The dictionary: its greatest size, and the documents it is trained on: so many, of at most so many bytes each.
DICT_BYTES, SAMPLE, SAMPLE_BYTES = 64 << 10, 1000, 16 << 10
LEVEL = 3
#: Bytes of input for each range of keys; a range is sorted and written by one task.
RANGE_BYTES = 64 << 20
_FOOTER = struct.Struct("<QQQ8s")

MANIFEST = "part int, number int, path string, docs bigint, ids bigint, bytes bigint"


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a URI, or of a path without a scheme."""
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace(":", "://", 1))


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary for these samples; their own bytes where they are too few to train on, nothing where there are none."""
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(size, max(1024, total // 8)), samples).as_bytes() if len(samples) > 7 else b"".join(samples)[:size]
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


@functools.lru_cache(4)
def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    """zstandard's own kind where the bytes are such a dictionary, otherwise their bare content."""
    if not data:
        return None
    kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(data, dict_type=kind)


def dictionary_of(docs: DataFrame, text: str = "text", path: str | None = None, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """A dictionary trained in one task on whole short documents, those with the least text hashes.

    The sample is bounded: `sample` documents of 1 to `sample_bytes` bytes.
    Only the dictionary comes to the driver, at most `DICT_BYTES`.
    """
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))
        samples = []
        for batch in batches:
            for ids, offsets in encode(batch.column(0)):
                samples += [ids[a:b].astype(_kind(path)).tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array([train_dictionary(samples)], pa.binary())], names=["dictionary"])

    short = docs.select(F.col(text).alias("text")).where(F.octet_length("text").between(1, sample_bytes))
    rows = short.orderBy(F.xxhash64("text"), "text").limit(sample).coalesce(1).mapInArrow(run, "dictionary binary").collect()
    return bytes(rows[0][0]) if rows else b""


@functools.lru_cache(4)
def _kind(path: str) -> str:
    """Two bytes an id where the vocabulary allows it, otherwise four."""
    encode = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))
    return "<u2" if encode.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


class Writer:
    """One file, written as documents come."""

    def __init__(self, path: str, dictionary: bytes, kind: str):
        self.path, self.kind = path, np.dtype(kind)
        system, at = _open(path)
        self.out = system.open_output_stream(at)
        self.compressor = zstandard.ZstdCompressor(LEVEL, dict_data=_dictionary(dictionary), write_content_size=True)
        self.at = self.out.write(MAGIC + hashlib.sha256(dictionary).digest())
        self.keys, self.nulls, self.offsets, self.starts = [], bytearray(), [self.at], [0]

    def add(self, key: int | None, ids: np.ndarray) -> None:
        frame = self.compressor.compress(ids.astype(self.kind).tobytes())
        self.out.write(frame)
        self.keys.append(key or 0)
        self.nulls.append(key is None)
        self.offsets.append(self.offsets[-1] + len(frame))
        self.starts.append(self.starts[-1] + len(ids))

    @property
    def full(self) -> bool:
        return self.offsets[-1] > FILE_BYTES or len(self.keys) >= FILE_DOCS

    def close(self) -> tuple[str, int, int, int]:
        """Ends the file: path, documents, ids, bytes."""
        index = np.array(self.keys, "<i8").tobytes() + bytes(self.nulls) + np.array(self.offsets, "<u8").tobytes() + np.array(self.starts, "<u8").tobytes()
        self.out.write(index + _FOOTER.pack(len(self.keys), self.offsets[-1], self.kind.itemsize, MAGIC))
        self.out.close()
        return self.path, len(self.keys), self.starts[-1], self.offsets[-1] + len(index) + _FOOTER.size


class Reader:
    """One file: its index at once, documents as they are asked for.

    Raises ValueError where the file is damaged or needs another dictionary.
    """

    def __init__(self, path: str, dictionary: bytes):
        system, at = _open(path)
        self.file = system.open_input_file(at)
        size = self.file.size()
        if size < 40 + _FOOTER.size or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is no token file")
        if self.file.read_at(32, 8) != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} needs another dictionary")
        n, index, width, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC or size != index + n * 9 + (n + 1) * 16 + _FOOTER.size:
            raise ValueError(f"{path} is damaged")
        raw = self.file.read_at(n * 9 + (n + 1) * 16, index)
        self.n, self.kind = n, np.dtype(f"<u{width}")
        self.keys, self.nulls = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, n * 8)
        self.offsets = np.frombuffer(raw, "<u8", n + 1, n * 9).astype(np.int64)
        self.starts = np.frombuffer(raw, "<u8", n + 1, n * 9 + (n + 1) * 8).astype(np.int64)
        self.decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def _ids(self, i: int, frame: bytes) -> np.ndarray:
        ids = np.frombuffer(self.decompressor.decompress(frame), self.kind)
        if len(ids) != self.starts[i + 1] - self.starts[i]:
            raise ValueError(f"document {i} is damaged")
        return ids

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, reading its bytes alone."""
        a, b = self.offsets[i : i + 2].tolist()
        return self._ids(i, self.file.read_at(b - a, a))

    def find(self, key: int) -> np.ndarray | None:
        """The ids of the first document with this key; keys ascend after the nulls."""
        first = int(self.nulls.sum())
        i = first + int(np.searchsorted(self.keys[first:], key))
        return self.document(i) if i < self.n and self.keys[i] == key else None

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(key, ids before it, ids) of all documents, reading about 4 MB at a time."""
        i = 0
        while i < self.n:
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + (4 << 20), side="right")) - 1)
            a, b = int(self.offsets[i]), int(self.offsets[j])
            raw = self.file.read_at(b - a, a)
            for k in range(i, j):
                x, y = self.offsets[k : k + 2].tolist()
                yield None if self.nulls[k] else int(self.keys[k]), int(self.starts[k]), self._ids(k, raw[x - a : y - a])
            i = j


def write_files(docs: DataFrame, folder: str, dictionary: bytes, key: str = "doc_id", text: str = "text", end: int = END, path: str | None = None, ranges: int | None = None) -> DataFrame:
    """Writes all documents to files in `folder`, in ascending order of an integer key; one row for each file, in the order of (part, number).

    A text's ids are the tokenizer's, then `end`; null counts as empty, which
    is `end` alone.  Null keys come first; rows with one key are in the order
    of their texts, and rows that are equal in both may lie in several ranges,
    so no key is too frequent for a task.  An empty table gives no files.
    Other columns play no part.  A text of any length is one frame.  `folder`
    is a URI that executors can open by pyarrow (file, hdfs, s3, gs).
    """
    bounded_batches(docs.sparkSession)
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))
        kind, part, name, files, writer = _kind(path), 0, uuid.uuid4().hex, [], None
        for batch in batches:
            keys, at = batch.column(0).to_pylist(), 0
            part = batch.column(2)[0].as_py() if len(batch) else part
            for ids, offsets in encode(batch.column(1)):
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    writer = writer or Writer(f"{folder}/{part:06d}-{len(files):04d}-{name}.tok", dictionary, kind)
                    writer.add(keys[at], np.append(ids[a:b], np.uint32(end)))
                    at += 1
                    if writer.full:
                        files.append(writer.close())
                        writer = None
        if writer:
            files.append(writer.close())
        if files:
            paths, n_docs, n_ids, n_bytes = zip(*files, strict=True)
            columns = [pa.array([part] * len(files), pa.int32()), pa.array(range(len(files)), pa.int32()), pa.array(paths, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in (n_docs, n_ids, n_bytes))], names=["part", "number", "path", "docs", "ids", "bytes"])

    system, at = _open(folder)
    system.create_dir(at, recursive=True)
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = ["key", "hash", "text"]
    if ranges is None:
        ranges = max(docs.sparkSession.sparkContext.defaultParallelism, text_bytes(docs, text) // RANGE_BYTES)
    dealt = rows.repartitionByRange(ranges, "key", "hash", "row").sortWithinPartitions(*order)
    return dealt.select("key", "text", F.spark_partition_id().alias("part")).mapInArrow(run, MANIFEST)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0


def with_starts(manifest: DataFrame) -> DataFrame:
    """Adds `start`, the ids of all files before each: sums of ranges, of which there is one a task, and then sums within each range."""
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("all")).select("part", F.coalesce(F.sum("all").over(order), F.lit(0)).alias("before"))
    own = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("inner", F.coalesce(F.sum("ids").over(own), F.lit(0))).join(parts, "part").withColumn("start", F.col("before") + F.col("inner")).drop("before", "inner")


def read_files(files: DataFrame, dictionary: bytes, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """key, start, n_tokens, ids_crc32 and, if asked, ids of every document in the files of a manifest with `start`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size = [], 0
                for k, start, ids in Reader(path, dictionary):
                    whole = ids.astype("<u4")
                    rows.append((k, base + start, len(ids), zlib.crc32(whole.tobytes()), whole if with_ids else None))
                    size += 100 + with_ids * whole.nbytes
                    if size > 4 << 20:
                        yield pack(rows)
                        rows, size = [], 0
                if rows:
                    yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(c, pa.int64()) for c in columns[:4]]
        if with_ids:
            arrays.append(pa.array([x.astype(np.int64) for x in columns[4]], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(arrays, names=["key", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    schema = "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return files.select("path", "start").mapInArrow(run, schema).withColumnRenamed("key", key)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to token files and read back from them; the files go once the answer is a table."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    dictionary = dictionary_of(docs)
    manifest = scratch.written(write_files(docs, f"{scratch.path}/tokens", dictionary), "manifest")
    files = scratch.written(with_starts(manifest), "files")
    # A task reads few files.
    found = written(read_files(files.repartition(max(1, files.count()), "path"), dictionary), "token-rows")
    scratch.drop()
    return found
