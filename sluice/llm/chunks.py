"""Document fingerprints: content-defined chunks under a normalised gear hash.

The gear hash of a byte position is the sum of a random value of each of the
last 64 bytes, doubled for each byte since; it is found for all bytes at once
by six doublings.  A cut falls where its high bits are zero: more bits are
asked for before the normal size than after it, so that sizes stay close to
it.  A fingerprint is the set of (digest, length) of a text's chunks, and
containment the share of the text's bytes in chunks the other also has.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import bounded_batches, table

_GEAR = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
#: Least, normal and largest chunk in bytes; bits that must be zero before and after the normal size.
SIZES, BITS = (16, 48, 192), (7, 4)


def gear(data: np.ndarray) -> np.ndarray:
    """Hash of the 64 bytes that end at each byte (fewer at the beginning)."""
    out = _GEAR[data]
    step = 1
    while step < 64:
        shifted = out[:-step] << np.uint64(step)
        out[step:] += shifted
        step *= 2
    return out


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each chunk of all texts in order, and n+1 offsets into the chunks by text.

    Texts lie one after another in `data`.  A boundary looks at 64 bytes, so
    near a text's beginning it also sees the end of the text before; those
    positions are hashed anew from the text alone, so that equal texts have
    equal chunks.
    """
    value = gear(data)
    size = np.diff(offsets)
    for a, n in zip(offsets[:-1].tolist(), size.tolist(), strict=True):
        n = min(63, n)
        value[a : a + n] = gear(data[a : a + n])
    least, normal, most = SIZES
    weak = np.flatnonzero(value >> np.uint64(64 - BITS[1]) == 0) + 1
    strict = (value[weak - 1] >> np.uint64(64 - BITS[0]) == 0).tolist()
    weak = weak.tolist()
    weak.append(1 << 62)
    starts, counts = [], []
    k = 0
    for begin, end in pairwise(offsets.tolist()):
        before, at = len(starts), begin
        while at < end:
            starts.append(at)
            stop = min(at + most, end)
            while weak[k] < at + least:
                k += 1
            j = k
            while weak[j] < stop and not (strict[j] or weak[j] >= at + normal):
                j += 1
            at = min(weak[j], stop)
            k = j
        counts.append(len(starts) - before)
    return np.array(starts, np.int64), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def chunk_sets(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, the digests (40 bits, ascending) and lengths of its distinct chunks."""
    out = []
    for data, offsets in words.blocks(column):
        first, by_text = cuts(data, offsets)
        last = np.append(first[1:], len(data))
        last_of_text = by_text[1:][np.diff(by_text) > 0] - 1
        last[last_of_text] = offsets[1:][np.diff(by_text) > 0]
        digest = words.span_hashes(data, first, last, lower=False) >> np.uint64(24)
        length = last - first
        for a, b in pairwise(by_text.tolist()):
            found, at = np.unique(digest[a:b], return_index=True)
            out.append((found, length[a:b][at]))
    return out


def fingerprint(chunks: tuple[np.ndarray, np.ndarray]) -> str:
    """14 hex digits for each distinct chunk: digest, then length; empty for an empty text."""
    packed = (chunks[0] << np.uint64(16)) | chunks[1].astype(np.uint64)
    return np.ascontiguousarray(packed.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, 1:].tobytes().hex()


def containment(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of a's bytes in chunks that b has too; two empty sets are alike, an empty one is in no other."""
    if not len(a[0]):
        return float(not len(b[0]))
    at = np.minimum(np.searchsorted(b[0], a[0]), max(len(b[0]) - 1, 0))
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    return float(a[1][same].sum() / a[1].sum())


#: Rows of a block of the order by key, and the most blocks (their first keys are kept on the driver).
BLOCK_ROWS, MOST_BLOCKS = 4096, 65_536
#: Texts, and characters of them, that are chunked together.
HELD_ROWS, HELD_CHARS = 128, 1 << 20


class _Blocks:
    """Cuts of the order by (key, MD5 of the text): nulls first, at quantiles of the keys, and within a key that has many quantiles at parts of the MD5."""

    def __init__(self, quantiles: list[int], nulls: int):
        count = Counter(quantiles)
        edges = set(count)
        edges |= {k - 1 for k, n in count.items() if n > 1}  # a block of its own for a key of many rows
        self.edges = np.array(sorted(edges), np.int64)
        parts = [max(1, -(-nulls // BLOCK_ROWS)), *(count[k] + 1 if count[k] > 1 else 1 for k in self.edges.tolist()), 1]
        self.parts = np.array(parts, np.int64)
        self.first = np.cumsum(self.parts) - self.parts

    def of(self, keys: pa.Array, sums: pa.Array) -> pa.Array:
        null = keys.is_null().to_numpy(zero_copy_only=False)
        at = np.searchsorted(self.edges, keys.fill_null(0).to_numpy(zero_copy_only=False), side="left") + 1
        at[null] = 0
        high = np.array([int(s[:8], 16) for s in sums.to_pylist()], np.int64)
        return pa.array(self.first[at] + high * self.parts[at] // 2**32)


def in_order(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, text, copy: sorted partitions that hold whole blocks of the order by key.

    Null keys come first; null and equal keys are ordered by the MD5 of the
    text.  Keys are cut at approximate quantiles into blocks, rows of one key,
    or of none, by that MD5, so no key makes a block large.  Each block's last
    row, a copy, is the first row of the next block; the last block's is the
    first of all.  Only the first key and MD5 of each block come to the driver.
    """
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total, nulls = rows.agg(F.count("*"), F.count_if(F.col("key").isNull())).first()
    blocks = min(MOST_BLOCKS, -(-(total - nulls) // BLOCK_ROWS))
    cuts_ = rows.approxQuantile("key", [k / blocks for k in range(1, blocks)], 1 / (4 * blocks)) if blocks > 1 else []
    known = _Blocks([int(x) for x in cuts_], nulls)

    def find(keys: pa.Array, sums: pa.Array) -> pa.Array:
        return known.of(keys, sums)

    rows = rows.withColumn("sum", F.md5(F.col("text").cast("binary"))).withColumn("block", F.arrow_udf(find, "bigint")("key", "sum"))
    first = {r.block: (r.least.key, r.least.sum) for r in rows.groupBy("block").agg(F.min(F.struct("key", "sum")).alias("least")).collect()}
    order = sorted(first)
    marks = [(*first[b], order[i - 1]) for i, b in enumerate(order)]
    marks = df.sparkSession.createDataFrame(marks, "k bigint, s string, to bigint")
    copies = (
        rows.join(F.broadcast(marks), F.col("key").eqNullSafe(F.col("k")) & (F.col("sum") == F.col("s")))
        .groupBy("to").agg(F.first("key").alias("key"), F.first("text").alias("text"), F.first("sum").alias("sum"))
        .select("key", "text", F.col("to").alias("block"), "sum", F.lit(True).alias("copy"))
    )
    both = rows.withColumn("copy", F.lit(False)).unionByName(copies)
    return both.repartition("block").sortWithinPartitions("block", "copy", F.col("key").asc_nulls_first(), "sum").select("key", "text", "copy")


def sha_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def edit_tail(text: str, other: str) -> str:
    """The last floor(n/2) code points replaced by the first as many, or all, of another text."""
    n = len(text) // 2
    return text[: len(text) - n] + other[:n]


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    The next row is the one that follows by ascending key, after the last the
    first; a single row is its own next.  Null texts count as empty.  Null keys
    come first; rows with null or equal keys follow one another by the MD5 of
    their texts, and rows equal in both in any order, which gives the same
    values.  Every row stays; other columns play no part; an empty table gives
    no rows.  Texts are held a few at a time, by their length.
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        chars = 0
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held.append(row[:2])
                chars += len(row[1])
                if row[2] or len(held) > HELD_ROWS or (len(held) > 1 and chars > HELD_CHARS):  # a copy ends its block
                    yield judge(held)
                    held = [] if row[2] else held[-1:]
                    chars = sum(len(t) for _, t in held)

    def judge(held: list[tuple[int | None, str]]) -> pa.RecordBatch:
        texts = [t for _, t in held]
        edited = [edit_tail(a, b) for a, b in pairwise(texts)]
        sets, new = chunk_sets(pa.array(texts, pa.large_string())), chunk_sets(pa.array(edited, pa.large_string()))
        own = sets[:-1]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in held[:-1]], pa.int64()), pa.array(map(len, texts[:-1]), pa.int64()), pa.array(map(sha_hex, edited), pa.string()),
                pa.array(map(fingerprint, own), pa.string()), pa.array(map(fingerprint, new), pa.string()),
                pa.array(map(containment, own, new), pa.float64()), pa.array(map(containment, own, sets[1:]), pa.float64()),
            ],
            names=["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    schema = "key bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(df, key, text).mapInArrow(run, schema).withColumnRenamed("key", key)


def op7_chunk_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, its edited text and the next document."""
    return fingerprints(table(spark, sf_dir, "documents"))
