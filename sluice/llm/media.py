"""Media columns: Netpbm and BMP to arrays, area resizing by integral images, NPY tiles, difference hashes.

An image is a uint8 array (height, width) or (height, width, 3).  Every
function is pure numpy on one image; the DataFrame operators run them inside
`mapInArrow`, one row at a time within Arrow batches, and hand on their files a
few MB at a time, so that memory is bounded by the largest image.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

#: Samples in a row of the image that a text becomes.
ROW = 64
TILE = (8, 9)
#: Bytes of files that leave together.
OUT_BYTES = 4_000_000
#: Rows of an image that the integral image is taken of at a time.
STRIP = 4096


def encode_netpbm(image: np.ndarray) -> bytes:
    """Binary greymap (P5) of a two-dimensional array, binary pixmap (P6) of one with three channels."""
    kind = b"P5" if image.ndim == 2 else b"P6"
    return kind + b"\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6, with comments; samples of another maximum than 255 are scaled to 255."""
    if len(data) < 2 or data[:1] != b"P" or data[1:2] not in b"123456":
        raise ValueError("not a Netpbm image")
    kind, at, fields = int(data[1:2]), 2, []
    while len(fields) < (2 if kind in (1, 4) else 3):
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("broken Netpbm header")
        fields.append(int(data[at:end]))
        at = end
    width, height, top = (*fields, 1)[:3]
    depth = 3 if kind in (3, 6) else 1
    n = width * height * depth
    if kind == 1:
        digits = np.frombuffer(data, np.uint8)[at:]
        samples = (digits[(digits == 48) | (digits == 49)][:n] == 48).astype(np.uint8) * 255
    elif kind in (2, 3):
        samples = np.array(data[at:].split()[:n], np.int64)
    elif kind == 4:
        stride = (width + 7) // 8
        rows = np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride)
        samples = (1 - np.unpackbits(rows, axis=1)[:, :width]).reshape(-1) * 255
    else:
        samples = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at + 1)
    if len(samples) != n:
        raise ValueError("Netpbm image is cut short")
    if kind not in (1, 4) and not 0 < top < 65536:
        raise ValueError("Netpbm maximum out of range")
    if kind not in (1, 4) and len(samples) and (samples.max() > top or samples.min() < 0):
        raise ValueError("Netpbm sample out of range")
    if kind not in (1, 4) and top != 255:
        samples = (samples.astype(np.int64) * 255 + top // 2) // top
    shape = (height, width, 3) if depth == 3 else (height, width)
    return samples.astype(np.uint8).reshape(shape)


def encode_bmp(image: np.ndarray) -> bytes:
    """8-bit grey with a palette, or 24-bit colour; rows from the bottom, padded to four bytes."""
    height, width = image.shape[:2]
    grey = image.ndim == 2
    rows = image[::-1].reshape(height, -1) if grey else image[::-1, :, ::-1].reshape(height, -1)
    body = np.zeros((height, (rows.shape[1] + 3) // 4 * 4), np.uint8)
    body[:, : rows.shape[1]] = rows
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1) if grey else np.zeros((0, 4), np.uint8)
    if grey:
        palette[:, 3] = 0
    start = 54 + palette.size
    head = b"BM" + struct.pack("<IHHI", start + body.size, 0, 0, start)
    head += struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8 if grey else 24, 0, body.size, 2835, 2835, 256 if grey else 0, 0)
    return head + palette.tobytes() + body.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits, or of 32 bits in fields of 8; a grey palette gives a two-dimensional array."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, size, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError("unsupported BMP")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    body = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if height > 0:
        body = body[::-1]
    if packed == 3:
        masks = struct.unpack_from("<3I", data, 54)
        shifts = [m.bit_length() - 8 for m in masks]
        if bits != 32 or any(s not in (0, 8, 16, 24) or m != 255 << s for m, s in zip(masks, shifts, strict=True)):
            raise ValueError("unsupported BMP fields")
        return np.ascontiguousarray(body[:, : width * 4].reshape(rows, width, 4)[:, :, [s // 8 for s in shifts]])
    if bits >= 24:
        return np.ascontiguousarray(body[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1])
    (used,) = struct.unpack_from("<I", data, 46)
    palette = np.frombuffer(data, np.uint8, 4 * (used or 1 << bits), 14 + size).reshape(-1, 4)[:, 2::-1]
    per = 8 // bits
    index = np.unpackbits(body, axis=1).reshape(rows, stride * per, bits) if bits < 8 else body
    if bits < 8:
        index = (index * (1 << np.arange(bits)[::-1])).sum(2)
    image = palette[index[:, :width]]
    return image[:, :, 0].copy() if (image == image[:, :, :1]).all() else image


def decode(data: bytes) -> np.ndarray:
    """The array of a Netpbm or BMP image."""
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the exact area of each new pixel, halves up, by fractional look-ups in the integral image.

    All in whole numbers: an edge lies so many new heights (or widths) below a
    row.  The integral image is built strip by strip, and only its rows at the
    edges are kept, so a tall image takes no more memory than a strip.
    """
    if image.ndim == 3:
        return np.stack([area_resize(image[:, :, c], height, width) for c in range(image.shape[2])], 2)
    h, w = image.shape

    def edges(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(n + 1, dtype=np.int64) * size
        low = np.minimum(at // n, size - 1)
        return low, (at - low * n)[:, None]

    low, part = edges(height, h)
    wanted = np.unique(np.concatenate([low, low + 1]))
    kept, above = np.zeros((len(wanted), w + 1), np.int64), np.zeros(w + 1, np.int64)
    for start in range(0, h, STRIP):
        strip = np.cumsum(image[start : start + STRIP], 0, dtype=np.int64)
        total = np.zeros((len(strip), w + 1), np.int64)
        np.cumsum(strip, 1, out=total[:, 1:])
        total += above
        at = np.flatnonzero((wanted > start) & (wanted <= start + len(strip)))
        kept[at] = total[wanted[at] - start - 1]
        above = total[-1].copy()
    first, second = kept[np.searchsorted(wanted, low)], kept[np.searchsorted(wanted, low + 1)]
    total = (first * (height - part) + second * part).T
    low, part = edges(width, w)
    total = (total[low] * (width - part) + total[low + 1] * part).T
    sums = total[1:, 1:] - total[:-1, 1:] - total[1:, :-1] + total[:-1, :-1]
    return ((2 * sums + h * w) // (2 * h * w)).astype(np.uint8)


def npy_bytes(image: np.ndarray) -> bytes:
    """The array as an NPY file."""
    out = io.BytesIO()
    np.save(out, image, allow_pickle=False)
    return out.getvalue()


def difference_hash(tile: np.ndarray) -> str:
    """16 hex digits: for an 8 by 9 tile, whether each sample is below its right neighbour."""
    grey = tile.mean(2) if tile.ndim == 3 else tile
    return np.packbits(grey[:, :-1] < grey[:, 1:]).tobytes().hex()


def media_tiles(df: DataFrame, key: str, media: str, tile: tuple[int, int] = (64, 64)) -> DataFrame:
    """For a binary column of images: key, height, width, channels, tile (an NPY file), dhash, error.

    Nulls and broken images, with numbers however large, give nulls and a
    message in `error`; every row stays, repeated ones too, and an empty table
    gives no rows.  Other columns of `df` play no part, whatever their names.
    An image is decoded whole; batches are bounded by bytes.
    """
    bounded_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                try:
                    if data is None:
                        raise ValueError("null")
                    image = decode(data)
                    if not image.size:
                        raise ValueError("empty image")
                    h, w, *c = image.shape
                    rows.append((h, w, c[0] if c else 1, npy_bytes(area_resize(image, *tile)), difference_hash(area_resize(image, *TILE)), None))
                except (ValueError, IndexError, struct.error, TypeError, OverflowError, MemoryError) as e:
                    rows.append((None, None, None, None, None, str(e)))
            parts = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p, t) for p, t in zip(parts, types, strict=True))], names=["key", "height", "width", "channels", "tile", "dhash", "error"])

    out = df.select(F.col(key).alias("key"), F.col(media).alias("media")).mapInArrow(run, f"key {kind}, height int, width int, channels int, tile binary, dhash string, error string")
    return out.withColumnRenamed("key", key)


def text_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each whole text as a greymap of 64 samples a row: key, n_bytes, media (the file), and what is read back from it.

    Null counts as empty; the UTF-8 bytes are padded with 0 to a positive
    multiple of 64.  payload_* come from the samples decoded again; tile is the
    resized 8 by 9 NPY file, feature its difference hash.  Every row stays,
    repeated ones too; equal texts have equal values; other columns of `df`
    play no part; an empty table gives no rows.  Rows leave in batches of a few
    MB of files, or of one file that is longer.
    """
    bounded_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    types = (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            rows, held, done = [], 0, 0
            for i in range(len(batch)):
                data = texts[i].as_py() or b""
                padded = data + bytes(-len(data) % ROW or (0 if data else ROW))
                media = encode_netpbm(np.frombuffer(padded, np.uint8).reshape(-1, ROW))
                image = decode(media)
                back = image.tobytes()
                tile = area_resize(image, *TILE)
                rows.append((len(data), media, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), npy_bytes(tile), difference_hash(tile)))
                held += len(media)
                if held >= OUT_BYTES or i + 1 == len(batch):
                    columns = [pa.array(p, t) for p, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([keys.slice(done, len(rows)), *columns], names=["key", "n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "tile", "feature"])
                    rows, held, done = [], 0, i + 1

    schema = f"key {kind}, n_bytes bigint, media binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, tile binary, feature string"
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def op1_media_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the media of every document."""
    return text_media(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
        F.sha2("tile", 256).alias("tile_sha256"),
    )
