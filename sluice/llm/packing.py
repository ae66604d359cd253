"""Best-fit packing of token sequences.

Documents become token ids once; ids of a word are kept by the worker, so a
word is tokenized once for each worker and not once for each occurrence.
Pieces are dealt at random into groups of bounded size, and each group packs
its pieces best fit decreasing: a segment tree over the remaining capacities
finds the fullest open sequence that a piece still fits in logarithmic time.
Apart from at most one half-full sequence for each group, packing in groups
costs nothing, since each holds thousands of pieces of all lengths.
"""

from __future__ import annotations

import itertools
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import bounded_batches, free_name, table

LENGTH = 4096
END = 1
#: Rows whose pieces one task packs.
GROUP_ROWS = 16384
#: Words whose ids a worker keeps; beyond, it forgets all and starts again.
KEPT_WORDS = 500_000


def vocabulary() -> str:
    """File of the public tokenizer that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_characters() -> dict[int, str]:
    """The printable character that byte-level tokenizers write for each byte: itself, or the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTE_CHARACTERS = _byte_characters()


class Encoder:
    """Token ids of whole texts by a tokenizer that works on words: it drops white space, and lower-cases.

    Texts are cut at ASCII white space, and after an ASCII letter that another
    ASCII character than a letter follows.  The tokenizer's own cuts include
    these, its normaliser changes nothing across them, so the ids of the parts
    are those of the whole.  A text with `<|`, which may begin a special token,
    goes through the tokenizer as it is.  Parts are known by a 64-bit hash.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        # Known hashes in order, with each one's place in `start`; those met lately are in a dictionary till they are many.
        self.keys, self.places, self.recent = words.EMPTY, np.zeros(0, np.int64), {}
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _slow(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text. A part of letters alone is one word to the tokenizer, so its model is asked directly."""
        out: list[list[int] | None] = []
        model = self.tokenizer.model
        for text in texts:
            word = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()
            if not word.isalpha() or "Σ" in text:  # Python lower-cases a last sigma in its own way
                out.append(None)
                continue
            word = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARACTERS)
            out.append([t.id for t in model.tokenize(word)])
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def __call__(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of all texts one after another, n+1 offsets) of the texts in turn, about 2 MB at a time."""
        for data, offsets in words.blocks(column, 1 << 21):
            raw = data.tobytes()
            if b"<|" not in raw:
                yield self._block(data, offsets)
                continue
            out = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                whole = raw[a:b]
                out.append(np.array(self.tokenizer.encode(whole.decode(), add_special_tokens=False).ids, np.uint32) if b"<|" in whole else self._block(data[a:b], np.array([0, b - a]))[0])
            yield np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, last, by_text = split_parts(data, offsets)
        if not len(first):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        hashes, at, which = np.unique(words.span_hashes(data, first, last), return_index=True, return_inverse=True)
        if len(self.start) + len(hashes) > KEPT_WORDS:
            self.forget()
        place = np.full(len(hashes), -1, np.int64)
        if len(self.keys):
            near = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            place = np.where(self.keys[near] == hashes, self.places[near], -1)
        missing = np.flatnonzero(place < 0)
        place[missing] = [self.recent.get(k, -1) for k in hashes[missing].tolist()]
        new = np.flatnonzero(place < 0)
        if len(new):
            raw = data.tobytes()
            spans = zip(first[at[new]].tolist(), last[at[new]].tolist(), strict=True)
            ids = self._slow([raw[a:b].decode() for a, b in spans])
            place[new] = np.arange(len(new)) + len(self.start) - 1
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(x) for x in ids])])
            self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(ids), np.uint32)])
            self.recent.update(zip(hashes[new].tolist(), place[new].tolist(), strict=True))
            if len(self.recent) > 1 << 16:
                keys = np.concatenate([self.keys, np.fromiter(self.recent.keys(), np.uint64)])
                order = np.argsort(keys)
                self.keys, self.places = keys[order], np.concatenate([self.places, np.fromiter(self.recent.values(), np.int64)])[order]
                self.recent = {}
        start, size = self.start[place][which], (self.start[place + 1] - self.start[place])[which]
        ends = np.cumsum(size)
        index = np.arange(int(ends[-1]), dtype=np.int64) + np.repeat(start - (ends - size), size)
        ends = np.concatenate([[0], ends])
        return self.ids[index], ends[by_text]


#: 0 white space, 1 ASCII letter, 2 other ASCII, 3 beyond ASCII.
_KIND = np.full(256, 2, np.uint8)
_KIND[words._SPACE] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 3


def split_parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the parts, and n+1 offsets into them by text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _KIND[data]
    solid = kind > 0
    # Whether a part ends between a byte and the next one.
    cut = (kind[:-1] == 1) & (kind[1:] == 2)
    inner = offsets[(offsets > 0) & (offsets < len(data))] - 1
    cut[inner] = True
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1] | cut
    ends[:-1] &= ~solid[1:] | cut
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return first, last, np.searchsorted(first, offsets)


class Fullest:
    """Open sequences by remaining capacity: a segment tree over 0..length that finds the tightest that fits."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.open: list[list[int]] = [[] for _ in range(length + 1)]
        self.tree = bytearray(2 * self.size)  # whether any sequence with this capacity is open, below each node

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        k = room + self.size
        while k and not self.tree[k]:
            self.tree[k] = 1
            k >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns (room, sequence) with the least room that is not below `least`."""
        k = least + self.size
        while not self.tree[k]:
            while k & 1:  # a right child: on to the parent's right neighbour
                k >>= 1
                if not k:
                    return None
            k += 1
        while k < self.size:
            k = 2 * k if self.tree[2 * k] else 2 * k + 1
        room = k - self.size
        sequence = self.open[room].pop()
        if not self.open[room]:
            while k and not (self.tree[2 * k] or self.tree[2 * k + 1] if k < self.size else False):
                self.tree[k] = 0
                k >>= 1
        return room, sequence


def best_fit(lengths: list[int], length: int = LENGTH) -> tuple[list[int], list[int]]:
    """Sequence and offset of each piece, best fit decreasing; ties in the order given."""
    free, n = Fullest(length), 0
    sequence, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room, which = free.take(lengths[i]) or (length, n)
        n = max(n, which + 1)
        sequence[i], offset[i] = which, length - room
        if room > lengths[i]:
            free.add(room - lengths[i], which)
    return sequence, offset


_ENCODERS: dict[str, Encoder] = {}


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """key, piece, start, length, ids_crc32 and, if asked, ids; other columns play no part.

    A text's ids are the tokenizer's, then `end`; only longer ones are cut.
    Null counts as empty, which is `end` alone.  Null and repeated keys are
    kept as they are, a row each; an empty table gives no pieces.  Texts go
    through in blocks of about 2 MB, or one text if it is longer.
    """
    bounded_batches(df.sparkSession)
    path = path or vocabulary()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))
        for batch in batches:
            done = 0
            for ids, offsets in encode(batch.column(1)):
                owner, piece, start, size, crc, own = [], [], [], [], [], []
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    whole = np.append(ids[a:b], np.uint32(end)).astype("<u4")
                    for k in range(0, len(whole), length):
                        part = whole[k : k + length]
                        owner.append(done + i)
                        piece.append(k // length)
                        start.append(k)
                        size.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            own.append(part)
                done += len(offsets) - 1
                rows = batch.column(0).take(pa.array(owner, pa.int64()))
                columns = [rows, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))]
                names = ["key", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def pack(df: DataFrame, groups: int, length: int = LENGTH) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` of at most `length` tokens, in so many groups.

    Columns of these two names in `df` are replaced.  Rows fall into groups by
    their values and their partition, so that equal rows, however many, do not
    meet in one group.
    """
    df = df.drop("sequence_id", "offset")
    group = free_name(df, "group")
    kinds = df.schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", sequence_id bigint, offset bigint"
    names = [f.name for f in kinds]

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part = part.select(names)
        # Rows in an order of their own, so that a task that is run again gives the same.
        part = part.sort_by([(n, "ascending") for n in names if not pa.types.is_nested(part.schema.field(n).type)])
        sequence, offset = best_fit(part["length"].to_pylist(), length)
        base = key[0].as_py() << 32
        return part.append_column("sequence_id", pa.array([base + s for s in sequence], pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    spread = F.pmod(F.xxhash64(F.spark_partition_id(), *[f.name for f in kinds if f.dataType.typeName() != "array"]), F.lit(groups))
    return df.withColumn(group, spread).groupBy(group).applyInArrow(run, out)


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", with_ids: bool = False, **options: object) -> DataFrame:
    """All pieces of all documents with their sequences and places."""
    n = docs.count()
    return pack(pieces(docs, key, text, with_ids=with_ids, **options), max(1, n // GROUP_ROWS))


def op4_bestfit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing of all documents into sequences of at most 4096 tokens."""
    return packed(table(spark, sf_dir, "documents"))
