"""Spelling variants: words one edit apart, each led to a much more frequent one.

Two words of one length are near if they are equal without their i-th letters;
a word is near a shorter one if that is left when a letter is deleted.  So each
word gives an integer key for each deleted place (and that place), a key for
each word that a deletion may leave, and one for itself.  Polynomial hashes of
all prefixes and suffixes give these for a whole batch of words at once.  Keys
are dealt by their high bits and sorted; runs of equal keys are candidates.
Only these meet their strings again, and are near if the strings without the
letter are equal, so hashes that collide do no harm.

No pairs are made.  Words equal without their i-th letters are all near each
other, so a group's size and its two most frequent words tell everything; the
group of a word and those that leave it is a star.  Groups are bounded by the
alphabet (90 letters) and, for stars, the word's length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words
from .common import Scratch, bounded_batches, table, written

#: Fixed values of the contract.
LETTERS, COUNT, DAMAGE, TIMES = 6, 5, 199, 5
#: Lead byte of U+00C0..U+00FF in UTF-8.
_LEAD = 0xC3
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[_LEAD] = True
#: Families of keys, by their lowest bit: equal but for one place, or left by a deletion.
PLACE, LEFT, OWN = 0, 1, 2
#: Longest run whose CRC is computed together with others'.
_SHORT = 48


def _crc_table() -> np.ndarray:
    """One step of CRC-32 (polynomial 0xEDB88320) for each byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_CRC = _crc_table()


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, text) of every maximal run of letters in UTF-8 bytes."""
    solid = _LETTER[data]
    solid[1:] |= data[:-1] == _LEAD
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:-1]
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return first, last, np.searchsorted(offsets, first, side="right") - 1


def run_crcs(data: np.ndarray, first: np.ndarray, last: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of bytes, each carried on from its seed; one place of all short spans at a time."""
    size = last - first
    order = np.argsort(-size, kind="stable")
    size, begin = size[order], first[order]
    state = seeds[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    long = int(np.searchsorted(-size, -_SHORT))
    for i in range(long):
        state[i] = zlib.crc32(data[begin[i] : begin[i] + size[i]].tobytes(), int(state[i] ^ np.uint32(0xFFFFFFFF))) ^ 0xFFFFFFFF
    for j in range(min(_SHORT, int(size[long]) if long < len(size) else 0)):
        n = int(np.searchsorted(-size, -j))  # spans longer than j
        byte = data[begin[long:n] + j]
        state[long:n] = _CRC[(state[long:n] ^ byte) & np.uint32(255)] ^ (state[long:n] >> np.uint32(8))
    out = np.empty(len(size), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _strings(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The spans as an Arrow string column."""
    size = last - first
    ends = np.cumsum(size)
    index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(data[index]))


def counted_words(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LETTERS, count: int = COUNT, damage: int | None = None) -> DataFrame:
    """word, n of all runs of `[A-Za-z\\u00C0-\\u00FF]` with A-Z lower-cased, of at least `letters` letters and `count` occurrences.

    With `damage`, a run whose crc32 of `<key>:<run>` it divides loses the
    letter at that number modulo its length.  Null texts have no words, null
    keys are written as nothing; repeated rows count each, other columns play
    no part, an empty table has no words.  Texts are read in blocks of 8 MB or
    one longer text, and each block's counts leave the worker; the rest is
    Spark's aggregation, partial before the shuffle.
    """
    bounded_batches(docs.sparkSession)

    def block(data: np.ndarray, offsets: np.ndarray, keys: list[str]) -> pa.RecordBatch:
        data = words._LOWER[data]
        first, last, owner = runs(data, offsets)
        lead = np.concatenate([[0], np.cumsum(data == _LEAD)])
        size = last - first - (lead[last] - lead[first])
        kept, hurt = size >= letters, np.zeros(len(first), bool)
        changed: dict[bytes, int] = {}
        if damage:
            seeds = np.array([zlib.crc32(f"{k}:".encode()) for k in keys], np.uint32)
            crc = run_crcs(data, first, last, seeds[owner])
            hurt = crc % np.uint32(damage) == 0
            for i in np.flatnonzero(hurt & (size > letters)).tolist():
                word = data[first[i] : last[i]].tobytes().decode()
                at = int(crc[i]) % len(word)
                changed[word[:at] + word[at + 1 :]] = changed.get(word[:at] + word[at + 1 :], 0) + 1
        first, last = first[kept & ~hurt], last[kept & ~hurt]
        _, at, n = np.unique(words.span_hashes(data, first, last, lower=False), return_index=True, return_counts=True)
        found = _strings(data, first[at], last[at])
        return pa.RecordBatch.from_arrays([pa.concat_arrays([found, pa.array(list(changed), pa.large_string())]).cast(pa.string()), pa.array([*n.tolist(), *changed.values()], pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, done = batch.column(0).to_pylist(), 0
            for data, offsets in words.blocks(batch.column(1), 8 << 20):
                yield block(data, offsets, keys[done : done + len(offsets) - 1])
                done += len(offsets) - 1

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def deletion_keys(column: pa.Array, letters: int = LETTERS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, index of the word, place, kind) of all keys of all words."""
    data, offsets = words.text_bytes(column)
    if not len(data):
        return words.EMPTY, *[np.zeros(0, np.int64)] * 3
    solid = data != _LEAD
    after = np.zeros(len(data), bool)
    after[1:] = ~solid[:-1]
    letter = np.where(after, data + np.uint8(0x40), data)[solid]  # code points: all are below 256
    offsets = np.concatenate([[0], np.cumsum(solid)])[offsets]
    up, down = words._powers(len(letter) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words._BYTE[letter] * up[: len(letter)])])
    a, b = offsets[:-1], offsets[1:]
    word = np.repeat(np.arange(len(a)), b - a)
    g = np.arange(len(letter))
    begin, end = a[word], b[word]
    # What is before the deleted place, and what is after it moved back by one.
    left = (total[g] - total[begin]) * down[begin] + (total[end] - total[g + 1]) * down[begin + 1]
    place = g - begin
    one = np.uint64(1)
    by_place = words.mix(left + words.mix(place.astype(np.uint64) + one)) & ~one
    # Of a run of one letter any deletion leaves the same word; and nothing shorter than `letters` is a word.
    leaves = (end - begin > letters) & ((place == 0) | (letter != np.roll(letter, 1)))
    shorter = words.mix(left[leaves]) | one
    own = words.mix((total[b] - total[a]) * down[a]) | one
    kinds = np.repeat([PLACE, LEFT, OWN], [len(g), len(shorter), len(a)])
    return np.concatenate([by_place, shorter, own]), np.concatenate([word, word[leaves], np.arange(len(a))]), np.concatenate([place, place[leaves], np.full(len(a), -1)]), kinds


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key others have too, with the word itself where it is left by deletions."""

    def chosen(rows: pa.Table) -> list[pa.RecordBatch]:
        key, kind = rows["key"].to_numpy(), rows["kind"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        good = (size > 1) & ((key[first] & 1 == 0) | (np.add.reduceat((kind == OWN).astype(np.int64), first) > 0))
        return rows.filter(pa.array(np.repeat(good, size))).combine_chunks().to_batches()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        start = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
        if start or (held and held[0].column(0)[0].as_py() != key[0]):
            if held and held[0].column(0)[0].as_py() != key[0]:
                yield from chosen(pa.Table.from_batches(held))
                held = []
            yield from chosen(pa.Table.from_batches([*held, batch.slice(0, start)])) if start else ()
            held = []
        held.append(batch.slice(start))
    if held:
        yield from chosen(pa.Table.from_batches(held))


def near_words(counted: DataFrame, scratch: Scratch, letters: int = LETTERS) -> DataFrame:
    """word, n_near, near, near_n of words with a near one: how many those are, and the most frequent (ties: the first in code-point order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, word, place, kind = deletion_keys(batch.column(1), letters)
            ids = batch.column(0).to_numpy()
            columns = [pa.array(key.view(np.int64)), pa.array(ids[word] if len(ids) else word), pa.array(place.astype(np.int32)), pa.array(kind.astype(np.int8))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "place", "kind"])

    schema = "key bigint, id bigint, place int, kind tinyint"
    named = counted.select(F.xxhash64("word").alias("id"), "word", "n")
    keys = named.select("id", "word").mapInArrow(run, schema)
    dealt = keys.repartition(F.shiftrightunsigned("key", 44)).sortWithinPartitions("key")
    return confirmed(scratch.written(dealt.mapInArrow(_candidates, schema), "candidates").join(named.hint("merge"), "id"))


def confirmed(members: DataFrame) -> DataFrame:
    """What `near_words` returns, from rows (key, place, kind, word, n) of candidates: strings decide, whatever else shares a key."""
    without = F.concat(F.expr("left(word, place)"), F.lit("\0"), F.expr("substring(word, place + 2)"))
    core = F.when(F.col("kind") == PLACE, without).when(F.col("kind") == LEFT, F.replace(without, F.lit("\0"))).otherwise(F.col("word"))
    group = Window.partitionBy("key", "core")
    order = group.orderBy(F.col("kind") != OWN, F.desc("n"), "word")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = F.struct((-F.col("n")).alias("less"), F.col("word").alias("near"), "kind")
    rows = members.withColumn("core", core).select(
        "word", "kind", F.row_number().over(order).alias("turn"), F.count("*").over(group).alias("size"), F.first(one).over(whole).alias("top"), F.nth_value(one, 2).over(whole).alias("next")
    )
    # A group that no word stands for is one of words that leave the same letters, but no word.
    rows = rows.where((F.col("size") > 1) & ((F.col("kind") == PLACE) | (F.col("top.kind") == OWN)))
    best = F.when(F.col("turn") == 1, F.col("next")).otherwise(F.col("top"))
    count = F.when(F.col("kind") == LEFT, 1).otherwise(F.col("size") - 1)
    rows = rows.select("word", count.alias("count"), F.struct(best["less"].alias("less"), best["near"].alias("near")).alias("best"))
    found = rows.groupBy("word").agg(F.sum("count").alias("n_near"), F.min("best").alias("best"))
    return found.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root: where following forms ends; each round doubles the steps taken, and counts on forms being more frequent than their words."""
    now = scratch.written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = now.join(on.hint("merge"), "root", "left")
        now = scratch.written(step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def spelling_forms(counted: DataFrame, times: int = TIMES, letters: int = LETTERS) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words with their counts n, as a table of its own.

    A word's form is its most frequent near word, if that is at least `times`
    as frequent; its root is where forms lead.  Words of any length may come;
    no words give no rows.  Other columns play no part.
    """
    bounded_batches(counted.sparkSession)
    scratch = Scratch(counted.sparkSession)
    counted = scratch.written(counted.select("word", "n"), "words")
    near = near_words(counted, scratch, letters)
    much = F.col("near_n") >= times * F.col("n")
    rows = scratch.written(
        counted.join(near.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(much, F.col("near")).alias("form"), F.when(much, F.col("near_n")).alias("form_n")), "forms"
    )
    ends = roots(rows.where("form IS NOT NULL"), scratch)
    out = written(rows.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "spelling")
    scratch.drop()
    return out


def op11_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of all words of all documents, after the contract's damage."""
    return spelling_forms(counted_words(table(spark, sf_dir, "documents"), damage=DAMAGE))
