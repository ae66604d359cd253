"""Language-model scoring by a weighted backoff automaton.

The model.  P1(w) = (c(w) + 1) / (N + V + 1).  For longer contexts h, with the
context h' that lacks h's first token,
    P(w | h) = (c(h w) + K P(w | h')) / (c(h) + K)   if c(h) > 0, else P(w | h').

The automaton.  Every context seen in training is a state, the empty one the
root.  An arc leads from h over w if h w was seen: it weighs log10 P(w | h),
and ends in the longest suffix of h w that is a state.  A failure arc leads
from h to h' and weighs log10 K / (c(h) + K).  The root has an arc over every
token.  A text is read from left to right: in its state, the automaton follows
failure arcs until there is an arc over the next token, takes it, and adds up
the weights on the way.

The work.  Documents fall by hash into chunks of bounded size.  A chunk asks
for the training counts of its distinct n-grams, and gives its own counts of
them, in one packed row for each range of n-gram hashes; each range adds up all
chunks' counts and answers each chunk in the order it asked.  A chunk then
builds exactly the part of the automaton that its documents can reach, whatever
the size of the whole, which exists only in pieces.  A frequent n-gram is one
entry of each chunk, however often it occurs.  Unigrams and bigrams are asked
for first, then each longer order by itself, so that no more than that is under
way at once.  N-grams are known by 63 bits of a hash, and a last bit that tells
single tokens from longer ones.

Chunks and ranges grow with the root of the input, so rows of questions grow in
proportion to it, up to `MOST_CHUNK` and `MOST_RANGE` bytes, which bound a
task's memory; beyond that (60 GB of text) there are more and shorter rows, but
no more than there are questions.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import Scratch, bounded_batches, table, written

ORDER = 3
#: Weight of the shorter context, in occurrences.
PRIOR = 200.0
#: Bytes of text in a chunk and of questions in a range: the least, and the most.
LEAST_CHUNK, MOST_CHUNK = 4_000_000, 32_000_000
LEAST_RANGE, MOST_RANGE = 16_000_000, 256_000_000
#: Tokens that one lane reads; a longer text is read by several lanes at once.
LANE = 256
FOLDS, HELD_OUT = 7, 2

_END, _BEGIN = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each token (a text's words and one end), and n+1 token offsets by text."""
    found, at = words.word_hashes(column)
    n = np.diff(at)
    offsets = at + np.arange(len(at))
    tokens = np.empty(len(found) + len(n), np.uint64)
    last = np.zeros(len(tokens), bool)
    last[offsets[1:] - 1] = True
    tokens[last], tokens[~last] = _END, found
    return tokens, offsets


def grams(tokens: np.ndarray, offsets: np.ndarray, order: int) -> list[np.ndarray]:
    """For each n up to `order` the hash of the n-gram that ends at each token (0: there is none). The first word follows a beginning."""
    place = np.arange(len(tokens)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = [tokens]
    before = np.empty_like(tokens)  # the (k-1)-gram that ends one token earlier
    for k in range(2, order + 1):
        before[1:], before[:1] = out[-1][:-1], 0
        if k == 2:
            before[place == 0] = _BEGIN
        longer = words.chain(words.chain(before, tokens), np.full(1, k, np.uint64))
        longer[place < k - 2] = 0
        out.append(longer)
    return out


def pack_counts(count: np.ndarray) -> tuple[bytes, bytes]:
    """One byte for each count, and eight more for those from 255 on."""
    return np.minimum(count, 255).astype(np.uint8).tobytes(), count[count >= 255].astype("<i8").tobytes()


def unpack_counts(small: bytes, large: bytes) -> np.ndarray:
    out = np.frombuffer(small, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(large, "<i8")
    return out


def _ranges(keys: np.ndarray, bits: int) -> np.ndarray:
    """2**bits + 1 offsets into sorted hashes, by their first bits."""
    if not bits:
        return np.array([0, len(keys)])
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(keys, edges), len(keys))


class _Asked:
    """The distinct n-grams of some orders in a chunk: sorted hashes, and for each order where its grams are among them."""

    def __init__(self, by_order: list[np.ndarray], orders: tuple[int, ...]):
        one = np.uint64(1)
        flat = [by_order[k - 1] | one if k == 1 else by_order[k - 1] & ~one for k in orders]
        if orders[0] == 1:
            flat.append(np.array([_BEGIN & ~one]))
        self.keys, self.which = np.unique(np.concatenate(flat), return_inverse=True)
        n = len(by_order[0])
        self.at = {k: self.which[i * n : (i + 1) * n] for i, k in enumerate(orders)}
        self.begin = int(self.which[-1]) if orders[0] == 1 else -1

    def counts(self, trains: np.ndarray, texts: int) -> np.ndarray:
        """How often the chunk's own training texts have each; 0 (no n-gram) does not count."""
        weight = np.tile(trains, len(self.at))
        if self.begin >= 0:
            weight = np.append(weight, texts)
        return np.bincount(self.which, weight, len(self.keys)).astype(np.int64) * (self.keys != 0)


def rounds(order: int) -> list[tuple[int, ...]]:
    """The orders that are asked for together."""
    return [tuple(range(1, min(order, 2) + 1)), *((k,) for k in range(3, order + 1))]


def sizes(total: int) -> tuple[int, int]:
    """Number of chunks, and bits of the number of ranges, for so many bytes of text."""
    grown = math.sqrt(total) * 128
    chunk = min(max(grown, LEAST_CHUNK), MOST_CHUNK)
    range_ = min(max(4 * grown, LEAST_RANGE), MOST_RANGE)
    # A byte of text has at most one token for two, and so one n-gram of each order for as many.
    return max(1, math.ceil(total / chunk)), max(0, math.ceil(math.log2(max(1.0, 1.5 * total / range_))))


_ASK = "bucket int, chunk bigint, keys binary, count binary, count_large binary"
_TELL = "chunk bigint, bucket int, count binary, count_large binary, n_tokens bigint, n_types bigint"


def _chunk(part: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's rows in one order, whichever way they came; whether each is held out; token hashes and their offsets."""
    part = part.sort_by([("key", "ascending"), ("text", "ascending")]).combine_chunks()
    return part, part["held_out"].to_numpy(zero_copy_only=False).astype(bool), *token_hashes(part["text"].combine_chunks())


def _asker(orders: tuple[int, ...], bits: int):
    def ask(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        _, held, tokens, offsets = _chunk(part)
        asked = _Asked(grams(tokens, offsets, orders[-1]), orders)
        count = asked.counts(np.repeat(~held, np.diff(offsets)), int((~held).sum()))
        at, out = _ranges(asked.keys, bits), []
        for b in range(1 << bits):
            s = slice(at[b], at[b + 1])
            if s.stop > s.start:
                out.append((b, key[0].as_py(), asked.keys[s].tobytes(), *pack_counts(count[s])))
        types = [pa.int32(), pa.int64(), *[pa.binary()] * 3]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["bucket", "chunk", "keys", "count", "count_large"])

    return ask


def _tell(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
    chunk = part["chunk"].to_pylist()
    keys = [np.frombuffer(x, np.uint64) for x in part["keys"].to_pylist()]
    counts = list(map(unpack_counts, part["count"].to_pylist(), part["count_large"].to_pylist()))
    found, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(which, np.concatenate(counts), len(found)).astype(np.int64)
    single = (found & np.uint64(1)).astype(bool)
    columns = list(zip(*(pack_counts(x) for x in np.split(total[which], np.cumsum([len(k) for k in keys])[:-1])), strict=True))
    first = [1] + [0] * (len(chunk) - 1)  # the range's sums stand in one of its rows
    n_tokens, n_types = int(total[single].sum()), int((total[single] > 0).sum())
    return pa.table({
        "chunk": pa.array(chunk, pa.int64()), "bucket": pa.array([key[0].as_py()] * len(chunk), pa.int32()),
        "count": pa.array(columns[0], pa.binary()), "count_large": pa.array(columns[1], pa.binary()),
        "n_tokens": pa.array([n_tokens * f for f in first], pa.int64()), "n_types": pa.array([n_types * f for f in first], pa.int64()),
    })


def score(df: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, prior: float = PRIOR, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; other columns play no part.

    Learns from the rows whose crc32(key as text) mod `folds` is not
    `held_out` (a null key counts as the empty text).  Null texts are empty,
    and have one token, their end.  Every row stays; repeated rows count as
    often as they occur and have equal scores.  A text longer than a chunk
    makes its chunk longer.  An empty table gives no rows.
    """
    bounded_batches(df.sparkSession)
    scratch = Scratch(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("key"), body.alias("text"))
    rows = rows.withColumn("held_out", F.crc32(F.coalesce(F.col("key").cast("string"), F.lit("")).cast("binary")) % folds == held_out)
    chunks, bits = sizes(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("key", "text"), F.lit(chunks)))
    told = []
    for turn, orders in enumerate(rounds(order)):
        asked = rows.groupBy("chunk").applyInArrow(_asker(orders, bits), _ASK)
        told.append(scratch.written(asked.groupBy("bucket").applyInArrow(_tell, _TELL).withColumn("turn", F.lit(turn)), "counts"))
    n_tokens, n_types = (x or 0 for x in told[0].agg(F.sum("n_tokens"), F.sum("n_types")).first())
    answers = told[0]
    for more in told[1:]:
        answers = answers.unionByName(more)

    def read(part: pa.Table, answers: pa.Table) -> pa.Table:
        part, held, tokens, offsets = _chunk(part)
        answers = answers.sort_by([("turn", "ascending"), ("bucket", "ascending")])
        by_order = grams(tokens, offsets, order)
        asked = [_Asked(by_order, orders) for orders in rounds(order)]
        count = np.concatenate(list(map(unpack_counts, answers["count"].to_pylist(), answers["count_large"].to_pylist())))
        if len(count) != sum(len(a.keys) for a in asked):
            raise RuntimeError("a chunk's answers do not fit its questions")
        automaton = Automaton(asked, count, offsets, order, n_tokens + n_types, prior)
        single = asked[0].at[1]
        sums = lambda x: np.add.reduceat(x, offsets[:-1])  # noqa: E731  every text has its end, so none is empty
        return pa.table({
            "key": part["key"], "held_out": part["held_out"], "n_tokens": pa.array(np.diff(offsets), pa.int64()), "n_known": pa.array(sums((count[single] > 0).astype(np.int64)), pa.int64()),
            "base_score": pa.array(sums(automaton.root_weight[single]), pa.float64()), "score": pa.array(automaton.read(single, offsets), pa.float64()),
        })

    schema = f"key {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    out = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(read, schema)
    out = out.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
    out = written(out, "scores")
    scratch.drop()
    return out


class Automaton:
    """The part of the automaton that a chunk's texts reach.

    State 0 is the root, state g + 1 the context that is n-gram g of the
    chunk.  Arcs are sorted by state * symbols + symbol, so that one search
    finds those of many lanes.  Symbols are the numbers of the single tokens.
    """

    def __init__(self, asked: list[_Asked], count: np.ndarray, offsets: np.ndarray, order: int, words_: int, prior: float):
        n, base, gram = int(offsets[-1]), 0, {}
        for a in asked:
            gram |= {k: at + base for k, at in a.at.items()}
            base += len(a.keys)
        begin, place = asked[0].begin, np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
        self.order, self.symbols = order, len(asked[0].keys)
        known = count[: self.symbols]
        self.root_weight = np.log10((known + 1) / (words_ + 1))
        self.root_to = np.where((known > 0) & (order > 1), np.arange(self.symbols) + 1, 0)
        self.fail_to = np.zeros(len(count) + 1, np.int64)
        self.fail_weight = np.zeros(len(count) + 1)
        self.fail_weight[1:] = np.log10(prior / (count + prior))
        self.start = begin + 1 if order > 1 and count[begin] > 0 else 0
        p = np.zeros(len(count))
        p[: self.symbols] = 10.0**self.root_weight
        keys, weights, ends = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        for k in range(2, order + 1):
            at = np.flatnonzero(place >= k - 2)
            where = np.full(len(count), -1, np.int64)  # one place at which each n-gram of this order ends
            where[gram[k][at]] = at
            g = np.flatnonzero((where >= 0) & (count > 0))
            t = where[g]
            context = np.where(place[t] == 0, begin, gram[k - 1][t - 1]) if k == 2 else gram[k - 1][t - 1]
            shorter = gram[k - 1][t]
            p[g] = (count[g] + prior * p[shorter]) / (count[context] + prior)
            keys.append((context + 1) * self.symbols + gram[1][t])
            weights.append(np.log10(p[g]))
            ends.append(g + 1 if k < order else shorter + 1)
            if k < order:
                self.fail_to[g + 1] = shorter + 1
        keys = np.concatenate(keys)
        by = np.argsort(keys)
        self.keys, self.weights, self.ends = np.append(keys[by], np.iinfo(np.int64).max), np.concatenate(weights)[by], np.concatenate(ends)[by]

    def read(self, tokens: np.ndarray, offsets: np.ndarray, lane: int = LANE) -> np.ndarray:
        """log10 probability of each text: its tokens read one after another, all texts at once.

        A text longer than a lane is read by several.  A state knows the last
        order - 1 tokens alone, so a lane that starts within a text first reads
        as many tokens before its own, whose weights do not count.
        """
        size = np.diff(offsets)
        count = -(-size // lane)
        text = np.repeat(np.arange(len(size)), count)
        own = offsets[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * lane
        end = np.minimum(own + lane, offsets[1:][text])
        first = np.maximum(own - (self.order - 1), offsets[:-1][text])
        by = np.argsort(first - end, kind="stable")  # the longest first, so that those still reading stand in front
        text, own, end, first = text[by], own[by], end[by], first[by]
        steps = end - first
        state = np.where(first == offsets[:-1][text], self.start, 0)
        total = np.zeros(len(text))
        for step in range(int(steps[0]) if len(steps) else 0):
            n = int(np.searchsorted(-steps, -step, side="left"))
            symbol, weight = tokens[first[:n] + step], np.zeros(n)
            lanes = np.arange(n)
            while len(lanes):
                lanes = lanes[state[lanes] != 0]  # those at the root are done: it has every arc
                sought = state[lanes] * self.symbols + symbol[lanes]
                arc = np.searchsorted(self.keys, sought)
                hit = self.keys[arc] == sought
                found, arc = lanes[hit], arc[hit]
                weight[found] += self.weights[arc]
                state[found], symbol[found] = self.ends[arc], -1
                lanes = lanes[~hit]
                weight[lanes] += self.fail_weight[state[lanes]]
                state[lanes] = self.fail_to[state[lanes]]
            at_root = np.flatnonzero(symbol >= 0)
            weight[at_root] += self.root_weight[symbol[at_root]]
            state[at_root] = self.root_to[symbol[at_root]]
            total[:n] += np.where(first[:n] + step >= own[:n], weight, 0.0)
        return np.bincount(text, total, len(size))


def op2_backoff_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the model of those not held out."""
    return score(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
