"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A token's input is the sum of a word vector and of the mean of its character
n-gram vectors, both looked up by hash; word vectors begin with the word's log
odds in the training sample in one of their dimensions.  Two gated recurrent layers, one
for each direction, read a window of tokens; attention pools their states, and
a logistic unit gives the window's probability.  A text is cut into windows
that overlap by a quarter, all of them are scored, and the largest is the text's score.

The training sample is bounded (`SAMPLE` rows of each class, the least by a
hash of their key; of each a bounded number of windows a round): it meets in
one task, and the trained network alone comes to the driver.  Scoring covers
every window of every text.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import Scratch, bounded_batches, table

#: Rows of each class, of at most so many UTF-8 bytes, that training uses.
SAMPLE, SAMPLE_BYTES = 1000, 20_000
FOLDS, HELD_OUT = 5, 0
WINDOW, STRIDE = 64, 48
HIDDEN, INPUT = 8, 8
WORD_SLOTS, CHAR_SLOTS = 1 << 16, 1 << 14
#: Clean documents for each toxic one, where the network's bias is set.
CLEAN = 9
#: Character n-grams' length.
NGRAM = 3
ROUNDS, EPOCHS, BATCH, RATE = 3, 4, 256, 0.01


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Tokens:
    """Tokens of a block of texts: offsets by text, word slots, and character slots with offsets by distinct token."""

    offsets: np.ndarray
    which: np.ndarray
    word: np.ndarray
    chars: np.ndarray
    char_at: np.ndarray


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Runs of letters (ASCII ones, lower-cased, and all bytes beyond ASCII) and single other characters."""
    kind = _KIND[data]
    solid = kind > 0
    joined = (kind[1:] == 1) & (kind[:-1] == 1) if len(data) else np.zeros(0, bool)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts, ends = solid.copy(), solid.copy()
    if len(data):
        starts[1:] &= ~joined | edge[1:-1]
        ends[:-1] &= ~joined | edge[1:-1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    hashes, at, which = np.unique(words.span_hashes(data, first, last), return_index=True, return_inverse=True)
    # Character n-grams of the distinct tokens, each between marks of its beginning and end.
    low = words._LOWER[data]
    a, n = first[at], (last - first)[at]
    size = n + 2
    begin = np.cumsum(size) - size
    padded = np.full(int(size.sum()), 1, np.uint8)
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    padded[inner + np.repeat(begin + 1, n)] = low[inner + np.repeat(a, n)]
    count = np.maximum(size - NGRAM + 1, 1)
    char_begin = np.cumsum(count) - count
    from_ = np.arange(int(count.sum())) - np.repeat(char_begin, count) + np.repeat(begin, count)
    code = np.zeros(len(from_), np.uint64)
    for k in range(NGRAM):
        code = code * np.uint64(257) + padded[np.minimum(from_ + k, max(len(padded) - 1, 0))] if len(padded) else code
    chars = (words.mix(code) % np.uint64(CHAR_SLOTS)).astype(np.int64)
    return Tokens(np.searchsorted(first, offsets), which, (hashes % np.uint64(WORD_SLOTS)).astype(np.int64), chars, np.append(char_begin, len(chars)))


_KIND = np.full(256, 2, np.uint8)
_KIND[words._SPACE] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token of every window, and n+1 offsets into the windows by text; a text without tokens has none."""
    n = np.diff(offsets)
    count = np.where(n > WINDOW, -(-(n - WINDOW) // STRIDE) + 1, (n > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(count)])
    k = np.arange(at[-1]) - np.repeat(at[:-1], count)
    # The last window ends with the text.
    last = np.repeat(np.maximum(n - WINDOW, 0), count)
    return np.repeat(offsets[:-1], count) + np.minimum(k * STRIDE, last), at


class Network:
    """Parameters and passes. One padding token, with vector 0, stands at the end of the table of inputs."""

    def __init__(self, seed: int = 5):
        g = np.random.default_rng(seed)
        normal = lambda *s, scale=0.1: (g.standard_normal(s) * scale).astype(np.float32)
        # Tokens never trained on add nothing.
        self.p = {"word": np.zeros((WORD_SLOTS, INPUT), np.float32), "char": np.zeros((CHAR_SLOTS, INPUT), np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": normal(INPUT, 3 * HIDDEN, scale=0.4), f"U{d}": normal(HIDDEN, 3 * HIDDEN, scale=0.3), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": normal(2 * HIDDEN, HIDDEN, scale=0.3), "a": normal(HIDDEN, scale=0.5), "v": normal(2 * HIDDEN, scale=0.5), "v0": np.full(1, -1.0, np.float32)}

    def inputs(self, t: Tokens) -> np.ndarray:
        """A vector for each distinct token of the block, and 0 for padding."""
        out = np.zeros((len(t.word) + 1, INPUT), np.float32)
        if len(t.word):
            n = np.diff(t.char_at)[:, None]
            out[:-1] = self.p["word"][t.word] + np.add.reduceat(self.p["char"][t.chars], t.char_at[:-1]) / n
        return out

    def direction(self, gates: np.ndarray, index: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States (steps, windows, HIDDEN) of one direction; index: (steps, windows) rows of `gates`."""
        u, h = self.p[f"U{d}"], np.zeros((index.shape[1], HIDDEN), np.float32)
        out, kept = np.empty((*index.shape, HIDDEN), np.float32), []
        pad = len(gates) - 1
        for s in range(len(index)) if d == "f" else range(len(index) - 1, -1, -1):
            x = gates[index[s]]
            zr = x[:, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN]
            np.multiply(zr, 0.5, out=zr)
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            hu = h @ u[:, 2 * HIDDEN :]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * hu)
            real = (index[s] != pad)[:, None]
            z = np.where(real, z, 0)
            if keep:
                kept.append((s, h, z, r, n, hu, real))
            h = h + z * (n - h)
            out[s] = h
        return out, kept

    def gates(self, vectors: np.ndarray, d: str) -> np.ndarray:
        return vectors @ self.p[f"W{d}"] + self.p[f"c{d}"]

    def forward(self, vectors: np.ndarray, index: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple | None]:
        """Logit of each window (columns of index)."""
        (f, kf), (b, kb) = (self.direction(self.gates(vectors, d), index, d, keep) for d in "fb")
        h = np.concatenate([f, b], 2)
        e = np.tanh(h @ self.p["A"])
        s = e @ self.p["a"]
        s = np.where(index == len(vectors) - 1, -1e9, s)
        w = np.exp(s - s.max(0))
        w /= w.sum(0)
        pooled = np.einsum("sw,swh->wh", w, h)
        return pooled @ self.p["v"] + self.p["v0"][0], (h, e, w, pooled, kf, kb) if keep else None

    def backward(self, vectors: np.ndarray, index: np.ndarray, saved: tuple, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the dense parameters, and of `vectors`."""
        h, e, w, pooled, kf, kb = saved
        p, g = self.p, {}
        g["v"], g["v0"] = pooled.T @ dlogit, np.array([dlogit.sum()], np.float32)
        dpooled = dlogit[:, None] * p["v"]
        dw = np.einsum("wh,swh->sw", dpooled, h)
        dh = w[:, :, None] * dpooled
        ds = w * (dw - (w * dw).sum(0))
        g["a"] = np.einsum("sw,swk->k", ds, e)
        de = ds[:, :, None] * p["a"] * (1 - e * e)
        g["A"] = np.einsum("swh,swk->hk", h, de)
        dh = dh + de @ p["A"].T
        dvectors = np.zeros_like(vectors)
        flat = index.reshape(-1)
        order = np.argsort(flat, kind="stable")
        bounds = np.searchsorted(flat[order], np.arange(len(vectors)))
        for d, kept, part in (("f", kf, dh[:, :, :HIDDEN]), ("b", kb, dh[:, :, HIDDEN:])):
            u = p[f"U{d}"]
            du = np.zeros_like(u)
            dinput = np.empty((*index.shape, 3 * HIDDEN), np.float32)
            after = np.zeros((index.shape[1], HIDDEN), np.float32)
            for s, before, z, r, n, hu, real in reversed(kept):
                now = part[s] + after
                dn = now * z * (1 - n * n)
                dz = now * (n - before) * z * (1 - z) * real
                dr = dn * hu * r * (1 - r)
                dx = np.concatenate([dz, dr, dn], 1)
                dun = dn * r
                after = now * (1 - z) + dx[:, : 2 * HIDDEN] @ u[:, : 2 * HIDDEN].T + dun @ u[:, 2 * HIDDEN :].T
                du[:, : 2 * HIDDEN] += before.T @ dx[:, : 2 * HIDDEN]
                du[:, 2 * HIDDEN :] += before.T @ dun
                dinput[s] = dx
            dgates = _sum_rows(dinput.reshape(-1, 3 * HIDDEN), order, bounds, len(vectors))
            dgates[-1] = 0
            g[f"W{d}"], g[f"U{d}"], g[f"c{d}"] = vectors.T @ dgates, du, dgates.sum(0)
            dvectors += dgates @ p[f"W{d}"].T
        return g, dvectors

    def best_windows(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits of all windows of a block, in bounded batches, with their first tokens and offsets by text."""
        begin, at = windows(t.offsets)
        vectors = self.inputs(t)
        out = np.empty(len(begin), np.float32)
        for k in range(0, len(begin), 1024):
            out[k : k + 1024] = self.forward(vectors, self.index(t, begin[k : k + 1024]))[0]
        return out, begin, at

    def index(self, t: Tokens, begin: np.ndarray) -> np.ndarray:
        """(steps, windows) of distinct tokens; past the end of a text, padding."""
        place = begin + np.arange(WINDOW)[:, None]
        end = t.offsets[np.searchsorted(t.offsets, begin, side="right")]
        if not len(t.which):
            return np.zeros((WINDOW, 0), np.int64)
        return np.where(place < end, t.which[np.minimum(place, len(t.which) - 1)], len(t.word))


def train(texts: list[str], toxic: np.ndarray, seed: int = 5) -> Network:
    """A network that knows a text as toxic by its most toxic window.

    In each round, every text is represented by the window the network (at
    first, the words' log odds) finds most toxic, and clean ones by another
    window as well.
    """
    net, g = Network(seed), np.random.default_rng(seed)
    if not len(texts) or toxic.all() or not toxic.any():
        net.p["v"][:] = 0
        net.p["v0"][:] = 4.0 if len(texts) and toxic.all() else -4.0
        return net
    data, offsets = words.text_bytes(pa.array(texts, pa.large_string()))
    t = tokens(data, offsets)
    begin, at = windows(t.offsets)
    # Texts in which each distinct token occurs, by class.
    text_of = np.repeat(np.arange(len(texts)), np.diff(t.offsets))
    pairs = np.unique(text_of * np.int64(len(t.word)) + t.which)
    seen = np.stack([np.bincount(pairs % len(t.word), toxic[pairs // len(t.word)] == c, len(t.word)) for c in (0, 1)])
    odds = np.log((seen[1] + 0.5) / (toxic.sum() + 1)) - np.log((seen[0] + 0.5) / ((~toxic).sum() + 1))
    odds *= np.sqrt(seen.sum(0) / (seen.sum(0) + 8))
    strong = np.abs(odds) > 0.7
    net.p["word"][t.word[strong], 0] += np.clip(odds[strong], -3, 3).astype(np.float32)
    size = np.diff(at)
    full = size > 0
    weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum()) * len(texts)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    token_odds = np.append(np.maximum(odds, 0), 0).astype(np.float32)
    for round_ in range(ROUNDS):
        if round_ == 0:
            value = np.concatenate([token_odds[net.index(t, begin[k : k + 1024])].max(0) for k in range(0, len(begin), 1024)])
        else:
            value = net.best_windows(t)[0]
        owner = np.repeat(np.arange(len(texts)), size)
        order = np.lexsort((-value, owner))
        chosen = [order[at[:-1][full]]]
        clean = np.flatnonzero(full & ~toxic)
        chosen.append(at[clean] + (g.random(len(clean)) * size[clean]).astype(np.int64))
        every = np.concatenate(chosen)
        for _ in range(EPOCHS):
            g.shuffle(every)
            for k in range(0, len(every), BATCH):
                part = every[k : k + BATCH]
                which, index = np.unique(net.index(t, begin[part]), return_inverse=True)
                index = index.reshape(WINDOW, -1)
                pad = which[-1] == len(t.word)
                own = which[:-1] if pad else which
                sub_at = np.diff(t.char_at)[own]
                char_from = np.cumsum(sub_at) - sub_at
                chars = t.chars[np.arange(int(sub_at.sum())) - np.repeat(char_from, sub_at) + np.repeat(t.char_at[own], sub_at)]
                sub = Tokens(np.zeros(1, np.int64), which, t.word[own], chars, np.append(char_from, len(chars)))
                vectors = net.inputs(sub)
                logit, saved = net.forward(vectors, index, keep=True)
                label, wt = toxic[owner[part]], weight[owner[part]]
                wt = np.where(label, wt, wt / 2)
                grads, dvec = net.backward(vectors, index, saved, ((_sigmoid(logit) - label) * wt / len(part)).astype(np.float32))
                dvec = dvec[:-1]
                step += 1
                scale = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for name, grad in grads.items():
                    _adam(net.p[name], moment[name], slice(None), grad, scale)
                for name, slots, dv in (("word", sub.word, dvec), ("char", chars, np.repeat(dvec / sub_at[:, None], sub_at, 0))):
                    order = np.argsort(slots, kind="stable")
                    rows, first = np.unique(slots[order], return_index=True)
                    grad = np.add.reduceat(dv[order], first)
                    _adam(net.p[name], moment[name], rows, grad, scale)
    # The bias that errs least on the sample's texts, were toxic ones one in CLEAN + 1.
    logit = np.maximum.reduceat(net.best_windows(t)[0], at[:-1][full])
    label = toxic[full]
    order = np.argsort(logit)
    cost = np.append(0, np.cumsum(np.where(label[order], 1 / max(1, label.sum()), 0))) + np.append(np.cumsum(np.where(label[order], 0, CLEAN / max(1, (~label).sum()))[::-1])[::-1], 0)
    edges = np.concatenate([[logit[order[0]] - 1], (logit[order][1:] + logit[order][:-1]) / 2, [logit[order[-1]] + 1]])
    best = edges[cost == cost.min()]
    net.p["v0"] = (net.p["v0"] - (best[0] + best[-1]) / 2).astype(np.float32)
    return net


def _sum_rows(rows: np.ndarray, order: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each of n numbers; `order` sorts the rows by number, and bounds[k] is where number k begins."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    size = np.diff(np.append(bounds, len(order)))
    some = size > 0
    out[some] = np.add.reduceat(rows[order], bounds[some])
    return out


def _adam(value: np.ndarray, moment: tuple[np.ndarray, np.ndarray], rows: slice | np.ndarray, grad: np.ndarray, scale: float) -> None:
    m, v = moment
    m[rows] = 0.9 * m[rows] + 0.1 * grad
    v[rows] = 0.999 * v[rows] + 0.001 * grad * grad
    value[rows] -= scale * m[rows] / (np.sqrt(v[rows]) + 1e-7)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Network:
    """Trains on a bounded sample of labelled rows whose crc32(key as text) mod 5 is not 0.

    Rows of other labels than 0 and 1 and null keys are not used.  Of rows with
    one key, the label is the larger and the text the least.  The sample meets
    in one task, which trains; only the network, of fixed size, comes to the
    driver.  Without labelled rows all scores are low.
    """
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    fold = F.crc32(F.col("key").cast("string").cast("binary"))
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and key is not null")
    marked = marked.where(fold % FOLDS != HELD_OUT).groupBy("key").agg(F.max("label").alias("label")).withColumn("turn", F.xxhash64("key"))
    sizes = docs.select(F.col(key).alias("key"), F.octet_length(text).alias("size"), F.col(text).alias("text"))
    short = sizes.where(F.col("size") <= SAMPLE_BYTES)
    known = scratch.written(marked.join(short.select("key"), "key", "left_semi"), "labelled")
    first, second = (known.where(F.col("label") == c).orderBy("turn", "key").limit(SAMPLE) for c in (0, 1))
    picks = scratch.written(first.unionByName(second).select("key", "label"), "picks")
    sample = short.join(F.broadcast(picks), "key").groupBy("key").agg(F.min("text").alias("text"), F.first("label").alias("label"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        net = train([t for _, t, _ in rows], np.array([c for _, _, c in rows], bool))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net.p)], pa.binary())], names=["weights"])

    found = sample.coalesce(1).mapInArrow(learn, "weights binary").first()
    scratch.drop()
    net = Network()
    net.p = pickle.loads(found.weights) if found else train([], np.zeros(0, bool)).p
    return net


def with_scores(df: DataFrame, net: Network, text: str = "text", into: str = "score") -> DataFrame:
    """Adds the probability that a text is toxic, that of its most toxic window, as the column `into`.

    A text without tokens, empty or null, has that of a window of none.  Every
    row stays, repeated ones too, and equal texts have equal scores but for the
    last digits; a column `into` of `df` is replaced.  A long text is read in pieces of a few
    thousand windows.
    """
    bounded_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def judge(column: pa.Array) -> pa.Array:
        net, out = sent.value, []
        empty = float(_sigmoid(net.p["v0"])[0])
        for data, offsets in words.blocks(column, 1 << 20):
            value, _, at = net.best_windows(tokens(data, offsets))
            full = np.diff(at) > 0
            score = np.full(len(full), empty)
            if full.any():
                score[full] = _sigmoid(np.maximum.reduceat(value, at[:-1][full]).astype(np.float64))
            out.append(score)
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return df.withColumn(into, F.arrow_udf(judge, "double")(F.col(text)))


def op9_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = table(spark, sf_dir, "documents")
    scored = with_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
