"""MinHash near-duplicate detection with b-bit signatures.

1. Each document's shingle set gives minima under `ROWS * BANDS` hash
   functions: a key for each band of ROWS minima, and the low bits of all
   minima packed into a short signature.
2. Equal sets become one class, with a number of its own.
3. Classes that share a band key are candidates.  Within a key, each class is
   paired with the key's least number, so the pairs grow with the classes and
   not with their square.  Pairs whose sizes, or whose signatures' collision-
   corrected similarity, rule a link out are dropped; the rest are confirmed on
   the full sets, which are made anew from the text.
4. Where a candidate was not linked to its key's least class, it may still be
   to another class of the key.  Those outside of the least class's component
   meet all members of the key, tile by tile: signatures first tell which
   classes have a possible partner in another component, then those classes'
   full sets meet, and only links that join two components leave the task.  So
   a group of copies costs its outsiders times its members.  A key with more
   than `HOT` outsiders (documents from one form, alike but not linked) is cut
   up first: its members' keys are the rarest shingles of their full sets, as
   many as a linked set can't do without (prefix filtering), and steps 3 and 4
   are taken on these, however many share one.
5. Components of the confirmed links, spread over each class's rows.

A pair at the threshold 0.8 misses all bands with a chance below
(1 - 0.8**5)**32 = 3e-6, and no key of a cut up band is left to chance; the
signature's allowance is six standard deviations.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import Scratch, bounded_batches, table, written
from .components import components

BANDS, ROWS, BITS = 32, 5, 2
SIGMAS = 6
#: Classes of one band key that one task compares with as many others.
TILE = 2048
#: Classes of a band key outside of its least class's component, beyond which the key is cut up; classes of a shingle
#: that are compared as plain pairs then.
HOT, FEW = 16384, 32
#: Bits of the filter that goes before joins with texts: 8 MB.
MOST_BITS = 1 << 26

_RANDOM = np.random.default_rng(99)
_XOR = _RANDOM.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_TIMES = _RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PAIRS = np.uint8(0x55)


def signatures(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the non-empty sets in sets[at[i]:at[i+1]]: band keys (n, BANDS) and packed low bits (n, bytes)."""
    n = len(at) - 1
    least = np.empty((BANDS * ROWS, n), np.uint64)
    for k in range(BANDS * ROWS):
        np.minimum.reduceat((sets ^ _XOR[k]) * _TIMES[k], at[:-1], out=least[k])
    keys = np.empty((n, BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(n, b, np.uint64)
        for r in range(ROWS):
            key = words.chain(key, least[b * ROWS + r])
        keys[:, b] = key
    low = (words.mix(least.T) & np.uint64(2**BITS - 1)).astype(np.uint8)
    bits = np.stack([(low >> k) & 1 for k in range(BITS)], 2).reshape(n, -1)
    return keys, np.packbits(bits, axis=1)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimates from packed signatures along the last axis: the share of equal groups of low bits, corrected for chance."""
    other = a ^ b
    differ = (other | other >> 1) & _PAIRS
    same = 1 - np.bitwise_count(differ).sum(-1, dtype=np.int64) / (BANDS * ROWS)
    chance = 2.0**-BITS
    return (same - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    """Estimates below this rule out a similarity of `percent` hundredths."""
    chance, j = 2.0**-BITS, percent / 100
    same = j + (1 - j) * chance
    return j - SIGMAS * math.sqrt(same * (1 - same) / (BANDS * ROWS)) / (1 - chance)


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """id, text, row: a hash of both, that tells rows apart unless they are the same."""
    return df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).withColumn("row", F.xxhash64("id", "text"))


def sketches(rows: DataFrame, width: int) -> DataFrame:
    """id, row, n (size of the set), digest, bands, sig; a text without words has n 0 and nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for _, offsets in words.blocks(batch.column(2)):
                rows = len(offsets) - 1
                sets, at = words.shingle_sets(batch.column(2).slice(done, rows), width)
                size = np.diff(at)
                full = np.flatnonzero(size)
                digest, bands, sig = [None] * rows, [None] * rows, [None] * rows
                if len(full):
                    keys, packed = signatures(sets, np.append(at[:-1][full], at[-1]))
                    for j, i in enumerate(full.tolist()):
                        digest[i] = _digest(sets[at[i] : at[i + 1]])
                        bands[i], sig[i] = keys[j].view(np.int64), packed[j].tobytes()
                given = [batch.column(k).slice(done, rows) for k in (0, 1)]
                made = [pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())]
                yield pa.RecordBatch.from_arrays([*given, *made], names=["id", "row", "n", "digest", "bands", "sig"])
                done += rows

    return rows.select("id", "row", "text").mapInArrow(run, "id bigint, row bigint, n bigint, digest binary, bands array<bigint>, sig binary")


def _sets(df: DataFrame, width: int) -> DataFrame:
    """node, set (its hashed shingles as bytes) of rows (node, digest, text), for texts whose set has the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for _, offsets in words.blocks(batch.column(2)):
                rows = len(offsets) - 1
                sets, at = words.shingle_sets(batch.column(2).slice(done, rows), width)
                wanted = batch.column(1).slice(done, rows).to_pylist()
                whole = [sets[a:b].tobytes() if _digest(sets[a:b]) == d else None for a, b, d in zip(at[:-1].tolist(), at[1:].tolist(), wanted, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, rows), pa.array(whole, pa.binary())], names=["node", "set"])
                done += rows

    return df.select("node", "digest", "text").mapInArrow(run, "node bigint, set binary").where("set is not null")


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, digest, text of the rows whose hash is one of `wanted` (node, row, digest; a stored table, read three times).

    A Bloom filter goes first, so that the join moves few other texts. It has
    at most MOST_BITS bits, however many there are; the join is exact.
    """
    bits = min(MOST_BITS, 1 << max(10, (12 * wanted.count()).bit_length()))
    places = [F.pmod(F.xxhash64("row", F.lit(k)), F.lit(bits)) for k in range(2)]
    filled = wanted.select(F.explode(F.array(*places)).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    found, table_ = filled.toArrow(), np.zeros(bits // 64, np.int64)
    table_[found["w"].to_numpy()] = found["b"].to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(table_)

    def might(a: pa.Array, b: pa.Array) -> pa.Array:
        hit = [(sent.value[p >> 6] >> (p & 63)) & 1 for p in (a.to_numpy(), b.to_numpy())]
        return pa.array((hit[0] & hit[1]).astype(bool))

    return rows.where(F.arrow_udf(might, "boolean")(*places)).join(wanted.hint("merge"), "row").select("node", "digest", "text")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection reaches percent * union, in whole numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """key, n_shingles, component_id, kept of each row of `df`; other columns play no part.

    Rows are linked if their sets of distinct `width`-word shingles have a
    similarity of percent / 100 or more, or if their keys are equal.
    component_id is the least key reachable, kept whether that is the row's
    own.  A row without words is linked with nothing, its component is its own
    key.  Rows with a null key take part like others, but links between them
    are by text alone; they are kept if no row of their component has a key
    (component_id is then null).  Repeated rows have equal results.  An empty
    table gives no rows; texts are read whole, however long.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    rows = _rows(df, key, text)
    light = scratch.written(sketches(rows, width), "sketches")
    one = light.where("n > 0").groupBy("digest").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    # Numbers of a stored table: a task that is run again before it is stored gives new ones to all its rows.
    classes = scratch.written(one.withColumn("node", F.monotonically_increasing_id()), "classes")
    nodes = light.where("n > 0").select("id", "digest").join(classes.select("digest", "node").hint("merge"), "digest").select("id", "node")
    # Rows with equal keys and other texts: an edge for each further class of a key.
    several = light.where("n > 0 and id is not null").groupBy("id").agg(F.min(F.xxhash64("digest")).alias("a"), F.max(F.xxhash64("digest")).alias("b")).where("a != b").select("id")
    keyed = nodes.join(several.hint("merge"), "id").distinct()
    same_key = keyed.join(keyed.groupBy("id").agg(F.min("node").alias("u")).hint("merge"), "id").select("u", F.col("node").alias("v")).where("u != v").distinct()
    search = _Search(scratch, rows, classes, width, percent)
    edges = scratch.written(search.links(classes.select("node", F.explode("bands").alias("band")), same_key), "links")
    found = components(edges, scratch)
    # Of every class its component, of every component its least key.
    spread = scratch.written(classes.select("digest", "node").join(found.hint("merge"), F.col("node") == F.col("id"), "left").select("digest", F.coalesce("component", "node").alias("component")), "spread")
    full = light.where("n > 0").select("id", "n", "digest").join(spread.hint("merge"), "digest").select("id", "n", "component")
    least = full.groupBy("component").agg(F.min("id").alias("component_id"))
    named = full.join(least.hint("merge"), "component").select("id", "n", "component_id")
    empty = light.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    out = named.unionByName(empty).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")
    out = written(out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.col("component_id").isNull())), "near-duplicates")
    scratch.drop()
    return out


class _Search:
    """Links between classes that share a band key."""

    def __init__(self, scratch: Scratch, rows: DataFrame, classes: DataFrame, width: int, percent: int):
        self.scratch, self.rows, self.classes, self.width, self.percent = scratch, rows, classes, width, percent
        self.allowed, self.short = least_estimate(percent), classes.select("node", "n", "sig")

    def sets_of(self, nodes: DataFrame) -> DataFrame:
        """node, set of distinct nodes."""
        wanted = self.scratch.written(nodes.join(self.classes.select("node", "row", "digest").hint("merge"), "node"), "wanted")
        made = _sets(_texts(self.rows, wanted), self.width)
        return self.scratch.written(made.groupBy("node").agg(F.first("set").alias("set")), "sets")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The (u, v) of the stored `pairs` that are linked."""
        percent = self.percent

        def confirm(a: pa.Array, b: pa.Array) -> pa.Array:
            both = zip(a.to_pylist(), b.to_pylist(), strict=True)
            return pa.array([linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in both], pa.bool_())

        sets = self.sets_of(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
        a, b = sets.select(F.col("node").alias("u"), F.col("set").alias("set_u")), sets.select(F.col("node").alias("v"), F.col("set").alias("set_v"))
        return pairs.join(a.hint("merge"), "u").join(b.hint("merge"), "v").where(F.arrow_udf(confirm, "boolean")("set_u", "set_v")).select("u", "v")

    def links(self, keys: DataFrame, known: DataFrame, cut: bool = True) -> DataFrame:
        """(u, v): `known` links, and such confirmed ones that all classes that rows (node, band) of `keys` bring together
        are connected if their links connect them.  cut: whether hot keys may be cut up."""
        scratch, percent, allowed = self.scratch, self.percent, self.allowed
        leaders = keys.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("members")).where("members > 1")
        members = scratch.written(keys.join(leaders.hint("merge"), "band"), "band-members")
        stars = members.where("node != leader").select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct()
        near = (
            stars.join(self.short.toDF("u", "n_u", "sig_u").hint("merge"), "u").join(self.short.toDF("v", "n_v", "sig_v").hint("merge"), "v")
            .where(_sized(percent)).where(F.arrow_udf(_possible(allowed), "boolean")("sig_u", "sig_v")).select("u", "v")
        )
        first = scratch.written(self.confirmed(scratch.written(near, "near")).unionByName(known).distinct(), "links")
        found = scratch.written(components(first, scratch), "components")

        # Members outside of their leader's component, and the keys that have any.
        of = found.select(F.col("id").alias("node"), "component")
        owner = members.join(of.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        leading = of.select(F.col("node").alias("leader"), F.col("component").alias("leading"))
        owner = scratch.written(owner.join(leading.hint("merge"), "leader", "left").withColumn("outside", F.col("component") != F.coalesce("leading", "leader")).drop("leading", "leader"), "owners")
        open_ = scratch.written(owner.where("outside").groupBy("band").agg(F.count("*").alias("outsiders")), "open-bands")
        largest = open_.agg(F.max("outsiders")).first()[0]
        if not largest:
            return first
        if cut and largest > HOT:
            hot = open_.where(F.col("outsiders") > HOT).select("band")
            nodes = scratch.written(owner.join(hot.hint("merge"), "band", "left_semi").select("node").distinct(), "hot-nodes")
            first = scratch.written(self.linked_by_prefixes(nodes, first), "links")
            open_ = open_.where(F.col("outsiders") <= HOT)
            found = scratch.written(components(first, scratch), "components")
            of = found.select(F.col("id").alias("node"), "component")
            owner = owner.drop("component").join(of.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        rows = owner.join(open_.hint("merge"), "band").join(self.short.hint("merge"), "node")
        partnered = scratch.written(_partnered(rows, percent, allowed), "partnered")
        if partnered.isEmpty():
            return first
        # Classes connected by such keys are one family, whose open pairs are confirmed together.
        chains = partnered.join(partnered.groupBy("band").agg(F.min("node").alias("u")).hint("merge"), "band").select("u", F.col("node").alias("v")).distinct()
        family = scratch.written(components(chains, scratch).select(F.col("id").alias("node"), F.col("component").alias("family")), "families")
        family = family.join(family.groupBy("family").agg(F.count("*").alias("members")).hint("merge"), "family")
        family = family.join(of.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        sets = self.sets_of(family.select("node"))
        rows = scratch.written(family.join(self.short.hint("merge"), "node").join(sets.hint("merge"), "node"), "family-sets")
        return first.unionByName(scratch.written(_confirmed(rows, percent, allowed), "links"))

    def linked_by_prefixes(self, nodes: DataFrame, known: DataFrame) -> DataFrame:
        """`known` links, and such as connect all of the distinct `nodes` that links connect, without any chance: nodes are
        known by the shingles of their prefixes.

        Shingles are ordered by the nodes that have them, the rarest first.  Sets whose similarity reaches the threshold
        share so many that each has one of these among the first that it may not leave out.  Nodes of a shingle of up to
        `FEW` all meet, those of others as classes of a band key do.
        """
        scratch, percent, allowed = self.scratch, self.percent, self.allowed

        def items(sets: pa.Array) -> pa.Array:
            at = np.cumsum([0, *(len(x) // 8 for x in sets.to_pylist())], dtype=np.int64)
            return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(sets.to_pylist()), np.int64)))

        each = scratch.written(self.sets_of(nodes).select("node", F.explode(F.arrow_udf(items, "array<bigint>")("set")).alias("band")), "shingles")
        often = each.groupBy("band").agg(F.count("*").alias("members"))
        ranked = each.join(often.hint("merge"), "band").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("members", "band"))).alias("by"))
        prefix = F.slice("by", F.lit(1), F.expr(f"cast(size(by) - ({percent} * size(by) + 99) div 100 + 1 as int)"))
        keys = scratch.written(ranked.select("node", F.explode(prefix).alias("k")).select("node", "k.band", "k.members").where("members > 1"), "prefixes")
        few = keys.where(F.col("members") <= FEW).join(self.short.hint("merge"), "node").select("band", "node", "n", "sig")
        few = scratch.written(few, "rare")
        a, b = few.toDF("band", "u", "n_u", "sig_u"), few.toDF("band", "v", "n_v", "sig_v")
        pairs = a.join(b.hint("merge"), "band").where("u < v").where(_sized(percent)).where(F.arrow_udf(_possible(allowed), "boolean")("sig_u", "sig_v"))
        rare = self.confirmed(scratch.written(pairs.select("u", "v").distinct(), "near"))
        first = scratch.written(known.unionByName(rare).distinct(), "links")
        return self.links(keys.where(F.col("members") > FEW).select("node", "band"), first, cut=False)


def _sized(percent: int) -> Column:
    """Whether the sizes n_u and n_v allow a link."""
    return F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent


def _possible(allowed: float) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """Whether two columns of signatures allow a link."""

    def possible(sa: pa.Array, sb: pa.Array) -> pa.Array:
        a, b = (np.array([np.frombuffer(x, np.uint8) for x in c.to_pylist()], np.uint8).reshape(len(c), -1) for c in (sa, sb))
        return pa.array(similarity(a, b) >= allowed)

    return possible


def _tile_of(n: Column, by: str) -> tuple[Column, Column]:
    """How many tiles a group of n makes, and the one that a row is in."""
    tiles = F.ceil(n / TILE).cast("int")
    return tiles, F.pmod(F.xxhash64(by), tiles).cast("int")


def _tiled(rows: DataFrame) -> DataFrame:
    """Rows with `members` (the size of their group) as often as their tile meets another: a, step and side are added.

    Tile t is side 0 of the meetings (t, 0), (t, 1), ... up to half way around,
    and side 1 of those of the tiles before it.  A group of one tile meets itself.
    """
    tiles, tile = _tile_of(F.col("members"), "node")
    out = rows.withColumn("tiles", tiles).withColumn("tile", tile)
    steps = F.sequence(F.lit(0), F.floor(F.col("tiles") / 2).cast("int"))
    at = F.flatten(F.transform(steps, lambda s: F.array(
        F.struct(F.col("tile").alias("a"), s.alias("step"), F.lit(0).alias("side")),
        F.struct(F.pmod(F.col("tile") - s, F.col("tiles")).cast("int").alias("a"), s.alias("step"), F.lit(1).alias("side")),
    )))
    return out.withColumn("at", F.explode(at)).select(*rows.columns, "at.a", "at.step", "at.side")


def _tiled_outsiders(rows: DataFrame) -> DataFrame:
    """Rows with `members` and `outsiders` (of their band) and `outside`: each tile of outsiders (side 0) meets each tile of members (side 1)."""
    out_tiles, out_tile = _tile_of(F.col("outsiders"), "node")
    all_tiles, all_tile = _tile_of(F.col("members"), "node")
    to = lambda tiles: F.sequence(F.lit(0), tiles - 1)
    left = rows.where("outside").withColumn("step", F.explode(to(all_tiles))).withColumn("a", out_tile).withColumn("side", F.lit(0))
    right = rows.withColumn("a", F.explode(to(out_tiles))).withColumn("step", all_tile).withColumn("side", F.lit(1))
    return left.unionByName(right)


class _Tile:
    """The two sides of a meeting of tiles, as arrays."""

    def __init__(self, part: pa.Table, percent: int, allowed: float):
        side = part["side"].to_numpy()
        sig = np.array([np.frombuffer(x, np.uint8) for x in part["sig"].to_pylist()], np.uint8).reshape(len(side), -1)
        self.rows = tuple(np.flatnonzero(side == s) for s in (0, 1))
        self.sig = tuple(sig[r] for r in self.rows)
        self.id, self.component, self.n = (tuple(part[c].to_numpy()[r] for r in self.rows) for c in ("node", "component", "n"))
        self.percent, self.allowed = percent, allowed

    def partners(self, i: int, component: np.ndarray, own: int) -> np.ndarray:
        """Places on the right, of other components than `own`, that sizes and signatures allow a link with place i on the left."""
        n, other = self.n[0][i], self.n[1]
        at = np.flatnonzero((component != own) & (np.minimum(n, other) * 100 >= np.maximum(n, other) * self.percent))
        return at[similarity(self.sig[0][i], self.sig[1][at]) >= self.allowed] if len(at) else at


def _partnered(open_: DataFrame, percent: int, allowed: float) -> DataFrame:
    """(band, node) of the rows that have a possible partner in another component of their band; the pairs themselves go nowhere."""

    def screen(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        tile = _Tile(part, percent, allowed)
        left, right = np.zeros(len(tile.id[0]), bool), np.zeros(len(tile.id[1]), bool)
        for i in range(len(left)):
            at = tile.partners(i, tile.component[1], tile.component[0][i])
            left[i] = len(at) > 0
            right[at] = True
        ids = np.unique(np.concatenate([tile.id[0][left], tile.id[1][right]]))
        return pa.table({"band": pa.array([key[0].as_py()] * len(ids), pa.int64()), "node": pa.array(ids, pa.int64())})

    rows = _tiled_outsiders(open_).select("band", "a", "step", "side", "node", "component", "n", "sig")
    return rows.groupBy("band", "a", "step").applyInArrow(screen, "band bigint, node bigint").distinct()


def _confirmed(rows: DataFrame, percent: int, allowed: float) -> DataFrame:
    """(u, v): confirmed links that connect all the components of each family that links connect, one for each step.

    Wants node, family, members, component, n, sig and set.  Within a meeting of
    tiles, components grow as links are found, and pairs inside of one are not
    looked at; sets are counted against each other all at once.
    """

    def confirm(part: pa.Table) -> pa.Table:
        tile = _Tile(part, percent, allowed)
        names, parent = np.unique(np.concatenate(tile.component), return_inverse=True)
        own, other = parent[: len(tile.id[0])].copy(), parent[len(tile.id[0]) :].copy()
        sets = [np.frombuffer(x, np.uint64) for x in part["set"].to_pylist()]
        values, dense = np.unique(np.concatenate(sets), return_inverse=True)
        at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        mark, us, vs = np.zeros(len(values), bool), [], []
        for i in range(len(own)):
            near = tile.partners(i, other, own[i])
            if not len(near):
                continue
            mine = dense[at[tile.rows[0][i]] : at[tile.rows[0][i] + 1]]
            mark[mine] = True
            where = tile.rows[1][near]
            size = at[where + 1] - at[where]
            begin = np.cumsum(size) - size
            both = np.add.reduceat(mark[dense[np.arange(int(size.sum())) - np.repeat(begin - at[where], size)]].astype(np.int64), begin)
            mark[mine] = False
            for j in near[100 * both >= percent * (len(mine) + size - both)].tolist():
                if other[j] != own[i]:
                    us.append(min(tile.id[0][i], tile.id[1][j]))
                    vs.append(max(tile.id[0][i], tile.id[1][j]))
                    gone, stays = other[j], own[i]
                    own[own == gone], other[other == gone] = stays, stays
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return _tiled(rows).groupBy("family", "a", "step").applyInArrow(confirm, "u bigint, v bigint")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)
