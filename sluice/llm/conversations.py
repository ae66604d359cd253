"""Repair of conversations: the cheapest edits after which roles alternate.

A conversation's turns are read once from left to right.  Four grammar states
(nothing yet, after a system, a user, an assistant turn) each carry the least
(cost, audit string) that leads to them; every turn's layer is closed with at
most two inserted turns.  Costs are kept relative to the layer's least one and
audit strings by their rank in the layer, so a step is a lookup in a small
table, and each turn notes for each state what led to it.  A second reading,
from right to left, follows the notes from the best end and names each turn's
edit.

Readings are streams over rows that Spark has dealt by conversation and sorted,
spilling where they are many.  A worker holds a batch and one layer, never a
conversation.  A conversation's turns do pass through one task, as their
order is what the repair is about.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, table

#: Fixed values of the contract: costs of edits, and what an undeleted truncated turn adds.
COST = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
SPACE = " \t\n\x0b\f\r"

#: States: 0 nothing yet, 1 after a system turn, 2 after a user turn, 3 after an assistant turn.
ACCEPT = (0, 3)
#: What a turn with the given initial does from each state; others do not fit.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The role that an inserted or changed turn must have after each state, and the state it leads to.
ROLE = ("user", "user", "assistant", "user")
AFTER = (2, 2, 3, 2)
INITIALS = "sua?"

Layer = tuple[tuple[int, int] | None, ...]
START: Layer = ((0, 0), None, None, None)


def _closed(layer: Layer) -> dict[int, tuple[int, int, str, int]]:
    """state -> least (cost, rank of the string, inserted letters, state before them), with up to two inserted turns."""
    best: dict[int, tuple[int, int, str, int]] = {}
    for base, entry in enumerate(layer):
        if entry is None:
            continue
        state = base
        for k in range(3):
            found = (entry[0] + k * COST["I"], entry[1], "I" * k, base)
            if state not in best or found < best[state]:
                best[state] = found
            state = AFTER[state]
    return best


@functools.cache
def step(layer: Layer, initial: str, gone: bool, truncated: bool) -> tuple[Layer, int, int]:
    """(next layer, what its costs are relative to, note of what led to each state) after one turn.

    Strings of one layer end in the letter of the layer's turn, so none begins
    another one: their order is that of their ranks, and then of what follows.
    A state that can be had more cheaply by inserting goes, and so does one
    that is dearer than the state after an assistant turn, with the cost of a
    system turn's deletion for the empty one; so costs stay within a few units
    and the table of steps stays small.
    """
    found: dict[int, tuple[int, int, str, int]] = {}
    for state, (cost, rank, inserted, base) in _closed(layer).items():
        moves = [(state, COST["D"], "D")]
        if not gone:
            extra = TRUNCATED if truncated else 0
            moves.append((AFTER[state], COST["R"] + extra, "R"))
            if (state, initial) in STEP:
                moves.append((STEP[state, initial], COST["K"] + extra, "K"))
        for to, more, letter in moves:
            new = (cost + more, rank, inserted + letter, base)
            if to not in found or new < found[to]:
                found[to] = new
    ranks = {s: r for r, s in enumerate(sorted(found, key=lambda s: found[s][1:3]))}
    layer = tuple((found[s][0], ranks[s]) if s in found else None for s in range(4))
    closed = _closed(layer)
    assistant = closed[3][0] if 3 in closed else None
    limit = {} if assistant is None else {0: assistant + COST["D"], 1: assistant}
    kept = {s for s in found if closed[s][3] == s and not closed[s][2] and found[s][0] <= limit.get(s, found[s][0])}
    least = min(found[s][0] for s in kept)
    note = 0
    for s in kept:
        _, _, letters, base = found[s]
        note |= (base | (len(letters) - 1) << 2 | "DKR".index(letters[-1]) << 4) << (8 * s)
    return tuple((found[s][0] - least, ranks[s]) if s in kept else None for s in range(4)), least, note


def end(layer: Layer) -> tuple[int, int]:
    """(state before the last inserted turns, their number) of the best complete conversation."""
    closed = _closed(layer)
    _, _, inserted, base = min(closed[s] for s in ACCEPT if s in closed)
    return base, len(inserted)


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `n` and `note` to turns in their order; each conversation ends with a row of its own, without a turn."""
    open_, current, layer, n = False, None, START, 0
    names: list[str] = []
    schema: pa.Schema | None = None

    def ends(rows: list[tuple]) -> pa.RecordBatch:
        columns = {"conv": [r[0] for r in rows], "n": [r[1] for r in rows], "note": [r[2] for r in rows]}
        return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * len(rows)), f.type) for f in schema], schema=schema)

    for batch in batches:
        if schema is None:
            names = batch.schema.names
            schema = pa.schema([*(pa.field(f.name, f.type) for f in batch.schema), pa.field("n", pa.int64()), pa.field("note", pa.int32())])
        done, numbers, notes = [], [], []
        for conv, kind in zip(batch.column(names.index("conv")).to_pylist(), batch.column(names.index("kind")).to_pylist(), strict=True):
            if not open_ or conv != current:
                if open_:
                    base, k = end(layer)
                    done.append((current, n, base | k << 2))
                open_, current, layer, n = True, conv, START, 0
            layer, _, note = step(layer, INITIALS[kind >> 2], bool(kind & 2), bool(kind & 1))
            numbers.append(n)
            notes.append(note if note < 1 << 31 else note - (1 << 32))
            n += 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64()), pa.array(notes, pa.int32())], schema=schema)
        if done:
            yield ends(done)
    if open_:
        base, k = end(layer)
        yield ends([(current, n, base | k << 2)])


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits from rows in reverse order: each turn's, and the turns inserted before it."""
    state, inserts = 0, 0
    for batch in batches:
        out: dict[str, list] = {"take": [], "place": [], "edit": [], "role": []}

        def edit(i: int, place: int, letter: str, role: str | None, out: dict[str, list] = out) -> None:
            for name, value in zip(out, (i, place, letter, role), strict=True):
                out[name].append(value)

        def inserted(i: int, n: int, base: int, k: int, edit=edit) -> int:
            """Names k turns before turn n, and returns the state after them."""
            for j in range(k):
                edit(i, 3 * n + j, "I", ROLE[base])
                base = AFTER[base]
            return base

        ends = pc.is_null(batch.column("kind")).to_pylist()
        for i, (n, note, last) in enumerate(zip(batch.column("n").to_pylist(), batch.column("note").to_pylist(), ends, strict=True)):
            if last:
                state, inserts = note & 3, note >> 2
                inserted(i, n, state, inserts)
                continue
            code = note >> (8 * state) & 255
            base, k, letter = code & 3, code >> 2 & 3, "DKR"[code >> 4 & 3]
            before = inserted(i, n, base, k)
            edit(i, 3 * n + 2, letter, ROLE[before] if letter == "R" else None)
            state = base
        take = pa.array(out["take"], pa.int64())
        rows = batch.take(take)
        new = pa.array([e == "I" for e in out["edit"]], pa.bool_())
        own = lambda name, rows=rows, new=new: pc.if_else(new, pa.scalar(None, rows.column(name).type), rows.column(name))
        role = pc.coalesce(pa.array(out["role"], pa.string()), rows.column("role").cast(pa.string()))
        text = pc.if_else(new, pa.scalar("", rows.column("text").type), rows.column("text"))
        kinds = own("kind")
        yield pa.RecordBatch.from_arrays(
            [rows.column("conv"), pa.array(out["place"], pa.int64()), pa.array(out["edit"], pa.string()), role, text, own("turn"), own("role"), kinds, own("fault")],
            names=["conv", "place", "edit", "role", "text", "turn", "old_role", "kind", "fault"],
        )


def faults(role: Column, text: Column, repeated: Column) -> Column:
    """blank, duplicate, truncated or null: the first that holds."""
    trimmed = F.rtrim(text, F.lit(SPACE))
    last = F.substring(trimmed, -1, 1)
    return F.when(trimmed == "", "blank").when(repeated, "duplicate").when(~last.isin(".", "!", "?"), "truncated")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The edits of each conversation: conv, place, edit, role, text, turn, old_role, fault, cost.

    One row for each turn (edit K kept, R with another role, D deleted) and
    each inserted turn (I, without turn and old_role), `place` ascending in the
    conversation's order, nulls of `turn` first, then by role and text.  What
    is left without D has role initials `(s?(ua)+)?` at the least cost, and of
    the cheapest edits the letters that are first in ASCII order.

    Null keys are one conversation; null roles and texts count as empty, so the
    text is blank.  Repeated rows are turns of their own, the later ones
    duplicates.  Other columns play no part, whatever their names; an empty
    table gives no rows.  Texts of any length only pass through.
    """
    bounded_batches(turns.sparkSession)
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((role, "role"), (text, "text"))]
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), *filled).repartition("conv")
    # A conversation's rows are together, so this window only sorts them; hashes go first as they are short.
    same = Window.partitionBy("conv", F.xxhash64("role", "text"), "role", "text").orderBy("turn")
    rows = rows.withColumn("repeated", F.row_number().over(same) > 1).withColumn("fault", faults(F.col("role"), F.col("text"), F.col("repeated")))
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    gone = F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).cast("int")
    kind = number * 4 + gone * 2 + F.coalesce(F.col("fault") == "truncated", F.lit(False)).cast("int")
    rows = rows.select("conv", "turn", "role", "text", "fault", kind.cast("int").alias("kind"))
    # kind is the last key: of equal rows the first one is no duplicate.
    rows = rows.sortWithinPartitions("conv", "turn", "role", "text", F.col("fault") == "duplicate")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    noted = rows.mapInArrow(_forward, ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", n bigint, note int")
    edits = noted.sortWithinPartitions("conv", F.desc("n")).mapInArrow(
        _backward, f"conv {kinds['conv']}, place bigint, edit string, role string, text string, turn {kinds['turn']}, old_role string, kind int, fault string"
    )
    cost = F.element_at(F.create_map(*[F.lit(x) for pair in COST.items() for x in pair]), F.col("edit"))
    late = F.when((F.col("fault") == "truncated") & (F.col("edit") != "D"), TRUNCATED).otherwise(0)
    edits = edits.withColumn("cost", (cost + late).cast("bigint")).drop("kind")
    return edits.sortWithinPartitions("conv", "place").withColumnRenamed("conv", conv)


class _Digest:
    """What one conversation's edits amount to, in their order."""

    def __init__(self) -> None:
        self.least = self.greatest = self.last = None
        self.distinct = self.illegal = self.cost = 0
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.initial: str | None = None
        self.audit: list[str] = []
        self.hash, self.any = hashlib.sha256(), False

    def add(self, edit: str, role: str, text: str, turn: int | None, old: str | None, fault: str | None, cost: int) -> None:
        self.audit.append(edit)
        self.cost += cost
        if edit != "I":
            if fault:
                self.count[fault] += 1
            if turn is not None:
                self.least = turn if self.least is None else self.least
                self.distinct += turn != self.last
                self.greatest = self.last = turn
            self.illegal += self.initial is not None and self.initial + old[:1] not in ("su", "ua", "au")
            self.initial = old[:1]
        if edit != "D":
            self.hash.update((b"\n" if self.any else b"") + f"{role}:".encode() + text.encode())
            self.any = True

    def values(self) -> tuple:
        gaps = 0 if self.least is None else min(self.greatest - self.least + 1 - self.distinct, 2**63 - 1)
        return gaps, *self.count.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def digests(edits: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of the rows that `repair` returned, as it returned them."""
    kind = edits.schema[conv].dataType.simpleString()
    schema = "conv {}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string".format(kind)
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, out_type = None, None, None
        for batch in batches:
            done = []
            out_type = batch.schema.field(0).type
            columns = [c.to_pylist() for c in batch.columns]
            for key, *row in zip(*columns, strict=True):
                if digest is None or key != current:
                    if digest is not None:
                        done.append((current, *digest.values()))
                    current, digest = key, _Digest()
                digest.add(*row)
            if done:
                yield _rows(done, out_type, names)
        if digest is not None:
            yield _rows([(current, *digest.values())], out_type, names)

    ordered = edits.sortWithinPartitions(conv, "place").select(F.col(conv).alias("conv"), "edit", "role", "text", F.col("turn").cast("bigint"), "old_role", "fault", "cost")
    return ordered.mapInArrow(run, schema).withColumnRenamed("conv", conv)


def _rows(rows: list[tuple], key: pa.DataType, names: list[str]) -> pa.RecordBatch:
    types = [key, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the contract's damage; nulls of any column are one space, but for the keys' own values."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), way.alias("way")).where("way != 0")
    role = F.when(F.col("way") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair of all damaged conversations; those without rows after the damage have zeros, no edits and the empty text's hash."""
    turns = table(spark, sf_dir, "conversations")
    found = digests(repair(damaged(turns)))
    original, key = free_name(found, "original"), F.col("conv_id")
    every = turns.select(key.alias(original)).distinct()
    rows = every.join(found, F.col(original).eqNullSafe(key), "left")
    zero = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    filled = rows.na.fill({**zero, "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})
    return filled.select(F.col(original).alias("conv_id"), *found.columns[1:])
